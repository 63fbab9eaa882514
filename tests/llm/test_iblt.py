from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from conftest import SF
from tickloom.llm import iblt
from tickloom.llm.queries import QUERIES


def pieces(text: str | None) -> set:
    out = set()
    for line in (text or "").split("\n"):
        at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", line)]
        out |= {line[at[i][0] : at[min(i + iblt.PIECE, len(at)) - 1][1]] for i in range(0, len(at), iblt.PIECE)}
    return out


def alike(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_against_plain_sets(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in QUERIES["op6_fingerprints"](spark, SF).collect()}
    assert len(got) == len(docs)
    prints: dict = {}
    for k, d in enumerate(docs):
        text, nxt = d.text or "", docs[(k + 1) % len(docs)].text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        r = got[d.doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - alike(pieces(text), pieces(edited))) < 1e-12 and abs(r.near_next - alike(pieces(text), pieces(nxt))) < 1e-12
        for p, t in ((r.fingerprint, text), (r.edited_fingerprint, edited)):
            assert prints.setdefault(p, pieces(t)) == pieces(t)


def test_differences_are_exact_at_any_size(spark):
    rng, rows = np.random.default_rng(1), []
    for n, k in ((0, 0), (0, 3), (1, 1), (5, 0), (40, 2), (300, 30), (300, 300), (2500, 40), (1500, 900)):
        common, left, right = (rng.integers(-(1 << 62), 1 << 62, m).tolist() for m in (n, k, k // 2))
        rows.append((sorted(common + left), sorted(common + right), sorted(left), sorted(right)))
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, l array<bigint>, r array<bigint>").repartition(8)
    for r in iblt.with_difference(df, "a", "b", "d").collect():
        assert sorted(r.d.only_a) == list(r.l) and sorted(r.d.only_b) == list(r.r)


def test_next_rows_and_cases(spark):
    rows = [(i * 7, f"t{i}") for i in range(57)] + [(5, None), (None, "none"), (7, "t1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""), reverse=True)
    pairs = sorted((str(a), str(want[(k + 1) % len(want)][1])) for k, a in enumerate(want))
    for n in (3, 1000):
        assert sorted((str((r.doc_id, r.text)), str(r.next)) for r in iblt.with_next(df, "text", "next", rows=n).collect()) == pairs
    assert iblt.with_next(df.limit(0), "text", "next").count() == 0
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "\n \n"), (4, "a b\na b"), (5, "a b"), (6, "w " * 60000)], "id int, text string")
    got = {r.id: r.d for r in texts.select("id", iblt.digests(F.col("text")).alias("d")).collect()}
    assert got[1] == got[2] == got[3] == [] and got[4] == got[5] and len(got[6]) == 1
