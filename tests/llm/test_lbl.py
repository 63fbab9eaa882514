from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from tickloom.llm import lbl
from tickloom.llm.queries import QUERIES


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def fold(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def plain(rows: list[tuple]) -> list[tuple]:
    """The base columns of each row (doc_id, text)."""
    c: Counter = Counter()
    for d, t in rows:
        if not fold(d):
            c.update([*words(t), "\n"])
    n, v = sum(c.values()), len(c)
    out = []
    for d, t in rows:
        w = [*words(t), "\n"]
        out.append((str(d), fold(d), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)))
    return sorted(out)


def base(rows) -> list[tuple]:
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)


def test_query_against_plain_counts_and_gain(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op3_lm_scores"](spark, SF).collect()
    want = {w[0]: w for w in plain(rows)}
    for r in got:
        w = want[str(r.doc_id)]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[1:5] and r.base_score == pytest.approx(w[5], rel=1e-9, abs=1e-5)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.score < 0 for r in got)


@pytest.mark.parametrize("hot", [0, 60, 100000])
def test_cases(spark, hot):
    rows = [(i, "the cat sat on the mat. The end " * (i % 3)) for i in range(40)] + [(100, None), (101, ""), (None, "null id"), (7, "x" * 70000), (7, "x" * 70000), (102, "\x00 \x00 é É")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    got = lbl.score(df, lbl.held_out(F.col("doc_id")), hot=hot).collect()
    assert base(got) == plain(rows) and all(np.isfinite(r.score) for r in got)
    assert lbl.score(df.limit(0), lbl.held_out(F.col("doc_id"))).count() == 0
    assert all(np.isfinite(r.score) for r in lbl.score(df, F.lit(True)).collect())


def test_the_model_is_normalised_and_learns():
    rng = np.random.default_rng(1)
    seen = np.zeros((lbl.CLASSES,) * 3)
    for a in range(lbl.CLASSES):
        for b in range(0, lbl.CLASSES, 7):
            seen[a, b, (a + 1) % lbl.CLASSES] += 50
            seen[a, b, rng.integers(0, lbl.CLASSES, 5)] += 1
    table = lbl.LogBilinear().fit(seen).table()
    assert np.allclose((10.0 ** table.astype(float)).sum(axis=2), 1, atol=1e-4)
    uni = np.log10(seen.sum(axis=(0, 1)) / seen.sum())
    assert (seen * table).sum() > (seen * uni).sum() * 0.8


def test_training_sees_every_trigram_by_its_count():
    rng = np.random.default_rng(2)
    seen = np.zeros((lbl.CLASSES,) * 3, np.int64)
    seen[rng.integers(0, 90, 3000), rng.integers(0, 90, 3000), rng.integers(0, 90, 3000)] = 10**6
    swapped = seen.copy()
    seen[94, 95, 92] = seen[93, 91, 90] = swapped[94, 95, 90] = swapped[93, 91, 92] = 40  # too few for a draw of fixed size
    one, other = (lbl.LogBilinear().fit(x, steps=100) for x in (seen, swapped))
    gain = lambda m: (m.source[94] @ m.place[0] + m.source[95] @ m.place[1]) @ (m.target[92] - m.target[90])
    assert gain(one) > gain(other)


def test_slices_are_cut_into_words_and_trigrams(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lbl, "SLICE", 12)
    texts = [None, "", " ", "a", "  A b\tc\n\x0bD\x0c\re ", "\x1c\x1f x\x85 y\xa0z", "\x00 é É K a a", "\n\n", "x" * 70, "a b a"]
    one = {w: i % lbl.CLASSES for i, w in enumerate(sorted({w for t in texts for w in words(t)}))}
    got = []
    for part in lbl.slices(pa.array(texts, pa.string())):
        found, at, sizes = lbl.words_of(part)
        found = [x.decode() for x in found.to_pylist()]
        assert len(set(found)) == len(found) and len(sizes) == len(part)
        each = [found[i] for i in at]
        trigrams = lbl.trigrams_of(np.array([one[w] for w in each], np.int64), sizes)
        for n in sizes:
            got.append((each[:n], [(t // lbl.CLASSES**2, t // lbl.CLASSES % lbl.CLASSES, t % lbl.CLASSES) for t in trigrams[:n + 1].tolist()]))
            each, trigrams = each[n:], trigrams[n + 1:]
        assert not each and not len(trigrams)
    path = lambda w: [0, 0, *[one[x] for x in w], 0]
    assert got == [(words(t), list(zip(path(words(t)), path(words(t))[1:], path(words(t))[2:]))) for t in texts]


@pytest.mark.parametrize("most", [1, 40, 1000])
def test_counts_of_words_are_added_up_in_between(spark, most):
    rows = [(f"a b{i % 7} c{i} A",) for i in range(200)]
    run = lbl.word_counts(spark.createDataFrame(rows, "text string").repartition(2), "text", most)
    want = Counter(w for (t,) in rows for w in words(t))
    assert {bytes(r.word).decode(): r.c for r in run.collect()} == want
