from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pytest

from conftest import SF
from tickloom.llm import ngram_join
from tickloom.llm.queries import QUERIES


def shingles(text: str | None, n: int) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset([tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [tuple(w)] if w else [])


def plain(rows: list[tuple], n: int, percent: int) -> list[tuple]:
    """All pairs of sets, joined to groups."""
    sets = [shingles(t, n) for _, t in rows]
    kinds = list(dict.fromkeys(s for s in sets if s))
    root = {s: s for s in kinds}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if 100 * len(a & b) >= percent * len(a | b):
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for (d, _), s in zip(rows, sets):
        if s and d is not None:
            ids[find(s)].append(d)
    return sorted(((str(d), len(s), str(min(ids[find(s)], default=d) if s else d)) for (d, _), s in zip(rows, sets)))


def got(df) -> list[tuple]:
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def edited(rng, groups: int, each: int, words: int) -> list[str]:
    out = []
    for _ in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 4000, words)]
        for _ in range(each):
            w = list(base)
            for at in rng.integers(0, words, rng.integers(0, 5)):
                w[at] = f"x{rng.integers(0, 9)}"
            out.append(" ".join(w[rng.integers(0, 3) :]))
    return out


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_groups_against_all_pairs(spark, monkeypatch, n, percent):
    rng = np.random.default_rng(n)
    passage = " ".join(f"p{x}" for x in range(60))
    texts = edited(rng, 6, 25, 80) + edited(rng, 30, 3, 12) + [f"{passage} " + " ".join(f"q{x}" for x in rng.integers(0, 10**6, 30)) for _ in range(40)]
    texts += [None, "", " \n", "One", "one", "one two", "One Two", "one two three four", "a " * 5000, "A\ta " * 2500, passage, passage.upper()]
    rows = [(int(k), t) for k, t in zip(rng.permutation(len(texts)) + 10, texts)] + [(10, "one"), (None, "one two"), (None, None), (11, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain(rows, n, percent)
    assert got(ngram_join.link(df, n, percent)) == want
    monkeypatch.setattr(ngram_join, "BUCKET_ROWS", 3)  # every bucket is spread
    assert got(ngram_join.link(df, n, percent)) == want


def test_one_of_each(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long, "a"), (3, long + " end", "b"), (9, "other words are here now", "c"), (9, "other words are here now", "c"), (9, "quite different words are here", "d"), (7, None, None), (8, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _n string")
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(3, long + " end"), (7, ""), (8, ""), (9, "other words are here now"), (9, "quite different words are here")]
    assert ngram_join.one_of_each(df.limit(0)).count() == 0 == ngram_join.link(df.limit(0)).count()


def test_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op10_ngram_join"](spark, SF)) == plain(rows, 4, 85)
