from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import SF
from tickloom.llm import periodic
from tickloom.llm.queries import ORACLES, QUERIES
from tools.compare import connect, diff


def plain(w: list, least: int = 24, times: int = 3) -> list[tuple]:
    """Every period's stretches of equal words that far apart; a stretch with a smaller period too counts for that one."""
    out: dict[tuple, int] = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                out[i, j + q] = min(q, out.get((i, j + q), q))
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def made_up(rng: random.Random) -> list[int]:
    w = [rng.randrange(rng.choice([1, 2, 3, 60])) for _ in range(rng.randint(0, 130))]
    for _ in range(rng.randint(0, 3)):
        passage = [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.randint(1, 25))]
        at, size = rng.randint(0, len(w)), rng.randint(0, 120)
        w[at : at + size // 2] = (passage * size)[:size]
    return w


@pytest.mark.parametrize("least,times", [(24, 3), (30, 4)])
def test_runs_against_plain_loops(least, times):
    rng, seen = random.Random(times), 0
    for _ in range(1500):
        texts = [made_up(rng) for _ in range(3)]
        expected = [plain(w, least, times) for w in texts]
        seen += sum(map(len, expected))
        assert [periodic.runs(w, least, times) for w in texts] == expected
        assert periodic._texts([[b"%d" % x for x in w] for w in texts], least, times, periodic.GRAM) == expected
    assert seen > 300


def test_every_path_has_the_last_end_of_its_suffixes():
    rng = random.Random(5)
    for _ in range(60):
        w, ends = [], periodic.LastEnds()
        for i in range(60):
            w.append(rng.randrange(2))
            segments = ends.append(w[-1])
            # longest suffix for each last end, by search
            expected, below = [], i + 1
            for size in range(i, 0, -1):
                end = next((e for e in range(i - 1, size - 2, -1) if w[e - size + 1 : e + 1] == w[i - size + 1 :]), None)
                if end is not None and (not expected or expected[-1][0] != end):
                    expected.append((end, size))
            # neighbouring segments may have one last end
            assert [s for k, s in enumerate(segments) if s[1] and (not k or segments[k - 1][0] != s[0])] == expected


def rows(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")


def test_runs_and_collapse_of_texts(spark):
    texts = [None, "", " \t\n", "one two", "a " * 23, "a " * 24, "x " + "a b c " * 8 + "y", "é ü " * 12 + "  é", "w " * 50_000]
    got = {r.doc_id: r for r in periodic.detect(rows(spark, texts)).collect()}
    assert [[tuple(x) for x in got[k].runs] for k in range(9)] == [[], [], [], [], [], [(0, 24, 1)], [(1, 24, 3)], [(0, 24, 2)], [(0, 50_000, 1)]]
    assert [got[k].collapsed for k in (0, 2, 3, 5, 6, 8)] == ["", "", "one two", "a", "x a b c y", "w"]
    assert got[4].best is None and tuple(got[6].best) == (1, 24, 3)


def test_ties_nested_runs_and_repeated_rows(spark):
    inner = ("a " * 24 + "b ") * 3
    text = inner + "c " + "d " * 24
    for r in periodic.detect(rows(spark, [text, text])).collect():
        w = text.split()
        assert [tuple(x) for x in r.runs] == plain(w) and len(r.runs) == 5
        assert tuple(r.best) == (0, 24, 1)  # of four with 24 periods, the first


def test_other_columns_null_ids_and_empty_tables(spark):
    d = spark.createDataFrame([(None, "a " * 30, 1, "r"), (None, None, 2, "s")], "doc_id long, text string, n_words int, start string")
    got = periodic.detect(d, change=periodic.repeated_tail)
    assert set(got.columns) == {"doc_id", "text", "start", "n_words", "runs", "best", "collapsed"}
    assert sorted((r.n_words, len(r.runs), r.start) for r in got.collect()) == [(0, 0, "s"), (30, 1, "r")]
    assert periodic.detect(d.limit(0)).count() == 0
    with pytest.raises(ValueError, match="24 words"):
        periodic.detect(d, least=10)


def test_rewritten_tails_follow_the_checksum():
    words = [b"w%d" % k for k in range(50)]
    seen = 0
    for doc in range(200):
        h = zlib.crc32(str(doc).encode())
        got = periodic.repeated_tail(doc, words)
        if h % 10:
            assert got == words
            continue
        seen += 1
        g = h // 10
        a = g % 50
        p = 1 + (50 - a) // (3 + g % 8)
        assert got == [words[i if i < a else a + (i - a) % p] for i in range(50)]
    assert seen > 5


def test_query_against_sql_and_plain(spark):
    got = QUERIES["op13_periodic_runs"](spark, SF)
    con = connect(SF)
    assert diff(got, con.sql(ORACLES["op13_periodic_runs"])) is None
    con.close()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in got.where(F.col("n_runs") > 0).collect():
        w = periodic.repeated_tail(r.doc_id, (texts[r.doc_id] or "").encode().split())
        found = plain(w)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        assert r.n_runs == len(found)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()
