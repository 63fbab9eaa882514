from __future__ import annotations

import re
from collections import Counter

from conftest import SF
from tickloom.llm import quality
from tickloom.llm.queries import ORACLES, QUERIES
from tools.compare import connect, diff


def plain(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered)


def test_query_against_sql(spark):
    assert diff(QUERIES["op7_quality_ledger"](spark, SF), connect(SF).sql(ORACLES["op7_quality_ledger"])) is None


def test_measurements_and_cases(spark):
    texts = [None, "", " \n\n ", "a", "a b", "a b c", "a a a a a", "x y z x y z\nx y z\nx y z", "é ß # | |", "one two three four " * 30, "q\n" * 9, "a\x0bb\x0cc\rd\ne",
             " ".join(f"w{i}" for i in range(20000)), "r s t u v " * 5000, "a b c d a b c", "a b c d a b c"]
    df = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id int, text string, n_words int")
    for r in quality.measure(df).collect():
        assert tuple(r[c] for c in quality.MEASURES) == plain(r.text), r.text and r.text[:50]
    assert quality.ledger(df.limit(0)).count() == 0


def test_policies_and_ablations_read_bits(spark):
    df = spark.createDataFrame([(1, "s", 0), (2, "s", 1), (3, "s", 3), (4, "t", 4), (5, None, 64)], "doc_id int, source string, failures long")
    kept = {r.doc_id: r.kept for r in quality.apply_policy(df, "v1").collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: True}
    got = {r.rule: (r.failed, r.alone, r.shared, r.documents) for r in quality.ablations(df, "v1").collect()}
    assert got["few_words"] == (2, 1, 1, 5) and got["repeated_windows"] == (1, 0, 1, 5) and got["symbols"] == (1, 1, 0, 5)
    by = {(r.source, r.rule): r for r in quality.ablations(df, "v1", "source").collect()}
    assert by["s", "few_words"].any_bits == 3 and by["s", "few_words"].all_bits == 0 and by["t", "symbols"].all_bits == 4


def test_labelled_junk_goes_and_clean_documents_stay(spark):
    kept = QUERIES["op7_quality_ledger"](spark, SF).select("doc_id", "n_words", "kept")
    labels = spark.read.parquet(f"{SF}/labels.parquet").join(kept, "doc_id").where("n_words >= 50").collect()
    good = [r.kept for r in labels if r.quality == 1]
    junk = [r.kept for r in labels if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(junk) <= 0.05 * len(junk)
