from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tickloom.llm import mixing, quality
from tickloom.llm.common import most_frequent


@pytest.mark.parametrize("size", [100, 900, 1000, 5000])
def test_most_frequent_of_equal_counts(spark, size):
    flat = spark.range(1000).select(F.concat(F.lit("w"), F.col("id")).alias("word"), F.lit(7).cast("long").alias("c"))
    got = most_frequent(flat, "c", size)
    assert 0.8 * min(size, 1000) <= got.count() <= size and sorted(got.collect()) == sorted(got.collect())
    steep = flat.unionByName(spark.range(50).select(F.concat(F.lit("top"), F.col("id")).alias("word"), (F.col("id") + 100).alias("c")))
    words = {r.word for r in most_frequent(steep, "c", size).collect()}
    assert {f"top{k}" for k in range(50)} <= words and len(words) <= size
    assert most_frequent(flat.limit(0), "c", size).count() == 0


def test_columns_with_clashing_names(spark):
    """Names that the operators use inside, or join by, stay what they were."""
    text = "some words of a line that is here # and there\n" * 8
    names = ["_t", "_w", "_l", "_h", "_p", "_s", "_once", "_0", "last_copy", "_mix_size", "_mix_source", "_mix_doc", "doc", "a.b"]
    rows = [(k, text, "s" if k % 2 else None, *[f"{n}{k}" for n in names]) for k in range(6)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    for got in (quality.measure(docs), quality.ledger(docs), mixing.mix(docs)):
        assert set(docs.columns) <= set(got.columns)
        assert sorted(tuple(r[n] for n in ["doc_id", *names]) for r in got.collect()) == [(k, *[f"{n}{k}" for n in names]) for k in range(6)]
