from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SF
from tickloom.llm import mixing
from tickloom.llm.queries import ORACLES, QUERIES
from tools.compare import connect, diff


def test_query_against_sql(spark):
    assert diff(QUERIES["op2_source_mix"](spark, SF), connect(SF).sql(ORACLES["op2_source_mix"])) is None


def test_reruns_agree_and_sources_come_near_their_targets(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7)).alias("source"),
                                    F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"))
    a = mixing.mix(docs)
    b = mixing.mix(docs.repartition(7))
    assert a.exceptAll(b).isEmpty()
    for r in a.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect():
        assert abs(r.taken - r.target) <= 100 and r.over <= 0


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1000, 1, 1], [1, 1, 1000, 5, 0], [7]])
def test_targets_fill_up_by_weight(spark, sizes):
    got = mixing.targets(spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")).orderBy("source").collect()
    left, want, open_ = 1.5 * sum(sizes), {}, dict(enumerate(sizes))
    while True:
        level = left / sum([5, 2, 1][i % 3] for i in open_) if open_ else 0
        full = [i for i in open_ if level * [5, 2, 1][i % 3] > 2 * sizes[i]]
        if not full:
            break
        for i in full:
            want[i] = 2.0 * open_.pop(i)
            left -= want[i]
    want |= {i: level * [5, 2, 1][i % 3] for i in open_}
    assert [r.target for r in got] == pytest.approx([want[i] for i in range(len(sizes))])


def test_cases(spark):
    rows = [(1, None, "a", 5), (2, "", None, 5), (None, "x y z", None, 5), (3, "x " * 40000, "a", 5), (3, "x " * 40000, "a", 5), (4, "p", "b", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int")
    got = mixing.mix(df).collect()
    assert len(got) == 6 and sum(r.taken for r in got) <= 1.5 * sum(r["size"] for r in got)
    assert all(r.taken == 0 for r in got if not r.text) and {r.source_size for r in got if r.source is None} == {3}
    assert mixing.mix(df.limit(0)).count() == 0
