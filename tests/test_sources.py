"""Bars merged in place."""

from __future__ import annotations

import glob
import os
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.session import shared_dir
from tickloom.sources.barstore import BarStore


def bars(spark, rows):
    pdf = pd.DataFrame([(s, pd.Timestamp(t), c, c, c, float(c), 1.0, m) for s, t, c, m in rows], columns=["symbol", "ts", "open", "high", "low", "close", "volume", "market"])
    return spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def state(store, **kw):
    return sorted((r.symbol, str(r.ts)[:10], r.close, r.market) for r in store.read(**kw).collect())


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def test_merges_rewrite_touched_parts_only(spark, monkeypatch):
    monkeypatch.setattr("tickloom.sources.barstore.FILE_ROWS", 2)
    path = f"{shared_dir(spark)}/tests/{uuid.uuid4().hex}"
    store = BarStore(spark, path)
    assert state(store) == [] and store.manifest() == []
    first = [("A", "2020-05-01", 1.0, "VN"), ("A", "2021-05-01", 2.0, "VN"), ("B", "2021-05-01", 3.0, "US"), ("C", "2021-06-01", 4.0, "VN"), ("C", "2021-06-02", 4.5, "VN")]
    store.merge(bars(spark, first), 0)
    assert state(store) == sorted(first)
    before = files(path)
    store.merge(bars(spark, [("A", "2021-05-01", 20.0, "VN"), ("A", "2021-05-02", 21.0, "VN")]), 1)
    second = sorted([("A", "2020-05-01", 1.0, "VN"), ("A", "2021-05-01", 20.0, "VN"), ("A", "2021-05-02", 21.0, "VN"), *first[2:]])
    assert state(store) == second
    assert {f: t for f, t in files(path).items() if f in before} == before
    assert {(p.market, p.bucket): p.batch for p in store.manifest()} == {("VN", "2020"): 0, ("VN", "2021"): 1, ("US", "2021"): 0}
    assert len([f for f in files(path) if "batch=1/market=VN/bucket=2021" in f]) >= 2
    # the same batch again changes nothing, an earlier one is refused, an empty one keeps all
    store.merge(bars(spark, [("A", "2021-05-01", 20.0, "VN"), ("A", "2021-05-02", 21.0, "VN")]), 1)
    assert state(store) == second
    store.merge(bars(spark, first).limit(0), 2)
    assert state(store) == second
    with pytest.raises(ValueError, match="merged already"):
        store.merge(bars(spark, first), 1)
    # as of an earlier batch, and a range that opens one part
    assert state(store, batch=0) == sorted(first)
    assert state(store, start="2021-05-02", end="2021-06-01", markets=["VN"]) == [("A", "2021-05-02", 21.0, "VN"), ("C", "2021-06-01", 4.0, "VN")]
    assert not any("bucket=2020" in f for f in store.read(start="2021-01-01").inputFiles())


def test_a_failed_merge_leaves_the_store_as_it_was(spark):
    path = f"{shared_dir(spark)}/tests/{uuid.uuid4().hex}"
    store = BarStore(spark, path)
    store.merge(bars(spark, [("A", "2020-05-01", 1.0, "VN")]), 0)
    failing = bars(spark, [("A", "2020-05-01", 9.0, "VN")]).withColumn("close", F.when(F.col("close") > 5, F.raise_error(F.lit("lost"))).otherwise(F.col("close")))
    with pytest.raises(Exception, match="lost"):
        store.merge(failing, 1)
    assert state(store) == [("A", "2020-05-01", 1.0, "VN")]
    store.merge(bars(spark, [("A", "2020-05-01", 9.0, "VN")]).withColumn("ingest_seq", F.lit(1)).unionByName(bars(spark, [("A", "2020-05-01", 7.0, "VN")]).withColumn("ingest_seq", F.lit(0))), 1)
    assert state(store) == [("A", "2020-05-01", 9.0, "VN")]
    store.merge(bars(spark, [("A", "2021-05-01", 2.0, "VN")]), 2)
    store.drop_before(2)
    assert store.batches() == [2] and state(store) == [("A", "2020-05-01", 9.0, "VN"), ("A", "2021-05-01", 2.0, "VN")]
    assert not glob.glob(f"{path}/data/batch=0")
