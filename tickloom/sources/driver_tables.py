"""Bar, tick and positioning tables derived from the given star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.series import index_bars
from tickloom.operators.resample import ohlcv
from tickloom.session import materialize

_MEMO: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One priced trade per line item: the brand is the instrument, the ship date its session."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("p_brand").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"),
        F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity").alias("seq"),
    )


def market_of(symbol) -> F.Column:
    n = F.regexp_replace(symbol, "Brand#", "").cast("int") % 3
    return F.when(n == 0, "VN").when(n == 1, "TW").otherwise("US")


def _daily_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of all instruments with the first and last trade of each, which bars of a group of instruments are made of too."""
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    return trades(spark, sf_dir).groupBy("symbol", day.alias("ts")).agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"),
        F.sum("volume").alias("volume"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def _build_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = derived(spark, sf_dir, "daily_parts").drop("first_seq", "last_seq")
    return index_bars(bars.withColumn("market", market_of(F.col("symbol"))), chunk="quarter", unique=True)


def _build_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One instrument of all trades, from the daily bars of each."""
    bars = derived(spark, sf_dir, "daily_parts").groupBy(F.lit("ALL").alias("symbol"), "ts").agg(
        F.min_by("open", "first_seq").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "last_seq").alias("close"), F.sum("volume").alias("volume"))
    return index_bars(bars, chunk="quarter", unique=True)


def _build_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"),
        F.lit(1.0).alias("volume"), F.struct("ts", "event_id").alias("seq"),
    )
    return index_bars(ohlcv(ticks, F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")), chunk="day", unique=True)


def _build_positioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = F.date_trunc("week", F.col("o_orderdate")).cast("timestamp_ntz")
    weekly = (
        table(spark, sf_dir, "orders").groupBy(week.alias("ts"))
        .agg(
            F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("open_interest"),
            F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("decimal(18,2)")))
            .cast("double").alias("commercial_short"),
            F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice").cast("decimal(18,2)")))
            .cast("double").alias("commercial_long"),
        )
        .withColumn("symbol", F.lit("ALL"))
    )
    return index_bars(weekly, chunk="year", unique=True)


_BUILD = {
    "daily_parts": _daily_parts,
    "bars_daily": _build_daily,
    "benchmark_daily": _build_benchmark,
    "bars_hourly": _build_hourly,
    "positioning": _build_positioning,
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, written once per application to the shared folder."""
    memo_key = (spark.sparkContext.applicationId, sf_dir, name)
    if memo_key not in _MEMO:
        _MEMO[memo_key] = materialize(_BUILD[name](spark, sf_dir), name)
    return _MEMO[memo_key]


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "bars_daily")


def benchmark_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "benchmark_daily")


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "bars_hourly")


def positioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "positioning")


def derived_table(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Any further table computed from the given ones, written once per application."""
    memo_key = (spark.sparkContext.applicationId, sf_dir, name)
    if memo_key not in _MEMO:
        _MEMO[memo_key] = materialize(build(), name)
    return _MEMO[memo_key]
