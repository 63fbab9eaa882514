"""Ticks to bars and bars to coarser bars: one partial-aggregating shuffle on (symbol, bucket)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ohlcv(ticks: DataFrame, bucket: Column, price: str = "price", seq: str = "seq") -> DataFrame:
    """Open/high/low/close/volume per (symbol, bucket); ``seq`` orders ticks inside a bucket."""
    return ticks.groupBy("symbol", bucket.alias("ts")).agg(
        F.min_by(price, seq).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, seq).alias("close"),
        F.sum("volume").alias("volume"),
    )


def week_end(ts: Column | str) -> Column:
    """Sunday that closes the week of ``ts``."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.date_add(F.date_trunc("week", ts).cast("date"), 6).cast("timestamp_ntz")


def four_hours(ts: Column | str) -> Column:
    """Start of the 4-hour bin, counted from midnight."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    day = F.date_trunc("day", ts)
    return (day + F.make_dt_interval(hours=(F.floor(F.hour(ts) / 4) * 4).cast("int"))).cast("timestamp_ntz")


def resample_bars(bars: DataFrame, bucket: Column) -> DataFrame:
    """Coarser bars from finer ones; buckets without rows do not appear."""
    return bars.groupBy("symbol", bucket.alias("bucket")).agg(
        F.min_by("open", "ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"),
    ).withColumnRenamed("bucket", "ts")


def latest(df: DataFrame, ts: str = "ts", key: str = "symbol") -> DataFrame:
    """Newest row of every symbol as an aggregate (combined map-side, no per-symbol window)."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), ts).alias("_r")).select(key, "_r.*")


def latest_quote(bars: DataFrame) -> DataFrame:
    """Newest close, the one before it, and the percentage change."""
    pair = bars.where(F.col("bar_no") >= F.col("n_bars") - 2).groupBy("symbol").agg(
        F.max_by("close", "bar_no").alias("price"),
        F.max("ts").alias("ts"),
        F.max_by("volume", "bar_no").alias("volume"),
        F.max("high").alias("_h"),
        F.min_by("close", "bar_no").alias("_prev"),
        F.count(F.lit(1)).alias("_n"),
    )
    prev = F.when(F.col("_n") > 1, F.col("_prev"))
    change = F.col("price") - prev
    return pair.select(
        "symbol", "ts", "price", "volume", prev.alias("prev_close"),
        F.coalesce(change, F.lit(0.0)).alias("change"),
        F.when(prev > 0, change / prev * 100).otherwise(0.0).alias("change_pct"),
    )
