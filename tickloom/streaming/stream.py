"""Structured Streaming forms of the bar, alert and risk operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from tickloom.operators.news import GeoSettings, causal_map, execution_gate, geo_risk


def with_event_time(df: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Watermarks need TIMESTAMP; landed files hold TIMESTAMP_NTZ in UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def tick_bars(ticks: DataFrame, interval: str = "1 hour", delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Bars per (symbol, window) of a tick stream (symbol, ts, price, volume, tick_id). In append mode a bar
    is emitted once, when the watermark has passed its end: exactly the closed bars."""
    d = with_event_time(ticks, "ts", delay)
    win = F.window("ts", interval, slide) if slide else F.window("ts", interval)
    seq = F.struct("ts", "tick_id")
    return d.groupBy(win, "symbol").agg(
        F.min_by("price", seq).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", seq).alias("close"),
        F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_ticks"),
    ).select("symbol", F.col("window.start").alias("ts"), F.col("window.end").alias("end_ts"), "open", "high", "low", "close", "volume", "n_ticks")


def sessions(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    d = with_event_time(events, "ts", delay)
    return d.groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("value")).select(
        key, F.col("session_window.start").alias("start_ts"), F.col("session_window.end").alias("end_ts"), "n_events", "value")


def dedup_alerts(alerts: DataFrame, key: str = "alert_key", delay: str = "1 day") -> DataFrame:
    """First alert of each key; state is dropped once the watermark has passed it."""
    return with_event_time(alerts, "ts", delay).dropDuplicatesWithinWatermark([key])


def latest_quotes(ticks: DataFrame) -> DataFrame:
    """Newest price per symbol (update mode)."""
    return ticks.groupBy("symbol").agg(F.max_by("price", F.struct("ts", "tick_id")).alias("price"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n_ticks"))


STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
_STATE = "peak double, ema double, n long"
_TRACK = "symbol string, ts timestamp, close double, ema double, trail_stop double"


def track_symbols(bars: DataFrame, span: int = 12, trail_pct: float = 0.05) -> DataFrame:
    """Running EMA and ratcheting stop of every symbol across micro-batches, for feeds whose batches come in time order: state per
    symbol is three numbers, and every row is answered at once. ``tracking.track_structure`` waits for late rows and lets symbols expire."""
    alpha = 2 / (span + 1)

    def fold(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        peak, ema, n = state.get if state.exists else (float("-inf"), 0.0, 0)
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        out = []
        for ts, close in zip(rows["ts"], rows["close"]):
            peak = max(peak, close)
            ema = close if n == 0 else ema + alpha * (close - ema)
            n += 1
            out.append((key[0], ts, close, ema, peak * (1 - trail_pct)))
        state.update((peak, ema, n))
        yield pd.DataFrame(out, columns=["symbol", "ts", "close", "ema", "trail_stop"])

    return bars.groupBy("symbol").applyInPandasWithState(fold, _TRACK, _STATE, "append", "NoTimeout")


def risk_slice(events: DataFrame, now: Column, cfg: GeoSettings = GeoSettings()) -> DataFrame:
    """Risk and gate over the look-back before ``now`` (used on a batch slice inside foreachBatch)."""
    recent = events.where(F.col("event_ts").cast("timestamp") >= now.cast("timestamp") - F.make_dt_interval(hours=F.lit(cfg.lookback_hours)))
    return execution_gate(causal_map(geo_risk(recent, now, cfg), cfg), now, cfg)


def risk_over_history(path: str, normalize: Callable[[DataFrame], DataFrame], cfg: GeoSettings = GeoSettings()) -> Callable[[DataFrame, int], DataFrame]:
    """A foreachBatch step that lands each batch by day and scores the look-back over all landed batches, so the
    risk does not depend on how the stream was cut into batches. Only days that the look-back reaches are read, and
    the newest time so far is carried from batch to batch."""

    def step(batch: DataFrame, batch_id: int) -> DataFrame:
        spark = batch.sparkSession
        batch.withColumn("_day", F.to_date("ts")).write.mode("overwrite").partitionBy("_day").parquet(f"{path}/history/_batch={batch_id}")
        ends = batch.agg(F.max("ts").alias("end"))
        if batch_id > 0:
            ends = ends.union(spark.read.schema(ends.schema).parquet(f"{path}/end/batch={batch_id - 1}"))
        ends.agg(F.max("end").alias("end")).write.mode("overwrite").parquet(f"{path}/end/batch={batch_id}")
        end = F.lit(str(spark.read.schema(ends.schema).parquet(f"{path}/end/batch={batch_id}").first()[0])).try_cast("timestamp_ntz")
        schema = T.StructType([*batch.schema.fields, T.StructField("_batch", T.IntegerType()), T.StructField("_day", T.DateType())])
        landed = spark.read.schema(schema).parquet(f"{path}/history").where(F.col("_batch") <= batch_id)
        landed = landed.where(F.col("_day") >= F.date_sub(end.cast("date"), cfg.lookback_hours // 24 + 1)).drop("_batch", "_day")
        return risk_slice(normalize(landed), end, cfg).drop("latest_event_ts")

    return step


def alert_stream(bars: DataFrame, zones: DataFrame, delay: str = "1 day") -> DataFrame:
    """Closed bars of a stream that touch a standing zone, one for each alert key, as soon as the first one comes. Keys name a day, so those
    that were sent are kept in the state store for ``delay`` of event time (a day at least, or a key could come again) and dropped then: what a
    batch reads does not grow with what was sent before it."""
    return zone_alerts(with_event_time(bars, "ts", delay), zones).dropDuplicatesWithinWatermark(["alert_key"])


def zone_alerts(bars: DataFrame, zones: DataFrame) -> DataFrame:
    """Stream-static join: closed bars that touch a standing zone of their symbol, with the alert key."""
    touch = (F.col("low") <= F.col("top")) & (F.col("high") >= F.col("bottom"))
    d = bars.join(zones.select("symbol", "top", "bottom"), "symbol").where(touch)
    key = F.concat_ws("|", "symbol", F.date_format("ts", "yyyy-MM-dd"), F.format_string("%.2f-%.2f", "bottom", "top"))
    return d.withColumn("alert_key", key)


def unsent(alerts: DataFrame, sent: DataFrame) -> DataFrame:
    return alerts.join(sent.select("alert_key"), "alert_key", "left_anti")


def batch_notice(batch: DataFrame, batch_id: int) -> DataFrame:
    """One row per micro-batch: how many rows it had and whether it was empty."""
    return batch.agg(F.count(F.lit(1)).alias("n_rows")).withColumns({"batch_id": F.lit(batch_id), "notice": F.when(F.col("n_rows") == 0, "NO_NEW_DATA").otherwise("OK")})


def run_available(stream: DataFrame, path: str, mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None,
                  keys: tuple[str, ...] = (), state_store: str | None = None) -> DataFrame:
    """Drive a stream over all landed data and read the result back. Every micro-batch overwrites its own
    folder, so a batch that is run again after a failure replaces its output. In complete mode the last batch is the
    result; in update mode the last row of each of ``keys`` is. ``state_store`` names the provider that this query keeps its state in."""
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys of its rows")
    spark: SparkSession = stream.sparkSession
    schema = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        out = each(batch, batch_id) if each else batch
        schema["out"] = out.schema
        out.write.mode("overwrite").parquet(f"{path}/out/batch_no={batch_id}")

    before = spark.conf.get(STORE_CONF)
    if state_store:
        spark.conf.set(STORE_CONF, state_store)
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    spark.conf.set(STORE_CONF, before)  # the running query has its own copy
    query.awaitTermination()
    if "out" not in schema:
        return spark.createDataFrame([], stream.schema)
    columns = schema["out"].names
    landed = spark.read.schema(T.StructType([*schema["out"].fields, T.StructField("batch_no", T.IntegerType())])).parquet(f"{path}/out")
    if mode == "complete":
        last = spark.read.parquet(f"{path}/out").agg(F.max("batch_no")).scalar()
        landed = landed.where(F.col("batch_no") == F.coalesce(last, F.lit(-1)))
    elif mode == "update":
        rest = [c for c in columns if c not in keys]
        landed = landed.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_no").alias("_r")).select(*keys, "_r.*")
    return landed.select(*columns)
