"""Streams cut into several micro-batches give the batch result."""

from __future__ import annotations

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from tickloom.operators.news import normalize_events
from tickloom.session import shared_dir
from tickloom.streaming import stream as st
from tickloom.streaming import tracking


@pytest.fixture(scope="module")
def landed(spark):
    """The events in five files, landed one after the other in time order and read one file per batch."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    path = f"{shared_dir(spark)}/tests/{uuid.uuid4().hex}"
    cuts = [e for e in events.approxQuantile("event_id", [0.2, 0.4, 0.6, 0.8], 0.0)]
    for lo, hi in zip([-1.0, *cuts], [*cuts, float("inf")]):
        events.where((F.col("event_id") > lo) & (F.col("event_id") <= hi)).coalesce(1).write.mode("append").parquet(path)
    return events, path


def ticks(df):
    return df.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("volume"), F.col("event_id").alias("tick_id"))


def source(spark, events, path):
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def out(spark):
    return f"{shared_dir(spark)}/tests/{uuid.uuid4().hex}"


def test_bars_equal_batch(spark, landed):
    events, path = landed
    got = st.run_available(st.tick_bars(ticks(source(spark, events, path)), delay="5 days"), out(spark)).toPandas()
    batch = st.tick_bars(ticks(events)).toPandas()
    end = events.agg(F.max("ts")).first()[0]
    keys = ["symbol", "ts"]
    want = batch.sort_values(keys).reset_index(drop=True)
    got = got.sort_values(keys).reset_index(drop=True)
    merged = got.merge(want, on=keys, suffixes=("", "_w"))
    assert len(merged) == len(got) > 0 and got[keys].duplicated().sum() == 0
    for c in ("open", "high", "low", "close", "volume"):
        np.testing.assert_allclose(merged[c], merged[f"{c}_w"])
    assert (got["end_ts"] <= end).all()


def test_alert_is_sent_once(spark, landed):
    """Keys are sent once over all batches, and old ones leave the state store."""
    events, path = landed
    zones = spark.createDataFrame([(t, 1e9, 0.0) for t in ("click", "view", "error", "signup", "purchase")], "symbol string, top double, bottom double")
    bars = source(spark, events, path).select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("low"), F.col("value").alias("high"), F.col("value").alias("close"))
    seen = []
    query = st.alert_stream(bars, zones).writeStream.trigger(availableNow=True).option("checkpointLocation", out(spark)).foreachBatch(lambda b, _: seen.extend(r.alert_key for r in b.collect())).start()
    query.awaitTermination()
    assert len(seen) == len(set(seen)) == events.select("event_type", F.to_date("ts")).distinct().count()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert kept[-1] <= 5 * 3 < len(seen)


def test_risk_covers_all_batches(spark, landed):
    events, path = landed
    norm = lambda d: normalize_events(d.select(F.col("ts").alias("event_ts"), F.lit("INFRA_ATTACK").alias("event_type"), (F.col("value") / 200).alias("confidence")))
    got = st.run_available(source(spark, events, path), out(spark), each=st.risk_over_history(out(spark), norm)).toPandas()
    end = F.lit(str(events.agg(F.max("ts")).first()[0])).cast("timestamp_ntz")
    want = st.risk_slice(norm(events), end).first()
    assert len(got) == 5
    assert (abs(got["geo_risk_score"] - want["geo_risk_score"]) < 1e-9).any()
    assert want["n_events"] in set(got["n_events"])


def test_state_survives_batches(spark, landed):
    events, path = landed
    bars = source(spark, events, path).select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("close"))
    got = st.run_available(st.track_symbols(bars), out(spark)).toPandas().sort_values(["symbol", "ts"], kind="stable")
    raw = events.toPandas().sort_values(["event_type", "ts"], kind="stable")
    for sym, g in raw.groupby("event_type"):
        mine = got[got.symbol == sym]
        np.testing.assert_allclose(mine["ema"], g["value"].ewm(span=12, adjust=False).mean(), rtol=1e-9)
        np.testing.assert_allclose(mine["trail_stop"], g["value"].cummax() * 0.95)


def test_notices(spark, landed):
    events, path = landed
    got = st.run_available(source(spark, events, path), out(spark), each=st.batch_notice).toPandas()
    assert got["n_rows"].sum() == events.count() and set(got["notice"]) == {"OK"}


def test_latest_quotes_over_batches(spark, landed):
    events, path = landed
    want = sorted((r.symbol, r.price, r.n_ticks) for r in st.latest_quotes(ticks(events)).collect())
    stream = st.latest_quotes(ticks(source(spark, events, path)))
    for mode in ("complete", "update"):
        got = st.run_available(stream, out(spark), mode, keys=("symbol",)).collect()
        assert sorted((r.symbol, r.price, r.n_ticks) for r in got) == want
    with pytest.raises(ValueError):
        st.run_available(stream, out(spark), "update")


def plain_tracks(rows, watermark, idle):
    """One symbol after the other in time order, with lists of everything seen so far."""
    out = []

    def state(sym, ts, event, g, stop, level_h, level_l, direction):
        c = np.array([x[3] for x in g])
        ema = c[0]
        for x in c[1:]:
            ema += 2 / 13 * (x - ema)
        out.append((sym, ts, event, direction, round(ema, 9), round(c.max() * 0.95, 9), round(stop, 9), level_h, level_l))

    for sym in sorted({r[0] for r in rows}):
        g, stop, level, open_, direction = [], -np.inf, [None, None], [False, False], None
        mine = sorted(r[1:] for r in rows if r[0] == sym and r[1] <= watermark)
        for ts, high, low, close in [*mine, (None,) * 4]:
            gone = g and (ts if ts is not None else watermark) - g[-1][0] > idle
            if gone and (ts is not None or not [r for r in rows if r[0] == sym and r[1] > watermark]):
                state(sym, g[-1][0] + idle, "EXPIRED", g, stop, *level, direction)
                g, stop, level, open_, direction = [], -np.inf, [None, None], [False, False], None
            if ts is None:
                continue
            before = g[-1][3] if g else None
            g.append((ts, high, low, close, high - low if before is None else max(high - low, abs(high - before), abs(low - before))))
            stop = max(stop, close - 3 * np.mean([x[4] for x in g[-14:]]))
            event = None
            if len(g) >= 7:
                h, lo = [x[1] for x in g[-7:]], [x[2] for x in g[-7:]]
                if h[3] == max(h) and h[3] > h[2] and h[3] > h[4]:
                    level[0], open_[0] = h[3], True
                if lo[3] == min(lo) and lo[3] < lo[2] and lo[3] < lo[4]:
                    level[1], open_[1] = lo[3], True
            if open_[0] and close > level[0]:
                event, open_[0], direction = ("CHOCH_BULL" if direction == "bear" else "BOS_BULL"), False, "bull"
            elif open_[1] and close < level[1]:
                event, open_[1], direction = ("CHOCH_BEAR" if direction == "bull" else "BOS_BEAR"), False, "bear"
            state(sym, ts, event, g, stop, *level, direction)
    return out


def test_structure_state_over_fifty_batches(spark):
    """Late bars, gaps that end a symbol, and a state that stays as small as it was."""
    rng = np.random.default_rng(8)
    start, rows = 1_700_000_000, []
    for sym, n in (("A", 500), ("B", 400), ("C", 60)):
        gaps = rng.choice([60, 60, 60, 120, 3600 * 5], n, p=[0.5, 0.2, 0.2, 0.095, 0.005])
        price = 100 + np.cumsum(rng.normal(0, 1, n))
        for ts, p in zip(start + np.cumsum(gaps), price):
            rows.append((sym, int(ts), float(p + rng.random()), float(p - rng.random()), float(p)))
    rows.sort(key=lambda r: r[1] + rng.integers(0, 500))  # up to eight minutes late
    path = f"{shared_dir(spark)}/tests/{uuid.uuid4().hex}"
    schema = "symbol string, s long, high double, low double, close double"
    for part in np.array_split(np.arange(len(rows)), 50):
        spark.createDataFrame([rows[k] for k in part], schema).coalesce(1).write.mode("append").parquet(path)
    bars = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn("ts", F.timestamp_seconds("s"))
    stream = tracking.track_structure(bars, delay="10 minutes", max_idle_minutes=240)
    seen = []
    spark.conf.set(st.STORE_CONF, tracking.ROCKS)
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", out(spark)).foreachBatch(lambda b, _: seen.extend(b.withColumn("s", F.unix_seconds("ts")).collect())).start()
    spark.conf.unset(st.STORE_CONF)
    query.awaitTermination()
    watermark = max(r[1] for r in rows) - 600
    want = plain_tracks(rows, watermark, 240 * 60)
    have = sorted(((r.symbol, r.s, r.event, r.break_dir, round(r.ema, 9), round(r.trail_stop, 9), round(r.atr_stop, 9), r.swing_high, r.swing_low) for r in seen), key=lambda r: r[:2] + (r[2] or "",))
    want.sort(key=lambda r: r[:2] + (r[2] or "",))
    assert len([w for w in want if w[2] == "EXPIRED"]) >= 3 and len({w[2] for w in want}) == 6
    assert [w[:4] + w[7:] for w in have] == [w[:4] + w[7:] for w in want]
    np.testing.assert_allclose([w[4:7] for w in have], [w[4:7] for w in want], rtol=1e-8)
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(sizes) >= 50 and max(sizes[-10:]) <= max(sizes[5:15]) + 20
