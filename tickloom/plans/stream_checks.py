"""Streaming operators, driven over the landed events until everything available is read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.operators import news
from tickloom.plans import sqlkit as q
from tickloom.plans.registry import Registry, fix
from tickloom.plans.smc_checks import CAUSAL
from tickloom.session import scratch_root
from tickloom.sources.driver_tables import bars_hourly, table
from tickloom.streaming import stream as st
from tickloom.streaming import tracking

R = Registry()


def source(s, d):
    return s.readStream.schema(table(s, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)


def ticks(s, d):
    return source(s, d).select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("volume"), F.col("event_id").alias("tick_id"))


def out(s):
    return f"{scratch_root(s)}/streams/{uuid.uuid4().hex}"


def ntz(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


def run(s, stream, mode="append", each=None):
    return ntz(st.run_available(stream, out(s), mode, each))


BARS = lambda bucket: f"SELECT event_type AS symbol, {bucket} AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume, count(*) AS n_ticks FROM events GROUP BY 1, 2"
CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
COLS = ["symbol", "ts", "open", "high", "low", "close", "volume", "n_ticks"]
R.add("st1_hourly_bars", lambda s, d: run(s, st.tick_bars(ticks(s, d))).select(*COLS), f"SELECT * FROM ({BARS('CAST(date_trunc($$hour$$, events.ts) AS TIMESTAMP)')}) WHERE ts + INTERVAL 1 HOUR <= {CLOSED}")
R.add("st1_quarter_hour_bars", lambda s, d: run(s, st.tick_bars(ticks(s, d), "15 minutes")).select(*COLS), f"SELECT * FROM ({BARS('time_bucket(INTERVAL 15 MINUTE, events.ts)')}) WHERE ts + INTERVAL 15 MINUTE <= {CLOSED}")
R.add("st1_daily_bars", lambda s, d: run(s, st.tick_bars(ticks(s, d), "1 day")).select(*COLS), f"SELECT * FROM ({BARS('CAST(date_trunc($$day$$, events.ts) AS TIMESTAMP)')}) WHERE ts + INTERVAL 1 DAY <= {CLOSED}")
R.add("st2_sliding_windows", lambda s, d: run(s, st.tick_bars(ticks(s, d), "4 hours", slide="1 hour")).select("symbol", "ts", "volume", "high"),
      f"WITH w AS (SELECT event_type AS symbol, CAST(date_trunc('hour', ts) - o * INTERVAL 1 HOUR AS TIMESTAMP) AS ts, value FROM events, (SELECT unnest([0, 1, 2, 3]) AS o)) SELECT symbol, ts, CAST(count(*) AS DOUBLE) AS volume, max(value) AS high FROM w WHERE ts + INTERVAL 4 HOUR <= {CLOSED} GROUP BY 1, 2")
R.add("st3_closed_candles", lambda s, d: run(s, st.tick_bars(ticks(s, d))).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_closed"), F.max("end_ts").alias("last_end")),
      f"SELECT symbol, count(*) AS n_closed, max(ts) + INTERVAL 1 HOUR AS last_end FROM ({BARS('CAST(date_trunc($$hour$$, events.ts) AS TIMESTAMP)')}) WHERE ts + INTERVAL 1 HOUR <= {CLOSED} GROUP BY symbol")
R.add("st4_user_sessions", lambda s, d: run(s, st.sessions(source(s, d))).select("user_id", "start_ts", "end_ts", "n_events", fix("value", 4).alias("value")),
      f"""WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS nw FROM events), b AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sn FROM a),
 c AS (SELECT user_id, min(ts) AS start_ts, max(ts) + INTERVAL 30 MINUTE AS end_ts, count(*) AS n_events, sum(value) AS value FROM b GROUP BY user_id, sn) SELECT user_id, start_ts, end_ts, n_events, {q.fix('value', 4)} AS value FROM c WHERE end_ts <= {CLOSED}""")


def alerts(s, d):
    return source(s, d).where("value > 100").select("ts", F.concat_ws("|", "event_type", F.date_format("ts", "yyyy-MM-dd"), F.floor(F.col("value") / 50).cast("string")).alias("alert_key"))


R.add("st5_deduped_alerts", lambda s, d: run(s, st.dedup_alerts(alerts(s, d))).select("alert_key"),
      "SELECT DISTINCT event_type || '|' || strftime(ts, '%Y-%m-%d') || '|' || CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) AS alert_key FROM events WHERE value > 100")


def bar_stream(s, d):
    """Closed hourly bars landed as files, read as a stream."""
    path = f"{scratch_root(s)}/landed/{uuid.uuid4().hex}"
    b = bars_hourly(s, d).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "high", "low", "close")
    b.repartition(3).write.parquet(path)
    return s.readStream.schema(b.schema).parquet(path)


R.add("st6_tracked_symbols", lambda s, d: run(s, st.track_symbols(bar_stream(s, d))).select("symbol", "ts", fix("ema", 4).alias("ema"), fix("trail_stop", 4).alias("trail_stop")),
      q.sql([q.HOURLY], f"SELECT symbol, ts, {q.fix(f'sum(close * exp(0.16705408466316624 * (bar_no - 300)) * CASE WHEN bar_no = 0 THEN 1.0 ELSE 0.15384615384615385 END) OVER {q.RUN} / exp(0.16705408466316624 * (bar_no - 300))', 4)} AS ema, {q.fix(f'max(close) OVER {q.RUN} * 0.95', 4)} AS trail_stop FROM hours"))


def structure(s, d):
    stream = tracking.track_structure(bar_stream(s, d), delay="2 hours", max_idle_minutes=36 * 60)
    return ntz(st.run_available(stream, out(s), state_store=tracking.ROCKS))


# Bars behind the watermark; a gap of over 36 hours ends a symbol, which is numbered anew behind it.
_SPELLS = ["hq AS (SELECT *, ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) > INTERVAL 36 HOUR AS anew FROM h0)",
           "hs AS (SELECT *, symbol || '|' || count(*) FILTER (anew) OVER (PARTITION BY symbol ORDER BY ts) AS spell FROM hq)",
           "hb AS (SELECT spell AS symbol, symbol AS name, ts, high, low, close, row_number() OVER (PARTITION BY spell ORDER BY ts) - 1 AS bar_no, count(*) OVER (PARTITION BY spell) AS n_bars FROM hs)",
           f"bars AS (SELECT *, {q.TR.replace('PARTITION BY symbol', 'PARTITION BY spell')} AS tr FROM (SELECT *, symbol AS spell FROM hb))"]
R.add("st6_structure_state", lambda s, d: structure(s, d).select("symbol", "ts", "event", "break_dir", *[fix(c, 4).alias(c) for c in ("ema", "trail_stop", "atr_stop", "swing_high", "swing_low")]),
      q.sql([q.HOURLY, *_SPELLS, *CAUSAL[:5],
             "sj AS (SELECT s1.*, t.k, t.pk FROM s1 LEFT JOIN trn t ON t.symbol = s1.symbol AND t.bar_no = s1.bar_no)",
             f"""sx AS (SELECT *, sum(close * exp(0.16705408466316624 * (bar_no - 300)) * CASE WHEN bar_no = 0 THEN 1.0 ELSE 0.15384615384615385 END) OVER {q.RUN} / exp(0.16705408466316624 * (bar_no - 300)) AS ema,
 max(close) OVER {q.RUN} * 0.95 AS trail_stop, {q.mean('tr', 14, 1)} AS atr, last_value(k IGNORE NULLS) OVER {q.RUN} AS dr FROM sj)""",
             f"sy AS (SELECT *, max(close - 3.0 * atr) OVER {q.RUN} AS atr_stop FROM sx)",
             """sz AS (SELECT name AS symbol, ts, bar_no = n_bars - 1 AS final, CASE WHEN k IS NULL THEN NULL WHEN pk <> k THEN 'CHOCH_' ELSE 'BOS_' END || upper(k) AS event, CASE dr WHEN 'bull' THEN 'bull' WHEN 'bear' THEN 'bear' END AS break_dir,
 ema, trail_stop, atr_stop, lvl_sh AS swing_high, lvl_sl AS swing_low FROM sy)""",
             "mw AS (SELECT max(ts) - INTERVAL 2 HOUR AS w FROM h0)",
             """su AS (SELECT symbol, ts, event, break_dir, ema, trail_stop, atr_stop, swing_high, swing_low FROM sz, mw WHERE ts <= w
 UNION ALL SELECT sz.symbol, sz.ts + INTERVAL 36 HOUR, 'EXPIRED', break_dir, ema, trail_stop, atr_stop, swing_high, swing_low FROM sz, mw WHERE final AND sz.ts + INTERVAL 36 HOUR < w)"""],
            "SELECT symbol, ts, event, break_dir, " + ", ".join(f"{q.fix(c, 4)} AS {c}" for c in ("ema", "trail_stop", "atr_stop", "swing_high", "swing_low")) + " FROM su"))
R.add("st7_latest_quotes", lambda s, d: run(s, st.latest_quotes(ticks(s, d)), "complete"), "SELECT event_type AS symbol, last(value ORDER BY ts, event_id) AS price, max(ts) AS ts, count(*) AS n_ticks FROM events GROUP BY 1")


def risk_events(df):
    kinds = {"click": "SHIPPING_DISRUPTION", "error": "INFRA_ATTACK", "purchase": "DIPLOMATIC_DEESCALATION", "signup": "SANCTIONS_ENFORCEMENT"}
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")]
    return news.normalize_events(df.select(F.col("ts").alias("event_ts"), F.coalesce(kind, F.lit("OTHER")).alias("event_type"), (F.col("value") / 200).alias("confidence"), F.lit("HIGH").alias("severity")))


R.add("st8_rolling_geo_risk", lambda s, d: run(s, source(s, d), each=st.risk_over_history(out(s), risk_events)).select(fix("geo_risk_score", 5).alias("geo_risk_score"), "n_events", "gate_action", "gate_stale"),
      f"""WITH m AS (SELECT max(ts) AS t FROM events), e AS (SELECT CASE event_type WHEN 'click' THEN 1.0 WHEN 'error' THEN 1.0 WHEN 'purchase' THEN -0.8 WHEN 'signup' THEN 0.7 ELSE 0.25 END::DOUBLE * 0.8 * 0.8 * greatest(0, least(1, value / 200)) * exp(-ln(2.0) * epoch(t - ts) / 3600 / 36) AS r FROM events, m WHERE ts >= t - INTERVAL 72 HOUR),
 g AS (SELECT (greatest(-1, least(1, avg(r) + max(r) * 0.35)) + 1) / 2 AS g, count(*) AS n FROM e) SELECT {q.fix('g', 5)} AS geo_risk_score, n AS n_events, CASE WHEN n < 2 THEN 'REDUCE_SIZE' WHEN g >= 0.7 THEN 'PAUSE_NEW_LONGS' WHEN g >= 0.45 THEN 'REDUCE_SIZE' ELSE 'NORMAL' END AS gate_action, n < 2 AS gate_stale FROM g""")
ZONES = lambda s, d: table(s, d, "events").groupBy(F.col("event_type").alias("symbol")).agg(F.percentile("value", 0.98).alias("bottom"), F.percentile("value", 0.99).alias("top"))


R.add("st9_zone_alerts", lambda s, d: run(s, st.alert_stream(bar_stream(s, d), ZONES(s, d))).select("alert_key"),
      q.sql([q.HOURLY, "z AS (SELECT event_type AS symbol, quantile_cont(value, 0.98) AS bottom, quantile_cont(value, 0.99) AS top FROM events GROUP BY 1)"], "SELECT DISTINCT h.symbol || '|' || strftime(h.ts, '%Y-%m-%d') || '|' || printf('%.2f-%.2f', bottom, top) AS alert_key FROM hours h JOIN z USING (symbol) WHERE low <= top AND high >= bottom"))
def notices(s, d):
    """A batch with all events, and one in which no event is left."""
    full = run(s, source(s, d), each=st.batch_notice)
    return full.unionByName(run(s, source(s, d).where("event_type = 'none of the given ones'"), each=st.batch_notice)).groupBy("notice").agg(F.sum("n_rows").alias("n_rows"))


R.add("st10_batch_notices", notices, "SELECT CASE WHEN keep THEN 'OK' ELSE 'NO_NEW_DATA' END AS notice, CAST(count(*) FILTER (keep) AS BIGINT) AS n_rows FROM events, (VALUES (true), (false)) v(keep) GROUP BY keep")

QUERIES, ORACLES = R.queries, R.oracles
