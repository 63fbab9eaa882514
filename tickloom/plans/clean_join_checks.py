"""Sources, cleaning, joins, set operations and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.series import index_bars, is_last, tail
from tickloom.operators import clean, joins
from tickloom.operators import resample as rs
from tickloom.operators.indicators import fill
from tickloom.plans import sqlkit as q
from tickloom.plans.registry import KEY, Registry, fix, rounded, sel
from tickloom.sources.driver_tables import bars_daily, bars_hourly, benchmark_daily, positioning, table

R = Registry()
OHLCV = ["open", "high", "low", "close", "volume"]

# ---- sources -----------------------------------------------------------------------------------
R.add("s1_bars_in_range",
      lambda s, d: bars_daily(s, d).where((F.col("ts") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("ts") <= F.lit("1998-12-31").cast("timestamp_ntz")) & (F.col("n_bars") >= 60)).select(*KEY, *OHLCV),
      q.sql(q.DAILY, "SELECT symbol, ts, open, high, low, close, volume FROM bars WHERE ts >= TIMESTAMP '1997-01-01' AND ts <= TIMESTAMP '1998-12-31' AND n_bars >= 60"))
R.add("s14_bar_stats",
      lambda s, d: bars_daily(s, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")),
      q.sql(q.DAILY, "SELECT symbol, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM bars GROUP BY symbol"))

# ---- cleaning ----------------------------------------------------------------------------------


def odd_names(s, d):
    b = bars_daily(s, d)
    return b.select("symbol", F.col("ts").alias("Datetime"), F.col("open").alias("Open"), F.col("high").alias("HIGH"),
                    F.col("low").alias("Low"), F.col("close").alias("Adj Close"), F.col("volume").cast("string").alias("Volume"))


R.add("c1_normalized_columns", lambda s, d: clean.normalize_columns(odd_names(s, d)),
      q.sql(q.DAILY, "SELECT symbol, ts, open, high, low, close, volume FROM bars"))

SUFFIXED = "CASE p_partkey % 5 WHEN 0 THEN '.TWO' WHEN 1 THEN '.TW' WHEN 2 THEN '_VN' WHEN 3 THEN '.us' ELSE '' END"


def raw_symbols(s, d):
    n = F.col("p_partkey") % 5
    suffix = F.when(n == 0, ".TWO").when(n == 1, ".TW").when(n == 2, "_VN").when(n == 3, ".us").otherwise("")
    head = F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).otherwise(F.replace("p_name", F.lit(" "), F.lit("-")))
    return table(s, d, "part").select("p_partkey", F.concat(head, suffix).alias("raw"))


RAW = f"raw AS (SELECT p_partkey, (CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE replace(p_name, ' ', '-') END) || {SUFFIXED} AS raw FROM part)"
CLEANED = "raw"
for suf in clean.SUFFIXES:
    CLEANED = f"replace({CLEANED}, '{suf}', '')"
CLEANED = f"upper(translate({CLEANED}, '.=-', '___'))"
INFER = "CASE WHEN upper(raw) LIKE '%.VN' THEN 'VN' WHEN upper(raw) LIKE '%.TW' OR upper(raw) LIKE '%.TWO' OR regexp_full_match(raw, '[0-9]+') THEN 'TW' ELSE 'US' END"
R.add("c2_clean_symbols",
      lambda s, d: raw_symbols(s, d).select("p_partkey", clean.clean_symbol(F.col("raw")).alias("symbol"), clean.vendor_ticker(F.col("raw"), clean.infer_market(F.col("raw"))).alias("ticker")),
      q.sql(RAW, f"SELECT p_partkey, {CLEANED} AS symbol, CASE {INFER} WHEN 'VN' THEN {CLEANED} || '.VN' WHEN 'TW' THEN CASE WHEN raw LIKE '%.TWO' THEN raw ELSE {CLEANED} || '.TW' END ELSE raw END AS ticker FROM raw"))
R.add("c3_inferred_market",
      lambda s, d: raw_symbols(s, d).select("p_partkey", clean.infer_market(F.col("raw")).alias("market"), clean.is_cash_equity(F.col("raw"), F.lit("")).alias("cash_equity")),
      q.sql(RAW, f"SELECT p_partkey, {INFER} AS market, (upper(raw) LIKE '%.VN' OR upper(raw) LIKE '%.TW' OR upper(raw) LIKE '%.TWO') AS cash_equity FROM raw"))
NUM_TXT = "CASE event_id % 6 WHEN 0 THEN 'n/a' WHEN 1 THEN 'NaN' WHEN 2 THEN 'inf' WHEN 3 THEN NULL ELSE CAST(value AS VARCHAR) END"


def numeric_text(s, d):
    n = F.col("event_id") % 6
    return table(s, d, "events").select("event_id", F.when(n == 0, "n/a").when(n == 1, "NaN").when(n == 2, "inf").when(n == 3, None).otherwise(F.col("value").cast("string")).alias("txt"))


R.add("c4_safe_numbers", lambda s, d: numeric_text(s, d).select("event_id", clean.safe_number(F.col("txt")).alias("num")),
      f"WITH t AS (SELECT event_id, {NUM_TXT} AS txt FROM events) SELECT event_id, coalesce(CASE WHEN isfinite(TRY_CAST(txt AS DOUBLE)) THEN TRY_CAST(txt AS DOUBLE) END, 0.0) AS num FROM t")
R.add("f11_coercion", lambda s, d: numeric_text(s, d).select("event_id", F.col("txt").try_cast("double").isNull().alias("is_bad"), F.col("txt").try_cast("date").alias("as_date")),
      f"WITH t AS (SELECT event_id, {NUM_TXT} AS txt FROM events) SELECT event_id, TRY_CAST(txt AS DOUBLE) IS NULL AS is_bad, CAST(NULL AS DATE) AS as_date FROM t")


def mixed_units(s, d):
    """Daily bars quoted in thousands on every seventh day."""
    b = bars_daily(s, d)
    k = F.when(F.dayofyear("ts") % 7 == 0, 0.001).otherwise(1.0)
    return b.withColumns({c: F.col(c) * k for c in clean.PRICES})


MIXED = "mixed AS (SELECT * REPLACE (open * k AS open, high * k AS high, low * k AS low, close * k AS close) FROM (SELECT *, CASE WHEN dayofyear(ts) % 7 = 0 THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END AS k FROM bars))"
R.add("c5_price_units", lambda s, d: rounded(clean.normalize_units(mixed_units(s, d)), r4=["open", "high", "low", "close"]),
      q.sql([q.DAILY, MIXED, "med AS (SELECT symbol, median(close) AS m FROM mixed WHERE close > 0 GROUP BY symbol)",
             "hit AS (SELECT mixed.*, CASE WHEN close > 0 AND close < CASE WHEN m < 1000 THEN 1000 ELSE least(1000, m / 100) END THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS f FROM mixed JOIN med USING (symbol))"],
            "SELECT symbol, ts, " + ", ".join(f"{q.fix(f'{c} * f', 4)} AS {c}" for c in clean.PRICES) + " FROM hit"))


def raw_sessions(s, d):
    """Two source rows per bar: one at midnight, one at 07:00 with some fields missing or untraded."""
    b = bars_daily(s, d).select("symbol", "ts", *OHLCV)
    second = b.withColumns({
        "ts": F.col("ts") + F.expr("INTERVAL 7 HOURS"), "close": F.col("close") + 1,
        "open": F.when(F.dayofmonth("ts") % 3 == 0, None).otherwise(F.col("open")),
        "volume": F.when(F.dayofmonth("ts") % 4 == 0, F.lit(0.0)).otherwise(F.col("volume")),
    })
    first = b.withColumn("volume", F.when(F.dayofmonth("ts") % 8 == 0, F.lit(0.0)).otherwise(F.col("volume")))
    return first.withColumn("ingest_seq", F.lit(0)).unionByName(second.withColumn("ingest_seq", F.lit(1)))


SESS = """sess AS (SELECT symbol, ts, open, high, low, close, CASE WHEN day(ts) % 8 = 0 THEN 0 ELSE volume END AS volume, 0 AS seq FROM bars
 UNION ALL SELECT symbol, ts + INTERVAL 7 HOUR, CASE WHEN day(ts) % 3 = 0 THEN NULL ELSE open END, high, low, close + 1, CASE WHEN day(ts) % 4 = 0 THEN 0 ELSE volume END, 1 FROM bars),
rk AS (SELECT *, row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY (volume > 0)::INT DESC, (open IS NOT NULL)::INT DESC, seq DESC) AS rn FROM sess)"""
R.add("c6_canonical_sessions", lambda s, d: clean.canonical_sessions(raw_sessions(s, d)),
      q.sql([q.DAILY, SESS], "SELECT symbol, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts, open, high, low, close, volume FROM rk WHERE rn = 1 AND volume > 0"))
R.add("c7_scale_consistency", lambda s, d: clean.scale_is_consistent(mixed_units(s, d)),
      q.sql([q.DAILY, MIXED, f"r AS (SELECT symbol, close / {q.lag('close')} AS r FROM mixed)"],
            "SELECT symbol, coalesce(bool_and(r BETWEEN 0.01 AND 100), false) AND count(r) > 0 AS consistent FROM r GROUP BY symbol"))


def rescaled(s, d):
    """A smoothed series whose early part is quoted in thousandths."""
    b = bars_daily(s, d)
    calm = b.withColumns({c: 1000.0 + F.col(c) % 50 for c in clean.PRICES})
    n = F.substring("symbol", 7, 3).cast("int")
    k = F.when((n % 4 == 1) & (F.col("bar_no") < 100), 0.001).when((n % 4 == 2) & F.col("bar_no").between(100, 199), 0.001).when(
        (n % 4 == 3) & (F.floor(F.col("bar_no") / 50) % 2 == 0), 0.001).otherwise(1.0)
    return calm.withColumns({c: F.col(c) * k for c in clean.PRICES})


RESC = ["n0 AS (SELECT *, CAST(replace(symbol, 'Brand#', '') AS INT) % 4 AS sn FROM bars)",
        "n1 AS (SELECT *, CASE WHEN sn = 1 AND bar_no < 100 THEN 0.001::DOUBLE WHEN sn = 2 AND bar_no BETWEEN 100 AND 199 THEN 0.001::DOUBLE WHEN sn = 3 AND (bar_no // 50) % 2 = 0 THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END AS k FROM n0)",
        "n2 AS (SELECT symbol, ts, bar_no, " + ", ".join(f"(1000.0::DOUBLE + {c} % 50) * k AS {c}" for c in clean.PRICES) + " FROM n1)",
        f"n3 AS (SELECT *, close / {q.lag('close')} AS r FROM n2)",
        "n4 AS (SELECT *, CASE WHEN abs(ln(r)) >= 2 AND (r > 100 OR r < 0.005) THEN ln(r) END AS lr FROM n3)",
        f"n5 AS (SELECT *, coalesce(sum(lr) OVER ({q.P} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later, count(lr) OVER (PARTITION BY symbol) AS nb, max(CASE WHEN lr IS NOT NULL THEN bar_no END) OVER (PARTITION BY symbol) AS lastb FROM n4)",
        f"n6 AS (SELECT *, max(abs(ln((close * exp(later)) / w))) OVER (PARTITION BY symbol) AS worst FROM (SELECT *, lag(close * exp(later)) OVER ({q.P}) AS w FROM n5))",
        "n7 AS (SELECT *, nb > 2 OR (nb > 0 AND worst > 2) AS cut FROM n6)"]
R.add("c8_scale_break_repair", lambda s, d: rounded(clean.repair_scale_breaks(rescaled(s, d)), r4=["open", "high", "low", "close"]),
      q.sql([q.DAILY, *RESC], "SELECT symbol, ts, " + ", ".join(f"{q.fix(f'CASE WHEN cut THEN {c} ELSE {c} * exp(later) END', 4)} AS {c}" for c in clean.PRICES) + " FROM n7 WHERE NOT cut OR bar_no >= lastb"))
NOW = "2024-01-20 10:17:00"
R.add("c9_confirmed_candles", lambda s, d: clean.confirmed_candles(bars_hourly(s, d), F.lit(NOW).cast("timestamp_ntz"), 60).select(*KEY, "close"),
      q.sql(q.HOURLY, "SELECT symbol, ts, close FROM hours WHERE ts < TIMESTAMP '2024-01-20 10:00:00'"))
R.add("c10_intraday_validation", lambda s, d: clean.validate_intraday(bars_hourly(s, d).withColumn("close", 500 + F.col("close") % (F.length("symbol") * F.length("symbol") * 3)), F.lit("2024-02-01 10:00:00").cast("timestamp_ntz")),
      q.sql([q.HOURLY, "c AS (SELECT * REPLACE (500 + close % (length(symbol) * length(symbol) * 3) AS close) FROM hours)",
             f"r AS (SELECT *, close / {q.lag('close')} AS r FROM c)",
             "a AS (SELECT symbol, count(*) AS n, bool_and(r BETWEEN 0.01 AND 100) AS su, max(abs(r - 1)) AS jump, max(ts) AS latest FROM r GROUP BY symbol)",
             "z AS (SELECT symbol, CASE WHEN n < 14 THEN 'Need at least 14 H1 bars' WHEN NOT su THEN 'Mixed price units' WHEN jump > 0.15 THEN 'Implausible H1 price jump' WHEN TIMESTAMP '2024-02-01 10:00:00' - latest > INTERVAL 4 DAY THEN 'H1 data is stale' ELSE 'OK' END AS reason FROM a)"],
            "SELECT symbol, reason = 'OK' AS ok, reason FROM z"))
R.add("c11_fresh_symbols", lambda s, d: clean.fresh_symbols(bars_daily(s, d), F.lit("2001-11-01").cast("date")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")),
      q.sql(q.DAILY, "SELECT symbol, count(*) AS n FROM bars GROUP BY symbol HAVING max(ts) >= TIMESTAMP '2001-11-01'"))
LOCAL = "(ts + INTERVAL 7 HOUR)"
R.add("c12_expected_session", lambda s, d: table(s, d, "events").select("event_id", clean.expected_session(F.col("ts").cast("timestamp"), "VN").alias("expected")),
      f"""WITH l AS (SELECT event_id, {LOCAL} AS l FROM events),
 e AS (SELECT event_id, CASE WHEN isodow(l) < 6 AND hour(l) * 60 + minute(l) < 915 THEN CAST(l AS DATE) - 1 ELSE CAST(l AS DATE) END AS d FROM l)
 SELECT event_id, CAST(d - CASE isodow(d) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS DATE) AS expected FROM e""")
R.add("c13_market_open", lambda s, d: table(s, d, "events").select("event_id", *[clean.market_open(F.col("ts").cast("timestamp"), sc).alias(f"open_{sc.lower()}") for sc in ("VN", "TW", "VN_TW")]),
      """WITH l AS (SELECT event_id, ts + INTERVAL 8 HOUR AS l FROM events), m AS (SELECT event_id, isodow(l) < 6 AS wd, hour(l) * 60 + minute(l) AS m FROM l)
 SELECT event_id, wd AND m - 60 BETWEEN 540 AND 900 AS open_vn, wd AND m BETWEEN 540 AND 825 AS open_tw, wd AND (m - 60 BETWEEN 540 AND 900 OR m BETWEEN 540 AND 825) AS open_vn_tw FROM m""")


def split_counts(s, d):
    train, outcome = clean.point_in_time(bars_daily(s, d), F.lit("1999-06-30 12:00:00").cast("timestamp_ntz"))
    return train.withColumn("part", F.lit("train")).unionByName(outcome.withColumn("part", F.lit("outcome"))).groupBy("symbol", "part").agg(F.count(F.lit(1)).alias("n"))


R.add("c14_point_in_time_split", split_counts,
      q.sql(q.DAILY, "SELECT symbol, CASE WHEN ts < TIMESTAMP '1999-07-01' THEN 'train' ELSE 'outcome' END AS part, count(*) AS n FROM bars GROUP BY 1, 2"))
LISTING = lambda s, d: table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
    F.col("s_name").alias("symbol"), F.when(F.col("n_regionkey") == 0, "HOSE").when(F.col("n_regionkey") == 1, "HNX").otherwise("UPCOM").alias("exchange"))
R.add("c15_universe", lambda s, d: clean.universe(LISTING(s, d)), "SELECT DISTINCT s_name AS symbol FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey IN (0, 1)")


def instruments(s, d):
    m = F.when(F.col("p_partkey") % 3 == 0, "VN").when(F.col("p_partkey") % 3 == 1, "TW").otherwise("US")
    suffix = F.when(m == "VN", ".VN").when(m == "TW", ".TW").otherwise("")
    return table(s, d, "part").select(F.concat(F.lit("P"), "p_partkey", suffix).alias("symbol"), F.col("p_name").alias("name"), F.col("p_type").alias("sector"), m.alias("market"))


INSTR = """i AS (SELECT 'P' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.VN' WHEN 1 THEN '.TW' ELSE '' END AS symbol, p_name AS name, p_type AS sector,
 CASE p_partkey % 3 WHEN 0 THEN 'VN' WHEN 1 THEN 'TW' ELSE 'US' END AS market FROM part)"""
R.add("c16_instrument_search", lambda s, d: clean.search_instruments(instruments(s, d), "bolt", blacklist=("P4.TW",)),
      q.sql([INSTR, "h AS (SELECT *, upper(split_part(symbol, '.', 1)) AS base FROM i WHERE (lower(name) LIKE '%bolt%' OR lower(sector) LIKE '%bolt%' OR lower(symbol) LIKE '%bolt%') AND symbol <> 'P4.TW')"],
            "SELECT symbol, name, sector, market, base FROM h WHERE market <> 'US' OR (SELECT count(*) FROM h WHERE market <> 'US') = 0 ORDER BY CASE market WHEN 'TW' THEN 1 WHEN 'VN' THEN 2 ELSE 3 END, symbol LIMIT 10"))
R.add("c17_neutral_when_short", lambda s, d: clean.neutral_when_short(bars_daily(s, d).withColumns({"sig": F.lit(1), "why": F.lit("RUN")}), 1500, {"sig": 0, "why": "INSUFFICIENT_DATA"}).groupBy("sig", "why").agg(F.count(F.lit(1)).alias("n")),
      q.sql(q.DAILY, "SELECT CASE WHEN n_bars < 1500 THEN 0 ELSE 1 END AS sig, CASE WHEN n_bars < 1500 THEN 'INSUFFICIENT_DATA' ELSE 'RUN' END AS why, count(*) AS n FROM bars GROUP BY 1, 2"))
R.add("c18_finite_features", lambda s, d: table(s, d, "events").select("event_id", clean.finite_or_zero(F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).when(F.col("event_id") % 4 == 1, F.lit(float("inf"))).otherwise(F.col("value"))).alias("x")),
      "SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN 0.0 ELSE value END AS x FROM events")
R.add("c19_aliased_columns", lambda s, d: (lambda t: t.select("event_id", clean.to_percent(clean.first_existing(t, ["ratio", "pct", "value"]) / 40).alias("pct"), clean.first_existing(t, ["nope"], 0.0).alias("missing")))(table(s, d, "events")),
      "SELECT event_id, CASE WHEN abs(value / 40) < 1 THEN value / 40 * 100 ELSE value / 40 END AS pct, 0.0::DOUBLE AS missing FROM events")
R.add("c21_category_lookup", lambda s, d: table(s, d, "part").select("p_partkey", clean.lookup(F.col("p_type"), {"ECONOMY": 0.25, "MEDIUM": 0.5, "LARGE": 1.0}, 0.7).alias("weight")),
      "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 0.25 WHEN 'MEDIUM' THEN 0.5 WHEN 'LARGE' THEN 1.0 ELSE 0.7 END::DOUBLE AS weight FROM part")

# ---- joins -------------------------------------------------------------------------------------
R.add("j1_asof_positioning", lambda s, d: joins.asof_calendar(bars_daily(s, d).select(*KEY, "close"), positioning(s, d).withColumn("week", F.col("ts")), ["week", "open_interest", "commercial_short"]),
      q.sql([q.DAILY, q.POSITIONING], "SELECT b.symbol, b.ts, b.close, p.ts AS week, p.open_interest, p.commercial_short FROM bars b ASOF LEFT JOIN pos p ON b.ts >= p.ts"))
KEYED_RIGHT = lambda s, d: bars_daily(s, d).where(F.col("bar_no") % 11 == 3).select("symbol", (F.col("ts") + F.expr("INTERVAL 5 HOURS")).alias("ts"), F.col("close").alias("mark"))
R.add("j1_asof_per_symbol", lambda s, d: joins.asof_join(bars_daily(s, d).select(*KEY, "close"), KEYED_RIGHT(s, d), ["mark"]),
      q.sql([q.DAILY, "rt AS (SELECT symbol, ts + INTERVAL 5 HOUR AS ts, close AS mark FROM bars WHERE bar_no % 11 = 3)"],
            "SELECT b.symbol, b.ts, b.close, r.mark FROM bars b ASOF LEFT JOIN rt r ON b.symbol = r.symbol AND b.ts >= r.ts"))
R.add("j1_asof_back_filled", lambda s, d: joins.asof_join(bars_daily(s, d).select(*KEY, "close", "bar_no", "n_bars"), KEYED_RIGHT(s, d), ["mark"], back_fill=True).select(*KEY, "mark"),
      q.sql([q.DAILY, "rt AS (SELECT symbol, ts + INTERVAL 5 HOUR AS ts, close AS mark FROM bars WHERE bar_no % 11 = 3)",
             "j AS (SELECT b.symbol, b.ts, b.bar_no, r.mark FROM bars b ASOF LEFT JOIN rt r ON b.symbol = r.symbol AND b.ts >= r.ts)"],
            f"SELECT symbol, ts, first_value(mark IGNORE NULLS) OVER ({q.P} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mark FROM j"))
SPARSE_INDEX = lambda s, d: benchmark_daily(s, d).where(F.col("bar_no") % 3 == 0).select("ts", F.col("close").alias("idx"))
R.add("j2_left_join_ffill", lambda s, d: fill(bars_daily(s, d).select(*KEY, "bar_no", "n_bars").join(SPARSE_INDEX(s, d), "ts", "left"), ["idx"]).select(*KEY, "idx"),
      q.sql([q.DAILY, q.BENCH], f"SELECT symbol, ts, last_value(idx IGNORE NULLS) OVER {q.RUN} AS idx FROM (SELECT b.symbol, b.ts, b.bar_no, x.close AS idx FROM bars b LEFT JOIN (SELECT * FROM bench WHERE bar_no % 3 = 0) x ON b.ts = x.ts)"))


def macro_pair(s, d):
    a = benchmark_daily(s, d).where(F.col("bar_no") % 2 == 0).select("ts", F.col("close").alias("dxy"))
    b = benchmark_daily(s, d).where(F.col("bar_no") % 3 == 0).select("ts", F.col("open").alias("us10y"))
    both = a.join(b, "ts", "full").withColumn("symbol", F.lit("MACRO"))
    return fill(index_bars(both), ["dxy", "us10y"]).select("ts", "dxy", "us10y")


R.add("j3_full_join_ffill", macro_pair,
      q.sql([q.TRADES, q.BENCH], """SELECT ts, last_value(d IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS dxy, last_value(u IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS us10y
 FROM (SELECT ts, CASE WHEN bar_no % 2 = 0 THEN close END AS d, CASE WHEN bar_no % 3 = 0 THEN open END AS u FROM bench WHERE bar_no % 2 = 0 OR bar_no % 3 = 0)"""))
R.add("j4_benchmark_ratio", lambda s, d: joins.with_benchmark(bars_daily(s, d), benchmark_daily(s, d)).select(*KEY, "close", "index_close", "rel_strength"),
      q.sql([q.DAILY, q.BENCH], "SELECT b.symbol, b.ts, b.close, x.close AS index_close, b.close / x.close AS rel_strength FROM bars b JOIN bench x ON b.ts = x.ts"))


def flow_rows(s, d):
    return bars_daily(s, d).where(F.col("bar_no") % 2 == 0).select(*KEY, (F.col("volume") * 0.25).alias("foreign_buy"), (F.col("volume") * 0.125).alias("foreign_sell"), (F.col("volume") * 0.5).alias("block_volume"))


R.add("j5_flow_merge", lambda s, d: joins.merge_flow(bars_daily(s, d).select(*KEY, "close").withColumn("foreign_buy", F.lit(1.0)), flow_rows(s, d), fx=800.0).select(*KEY, "foreign_buy", "foreign_sell", "block_volume", fix("foreign_net_value", 2).alias("foreign_net_value")),
      q.sql([q.DAILY, "f AS (SELECT symbol, ts, close, CASE WHEN bar_no % 2 = 0 THEN volume * 0.25 ELSE 1.0 END::DOUBLE AS foreign_buy, CASE WHEN bar_no % 2 = 0 THEN volume * 0.125 ELSE 0.0 END::DOUBLE AS foreign_sell, CASE WHEN bar_no % 2 = 0 THEN volume * 0.5 ELSE 0.0 END::DOUBLE AS block_volume FROM bars)"],
            f"SELECT symbol, ts, foreign_buy, foreign_sell, block_volume, {q.fix('round((foreign_buy - foreign_sell) * close * 800 / 1000000, 3)', 2)} AS foreign_net_value FROM f"))
R.add("j6_dimension_lookup", lambda s, d: table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("N/A")).alias("sector")),
      "SELECT s_suppkey, coalesce(n_name, 'N/A') AS sector FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
R.add("j7_benchmark_assignment", lambda s, d: bars_daily(s, d).where(is_last()).select("symbol", "market", F.create_map(*[F.lit(x) for x in ("VN", "VNINDEX", "TW", "^TWII", "US", "^GSPC")])[F.col("market")].alias("benchmark")),
      q.sql(q.DAILY, "SELECT DISTINCT symbol, market, CASE market WHEN 'VN' THEN 'VNINDEX' WHEN 'TW' THEN '^TWII' ELSE '^GSPC' END AS benchmark FROM bars"))
WATCH = lambda s, d: table(s, d, "part").where(F.col("p_size") >= 50).select(F.col("p_brand").alias("symbol")).distinct()
R.add("j8_watch_list_semi", lambda s, d: bars_daily(s, d).join(WATCH(s, d), "symbol", "left_semi").groupBy("symbol").agg(F.sum("volume").alias("volume")),
      q.sql(q.DAILY, "SELECT symbol, sum(volume) AS volume FROM bars WHERE symbol IN (SELECT p_brand FROM part WHERE p_size >= 50) GROUP BY symbol"))
SENT = lambda s, d: bars_hourly(s, d).where(F.col("bar_no") % 3 == 0).select(F.concat_ws("|", "symbol", F.date_format("ts", "yyyy-MM-dd HH")).alias("alert_key"))
R.add("j9_unsent_anti", lambda s, d: bars_hourly(s, d).withColumn("alert_key", F.concat_ws("|", "symbol", F.date_format("ts", "yyyy-MM-dd HH"))).join(SENT(s, d), "alert_key", "left_anti").select("alert_key", "close"),
      q.sql(q.HOURLY, "SELECT symbol || '|' || strftime(ts, '%Y-%m-%d %H') AS alert_key, close FROM hours WHERE bar_no % 3 <> 0"))
R.add("j11_nearest_level", lambda s, d: joins.nearest(
    bars_daily(s, d).where(is_last()).select("symbol", F.col("close").alias("price")),
    tail(bars_daily(s, d), 40).select("symbol", F.col("bar_no").alias("zone_no"), F.col("high").alias("level")), "price", "level", side="short").select("symbol", "price", F.col("level"), "distance"),
      q.sql([q.DAILY, "p AS (SELECT symbol, close AS price FROM bars WHERE bar_no = n_bars - 1)",
             "c AS (SELECT p.symbol, price, high AS level, abs(high - price) / price AS distance, bar_no FROM p JOIN bars USING (symbol) WHERE bar_no >= n_bars - 40 AND high > price)"],
            "SELECT p.symbol, p.price, z.level, z.distance FROM p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY distance, bar_no) AS rn FROM c) z ON p.symbol = z.symbol AND z.rn = 1"))
R.add("j12_levels_in_band", lambda s, d: tail(bars_daily(s, d), 120).groupBy("symbol").agg(F.max("high").alias("hi"), F.min("low").alias("lo"), F.max_by("close", "bar_no").alias("c")).select(
    "symbol", joins.band_exists(F.transform(F.array(*[F.lit(x) for x in (0.236, 0.382, 0.5, 0.618)]), lambda r: F.col("hi") - (F.col("hi") - F.col("lo")) * r), F.col("c") * 0.9, F.col("c") * 1.1, F.col("c") * 0.01).alias("near_fib")),
      q.sql([q.DAILY, "a AS (SELECT symbol, max(high) AS hi, min(low) AS lo, arg_max(close, bar_no) AS c FROM bars WHERE bar_no >= n_bars - 120 GROUP BY symbol)"],
            "SELECT symbol, len(list_filter([hi - (hi - lo) * 0.236, hi - (hi - lo) * 0.382, hi - (hi - lo) * 0.5, hi - (hi - lo) * 0.618], lambda x: x BETWEEN c * 0.9 - c * 0.01 AND c * 1.1 + c * 0.01)) > 0 AS near_fib FROM a"))
R.add("j15_pair_correlations", lambda s, d: (lambda p: p.select("a", "b", "days", fix("corr", 6).alias("corr"), fix("cov", 4).alias("cov")))(
    joins.pairwise(__import__("tickloom.operators.indicators", fromlist=["x"]).lagged_returns(bars_daily(s, d), 1).select(*KEY, F.col("log_ret").alias("ret")))),
      q.sql([q.DAILY, f"r AS (SELECT symbol, ts, ln(close / {q.lag('close')}) AS ret FROM bars)"],
            f"SELECT x.symbol AS a, y.symbol AS b, count(*) AS days, {q.fix('corr(x.ret, y.ret)', 6)} AS corr, {q.fix('covar_samp(x.ret, y.ret)', 4)} AS cov FROM r x JOIN r y ON x.ts = y.ts AND x.symbol <= y.symbol WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2"))


def sources(s, d):
    b = bars_daily(s, d).select("symbol", "ts", "close", "market")
    fresh = b.where(F.col("market") == "VN")
    primary = b.where(F.col("market") != "US").withColumn("close", F.col("close") + 1)
    return joins.by_source_priority([fresh, primary, b.withColumn("close", F.col("close") + 2)])


R.add("j16_source_priority", lambda s, d: sources(s, d).select("symbol", "ts", "close", "src_rank"),
      q.sql(q.DAILY, "SELECT symbol, ts, close + CASE market WHEN 'VN' THEN 0 WHEN 'TW' THEN 1 ELSE 2 END AS close, CASE market WHEN 'VN' THEN 0 WHEN 'TW' THEN 1 ELSE 2 END AS src_rank FROM bars"))
R.add("j17_asset_bundle", lambda s, d: bars_daily(s, d).where(is_last()).select("symbol", "market").join(
    tail(bars_daily(s, d), 252).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ts", "close"))).alias("bars")), "symbol", "left").join(
    table(s, d, "part").groupBy(F.col("p_brand").alias("symbol")).agg(F.round(F.avg("p_retailprice"), 2).alias("_p"), F.count(F.lit(1)).alias("n_parts")), "symbol", "left").select(
    "symbol", "market", F.size("bars").alias("n_recent"), F.element_at("bars", -1)["close"].alias("last_close"), "n_parts"),
      q.sql(q.DAILY, "SELECT symbol, any_value(market) AS market, least(count(*), 252) AS n_recent, arg_max(close, bar_no) AS last_close, (SELECT count(*) FROM part WHERE p_brand = symbol) AS n_parts FROM bars GROUP BY symbol"))

# ---- set operations and top-k ------------------------------------------------------------------
R.add("se1_union_keep_last", lambda s, d: joins.keep_last(raw_sessions(s, d).withColumn("day", F.col("ts").cast("date")).select("symbol", "day", "close", "ingest_seq"), ["symbol", "day"], "ingest_seq"),
      q.sql(q.DAILY, "SELECT symbol, CAST(ts AS DATE) AS day, close + 1 AS close, 1 AS ingest_seq FROM bars"))
R.add("se3_concat_of_tops", lambda s, d: (lambda t: t.where(F.col("market") == "VN").orderBy(F.desc("volume"), "symbol").limit(3).unionByName(t.where(F.col("market") == "TW").orderBy(F.desc("volume"), "symbol").limit(3)))(
    bars_daily(s, d).groupBy("symbol", "market").agg(F.sum("volume").alias("volume"))),
      q.sql([q.DAILY, "t AS (SELECT symbol, market, sum(volume) AS volume FROM bars GROUP BY symbol, market)"],
            "(SELECT * FROM t WHERE market = 'VN' ORDER BY volume DESC, symbol LIMIT 3) UNION ALL (SELECT * FROM t WHERE market = 'TW' ORDER BY volume DESC, symbol LIMIT 3)"))
R.add("se4_overlap_and_difference", lambda s, d: (lambda a, b: a.intersect(b).withColumn("kind", F.lit("both")).unionByName(a.exceptAll(b).withColumn("kind", F.lit("only"))))(
    bars_daily(s, d).where(is_last()).select("symbol"), WATCH(s, d)),
      q.sql(q.DAILY, "SELECT DISTINCT symbol, CASE WHEN symbol IN (SELECT p_brand FROM part WHERE p_size >= 50) THEN 'both' ELSE 'only' END AS kind FROM bars"))
R.add("tk1_multi_key_top", lambda s, d: bars_daily(s, d).orderBy("market", F.desc("volume"), F.desc("close"), "symbol", "ts").limit(25).select("market", *KEY, "volume", "close"),
      q.sql(q.DAILY, "SELECT market, symbol, ts, volume, close FROM bars ORDER BY market, volume DESC, close DESC, symbol, ts LIMIT 25"))
R.add("tk2_last_n_per_symbol", lambda s, d: tail(bars_daily(s, d), 20).select(*KEY, "close"),
      q.sql(q.DAILY, "SELECT symbol, ts, close FROM bars WHERE bar_no >= n_bars - 20"))
R.add("tk3_first_max", lambda s, d: bars_daily(s, d).groupBy("symbol").agg(F.max_by("ts", F.struct("volume", -F.col("bar_no"))).alias("ts"), F.max("volume").alias("volume")),
      q.sql(q.DAILY, "SELECT symbol, ts, volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, bar_no) AS rn FROM bars) WHERE rn = 1"))

# ---- resampling --------------------------------------------------------------------------------
RESAMPLED = "symbol, ts, open, high, low, close, volume"


def coarse(src: str, bucket: str) -> str:
    return f"SELECT symbol, {bucket} AS ts, first(open ORDER BY bar_no) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY bar_no) AS close, sum(volume) AS volume FROM {src} GROUP BY symbol, {bucket}"


R.add("a1_weekly_bars", lambda s, d: rs.resample_bars(bars_daily(s, d), rs.week_end("ts")), q.sql(q.DAILY, coarse("bars", "CAST(date_trunc('week', bars.ts) + INTERVAL 6 DAY AS TIMESTAMP)")))
R.add("a1_monthly_bars", lambda s, d: rs.resample_bars(bars_daily(s, d), F.date_trunc("month", "ts").cast("timestamp_ntz")), q.sql(q.DAILY, coarse("bars", "CAST(date_trunc('month', bars.ts) AS TIMESTAMP)")))
R.add("a1_four_hour_bars", lambda s, d: rs.resample_bars(bars_hourly(s, d), rs.four_hours("ts")), q.sql(q.HOURLY, coarse("hours", "CAST(time_bucket(INTERVAL 4 HOUR, hours.ts) AS TIMESTAMP)")))
R.add("a2_latest_snapshot", lambda s, d: rs.latest(bars_daily(s, d)).select("symbol", "ts", "close", "volume"),
      q.sql(q.DAILY, "SELECT symbol, ts, close, volume FROM bars WHERE bar_no = n_bars - 1"))
R.add("a2_latest_quote", lambda s, d: rs.latest_quote(bars_daily(s, d)),
      q.sql([q.DAILY, f"l AS (SELECT *, {q.lag('close')} AS pc FROM bars)"], "SELECT symbol, ts, close AS price, volume, pc AS prev_close, close - pc AS change, (close - pc) / pc * 100 AS change_pct FROM l WHERE bar_no = n_bars - 1"))

QUERIES, ORACLES = R.queries, R.oracles
