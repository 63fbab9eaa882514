"""Sources, sinks, reports, registries and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.functions.series import index_bars, is_last, tail
from tickloom.operators import context as cx
from tickloom.operators import flow, indicators as ind, scanner as sc
from tickloom.operators import profile, risk
from tickloom.plans import sqlkit as q
from tickloom.plans.clean_join_checks import INSTR, instruments, raw_sessions, SESS
from tickloom.plans.flow_context_checks import BINS, FS, GR, QMF_LAYERS, QUOTES, SPAN, statement
from tickloom.plans.registry import KEY, Registry, fix, rounded, sel
from tickloom.plans.risk_ml_checks import var_sql
from tickloom.plans.scanner_checks import MID, RATED, SCAN, SHORT, rated, scan
from tickloom.session import scratch_root
from tickloom.sources import registry, store
from tickloom.sources.barstore import BarStore
from tickloom.sources.driver_tables import bars_daily, bars_hourly, benchmark_daily, table

R = Registry()
OHLCV = ["open", "high", "low", "close", "volume"]


def scratch(s):
    return f"{scratch_root(s)}/checks/{uuid.uuid4().hex}"


def upserted(s, d):
    """Bars landed in two overlapping deliveries, merged, written by market and read back."""
    b = bars_daily(s, d).select("symbol", "ts", *OHLCV, "market")
    old = b.where(F.col("ts") < F.lit("2000-01-01").cast("timestamp_ntz"))
    new = b.where(F.col("ts") >= F.lit("1999-06-01").cast("timestamp_ntz")).withColumn("close", F.col("close") + 5000.0)
    path = scratch(s)
    store.write_bars(store.merge_bars(old.withColumns({c: F.col(c) + 5000.0 for c in OHLCV[:4]}), new.withColumns({c: F.col(c) + 5000.0 for c in OHLCV[:3]})), path)
    return store.read_bars(s, path)


R.add("s2_upserted_bars", lambda s, d: upserted(s, d).select(*KEY, "close", "volume", "market"), q.sql(q.DAILY, "SELECT symbol, ts, close + 5000.0 AS close, volume, market FROM bars"))


def merged_in_place(s, d):
    """Three deliveries merged one after the other, the last one twice."""
    b = bars_daily(s, d).select("symbol", "ts", *OHLCV, "market")
    since = lambda t: F.col("ts") >= F.lit(t).cast("timestamp_ntz")
    keep = BarStore(s, scratch(s))
    keep.merge(b.where(~since("1998-01-01")), 0)
    keep.merge(b.where(since("1996-06-15") & ~since("1997-02-01")).withColumn("close", F.col("close") + 1), 1)
    for _ in range(2):
        keep.merge(b.where(since("1997-01-10") & (F.col("market") != "US")).withColumn("volume", F.col("volume") * 2), 2)
    return keep.read()


R.add("s2_merged_in_place", lambda s, d: merged_in_place(s, d).select(*KEY, "close", "volume", "market"),
      q.sql(q.DAILY, """SELECT symbol, ts, close + CASE WHEN ts >= '1996-06-15' AND ts < '1997-02-01' AND NOT (ts >= '1997-01-10' AND market <> 'US') THEN 1.0 ELSE 0 END AS close,
 volume * CASE WHEN ts >= '1997-01-10' AND market <> 'US' THEN 2.0 ELSE 1.0 END AS volume, market FROM bars WHERE ts < '1998-01-01' OR market <> 'US'"""))


def instrument_list(s, d):
    path = scratch(s)
    x = instruments(s, d).withColumn("updated", F.lit("2024-01-01").cast("timestamp_ntz") - F.make_dt_interval(days=F.length("name")))
    x.write.parquet(path)
    return store.fresh(s.read.parquet(path), F.lit("2024-01-01").cast("timestamp_ntz"), 24 * 9)


R.add("s3_fresh_instruments", lambda s, d: instrument_list(s, d).select("symbol", "market"), q.sql(INSTR, "SELECT symbol, market FROM i WHERE length(name) <= 9"))


def stored_fundamentals(s, d):
    from tickloom.operators.fundamentals import ttm_ratios

    path, now = scratch(s), F.lit("2024-01-08").cast("timestamp_ntz")
    r = ttm_ratios(statement(s, d), QUOTES(s, d)).drop("fcf").withColumns({"symbol": F.col("symbol").cast("string"), "market": F.lit("VN"), "updated": F.lit("2024-01-08").cast("timestamp_ntz") - F.make_dt_interval(hours=F.col("symbol").cast("int") * 10)})
    store.write_fundamentals(r.withColumns({m: F.when(F.col("symbol") != "3", F.col(m)) for m in store.METRICS}), path)
    return store.read_fundamentals(s, path, now)


R.add("s4_stored_fundamentals", lambda s, d: stored_fundamentals(s, d).select("symbol", fix("roe", 5).alias("roe")), q.sql(FS[:5], f"SELECT CAST(symbol AS VARCHAR) AS symbol, {q.fix('roe', 5)} AS roe FROM ra WHERE symbol <> 3 AND symbol * 10 <= 168"))


def csv_bars(s, d):
    path = scratch(s)
    store.write_csv(bars_daily(s, d).select("symbol", "ts", *OHLCV, "market"), path)
    return store.read_bars_csv(s, path)


for nm in ("s5_csv_bars", "s9_csv_export"):
    R.add(nm, lambda s, d: csv_bars(s, d).select(*KEY, *OHLCV, "market"), q.sql(q.DAILY, "SELECT symbol, ts, open, high, low, close, volume, market FROM bars"))


def second_choice(s, d):
    """Even brands are in the store, up to 1996 only; the CSV files have all, at other prices."""
    b = bars_daily(s, d).select("symbol", "ts", *OHLCV, "market")
    stored, spare = scratch(s), scratch(s)
    even = F.regexp_replace("symbol", "Brand#", "").cast("int") % 2 == 0
    store.write_bars(b.where(even & (F.col("ts") < F.lit("1997-01-01").cast("timestamp_ntz"))), stored)
    store.write_csv(b.withColumn("close", F.col("close") + 1), spare)
    return store.read_bars_first(s, stored, spare, "1994-01-01", "1998-06-30")


R.add("s5_csv_as_second_choice", lambda s, d: second_choice(s, d).select(*KEY, "close", "source"),
      q.sql([q.DAILY, "z AS (SELECT *, CAST(replace(symbol, 'Brand#', '') AS INT) % 2 = 0 AS even FROM bars WHERE ts >= '1994-01-01' AND ts <= '1998-06-30')"],
            "SELECT symbol, ts, CASE WHEN even THEN close ELSE close + 1 END AS close, CASE WHEN even THEN 'parquet' ELSE 'csv' END AS source FROM z WHERE NOT even OR ts < '1997-01-01'"))


def bundles(s, d):
    i = bars_daily(s, d).groupBy("symbol").agg(F.first("market").alias("market")).unionByName(s.createDataFrame([("none", "US")], "symbol string, market string"))
    f = table(s, d, "part").groupBy(F.col("p_brand").alias("symbol")).agg(F.count(F.lit(1)).alias("n_parts"))
    return store.asset_bundles(i, bars_daily(s, d), f, "1993-03-01", "1997-09-30")


R.add("j17_asset_bundles_by_year", lambda s, d: bundles(s, d).select(
    "symbol", "info.market", "fundamentals.n_parts", "page", F.col("pages").cast("long").alias("pages"), F.size("bars").alias("n_bars"), F.get("bars", F.lit(0))["ts"].alias("first_ts"),
    F.try_element_at("bars", F.lit(-1))["close"].alias("last_close"), fix(F.aggregate("bars", F.lit(0.0), lambda a, b: a + b["volume"]), 3).alias("volume")),
      q.sql([q.DAILY, "i AS (SELECT symbol, any_value(market) AS market FROM bars GROUP BY symbol UNION ALL SELECT 'none', 'US')",
             "g AS (SELECT symbol, date_trunc('year', ts) AS y, count(*) AS n_bars, min(ts) AS first_ts, arg_max(close, ts) AS last_close, sum(volume) AS volume FROM bars WHERE ts >= '1993-03-01' AND ts <= '1997-09-30' GROUP BY 1, 2)",
             "h AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY y) AS page, count(*) OVER (PARTITION BY symbol) AS pages FROM g)"],
            f"SELECT symbol, market, (SELECT nullif(count(*), 0) FROM part WHERE p_brand = i.symbol) AS n_parts, coalesce(page, 1) AS page, coalesce(pages, 1) AS pages, coalesce(n_bars, 0) AS n_bars, first_ts, last_close, {q.fix('coalesce(volume, 0)', 3)} AS volume FROM i LEFT JOIN h USING (symbol)"))


def cot_files(s, d):
    """Weekly order totals written in the yearly positioning format, read back and derived."""
    path = scratch(s)
    w = table(s, d, "orders").groupBy(F.date_trunc("week", "o_orderdate").alias("w"), "o_orderstatus").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    p = w.groupBy("w").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.first("v"))
    money = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    p.select(F.lit(" 088691 ").alias("CFTC_Contract_Market_Code"), F.date_format("w", "yyMMdd").alias("As_of_Date_In_Form_YYMMDD"), (F.coalesce("F", F.lit(0)) + F.coalesce("O", F.lit(0)) + F.coalesce("P", F.lit(0))).cast("string").alias("Open_Interest_All"),
             money("O").alias("Comm_Positions_Long_All"), money("F").alias("Comm_Positions_Short_All"), money("P").alias("NonComm_Positions_Long_All"), money("P").alias("NonComm_Positions_Short_All"),
             F.year("w").alias("y")).write.partitionBy("y").option("header", True).csv(path)
    return store.read_positioning_csv(s, path, "088691")


R.add("s6_positioning_files", lambda s, d: cot_files(s, d).select("ts", "commercial_net", "short_ratio", "short_change"),
      q.sql([q.POSITIONING, "z AS (SELECT ts, bar_no, open_interest, coalesce(commercial_short, 0) AS cs, coalesce(commercial_long, 0) AS cl FROM pos)"], "SELECT ts, cl - cs AS commercial_net, cs / nullif(open_interest, 0) AS short_ratio, cs - lag(cs) OVER (ORDER BY bar_no) AS short_change FROM z"))


def scan_round_trip(s, d):
    path = scratch(s)
    x = scan(s, d).select("symbol", "market", F.when(F.col("k") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("institutional_score")).alias("institutional_score"), "veto")
    store.write_scan(x, path, "2024-01-01", "VN_TW")
    return store.read_scan(s, path, x.schema)


for nm in ("s7_scan_results", "f10_json_round_trip"):
    R.add(nm, lambda s, d: scan_round_trip(s, d), q.sql(SCAN, "SELECT symbol, market, CASE WHEN k % 10 = 0 THEN NULL ELSE institutional_score END AS institutional_score, veto FROM scan"))
R.add("s8_report_snapshot", lambda s, d: store.snapshot(scan(s, d)).select(
    F.get_json_object("snapshot", "$.total_candidates").cast("long").alias("total"), F.get_json_object("snapshot", "$.counts.grade_a").cast("long").alias("grade_a"), F.get_json_object("snapshot", "$.top_a[0].symbol").alias("first_pick")),
      q.sql(SCAN, "SELECT count(*) AS total, CAST(count_if(entry_quality_grade = 'A') AS BIGINT) AS grade_a, (SELECT symbol FROM scan WHERE entry_quality_grade = 'A' ORDER BY institutional_score DESC, symbol LIMIT 1) AS first_pick FROM scan"))


def report(s, d):
    path = scratch(s)
    rows = sc.position_size(sc.ranks(rated(scan(s, d))))
    store.write_report(rows, path)
    out = None
    for name in ("top_picks", "short_term_picks", "vn_ranking", "tw_ranking", "position_sizing", "all_stocks", "scan_info"):
        one = s.read.option("header", True).csv(f"{path}/{name}").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("report_table", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


R.add("s10_report_tables", report, q.sql(SCAN, "SELECT 'top_picks' AS report_table, 20 AS n_rows UNION ALL SELECT 'scan_info', 1 UNION ALL SELECT unnest(['short_term_picks', 'position_sizing', 'all_stocks']), count(*) FROM scan UNION ALL SELECT CASE market WHEN 'VN' THEN 'vn_ranking' ELSE 'tw_ranking' END, count(*) FROM scan WHERE market <> 'US' GROUP BY market"))


def flow_sidecar(s, d):
    b = bars_daily(s, d)
    make = lambda k, m: b.where(F.col("bar_no") % 4 <= m).select(*KEY, (F.col("volume") * k).alias("foreign_buy"), (F.col("volume") * 0.125).alias("foreign_sell"), F.lit(0.0).alias("block_volume"))
    path = scratch(s)
    make(0.25, 1).write.json(path)
    saved = s.read.schema(make(0.25, 1).schema).json(path)
    return store.apply_flow(b.select(*KEY, "close"), saved, make(0.5, 0))


R.add("s11_flow_sidecar", lambda s, d: flow_sidecar(s, d).select(*KEY, "foreign_buy", "foreign_sell"),
      q.sql(q.DAILY, "SELECT symbol, ts, CASE bar_no % 4 WHEN 0 THEN volume * 0.5 WHEN 1 THEN volume * 0.25 ELSE 0 END::DOUBLE AS foreign_buy, CASE WHEN bar_no % 4 <= 1 THEN volume * 0.125 ELSE 0 END::DOUBLE AS foreign_sell FROM bars"))
R.add("s12_training_panel", lambda s, d: store.build_panel(bars_daily(s, d), benchmark_daily(s, d)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), fix(F.avg("rel_strength"), 6).alias("mean_rs")),
      q.sql([q.DAILY, q.BENCH], f"SELECT b.symbol, count(*) AS n_rows, {q.fix('avg(b.close / x.close)', 6)} AS mean_rs FROM bars b JOIN bench x ON b.ts = x.ts GROUP BY b.symbol"))
LINK = 'href="/([A-Za-z]+)">([^<]+)<'
R.add("s13_listing_rows", lambda s, d: store.extract_listing(table(s, d, "pages"), LINK, F.lit(".TW")).select("symbol", "name"),
      f"""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '{LINK}', 1)) AS code, unnest(regexp_extract_all(html, '{LINK}', 2)) AS name, generate_subscripts(regexp_extract_all(html, '{LINK}', 1), 1) AS i FROM pages)
 SELECT code || '.TW' AS symbol, arg_max(trim(name), page_id * 100000 + i) AS name FROM m GROUP BY code""")


def ratings(s, d):
    path = scratch(s)
    x = rated(scan(s, d)).select("symbol", "mid_rating", "short_rating")
    x.coalesce(1).write.json(f"{path}/a")
    x.where("symbol LIKE '%7'").withColumn("mid_rating", F.lit("newer")).coalesce(1).write.json(f"{path}/b")
    return store.newest_ratings(s, f"{path}/*", x.schema)


R.add("s15_newest_ratings", ratings, q.sql([SCAN, RATED], "SELECT symbol, CASE WHEN symbol LIKE '%7' THEN 'newer' ELSE mid END AS mid_rating, sht AS short_rating FROM rt"))
R.add("s16_source_coverage", lambda s, d: store.coverage(table(s, d, "part").select(F.when(F.col("p_size") == 7, F.concat("p_brand", F.lit("x"))).otherwise(F.col("p_brand")).alias("symbol")), bars_daily(s, d), 1400),
      q.sql(q.DAILY, "SELECT status, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 2) AS pct FROM (SELECT u.symbol, CASE WHEN c IS NULL THEN 'failed' WHEN c < 1400 THEN 'empty' ELSE 'ok' END AS status FROM (SELECT DISTINCT CASE WHEN p_size = 7 THEN p_brand || 'x' ELSE p_brand END AS symbol FROM part) u LEFT JOIN (SELECT symbol, count(*) AS c FROM bars GROUP BY symbol) b USING (symbol)) GROUP BY status"))

# ---- scalar functions and surfaces ---------------------------------------------------------------------
R.add("f1_string_functions", lambda s, d: table(s, d, "part").select("p_partkey", F.upper("p_name").alias("up"), F.regexp_extract("p_name", "([a-z]+) ", 1).alias("head"), F.concat_ws("|", "p_brand", "p_type").alias("joined"), F.substring("p_name", 2, 4).alias("mid"), F.col("p_name").startswith("b").alias("starts"), F.format_string("%05d", "p_size").alias("padded")),
      "SELECT p_partkey, upper(p_name) AS up, regexp_extract(p_name, '([a-z]+) ', 1) AS head, p_brand || '|' || p_type AS joined, substring(p_name, 2, 4) AS mid, p_name LIKE 'b%' AS starts, printf('%05d', p_size) AS padded FROM part")
R.add("f4_date_functions", lambda s, d: table(s, d, "orders").select("o_orderkey", F.month("o_orderdate").alias("m"), F.weekday("o_orderdate").alias("wd"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("txt"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("mon"), F.datediff(F.lit("2002-01-01"), "o_orderdate").alias("age_days"), store.short_date(F.date_format("o_orderdate", "yyMMdd")).alias("parsed")),
      "SELECT o_orderkey, month(o_orderdate) AS m, isodow(o_orderdate) - 1 AS wd, strftime(o_orderdate, '%Y-%m-%d') AS txt, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS mon, date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS age_days, CAST(o_orderdate AS DATE) AS parsed FROM orders")
R.add("f5_math_functions", lambda s, d: table(s, d, "events").select("event_id", fix(F.log(F.col("value") + 1), 6).alias("lg"), fix(F.tanh(F.col("value") / 50), 6).alias("th"), fix(F.sqrt("value"), 6).alias("sq"), F.signum(F.col("value") - 50).alias("sg"), F.floor(F.col("value") / 7).alias("fl"), F.bround(F.floor("value") / 2, 0).alias("half_even"), F.greatest(F.lit(10.0), F.least("value", F.lit(60.0))).alias("clipped")),
      f"SELECT event_id, {q.fix('ln(value + 1)', 6)} AS lg, {q.fix('tanh(value / 50)', 6)} AS th, {q.fix('sqrt(value)', 6)} AS sq, CAST(sign(value - 50) AS DOUBLE) AS sg, CAST(floor(value / 7) AS BIGINT) AS fl, coalesce(round_even(nullif(floor(value) / 2, 0), 0), 0) AS half_even, greatest(10.0::DOUBLE, least(value, 60.0::DOUBLE)) AS clipped FROM events")
R.add("f6_binning", lambda s, d: table(s, d, "events").select(profile.bin_no(F.col("value"), F.lit(0.0), F.lit(500.0), 20).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n")),
      "SELECT CAST(least(19, floor(value / 25)) AS INT) AS bin, count(*) AS n FROM events GROUP BY 1")
R.add("f7_conditional_labels", lambda s, d: table(s, d, "events").select("event_id", F.when(F.col("value") >= 75, "HIGH").when(F.col("value") >= 25, "MEDIUM").otherwise("LOW").alias("label")),
      "SELECT event_id, CASE WHEN value >= 75 THEN 'HIGH' WHEN value >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS label FROM events")
R.add("f8_array_functions", lambda s, d: tail(bars_daily(s, d), 10).groupBy("symbol").agg(F.array_sort(F.collect_list("close")).alias("a")).select("symbol", F.element_at("a", 1).alias("lowest"), F.size(F.filter("a", lambda x: x > 1000)).alias("n_high"), F.exists("a", lambda x: x > 5000).alias("any_big"), F.element_at(F.slice("a", 3, 2), -1).alias("fourth")),
      q.sql([q.DAILY, "z AS (SELECT symbol, list_sort(list(close)) AS a FROM bars WHERE bar_no >= n_bars - 10 GROUP BY symbol)"], "SELECT symbol, a[1] AS lowest, CAST(len(list_filter(a, lambda x: x > 1000)) AS INT) AS n_high, len(list_filter(a, lambda x: x > 5000)) > 0 AS any_big, a[4] AS fourth FROM z"))
R.add("f9_map_lookup", lambda s, d: bars_daily(s, d).where(is_last()).select("symbol", F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in (("hi", "high"), ("lo", "low"))])).alias("m")).select("symbol", F.col("m")["hi"].alias("hi"), F.coalesce(F.try_element_at("m", F.lit("mid")), F.lit(-1.0)).alias("mid")),
      q.sql(q.DAILY, "SELECT symbol, high AS hi, -1.0::DOUBLE AS mid FROM bars WHERE bar_no = n_bars - 1"))
_c, _l = q.chain("bars", *QMF_LAYERS)
R.add("u1_strategy_chain", lambda s, d: registry.chain(bars_daily(s, d), ind.atr, ind.rsi, flow.quant_money_flow).groupBy("symbol").agg(F.sum("qmf_signal").alias("net"), fix(F.avg("rsi"), 3).alias("mean_rsi")),
      q.sql([q.DAILY, *_c, *q.chain("bars", *q.RSI_LAYERS, prefix="rs")[0]], f"SELECT a.symbol, CAST(sum(a.qmf_signal) AS BIGINT) AS net, {q.fix('avg(b.rsi)', 3)} AS mean_rsi FROM {_l} a JOIN {q.chain('bars', *q.RSI_LAYERS, prefix='rs')[1]} b ON a.symbol = b.symbol AND a.bar_no = b.bar_no GROUP BY a.symbol"))


def from_registry(s, d):
    for m in ("VN", "TW", "US"):
        registry.register(m, lambda spark, start, end, m=m: bars_daily(spark, d).where((F.col("market") == m) & (F.col("ts") >= F.lit(start).cast("timestamp_ntz"))))
    return registry.read_all(s, "2000-01-01").groupBy("market").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("symbol").alias("symbols"))


R.add("u2_market_readers", from_registry, q.sql(q.DAILY, "SELECT market, count(*) AS n, count(DISTINCT symbol) AS symbols FROM bars WHERE ts >= TIMESTAMP '2000-01-01' GROUP BY market"))
R.add("u3_native_row_functions", lambda s, d: bars_daily(s, d).select(*KEY, F.when(F.col("close") > F.col("open"), "up").when(F.col("close") < F.col("open"), "down").otherwise("flat").alias("bar_kind")),
      q.sql(q.DAILY, "SELECT symbol, ts, CASE WHEN close > open THEN 'up' WHEN close < open THEN 'down' ELSE 'flat' END AS bar_kind FROM bars"))
R.add("u4_group_transforms", lambda s, d: ind.sma(bars_daily(s, d), (5,)).select(*KEY, fix(F.try_divide("close", "sma_5"), 5).alias("ma_5_rel")), q.sql(q.DAILY, f"SELECT symbol, ts, {q.fix('close / ' + q.mean('close', 5), 5)} AS ma_5_rel FROM bars"))
R.add("u5_aggregating_kernels", lambda s, d: profile.profile_levels(bars_daily(s, d)).join(risk.value_at_risk(bars_daily(s, d)), "symbol").select(
    "symbol", F.size("levels").alias("n_levels"), fix(F.aggregate("levels", F.lit(0.0), lambda a, x: a + x), 3).alias("levels"), fix("var_pct", 6).alias("var_pct")),
      q.sql([*var_sql("true"), SPAN(80), BINS(24), "lv AS (SELECT symbol, (lo + b * ((hi - lo) / 24) + (lo + (b + 1) * ((hi - lo) / 24))) / 2 AS level FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY vol DESC, b DESC) AS rn FROM bv) WHERE rn <= 3)",
             "ls AS (SELECT symbol, count(*) AS n, sum(level) AS s FROM lv GROUP BY symbol)"],
            f"SELECT symbol, ls.n AS n_levels, {q.fix('s', 3)} AS levels, {q.fix('abs(v)', 6)} AS var_pct FROM ls JOIN v2 USING (symbol)"))

QUERIES, ORACLES = R.queries, R.oracles
