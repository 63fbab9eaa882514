"""Hand-computed examples."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import collect, to_bars, walk
from tickloom.operators import clean, flow, risk, scanner, smc, trade_plans as plans, wyckoff
from tickloom.operators import indicators as ind


def bars_of(spark, rows, cols="symbol string, ts timestamp, open double, high double, low double, close double, volume double"):
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in cols.split(", ")])
    return spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_one_traded_bar_per_session(spark):
    t = pd.Timestamp
    rows = [("A", t("2026-04-29 00:00"), 1.0, 2.0, 1.0, 1.5, 10.0), ("A", t("2026-04-29 07:00"), 1.0, 2.0, 1.0, 1.6, 12.0),
            ("A", t("2026-04-30 00:00"), 1.0, 1.0, 1.0, 1.0, 0.0), ("A", t("2026-05-04 07:00"), 1.0, 2.0, 1.0, 1.7, 9.0)]
    d = collect(clean.canonical_sessions(bars_of(spark, rows).withColumn("ingest_seq", F.unix_seconds(F.col("ts").cast("timestamp")))), "ts")
    assert [str(x.date()) for x in d.ts] == ["2026-04-29", "2026-05-04"] and list(d.close) == [1.6, 1.7]


def test_gap_fill_share(spark):
    hi, lo, cl = [100, 103, 113, 112, 109, 110], [98, 100, 110, 109, 104, 107], [99, 102, 112, 110, 106, 109]
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2026-01-01", periods=6), "open": [float(c) for c in cl], "high": [float(x) for x in hi], "low": [float(x) for x in lo], "close": [float(x) for x in cl], "volume": 1.0})
    g = smc.fair_value_gaps(to_bars(spark, pdf)).where("direction = 'Bullish'").toPandas()
    assert (100.0, 110.0) in set(zip(g.bottom, g.top))
    assert g.loc[g.bottom == 100.0, "filled_pct"].iloc[0] == pytest.approx(0.60)


def test_mixed_units_become_units(spark):
    rows = [("A", pd.Timestamp("2026-01-01"), 26.2, 26.5, 26.0, 26.4, 1.0), ("A", pd.Timestamp("2026-01-02"), 26300.0, 26600.0, 26100.0, 26400.0, 1.0)]
    d = clean.normalize_units(bars_of(spark, rows)).toPandas()
    assert list(d.close.round(6)) == [26400.0, 26400.0]
    same = clean.normalize_units(bars_of(spark, rows), exempt=F.col("symbol") == "A").toPandas()
    assert sorted(same.close) == [26.4, 26400.0]


def test_forming_candle_is_dropped(spark):
    t = lambda x: pd.Timestamp(f"2026-01-05 {x}")
    rows = [("A", t(x), 1.0, 1.0, 1.0, 1.0, 1.0) for x in ("09:45", "10:00", "10:15")]
    now = F.lit("2026-01-05 10:17:00").cast("timestamp_ntz")
    assert clean.confirmed_candles(bars_of(spark, rows), now, 15).count() == 2
    daily = walk(45, 1, start="2025-11-01")
    assert clean.confirmed_candles(bars_of(spark, [tuple(r) for r in daily.itertuples(index=False)]), now, 15).count() == 0


def hourly(last_high=1.0, n=40, daily=False):
    c = [0.985 * 26400 + (26400 - 0.985 * 26400) * i / (n - 1) for i in range(n)]
    ts = pd.date_range("2026-03-01", periods=n, freq="D" if daily else "h")
    p = pd.DataFrame({"symbol": "A", "ts": ts, "open": c, "high": [x + 120 for x in c], "low": [x - 120 for x in c], "close": c, "volume": 1e5})
    p.loc[n - 1, "high"] *= last_high
    return p


def test_intraday_feed_rules(spark):
    now = lambda p: F.lit(str(p.ts.max())).cast("timestamp_ntz")
    p = hourly()
    assert clean.validate_intraday(to_bars(spark, p), now(p)).first()["reason"] == "OK"
    d = hourly(daily=True)
    assert clean.validate_intraday(to_bars(spark, d), now(d)).first()["reason"] == "Daily fallback is not an intraday feed"
    assert clean.validate_intraday(to_bars(spark, p), F.lit("2026-04-01").cast("timestamp_ntz")).first()["reason"] == "H1 data is stale"
    assert clean.validate_intraday(to_bars(spark, p.head(10)), now(p)).first()["reason"] == "Need at least 14 H1 bars"


def test_intraday_plan_zones(spark):
    p = hourly(last_high=1.12)
    bars = to_bars(spark, p)
    valid = clean.validate_intraday(bars, F.lit(str(p.ts.max())).cast("timestamp_ntz"))
    zones = spark.createDataFrame([("A", 1, 16377.71, 15758.51), ("A", 2, 26100.0, 25900.0)], "symbol string, zone_no int, top double, bottom double")
    r = plans.intraday_plan(bars, zones, valid).first()
    assert r["entry"] == 26100.0
    assert 26100 * 0.96 - 1e-6 <= r["stop"] <= 26100 * 0.985 + 1e-6
    assert r["phase0"] < 26400 * 1.03  # the forming spike of the newest bar is not used
    far = plans.intraday_plan(bars, zones.where("zone_no = 1"), valid).first()
    assert far["entry"] == pytest.approx(26400 * 0.995)


def test_risk_scalars(spark):
    flat = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2026-01-01", periods=100), "open": 100.0, "high": 100.0, "low": 100.0, "close": 100.0, "volume": 1.0})
    assert ind.rsi(to_bars(spark, flat)).where("bar_no = 99").first()["rsi"] == pytest.approx(50)
    curve = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2026-01-01", periods=4), "close": [100000.0, 98000.0, 84000.0, 96000.0]})
    assert list(collect(risk.circuit_breaker(to_bars(spark, curve)), "bar_no").halted) == [False, False, True, False]
    two = curve.head(2)
    assert risk.value_at_risk(to_bars(spark, two)).first()["var_pct"] == 0.0
    v = risk.value_at_risk(to_bars(spark, walk(300, 4))).first()
    assert v["cvar_pct"] >= v["var_pct"] > 0
    k = spark.range(1).select(risk.kelly_fraction(F.lit(0.6), F.lit(2.0), F.lit(1.0)).alias("k"), risk.kelly_fraction(F.lit(0.0), F.lit(2.0), F.lit(1.0)).alias("z")).first()
    assert k["k"] == pytest.approx(0.2) and k["z"] == 0.02


def test_missing_flow_is_neutral(spark, walks):
    d = flow.real_flow(to_bars(spark, walks))
    assert d.where("real_flow_available OR real_flow_signal <> 0").count() == 0
    with_flow = to_bars(spark, walks).withColumns({"foreign_buy": F.col("volume") * 0.6, "foreign_sell": F.col("volume") * 0.1, "block_volume": F.col("volume") * 0.3})
    r = flow.real_flow(with_flow)
    assert r.where("real_flow_available").count() == len(walks) and r.where("real_flow_signal = 1").count() > 0
    assert flow.quant_money_flow(to_bars(spark, walks).drop("volume")).select("qmf_reason").distinct().first()[0] == "MISSING_OHLCV"


def test_radar_slices_wide_zones(spark):
    p = pd.DataFrame({"symbol": "A", "ts": pd.bdate_range("2026-01-01", periods=60), "close": [24500 + (25550 - 24500) * i / 59 for i in range(60)]})
    p["open"], p["high"], p["low"], p["volume"] = p.close, p.close + 500, p.close - 500, 8e6
    bars = to_bars(spark, p)
    zone = lambda kind, top, bottom, w, n: f"named_struct('kind', '{kind}', 'direction', 'Bullish', 'top', {top}D, 'bottom', {bottom}D, 'weight', {w}D, 'bar_no', {n}L, 'ts', timestamp_ntz'2026-01-01', 'seq', {n}L)"
    state = bars.where("bar_no = 59").selectExpr(
        "symbol", "ts", "close AS current_price", "n_bars", "30.0D AS stoch_k", "'OVERSOLD' AS stoch_status", "true AS stoch_crossover", "1 AS smc_signal", "true AS smc_sweep_bull", "false AS smc_idm_bull",
        f"array({zone('FVG', 25500, 23600, 0.8, 50)}, {zone('FVG', 25600, 25250, 0.9, 55)}) AS zones")
    wy = spark.createDataFrame([("A", "PHASE C")], "symbol string, phase string")
    ctx = scanner.zone_context(state, bars, wy)
    r = collect(scanner.entry_radar(ctx), "zone_rank")
    assert (r.entry_low > 23600).all()
    assert r.source_low[0] == 25250 and r.status[0] == "ZONE_TOUCH"
    gate = spark.createDataFrame([("A", True, True, True)], "symbol string, buy_triggered boolean, mtf_confirmed boolean, h1_actionable boolean")
    assert collect(scanner.entry_radar(ctx, gate), "zone_rank").status[0] == "BUY_TRIGGERED"


def test_scale_breaks(spark):
    p = walk(60, 1)
    whole = p.copy()
    p.loc[:19, ["open", "high", "low", "close"]] /= 1000
    got = collect(clean.repair_scale_breaks(to_bars(spark, p)), "ts")
    jump = p.close[20] / p.close[19]
    assert got.close[0] == pytest.approx(p.close[0] * jump)
    assert len(got) == 60 and got.close[20] == whole.close[20]
    assert clean.scale_is_consistent(to_bars(spark, p)).first()["consistent"] is False


def test_reward_risk_struct(spark):
    r = spark.range(1).select(wyckoff.reward_risk(F.lit(100.0), F.lit(95.0), F.lit(112.0)).alias("a"), wyckoff.reward_risk(F.lit(100.0), F.lit(101.0), F.lit(112.0)).alias("b")).first()
    assert (r["a"]["rr"], r["a"]["valid"]) == (2.4, True) and (r["b"]["rr"], r["b"]["valid"]) == (0.0, False)


def test_symbol_cleaning(spark):
    d = spark.createDataFrame([("6770.TWO",), ("2330_TW",), ("vnm.VN",), ("GC=F",), ("BTC-USD",)], "s string")
    assert [r[0] for r in d.select(clean.clean_symbol(F.col("s"))).collect()] == ["6770", "2330", "VNM", "GC_F", "BTC_USD"]
    assert [r[0] for r in d.select(clean.infer_market(F.col("s"))).collect()] == ["TW", "US", "VN", "US", "US"]


def test_sentiment_is_rounded_as_its_sql_rounds_it(spark):
    import duckdb

    from tickloom.operators import news

    rows = [(n, n // 909 / 10 - 1, (n // 101 % 9 - 4) / 10, n % 101) for n in range(21 * 909)]
    df = spark.createDataFrame(rows, "id long, news_score double, social_score double, fear_greed long")
    got = [tuple(r) for r in news.composite_sentiment(df).orderBy("id").select("composite_score", "confidence").collect()]
    want = duckdb.sql("""WITH r AS (SELECT n, n // 909 / 10.0::DOUBLE - 1 AS nw, (n // 101 % 9 - 4) / 10.0::DOUBLE AS so, n % 101 AS fg FROM range(19089) t(n)),
 c AS (SELECT *, nw * 0.6 + so * 0.3 + (fg - 50) / 50 * 0.1 AS cs FROM r)
 SELECT round_even(cs, 4), round_even(least((abs(cs) * 0.5 + 0.5) * CASE WHEN nw * so > 0 THEN 1.0 ELSE 0.7 END * 100, 99), 1) FROM c ORDER BY n""").fetchall()
    assert got == want and (-0.57, 55.0) in got


def test_fundamental_points_are_scaled_in_the_order_of_the_sql(spark):
    from tickloom.operators import fundamentals as fd

    points = {"roe": (0, 6, 12, 20), "debt_to_equity": (0, 5, 10, 15), "revenue_growth": (0, 3, 7, 10), "profit_margin": (0, 1, 3, 5)}
    value = {"roe": (0.0, 0.05, 0.1, 0.15), "debt_to_equity": (3.0, 2.0, 1.0, 0.5), "revenue_growth": (0.0, 0.03, 0.08, 0.15), "profit_margin": (0.0, 0.05, 0.1, 0.2)}
    rows, want = [], {}
    for n in range(4**4 * 2):
        at = {m: n // 4**i % 4 for i, m in enumerate(points)}
        pe = n >= 4**4
        rows.append((n, *[value[m][k] for m, k in at.items()], 0.0, 0.0, 40.0 if pe else None))
        want[n] = min(100, int(sum(points[m][k] for m, k in at.items()) / (100 if pe else 85) * 100))
    df = spark.createDataFrame(rows, "symbol long, roe double, debt_to_equity double, revenue_growth double, profit_margin double, eps_growth double, fcf_yield double, pe_ratio double")
    got = {r.symbol: r.total_score for r in fd.fundamental_score(df).select("symbol", "total_score").collect()}
    assert got == want and 28 in want.values()  # 29 points of 100: 29 / 100 * 100 is 28.999999999999996
