"""Scanner, grading, ranking, plans and report operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.series import at_last, is_last, tail
from tickloom.operators import context as cx
from tickloom.operators import trade_plans as pl
from tickloom.operators import scanner as sc
from tickloom.operators import clean, wyckoff
from tickloom.operators.confluence import confluence, timeframe_bias
from tickloom.operators import indicators as ind
from tickloom.plans import sqlkit as q
from tickloom.plans.flow_context_checks import PA_CTES, PA_LAST
from tickloom.plans.registry import KEY, Registry, fix, sel
from tickloom.plans.smc_checks import FVG, LASTC, OB, state
from tickloom.plans.wyckoff_elliott_checks import CFG, QP, WY_CTES, WY_LAST, wy_table
from tickloom.sources.driver_tables import bars_daily, bars_hourly, benchmark_daily, derived_table, table

R = Registry()

# A wide scan table with one row per order; both engines read the same input expressions.
SCAN_COLUMNS = {
    "symbol": "concat('S', o_orderkey)", "market": "CASE o_orderkey % 3 WHEN 0 THEN 'VN' WHEN 1 THEN 'TW' ELSE 'US' END",
    "sector": "o_orderpriority", "recommendation": "CASE o_orderkey % 4 WHEN 0 THEN 'STRONG BUY' WHEN 1 THEN 'BUY' WHEN 2 THEN 'WATCH' ELSE 'AVOID' END",
    "institutional_score": "((o_orderkey * 37) % 1000) / 800.0e0 - 0.2499987e0", "confidence_boosted": "((o_orderkey * 53) % 1000) / 1500.0e0",
    "ai_confidence": "((o_orderkey * 47) % 1000) / 1200.0e0", "qmf_signal": "CAST(o_orderkey % 3 - 1 AS INT)", "qmf_score": "((o_orderkey * 29) % 200 - 100) / 200.0e0",
    "wyckoff_score": "((o_orderkey * 31) % 200 - 100) / 150.0e0", "smc_score": "((o_orderkey * 41) % 200 - 100) / 150.0e0", "smc_signal": "CAST(o_orderkey % 5 % 3 - 1 AS INT)",
    "stoch_k": "((o_orderkey * 17) % 1000) / 10.0e0", "stoch_d": "((o_orderkey * 19) % 1000) / 10.0e0",
    "pred_21d_ret_raw": "((o_orderkey * 23) % 1200 - 400) / 10.0e0", "pred_63d_ret_raw": "((o_orderkey * 61) % 2000 - 600) / 10.0e0",
    "pred_21d_ret": "((o_orderkey * 23) % 300 - 100) / 10.0e0 + 0.0013e0", "pred_63d_ret": "((o_orderkey * 61) % 500 - 150) / 10.0e0 + 0.0013e0",
    "daily_vol": "((o_orderkey * 7) % 100) / 2000.0e0", "last_close": "CASE WHEN o_orderkey % 97 = 0 THEN 0.0e0 ELSE o_totalprice / 1000.0e0 + 0.0001371e0 END",
    "ai_target_1d": "o_totalprice / 990.0e0 + 0.0001371e0", "ai_target": "o_totalprice / 950.0e0 + 0.0001371e0", "ai_bias": "CASE o_orderkey % 3 WHEN 0 THEN 'Bullish' WHEN 1 THEN 'Bearish' ELSE 'Neutral' END",
    "wyckoff_target": "CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice / 900.0e0 + 0.0001371e0 ELSE 0.0e0 END", "wyckoff_rr": "(o_orderkey % 4) / 1.5e0", "rs_score": "((o_orderkey * 71) % 1000 - 600) / 100.0e0",
    "wyckoff_phase": "CASE o_orderkey % 4 WHEN 0 THEN 'PHASE C' WHEN 1 THEN 'RANGE' WHEN 2 THEN 'MARKUP' ELSE 'ACCUMULATION' END",
    "smc_entry_status": "CASE o_orderkey % 5 WHEN 0 THEN 'READY' WHEN 1 THEN 'NEAR' WHEN 2 THEN 'WATCH' WHEN 3 THEN 'WAIT' ELSE 'NONE' END",
    "smc_entry_type": "CASE o_orderkey % 2 WHEN 0 THEN 'FVG' ELSE 'OB' END", "smc_entry_score": "CAST((o_orderkey * 13) % 9 AS INT)", "smc_entry_low": "o_totalprice / 1020.0e0 + 0.0001371e0", "smc_entry_high": "o_totalprice / 1005.0e0 + 0.0001371e0",
    "smc_entry_stop": "o_totalprice / 1050.0e0 + 0.0001371e0", "smc_entry_target": "o_totalprice / 930.0e0 + 0.0001371e0", "smc_entry_rr": "(o_orderkey % 6) / 2.0e0", "smc_entry_distance_pct": "(o_orderkey % 40) / 10.0e0 + 0.0013e0",
    "stoch_state": "CASE (o_orderkey * 3) % 4 WHEN 0 THEN 'OVERBOUGHT' WHEN 1 THEN 'OVERSOLD' ELSE 'NEUTRAL' END", "veto": "o_orderkey % 11 = 0",
    "entry_quality_grade": "CASE (o_orderkey * 7) % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'B' ELSE 'C' END",
    "elliott_tag": "CASE o_orderkey % 4 WHEN 0 THEN 'CAUTION_WAVE5' WHEN 1 THEN 'STRATEGIC_ONLY' WHEN 2 THEN 'NO_DATA' ELSE 'OK' END",
    "fundamental_grade": "CASE o_orderkey % 6 WHEN 0 THEN 'D' WHEN 1 THEN 'F' WHEN 2 THEN 'N/A' ELSE 'A' END", "data_coverage": "CAST((o_orderkey * 11) % 101 AS INT)", "total_score": "CAST((o_orderkey * 3) % 101 AS INT)",
    "fund_norm": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE ((o_orderkey * 3) % 101) / 100.0e0 END", "wy_smc_norm": "((o_orderkey * 5) % 101) / 100.0e0", "mtf_norm": "((o_orderkey * 9) % 101) / 100.0e0",
    "elliott_norm": "((o_orderkey * 15) % 101) / 100.0e0", "flow_norm": "((o_orderkey * 21) % 101) / 100.0e0", "annual_vol_pct": "((o_orderkey * 33) % 1200) / 10.0e0", "atr_pct": "((o_orderkey * 39) % 120) / 10.0e0 + 0.0013e0",
    "confluence_score": "CAST((o_orderkey * 5) % 19 - 9 AS INT)", "elliott_confidence": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST((o_orderkey * 7) % 91 AS INT) END",
    "elliott_bias": "CASE o_orderkey % 3 WHEN 0 THEN 'Bullish' WHEN 1 THEN 'Bearish' ELSE 'Neutral' END", "crash_level": "CAST(o_orderkey % 4 AS INT)", "regime": "CASE o_orderkey % 3 WHEN 0 THEN 'BULL' ELSE 'BEAR' END",
    "health": "CASE o_orderkey % 5 WHEN 0 THEN 'STRONG BUY' WHEN 1 THEN 'WEAK REBOUND' WHEN 2 THEN 'BULL FLAG' WHEN 3 THEN 'BEARISH SYNC' ELSE NULL END", "daily_bias": "CASE o_orderkey % 3 WHEN 0 THEN 'BULLISH' ELSE 'NEUTRAL' END",
    "flag_a": "o_orderkey % 2 = 0", "flag_b": "o_orderkey % 5 = 0", "gate_action": "CASE o_orderkey % 4 WHEN 0 THEN 'PAUSE_NEW_LONGS' WHEN 1 THEN ' reduce_size' WHEN 2 THEN 'odd' ELSE 'NORMAL' END", "gate_multiplier": "(o_orderkey % 13) / 10.0e0",
}
SCAN = "scan AS (SELECT o_orderkey AS k, " + ", ".join(f"{e} AS {c}" for c, e in SCAN_COLUMNS.items()) + " FROM orders)"


def scan(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("k"), *[F.expr(e).alias(c) for c, e in SCAN_COLUMNS.items()])


def add(name, op, ctes, select, where=""):
    """``select``: column -> SQL text; rounded columns are given as (text, digits)."""
    cols = ", ".join(f"{q.fix(v[0], v[1])} AS {c}" if isinstance(v, tuple) else f"{v} AS {c}" for c, v in select.items())
    R.add(name, lambda s, d: op(scan(s, d)).select(*[fix(c, v[1]).alias(c) if isinstance(v, tuple) else F.col(c) for c, v in select.items()]),
          q.sql([SCAN, *ctes], f"SELECT {cols} FROM {ctes[-1].split(' AS ')[0] if ctes else 'scan'} {where}"))


# ---- tiers ---------------------------------------------------------------------------------------
R.add("x1_tier1_rows", lambda s, d: sc.tier1(cx.price_action(bars_daily(s, d), benchmark_daily(s, d)), bars_daily(s, d)).select("symbol", "market", "rs_score", "structure", "volume_status", "last_close"),
      q.sql(PA_CTES, f"SELECT symbol, market, rs_score, structure, volume_status, close AS last_close FROM {PA_LAST} JOIN rs USING (symbol) WHERE bar_no = n_bars - 1 AND n_bars >= 50"))
R.add("x2_tier_filter", lambda s, d: sc.tier_filter(scan(s, d)).select("symbol", "rs_score"),
      q.sql(SCAN, "SELECT symbol, rs_score FROM scan WHERE (SELECT count(*) FROM scan WHERE rs_score >= -1.25) < 20 OR rs_score >= -1.25 ORDER BY rs_score DESC, symbol LIMIT 90"))
R.add("x3_prefilter", lambda s, d: sc.prefilter(cx.relative_strength(bars_daily(s, d), benchmark_daily(s, d)), wyckoff.quick_phase(bars_daily(s, d))).select("symbol", fix("prefilter_score", 4).alias("prefilter_score")),
      q.sql([*PA_CTES, *QP, "pf AS (SELECT symbol, rs_score * 0.55 + score * 0.45 + CASE WHEN lower(phase) LIKE '%markup%' THEN 0.10 WHEN lower(phase) LIKE '%transition%' THEN 0.05 WHEN lower(phase) LIKE '%markdown%' THEN -0.18 WHEN phase IN ('Re-Accumulation', 'CONSOLIDATION') AND score >= -0.2 THEN 0.18 ELSE 0 END AS p FROM rs JOIN qp USING (symbol))"],
            f"SELECT symbol, {q.fix('p', 4)} AS prefilter_score FROM pf ORDER BY p DESC, symbol LIMIT 60"))
X4 = ["x4a AS (SELECT *, CASE WHEN daily_vol > 0 THEN daily_vol ELSE 0.02 END AS dv, greatest(-1, least(1, wyckoff_score * 0.45 + smc_score * 0.35 + qmf_score * 0.20)) AS prior, CASE WHEN stoch_k > 85 AND stoch_d > 85 THEN 'OVERBOUGHT' WHEN stoch_k < 15 AND stoch_d < 15 THEN 'OVERSOLD' ELSE 'NEUTRAL' END AS ss FROM scan)",
      "x4b AS (SELECT *, greatest(10, least(45, dv * sqrt(21) * 400)) AS c1, greatest(20, least(80, dv * sqrt(63) * 450)) AS c3, greatest(0, least(1, ai_confidence + prior * 0.1)) AS cb FROM x4a)",
      "x4c AS (SELECT *, greatest(least(pred_21d_ret_raw, c1), -c1) AS p1, greatest(least(pred_63d_ret_raw, c3), -c3) AS p3 FROM x4b)",
      "x4d AS (SELECT *, greatest(-1, least(1, p1 / 15 * 0.30 + p3 / 20 * 0.35 + cb * 0.20 + prior * 0.15)) AS bl, CASE WHEN ss = 'OVERBOUGHT' AND qmf_signal < 0 AND p1 > 0 THEN 'Overbought + outflow contradiction' WHEN ss = 'OVERSOLD' AND qmf_signal > 0 AND p1 < 0 THEN 'Oversold + inflow contradiction' END AS cl, CASE WHEN market = 'TW' THEN 0.03 ELSE 0.08 END AS mb, CASE WHEN market = 'TW' THEN 0.12 ELSE 0.25 END AS ms FROM x4c)",
      "x4e AS (SELECT *, CASE WHEN cl IS NOT NULL THEN bl * 0.65 ELSE bl END AS sc FROM x4d)",
      "x4 AS (SELECT *, CASE WHEN cb < mb THEN 'WATCH' WHEN sc >= 0.45 AND cl IS NULL AND cb >= ms THEN 'STRONG BUY' WHEN sc >= 0.20 THEN 'BUY' WHEN sc <= -0.25 THEN 'AVOID' ELSE 'WATCH' END AS rec, coalesce(cl, CASE WHEN cb < mb THEN 'Low confidence gate' END, '') AS vr FROM x4e)"]
add("x4_institutional_score", sc.institutional_score, X4, {"symbol": "symbol", "institutional_score": ("sc", 6), "confidence_boosted": ("cb", 6), "recommendation": "rec", "veto": "cb < mb OR cl IS NOT NULL", "veto_reason": "vr", "pred_21d_ret": ("p1", 4), "stoch_state": "ss"})
GRADE = """CASE WHEN veto THEN 'C' WHEN recommendation IN ('STRONG BUY', 'BUY') AND confidence_boosted >= CASE WHEN market = 'TW' THEN 0.12 ELSE 0.20 END AND qmf_signal >= 0 AND stoch_state <> 'OVERBOUGHT' AND ((smc_entry_status = 'READY' AND smc_entry_score >= 6 AND institutional_score >= 0.25 AND wyckoff_score >= -0.05) OR (institutional_score >= 0.35 AND wyckoff_score >= 0)) THEN 'A'
 WHEN recommendation <> 'AVOID' AND confidence_boosted >= CASE WHEN market = 'TW' THEN 0.03 ELSE 0.08 END AND qmf_signal >= 0 AND ((smc_entry_status IN ('READY', 'NEAR') AND smc_entry_score >= 5 AND institutional_score >= 0.08 AND stoch_state <> 'OVERBOUGHT') OR institutional_score >= 0.12) THEN 'B' ELSE 'C' END"""
LEGACY = "CASE WHEN veto THEN 'C' WHEN recommendation IN ('STRONG BUY', 'BUY') AND institutional_score >= 0.35 AND confidence_boosted >= 0.2 AND qmf_signal >= 0 THEN 'A' WHEN institutional_score >= 0.12 AND confidence_boosted >= 0.08 AND qmf_signal >= 0 THEN 'B' ELSE 'C' END"
STRICT = "CASE WHEN NOT veto AND qmf_signal >= 0 AND recommendation IN ('STRONG BUY', 'BUY') AND institutional_score >= 0.35 AND confidence_boosted >= 0.2 AND wyckoff_score >= 0 AND stoch_state <> 'OVERBOUGHT' THEN 'A' WHEN NOT veto AND qmf_signal >= 0 AND recommendation <> 'AVOID' AND institutional_score >= 0.12 AND confidence_boosted >= 0.08 THEN 'B' ELSE 'C' END"
add("x5_entry_grades", lambda x: x.withColumns({"grade": sc.entry_grade(), "legacy": sc.legacy_grade(), "strict": sc.legacy_grade_strict()}), [], {"symbol": "symbol", "grade": GRADE, "legacy": LEGACY, "strict": STRICT})
RANKV = "institutional_score + CASE smc_entry_status WHEN 'READY' THEN 0.12e0 WHEN 'NEAR' THEN 0.08e0 WHEN 'WATCH' THEN 0.03e0 ELSE 0 END + least(greatest(smc_entry_score, 0), 8) * 0.01e0"
R.add("x6_final_rank", lambda s, d: sc.final_rank(scan(s, d)).select("symbol", fix("rank_value", 6).alias("rank_value")), q.sql(SCAN, f"SELECT symbol, {q.fix(RANKV, 6)} AS rank_value FROM scan ORDER BY {RANKV} DESC, symbol LIMIT 60"))
R.add("x7_market_tops", lambda s, d: sc.market_tops(scan(s, d), 20).select("symbol", "market", "market_rank", "institutional_score"),
      q.sql(SCAN, "SELECT * FROM (SELECT symbol, market, row_number() OVER (PARTITION BY market ORDER BY institutional_score DESC, symbol) AS market_rank, institutional_score FROM scan WHERE market IN ('VN', 'TW')) WHERE market_rank <= 20"))
COMP = "(coalesce(fund_norm, 0.5) * 0.30e0 + wy_smc_norm * 0.25e0 + mtf_norm * 0.20e0 + elliott_norm * 0.15e0 + flow_norm * 0.10e0) * 100"
MID = f"CASE WHEN {COMP} >= 72 THEN '{sc.MID_RATINGS[0]}' WHEN {COMP} >= 60 THEN '{sc.MID_RATINGS[1]}' WHEN {COMP} >= 45 THEN '{sc.MID_RATINGS[2]}' ELSE '{sc.MID_RATINGS[3]}' END"
SHORT = "CASE recommendation " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sc.SHORT_RATINGS.items()) + f" ELSE '{sc.SHORT_NEUTRAL}' END"
add("x8_composite_rating", sc.composite_rating, [], {"symbol": "symbol", "composite_score": (COMP, 4), "mid_rating": MID})
add("x9_short_rating", lambda x: x.withColumn("short_rating", sc.short_rating(F.col("recommendation"))), [], {"symbol": "symbol", "short_rating": SHORT})


def rated(x):
    return sc.composite_rating(x).withColumn("short_rating", sc.short_rating(F.col("recommendation")))


RATED = f"rt AS (SELECT *, {COMP} AS comp, {MID} AS mid, {SHORT} AS sht FROM scan)"
_so = "CASE sht " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in sc.SHORT_ORDER.items()) + " END"
R.add("w28_ranks", lambda s, d: sc.ranks(rated(scan(s, d))).select("symbol", "rank", F.col("market_rank").cast("long").alias("market_rank"), "short_rank"),
      q.sql([SCAN, RATED], f"SELECT symbol, row_number() OVER (ORDER BY comp DESC, symbol) AS rank, row_number() OVER (PARTITION BY market ORDER BY comp DESC, symbol) AS market_rank, row_number() OVER (ORDER BY {_so}, comp DESC, symbol) AS short_rank FROM rt"))
_b = lambda c: f"(CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in sc.BASE_PCT.items()) + " ELSE 0 END)::DOUBLE"
_m = "(CASE CASE WHEN bm >= bs THEN mid ELSE sht END " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in sc.STOP_MULT.items()) + " ELSE 1.0 END)::DOUBLE"
PS = [RATED, f"ps0 AS (SELECT *, {_b('mid')} AS bm, {_b('sht')} AS bs FROM rt)",
      f"ps AS (SELECT *, CASE WHEN greatest(bm, bs) = 0 THEN 0 ELSE least(greatest(bm, bs) * CASE WHEN annual_vol_pct > 80 THEN 0.5 WHEN annual_vol_pct > 60 THEN 0.7 ELSE 1.0 END::DOUBLE, CASE WHEN bm >= bs THEN 40 ELSE 25 END) END AS al, greatest(3, least(15, coalesce(round_even(nullif(atr_pct * {_m} * 1.5, 0), 2), 0))) AS sl, CASE WHEN market = 'TW' THEN 1 ELSE 100 END AS lot, CASE WHEN market = 'TW' THEN last_close * 800 ELSE last_close END AS unit FROM ps0)"]
add("x10_position_size", lambda x: sc.position_size(rated(x)), PS, {"symbol": "symbol", "allocation_pct": ("round(al, 4)", 1), "stop_loss_pct": ("sl", 2), "shares": "CASE WHEN last_close > 0 THEN CAST(floor(floor(1e9 * (al / 100) / unit) / lot) * lot AS BIGINT) ELSE 0 END",
    "risk_level": "CASE WHEN greatest(bm, bs) = 0 THEN 'Avoid' WHEN annual_vol_pct > 80 THEN 'High' WHEN annual_vol_pct > 60 THEN 'Medium' ELSE 'Low' END", "sizing_basis": "CASE WHEN greatest(bm, bs) = 0 THEN 'Avoid' WHEN bm >= bs THEN 'Mid-term' ELSE 'Short-term' END"})
EST = ["e0 AS (SELECT *, smc_entry_status IN ('READY', 'NEAR') AND smc_entry_low > 0 AND smc_entry_high > smc_entry_low AND smc_entry_stop > 0 AND smc_entry_target > smc_entry_high AS zn, CASE WHEN last_close > 0 THEN last_close ELSE greatest(ai_target_1d, 0.01) END AS e FROM scan)",
       "e1 AS (SELECT *, CASE WHEN wyckoff_target > 0 THEN wyckoff_target ELSE e * (pred_63d_ret / 100 + 1) END AS t FROM e0)",
       "e2 AS (SELECT *, CASE WHEN wyckoff_rr > 0 AND t > e THEN e - (t - e) / wyckoff_rr ELSE e * (1 - (CASE WHEN qmf_signal < 0 THEN least(CASE WHEN confidence_boosted >= 0.25 THEN 0.05 WHEN confidence_boosted < 0.15 THEN 0.07 ELSE 0.06 END + 0.01, 0.09) ELSE CASE WHEN confidence_boosted >= 0.25 THEN 0.05 WHEN confidence_boosted < 0.15 THEN 0.07 ELSE 0.06 END END)) END AS s0 FROM e1)",
       "e3 AS (SELECT *, CASE WHEN greatest(s0, 0.01) >= e THEN e * 0.95 ELSE greatest(s0, 0.01) END AS s, CASE WHEN t <= e THEN e * (greatest(pred_63d_ret, 5) / 100 + 1) ELSE t END AS t2 FROM e2)"]
add("x11_entry_stop_target", sc.entry_stop_target, EST, {"symbol": "symbol", "entry": ("CASE WHEN zn THEN (smc_entry_low + smc_entry_high) / 2 ELSE e END", 4), "stop_loss": ("CASE WHEN zn THEN smc_entry_stop ELSE s END", 4), "target": ("CASE WHEN zn THEN smc_entry_target ELSE t2 END", 4),
    "reward_risk": ("CASE WHEN zn THEN CASE WHEN smc_entry_rr > 0 THEN smc_entry_rr ELSE (smc_entry_target - smc_entry_high) / greatest(smc_entry_high - smc_entry_stop, 1e-9) END ELSE (t2 - e) / greatest(e - s, 1e-9) END", 3)})
TP = ["t0 AS (SELECT *, CASE WHEN wyckoff_target > 0 THEN greatest(ai_target, wyckoff_target) ELSE ai_target END AS g, CASE ai_bias WHEN 'Bullish' THEN last_close * 0.96 WHEN 'Bearish' THEN last_close * 1.04 ELSE last_close * 0.95 END AS st FROM scan)"]
_prr = "CASE WHEN last_close = st THEN 0 WHEN ai_bias = 'Bullish' THEN round_even((g - last_close) / (last_close - st), 2) WHEN ai_bias = 'Bearish' THEN round_even((last_close - g) / (st - last_close), 2) ELSE 0 END"
R.add("x12_trade_plan", lambda s, d: sc.trade_plan(scan(s, d)).select("symbol", fix("plan_stop", 2).alias("plan_stop"), fix("plan_goal", 2).alias("plan_goal"), fix("plan_rr", 2).alias("plan_rr")),
      q.sql([SCAN, *TP], f"SELECT symbol, {q.fix('round_even(st, 2)', 2)} AS plan_stop, {q.fix('round_even(g, 2)', 2)} AS plan_goal, {q.fix(_prr, 2)} AS plan_rr FROM t0"))
R.add("x13_buy_alerts", lambda s, d: sc.buy_alerts(scan(s, d)).select("symbol", "smc_entry_status", "smc_entry_score"),
      q.sql(SCAN, "SELECT symbol, smc_entry_status, smc_entry_score FROM scan WHERE smc_entry_status IN ('READY', 'NEAR') AND NOT veto AND market IN ('VN', 'TW') AND smc_entry_score >= 6 AND smc_entry_rr >= 1.4 AND NOT (smc_entry_status = 'NEAR' AND smc_entry_distance_pct > 1.5) AND qmf_signal >= 0 AND stoch_state <> 'OVERBOUGHT' AND institutional_score >= 0.05 ORDER BY CASE smc_entry_status WHEN 'READY' THEN 0 ELSE 1 END, smc_entry_score DESC, institutional_score DESC, smc_entry_distance_pct, symbol LIMIT 10"))
add("x14_alert_keys", lambda x: x.withColumn("alert_key", sc.alert_key()), [], {"symbol": "symbol", "alert_key": "market || '|' || symbol || '|' || smc_entry_status || '|' || smc_entry_type || '|' || printf('%.2f', round_even(smc_entry_low, 2)) || '-' || printf('%.2f', round_even(smc_entry_high, 2))"})
add("x15_consensus", sc.consensus, [], {"symbol": "symbol", "entry_grade_final": "CASE WHEN elliott_tag IN ('CAUTION_WAVE5', 'STRATEGIC_ONLY') THEN 'B' ELSE 'A' END",
    "consensus_action": "CASE WHEN fundamental_grade IN ('D', 'F') THEN 'REDUCE_RISK' WHEN elliott_tag = 'CAUTION_WAVE5' THEN 'WATCH_PULLBACK' WHEN elliott_tag = 'STRATEGIC_ONLY' THEN 'WATCH_CONFIRM' WHEN elliott_tag = 'NO_DATA' THEN 'WATCH_RISK' ELSE 'BUY' END"})
GEMB = "market = 'TW' AND entry_quality_grade IN ('A', 'B') AND NOT veto AND stoch_state <> 'OVERBOUGHT' AND qmf_signal >= 0"
R.add("x16_hidden_gems", lambda s, d: sc.hidden_gems(scan(s, d)).select("symbol", "pick_kind"),
      q.sql(SCAN, f"SELECT symbol, 'GEM' AS pick_kind FROM scan WHERE {GEMB} AND institutional_score BETWEEN 0.12 AND 0.85 AND confidence_boosted >= 0.03 AND pred_63d_ret >= 12 ORDER BY pred_63d_ret DESC, institutional_score DESC, symbol LIMIT 5"))
R.add("x17_report_tips", lambda s, d: sc.report_tips(scan(s, d)).select("n", F.array_join("tips", "|").alias("tips")),
      q.sql([SCAN, "a AS (SELECT count(*) AS n, count_if(entry_quality_grade = 'A') AS a, count_if(entry_quality_grade = 'C') AS c, count_if(last_close <= 0 OR institutional_score = 0) AS g, count_if(veto) AS v FROM scan)",
             f"t AS (SELECT n, list_filter([CASE WHEN a <= 2 THEN '{sc.TIPS[0]}' END, CASE WHEN c / n >= 0.5 THEN '{sc.TIPS[1]}' END, CASE WHEN g > 0 THEN 'Có ' || CAST(g AS BIGINT) || ' mã thiếu dữ liệu lõi; cần kiểm tra cache/API trước giờ mở cửa.' END, CASE WHEN v >= greatest(3, floor(n * 0.25)) THEN '{sc.TIPS[2]}' END], lambda x: x IS NOT NULL) AS t FROM a)"],
            f"SELECT n, CASE WHEN len(t) = 0 THEN '{sc.TIPS[3]}' ELSE array_to_string(t[1:3], '|') END AS tips FROM t"))
R.add("a9_grade_counts", lambda s, d: sc.grade_counts(scan(s, d)), q.sql(SCAN, "SELECT market, entry_quality_grade, count(*) AS n, CAST(count_if(veto) AS BIGINT) AS vetoed, CAST(count_if(recommendation IN ('STRONG BUY', 'BUY')) AS BIGINT) AS buys FROM scan GROUP BY ROLLUP (market, entry_quality_grade)"))
R.add("a22_sector_strength", lambda s, d: sc.sector_strength(scan(s, d)).select("sector", fix("avg_rs", 4).alias("avg_rs"), "n"), q.sql(SCAN, f"SELECT sector, {q.fix('avg(rs_score)', 4)} AS avg_rs, count(*) AS n FROM scan GROUP BY sector ORDER BY avg(rs_score) DESC, sector LIMIT 20"))
R.add("c22_preset_balanced", lambda s, d: sc.preset(scan(s, d), "Institutional Balanced").select("symbol"), q.sql(SCAN, "SELECT symbol FROM scan WHERE recommendation IN ('STRONG BUY', 'BUY') OR institutional_score >= 0.08 OR (qmf_score >= 0.05 AND wyckoff_score >= 0.05)"))
R.add("c22_preset_runner", lambda s, d: sc.preset(scan(s, d), "Parabolic Runner (1-3M)").select("symbol"),
      q.sql([SCAN, "st AS (SELECT symbol FROM scan WHERE market IN ('VN', 'TW') AND pred_21d_ret >= 8 AND pred_63d_ret >= 15 AND institutional_score >= 0.08 AND wyckoff_score >= -0.05 AND qmf_score >= -0.25 AND confidence_boosted >= 0.06)"],
            "SELECT symbol FROM st UNION ALL SELECT symbol FROM scan WHERE (SELECT count(*) FROM st) = 0 AND market IN ('VN', 'TW') AND pred_21d_ret >= 4 AND institutional_score >= 0.03 AND confidence_boosted >= 0.03"))
R.add("c22_preset_runner_fallback", lambda s, d: sc.preset(scan(s, d).where("pred_21d_ret < 8"), "Parabolic Runner (1-3M)").select("symbol"),
      q.sql(SCAN, "SELECT symbol FROM scan WHERE pred_21d_ret < 8 AND market IN ('VN', 'TW') AND pred_21d_ret >= 4 AND institutional_score >= 0.03 AND confidence_boosted >= 0.03"))
R.add("j8_preset_overlap", lambda s, d: sc.preset(scan(s, d), "Institutional Balanced").join(sc.preset(scan(s, d), "Parabolic Runner (1-3M)").select("symbol"), "symbol", "left_semi").select("symbol"),
      q.sql(SCAN, "SELECT symbol FROM scan WHERE (recommendation IN ('STRONG BUY', 'BUY') OR institutional_score >= 0.08 OR (qmf_score >= 0.05 AND wyckoff_score >= 0.05)) AND market IN ('VN', 'TW') AND pred_21d_ret >= 8 AND pred_63d_ret >= 15 AND institutional_score >= 0.08 AND wyckoff_score >= -0.05 AND qmf_score >= -0.25 AND confidence_boosted >= 0.06"))
add("f3_price_text", lambda x: x.withColumn("price_text", sc.price_text(F.col("smc_entry_low"), F.col("symbol"), F.col("market"))), [], {"symbol": "symbol", "price_text": "CASE market WHEN 'TW' THEN format('{:,.2f}', smc_entry_low) || ' NTD' WHEN 'VN' THEN format('{:,.2f}', smc_entry_low) || ' VND' ELSE '$' || format('{:,.2f}', smc_entry_low) END"})
add("f3_alert_lines", lambda x: x.withColumns({"line": sc.pick_line(F.lit(1)), "zone": sc.zone_text()}), [], {"symbol": "symbol",
    "line": "printf('1. <b>%s</b> | %s | inst=%.3f | 1M=%+.1f%% | 3M=%+.1f%%', symbol, recommendation, institutional_score, pred_21d_ret, pred_63d_ret)",
    "zone": "CASE WHEN smc_entry_status NOT IN ('READY', 'NEAR', 'WATCH') THEN 'SMC:NONE' ELSE printf('SMC:%s %s %.2f-%.2f (%d/8, %.1f%%)', smc_entry_status, smc_entry_type, smc_entry_low, smc_entry_high, smc_entry_score, smc_entry_distance_pct) END"})
R.add("f2_html_escape", lambda s, d: table(s, d, "pages").select("page_id", F.md5(sc.html_escape(F.col("html"))).alias("escaped_md5")),
      "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped_md5 FROM pages")

# ---- entry candidates ------------------------------------------------------------------------------


def context(s, d):
    return derived_table(s, d, "zone_context", lambda: sc.zone_context(state(s, d), bars_daily(s, d), wyckoff.wyckoff_state(wy_table(s, d))))


R.add("p13_smart_entries", lambda s, d: sc.smart_entries(context(s, d)))
R.add("p15_scan_entry_candidate", lambda s, d: sc.scan_entry(context(s, d)))
R.add("p16_entry_radar", lambda s, d: sc.entry_radar(context(s, d)))
add("p17_execution_gate", lambda x: sc.execution_gate(x.withColumns({"available": F.col("flag_a"), "actionable": F.col("flag_b"), "stoch_crossover": F.col("flag_a"), "smc_bos_bull": F.col("flag_b"), "smc_sweep_bull": F.lit(False), "smc_idm_bull": F.lit(False)})),
    ["g AS (SELECT *, daily_bias = 'BULLISH' AS dbl, coalesce(health IN ('STRONG BUY', 'BULL FLAG'), false) AS h4, flag_a AND flag_b AS h1, smc_signal > 0 AND (flag_a OR flag_b) AS tr FROM scan)"],
    {"symbol": "symbol", "daily_bullish": "dbl", "h4_bullish": "h4", "h1_actionable": "h1", "bullish_trigger": "tr", "mtf_confirmed": "dbl AND h4", "buy_triggered": "dbl AND h4 AND h1 AND tr"})


# ---- plans -----------------------------------------------------------------------------------------


def with_forecast(x):
    """One forecast row per scan row; the horizon follows the key."""
    return x.withColumns({
        "horizon": F.expr("CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 21 ELSE 63 END"), "current_price": F.col("last_close"), "predicted_return": F.col("pred_21d_ret") / 5,
        "predicted_lower": F.col("last_close") * 0.97, "predicted_upper": F.col("last_close") * 1.04, "predicted_price": F.col("last_close") * (F.col("pred_21d_ret") / 500 + 1), "confidence": F.col("confidence_boosted"), "bias": pl.bias_label(F.col("pred_21d_ret") / 5)})


FC = "fc AS (SELECT *, CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 21 ELSE 63 END AS horizon, last_close AS cur, pred_21d_ret / 5 AS pr, CASE WHEN pred_21d_ret / 5 > 1 THEN '🟢 BULLISH' WHEN pred_21d_ret / 5 < -1 THEN '🔴 BEARISH' ELSE '🟡 NEUTRAL' END AS bias FROM scan)"
add("m7_bias_labels", with_forecast, [FC], {"symbol": "symbol", "horizon": "horizon", "bias": "bias"})
CAL = [FC, "c0 AS (SELECT *, greatest(-1, least(1, wyckoff_score * 0.45 + smc_score * 0.35 + qmf_score * 0.20)) AS prior, stoch_k > 85 AND stoch_d > 85 AS ov, stoch_k < 15 AND stoch_d < 15 AS un, CASE horizon WHEN 1 THEN 0.25 WHEN 5 THEN 0.45 WHEN 21 THEN 0.70 ELSE 0.90 END AS hs FROM fc)",
       "c1 AS (SELECT *, pr / 100 + prior * 0.015 * hs AS r0 FROM c0)", "c2 AS (SELECT *, CASE WHEN (ov AND r0 > 0) OR (un AND r0 < 0) THEN r0 * CASE WHEN horizon <= 5 THEN 0.70 ELSE 0.85 END ELSE r0 END AS rt FROM c1)",
       "c3 AS (SELECT *, cur * (rt + 1) AS pp, greatest(0.01, least(0.22, abs(cur * 1.04 - cur * 0.97) / greatest(cur, 1e-9) * CASE WHEN wyckoff_phase = 'RANGE' OR abs(smc_score) < 0.12 THEN 1.15 ELSE 1 END * CASE WHEN ov OR un THEN 1.1 ELSE 1 END)) AS bd, greatest(0, least(1, confidence_boosted + CASE WHEN sign(pr / 100) = sign(prior) THEN 0.08 ELSE -0.08 END * least(abs(prior), 1) - CASE WHEN ov OR un THEN 0.03 ELSE 0 END - CASE WHEN qmf_signal = 0 THEN 0.02 ELSE 0 END)) AS cf FROM c2)"]
add("x19_calibrated_forecasts", lambda x: pl.calibrate(with_forecast(x)), CAL, {"symbol": "symbol", "horizon": "horizon", "predicted_price": ("CASE WHEN cur > 0 THEN pp ELSE cur * (pred_21d_ret / 500 + 1) END", 4), "predicted_return": ("CASE WHEN cur > 0 THEN rt * 100 ELSE pr END", 5),
     "predicted_lower": ("CASE WHEN cur > 0 THEN pp * (1 - bd / 2) ELSE cur * 0.97 END", 4), "confidence": ("CASE WHEN cur > 0 THEN cf ELSE confidence_boosted END", 6)})
VETO = [FC, "vt AS (SELECT *, CASE WHEN stoch_k > 88 AND stoch_d > 85 AND qmf_signal < 0 AND pr > 0 THEN 'OVERBOUGHT_OUTFLOW' WHEN stoch_k < 12 AND stoch_d < 15 AND qmf_signal > 0 AND pr < 0 THEN 'OVERSOLD_INFLOW' WHEN abs(smc_score) < 0.08 AND abs(qmf_score) < 0.10 AND abs(pr) > 1.2 THEN 'LOW_CONVICTION_HIGH_FORECAST' ELSE 'NONE' END AS vr FROM fc)"]
add("x20_auto_veto", lambda x: pl.merge_vetoes(pl.auto_veto(with_forecast(x)), {"flag_b": "VAR_GATE"}), VETO,
    {"symbol": "symbol", "veto_active": "vr <> 'NONE' OR flag_b", "veto_reason": "CASE WHEN vr <> 'NONE' AND flag_b THEN vr || ' | VAR_GATE' WHEN flag_b THEN 'VAR_GATE' ELSE vr END", "veto_severity": "CASE WHEN vr <> 'NONE' OR flag_b THEN 'HIGH' ELSE 'LOW' END"})
GG = [FC, "gg AS (SELECT *, CASE WHEN upper(trim(gate_action)) IN ('REDUCE_SIZE', 'PAUSE_NEW_LONGS') THEN upper(trim(gate_action)) ELSE 'NORMAL' END AS act, greatest(0, least(1, gate_multiplier)) AS ml FROM fc)"]
add("x21_geo_gate", lambda x: pl.apply_geo_gate(with_forecast(x)), GG, {"symbol": "symbol", "gate_action": "act", "confidence": ("CASE WHEN act = 'NORMAL' THEN confidence_boosted ELSE greatest(0, least(1, confidence_boosted * (ml * 0.35 + 0.65))) END", 6),
    "predicted_return": ("CASE WHEN act = 'PAUSE_NEW_LONGS' AND pr > 0 THEN 0 WHEN act = 'REDUCE_SIZE' AND pr > 0 THEN pr * 0.8 ELSE pr END", 6), "bias": "CASE WHEN act = 'PAUSE_NEW_LONGS' AND pr > 0 THEN '🟡 NEUTRAL' ELSE bias END"})
KC = [FC, "kc AS (SELECT *, greatest(0.05, least(0.95, confidence_boosted)) AS cf, greatest(0.3, least(3, abs(pr) / greatest(atr_pct, 0.25))) AS rr FROM fc)"]
KCAP = "greatest(0.003, least(0.025, (cf - (1 - cf) / rr) * 0.5))"
add("x23_kelly_cap", lambda x: pl.kelly_cap(with_forecast(x)), KC, {"symbol": "symbol", "kelly_cap": (KCAP, 6)})
RB = [*KC, f"rb0 AS (SELECT *, {KCAP} AS kcap, greatest(-1, least(1, greatest(-1, least(1, wyckoff_score * 0.45 + smc_score * 0.35 + qmf_score * 0.20)) * 0.4 + qmf_score * 0.25 + smc_score * 0.2 + wyckoff_score * 0.15)) AS cv FROM kc)",
      "rb AS (SELECT *, least(greatest(0.003, least(0.025, (greatest(0, least(1, confidence_boosted)) * 0.018 + 0.006) * ((cv * 0.55 + 1) * CASE WHEN veto THEN 0.55 ELSE 1 END))) * greatest(0, least(1, gate_multiplier)), greatest(kcap, 0.003)) AS rk, CAST(trunc(CASE WHEN wyckoff_phase IN ('PHASE C', 'ACCUMULATION') AND cv > 0 THEN greatest(40, least(80, cv * 25 + 55)) ELSE greatest(20, least(65, cv * 20 + 35)) END) AS INT) AS core FROM rb0)"]
add("x22_risk_budget", lambda x: pl.risk_budget(pl.kelly_cap(with_forecast(x)).withColumns({"veto_active": F.col("veto"), "institutional_prior": sc.structural_prior(F.col("wyckoff_score"), F.col("smc_score"), F.col("qmf_score"))})), RB,
    {"symbol": "symbol", "risk_pct": ("greatest(0.003, least(0.025, rk))", 6), "core_alloc": "core", "tactical_alloc": "100 - core"})
add("x22_simple_split", lambda x: pl.simple_split(x.withColumn("upside_63d", F.col("pred_63d_ret"))), [], {"symbol": "symbol", "core_alloc": "CASE WHEN wyckoff_phase = 'PHASE C' OR pred_63d_ret > 15 THEN 70 ELSE 30 END"})
PB = "CASE mode " + " ".join(f"WHEN '{m}' THEN {{{i}}}" for i, (m, *_) in enumerate(pl.MODES)) + " END"
_pm = lambda j: PB.format(*[m[j] for m in pl.MODES])
PBC = [f"pb AS (SELECT symbol, mode, last_close AS p, CASE WHEN atr_pct > 0 THEN atr_pct ELSE last_close * 0.02 END AS atr, ({_pm(1)})::DOUBLE AS z, ({_pm(2)})::DOUBLE AS sl, ({_pm(3)})::DOUBLE AS sz, veto, confidence_boosted AS cf, pred_21d_ret + pred_63d_ret AS up FROM scan, (SELECT unnest(['Aggressive', 'Balanced', 'Conservative']) AS mode))"]
add("x24_entry_playbook", lambda x: pl.entry_playbook(x.select("symbol", F.col("last_close").alias("live_price"), F.col("atr_pct").alias("atr"), F.lit(0.01).alias("risk_pct"), F.col("veto").alias("veto_active"), F.col("confidence_boosted").alias("confidence"), F.col("pred_21d_ret").alias("up_1m"), F.col("pred_63d_ret").alias("up_3m"))), PBC,
    {"symbol": "symbol", "mode": "mode", "zone_low": ("p - z * atr", 4), "zone_high": ("p + z * atr * 0.35", 4), "stop_loss": ("p - sl * atr", 4), "risk_per_trade_pct": ("greatest(0.2, least(4, 1.0 * sz * CASE WHEN veto THEN 0.7 ELSE 1 END * (cf * 0.5 + 0.75)))", 5), "bias": "CASE WHEN up >= 0 THEN 'LONG' ELSE 'DEFENSIVE' END"})
_t = lambda x: f"least(10, greatest(0, CAST(trunc({x}) AS INT)))"
SM = [f"sm0 AS (SELECT *, CASE WHEN smc_signal <> 0 THEN {_t('(smc_score + 1) * 5')} ELSE 5 END AS f0, 5 AS f1, {_t('(confluence_score + 9) / 18 * 10')} AS f2, CASE WHEN elliott_confidence IS NULL THEN NULL WHEN elliott_bias = 'Bullish' THEN {_t('floor(elliott_confidence / 10)')} WHEN elliott_bias = 'Bearish' THEN {_t('10 - floor(elliott_confidence / 10)')} ELSE 5 END AS f3, CASE WHEN data_coverage >= 40 AND fundamental_grade <> 'N/A' THEN CAST(trunc(total_score / 10) AS INT) END AS f4, {_t('(smc_score * 0.5 + 0.5) * 10')} AS f5 FROM scan)",
      "sm1 AS (SELECT *, (f0 * 2.0 + f1 * 1.5 + f2 * 2.0 + coalesce(f3, 0) * 1.5 + coalesce(f4, 0) * 1.5 + f5 * 1.0)::DOUBLE / (65 + CASE WHEN f3 IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN f4 IS NOT NULL THEN 15 ELSE 0 END) * 100 AS cp, (f0 >= 7)::INT + (f1 >= 7)::INT + (f2 >= 7)::INT + coalesce((f3 >= 7)::INT, 0) + coalesce((f4 >= 7)::INT, 0) + (f5 >= 7)::INT AS nh, 4 + (f3 IS NOT NULL)::INT + (f4 IS NOT NULL)::INT AS nc FROM sm0)"]
add("x25_signal_matrix", pl.signal_matrix, SM, {"symbol": "symbol", "composite": ("cp", 4), "conviction": "CASE WHEN nh >= nc * 0.6 THEN 'HIGH' WHEN nh >= nc * 0.4 THEN 'MEDIUM' ELSE 'LOW' END"})
RD = ["rd AS (SELECT *, abs(last_close - e) / e AS ds FROM (SELECT *, CASE WHEN flag_b THEN NULL ELSE last_close * (1 + (k % 30) / 1000.0e0) END AS e FROM scan))", "rd1 AS (SELECT *, CASE WHEN e IS NULL THEN 'DISABLED' WHEN ds < 0.005 THEN 'READY' WHEN ds < 0.015 THEN 'ALMOST' ELSE 'WAITING' END AS b FROM rd)"]
add("x26_readiness", lambda x: pl.readiness(x.withColumns({"current_price": F.col("last_close"), "entry": F.expr("CASE WHEN flag_b THEN NULL ELSE last_close * (1 + (k % 30) / 1000.0e0) END"), "stop": F.col("last_close") * 0.9, "target": F.col("last_close") * 1.2, "confidence": F.col("confidence_boosted"), "pattern": F.expr("CASE WHEN k % 7 = 0 THEN 'BULL FLAG' ELSE 'None' END")})), RD,
    {"symbol": "symbol", "ready_status": "CASE WHEN b = 'READY' AND (confidence_boosted > 0.7 OR abs(smc_score) > 0.4) THEN 'TRIGGER' WHEN e IS NOT NULL AND k % 7 = 0 THEN 'PYRAMID' ELSE b END", "tp1": ("e + (last_close * 1.2 - e) * 0.5", 4)})
add("x27_allocation_mode", lambda x: x.withColumn("mode", pl.allocation_mode(F.col("crash_level"), F.col("regime"))), [], {"symbol": "symbol", "mode": "CASE WHEN crash_level >= 2 THEN 'DEFENSIVE' WHEN regime = 'BULL' THEN 'OFFENSIVE' ELSE 'NEUTRAL' END"})


def hourly_smooth(s, d):
    """Hourly series in a narrow band, fit for the intraday feed rules."""
    k = lambda c: 500 + F.col(c) % 20
    b = bars_hourly(s, d)
    return b.withColumns({"open": k("open"), "close": k("close"), "high": F.lit(521.0), "low": F.lit(499.0)})


def intraday(s, d, side):
    b = hourly_smooth(s, d)
    zones = b.where((F.col("bar_no") % 50 == 0)).select("symbol", F.col("bar_no").alias("zone_no"), (F.col("close") + 2).alias("top"), (F.col("close") - 3).alias("bottom"))
    return pl.intraday_plan(b, zones, clean.validate_intraday(b, F.lit("2024-01-31").cast("timestamp_ntz")), side)




def _plan_sql(side: str) -> str:
    """Twin of the hourly plan on the smoothed series, whose true range is always 22."""
    long = side == "long"
    pick, bound, g = ("greatest", "least", 1) if long else ("least", "greatest", -1)
    near, far = ("top", "bottom") if long else ("bottom", "top")
    return f"""{side}0 AS (SELECT l.symbol, l.c, z.top, z.bottom, row_number() OVER (PARTITION BY l.symbol ORDER BY abs(z.{near} - l.c) / l.c, z.zn) AS rn FROM lasth l LEFT JOIN hz z ON z.symbol = l.symbol AND z.{near} {'<' if long else '>'} l.c AND abs(z.{near} - l.c) / l.c <= 0.03),
{side}1 AS (SELECT *, coalesce({near}, c * {0.995 if long else 1.005}) AS e FROM {side}0 WHERE rn = 1),
{side}2 AS (SELECT *, greatest(least(coalesce({far} - 22 * {0.2 * g}, e - 22 * {1.5 * g}), e * {0.985 if long else 1.04}), e * {0.96 if long else 1.015}) AS s FROM {side}1),
{side}3 AS (SELECT *, {bound}({pick}({'521' if long else '499'}, c + 22 * {2.0 * g}, e + (e - s) * {g} * {1.5 * g}), e * {1.06 if long else 0.94}) AS t FROM {side}2),
{side}4 AS (SELECT *, CASE WHEN c {'>=' if long else '<='} e + (t - e) * 0.7 THEN {pick}(s, e) ELSE s END AS s2, {pick}(c, {'521' if long else '499'}) AS p0 FROM {side}3),
{side} AS (SELECT symbol, '{side}' AS side, CASE WHEN s2 = e THEN 'Break-even protected' WHEN NOT ({'s2 < e AND e < t' if long else 't < e AND e < s2'}) THEN '{side.capitalize()} plan ordering invalid' WHEN NOT abs(e - s2) / e BETWEEN 0.015 - 1e-9 AND 0.04 + 1e-9 THEN 'Intraday stop outside 1.5%-4.0%' WHEN abs(t - e) / abs(e - s2) < 1.5 - 1e-9 THEN 'Risk:reward below 1.5' ELSE 'OK' END AS reason, e, s2, t, CASE WHEN abs(p0 - c) / c <= 0.03 THEN p0 END AS p0 FROM {side}4)"""


HZ = [q.HOURLY, "hs AS (SELECT symbol, bar_no, n_bars, 500 + close % 20 AS c FROM hours)", "hz AS (SELECT symbol, bar_no AS zn, c + 2 AS top, c - 3 AS bottom FROM hs WHERE bar_no % 50 = 0)", "lasth AS (SELECT symbol, c FROM hs WHERE bar_no = n_bars - 1)"]
R.add("x18_intraday_plan", lambda s, d: intraday(s, d, "long").withColumn("side", F.lit("long")).unionByName(intraday(s, d, "short").withColumn("side", F.lit("short"))).select(
    "symbol", "side", "reason", fix("entry", 4).alias("entry"), fix("stop", 4).alias("stop"), fix("target", 4).alias("target"), fix("phase0", 4).alias("phase0")),
      q.sql([*HZ, _plan_sql("long"), _plan_sql("short")], f"SELECT symbol, side, reason, {q.fix('e', 4)} AS entry, {q.fix('s2', 4)} AS stop, {q.fix('t', 4)} AS target, {q.fix('p0', 4)} AS phase0 FROM (SELECT * FROM long UNION ALL SELECT * FROM short)"))

# ---- multi-timeframe -------------------------------------------------------------------------------

def bias_rows(s, d):
    return scan(s, d).select(F.concat(F.lit("S"), F.floor(F.col("k") / 3).cast("string")).alias("symbol"), F.element_at(F.array(F.lit("Weekly"), F.lit("Daily"), F.lit("4H")), (F.col("k") % 3 + 1).cast("int")).alias("tf"),
                             F.expr("CASE k % 4 WHEN 0 THEN 'Bullish' WHEN 1 THEN 'Bearish' ELSE 'Ranging' END").alias("structure"), F.col("smc_signal").alias("signal"))


BIAS = ["b0 AS (SELECT concat('S', k // 3) AS symbol, k % 3 AS t, CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END + sign(smc_signal) AS bs FROM scan)"]
R.add("g9_timeframe_bias", lambda s, d: timeframe_bias(bias_rows(s, d)).select("symbol", "tf", "bull_score", "bias"),
      q.sql([SCAN, *BIAS], "SELECT symbol, ['Weekly', 'Daily', '4H'][t + 1] AS tf, CAST(bs AS INT) AS bull_score, CASE WHEN bs >= 2 THEN 'Bullish' WHEN bs <= -2 THEN 'Bearish' WHEN bs = 1 THEN 'Lean Bullish' WHEN bs = -1 THEN 'Lean Bearish' ELSE 'Neutral' END AS bias FROM b0"))
R.add("g10_confluence", lambda s, d: confluence(timeframe_bias(bias_rows(s, d))).select("symbol", "confluence_score", "alignment", "confluence_label"),
      q.sql([SCAN, *BIAS, "c AS (SELECT symbol, CAST(sum(bs) AS BIGINT) AS cs, CAST(greatest(count_if(bs > 0), count_if(bs < 0)) AS BIGINT) AS al FROM b0 GROUP BY symbol)"],
            "SELECT symbol, cs AS confluence_score, al AS alignment, CASE WHEN cs >= 5 THEN '🟢 Strong Bullish' WHEN cs >= 2 THEN '🟢 Lean Bullish' WHEN cs <= -5 THEN '🔴 Strong Bearish' WHEN cs <= -2 THEN '🔴 Lean Bearish' ELSE '⚪ Neutral / Mixed' END AS confluence_label FROM c"))

QUERIES, ORACLES = R.queries, R.oracles
