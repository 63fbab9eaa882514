"""Wyckoff and Elliott operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.series import index_bars, is_last
from tickloom.operators import elliott as el
from tickloom.operators import resample as rs
from tickloom.operators import wyckoff as wk
from tickloom.plans import sqlkit as q
from tickloom.plans.clean_join_checks import coarse
from tickloom.plans.registry import KEY, Registry, fix, rounded, sel
from tickloom.sources.driver_tables import bars_daily, derived_table

R = Registry()
CFG = wk.WyckoffSettings(tr_atr_ratio=1.05)  # wide enough that these noisy series do form ranges


def wy_table(s, d):
    return derived_table(s, d, "wyckoff_signals", lambda: wk.wyckoff_signals(bars_daily(s, d), CFG))


TRC = [f"wa0 AS (SELECT *, {q.TR} AS tr FROM bars)", f"wa AS (SELECT *, {q.mean('tr', 14, 1)} AS atr FROM wa0)",
       "tz AS (SELECT symbol, avg(CASE WHEN bar_no >= n_bars - 60 THEN atr END) AS an, avg(atr) AS al, quantile_cont(CASE WHEN bar_no >= n_bars - 60 THEN high END, 0.85) AS tr_upper, quantile_cont(CASE WHEN bar_no >= n_bars - 60 THEN low END, 0.15) AS tr_lower FROM wa WHERE bar_no >= n_bars - 180 AND n_bars >= 80 GROUP BY symbol)",
       "tt AS (SELECT tz.symbol, count_if(high BETWEEN tr_upper - an * 0.5 AND tr_upper + an * 0.5) AS ut, count_if(low BETWEEN tr_lower - an * 0.5 AND tr_lower + an * 0.5) AS lt FROM tz JOIN bars USING (symbol) WHERE bar_no >= n_bars - 60 GROUP BY tz.symbol)",
       "trg AS (SELECT tz.symbol, tr_upper, tr_lower FROM tz JOIN tt USING (symbol) WHERE NOT (al > 0 AND an > al * 1.05) AND ut >= 3 AND lt >= 3)"]
R.add("k1_trading_range", lambda s, d: wk.trading_range(bars_daily(s, d), CFG).select("symbol", fix("tr_upper", 4).alias("tr_upper"), fix("tr_lower", 4).alias("tr_lower")),
      q.sql([q.DAILY, *TRC], f"SELECT symbol, {q.fix('tr_upper', 4)} AS tr_upper, {q.fix('tr_lower', 4)} AS tr_lower FROM trg"))
UPB = "coalesce(close > v_pc, false)"
VSA_LAYERS = [
    {"v_pc": q.lag("close"), "v_sp": "greatest(high - low, 1e-6)", "v_vr": f"volume / nullif({q.mean('volume', 20, 5)}, 0)", "v_m20": q.mean("close", 20), "v_m5": q.mean("close", 5), "v_ch": f"close / {q.lag('close')} - 1"},
    {"v_up": UPB, "v_vals": f"list(v_sp) OVER {q.back(20)}", "v_nx": q.lead("v_ch"), "v_spm": q.mean("v_sp", 20)},
    {"v_rk": "CASE WHEN len(v_vals) >= 20 THEN (len(list_filter(v_vals, lambda x: x < v_sp)) + (len(list_filter(v_vals, lambda x: x = v_sp)) + 1) / 2.0) / 20 * 100 END",
     "v_uv": "CASE WHEN v_up THEN volume ELSE 0 END", "v_dv": "CASE WHEN v_up THEN 0 ELSE volume END"},
    {"vsa_stopping_vol": "coalesce(v_vr >= 2.0 AND v_rk <= 30 AND NOT v_up AND close < v_m20, false)", "vsa_no_supply": "coalesce(v_vr <= 0.5 AND NOT v_up AND v_rk <= 50, false)",
     "vsa_shakeout": "coalesce(v_ch <= -0.02 AND v_nx >= 0.01 AND v_vr < 1.5, false)", "vsa_sos": "coalesce(v_vr >= 1.5 AND v_rk >= 75 AND v_up AND close > v_m5, false)",
     "vsa_sow": "coalesce(v_vr >= 1.5 AND v_rk >= 75 AND NOT v_up AND close < v_m5, false)",
     "effort_vs_result": q.clip("coalesce(v_sp / nullif(v_spm, 0), 1) / coalesce(v_vr, 1)", 0, 5), "weis_wave_ratio": q.clip(f"{q.total('v_uv', 20, 5)} / nullif({q.total('v_dv', 20, 5)}, 0)", 0.1, 10)},
    {"vsa_label": "CASE " + " ".join(f"WHEN {f} THEN '{t}'" for f, t in wk.VSA_LABELS.items()) + f" ELSE '{wk.NORMAL_BAR}' END"},
]
FLAGS = ["vsa_stopping_vol", "vsa_no_supply", "vsa_shakeout", "vsa_sos", "vsa_sow", "vsa_label"]
_c, _l = q.chain("bars", *VSA_LAYERS)
R.add("k3_volume_spread_flags", lambda s, d: wk.vsa(bars_daily(s, d)).select(*KEY, *FLAGS), q.sql([q.DAILY, *_c], sel(_l, FLAGS)))
R.add("w19_weis_wave_ratio", lambda s, d: rounded(wk.vsa(bars_daily(s, d)), r6=["weis_wave_ratio"]), q.sql([q.DAILY, *_c], sel(_l, r6=["weis_wave_ratio"])))
R.add("w20_effort_vs_result", lambda s, d: rounded(wk.vsa(bars_daily(s, d)), r6=["effort_vs_result"]), q.sql([q.DAILY, *_c], sel(_l, r6=["effort_vs_result"])))
WY_LAYERS = [
    *q.ATR_LAYERS, *VSA_LAYERS,
    {"k_ab": f"coalesce(close > {q.mean('close', 200, 50)}, false)", "k_win": "bar_no >= n_bars - 60", "k_pos": "CASE WHEN tr_upper IS NULL THEN 0.5 ELSE coalesce((close - tr_lower) / nullif(tr_upper - tr_lower, 0), 0.5) END"},
    {"k_ab10": q.lag("k_ab", 10), "k_bl": "(tr_lower - low) / tr_lower", "k_rec": f"max(close) OVER {q.rows(1, 3)}", "k_s3": f"coalesce(sum(v_ch) OVER {q.rows(-3, -1)}, 0)"},
    {"wyckoff_phase": f"CASE WHEN tr_upper IS NULL THEN CASE WHEN k_ab THEN '{wk.MARKUP}' ELSE '{wk.MARKDOWN}' END WHEN k_win AND k_ab THEN '{wk.DISTRIBUTION}' WHEN close > tr_upper AND coalesce(NOT k_ab10, true) THEN '{wk.PHASE_E}' WHEN k_win AND low < tr_lower * (1 - 0.005) AND NOT k_ab THEN '{wk.PHASE_C}' WHEN k_win AND k_pos > 0.8 THEN '{wk.PHASE_D}' WHEN k_win AND k_pos BETWEEN 0.2 AND 0.8 THEN '{wk.PHASE_B}' ELSE 'UNKNOWN' END",
     "wyckoff_spring": "coalesce(k_bl BETWEEN 0.005 AND 0.03 AND coalesce(v_vr, 1) < 0.8 AND close >= tr_lower * 0.995 AND k_rec >= tr_lower, false)",
     "wyckoff_lps": "coalesce(bar_no >= 2 AND close >= (tr_upper + tr_lower) / 2 AND v_ch < 0 AND NOT (atr > 0 AND v_pc - close > atr) AND coalesce(v_vr, 1) < 0.7 AND k_s3 > 0, false)"},
    {"k_base": "CASE wyckoff_phase " + " ".join(f"WHEN '{p}' THEN {v}::DOUBLE" for p, v in wk.PHASE_SCORE.items()) + " ELSE 0 END + " + " + ".join(f"(CASE WHEN {f} THEN {v}::DOUBLE ELSE 0 END)" for f, v in wk.VSA_SCORE.items()) + " + (CASE WHEN wyckoff_spring THEN 0.30::DOUBLE ELSE 0 END) + (CASE WHEN wyckoff_lps THEN 0.20::DOUBLE ELSE 0 END) + " + q.clip("(coalesce(weis_wave_ratio, 1) - 1) * 0.1", -0.2, 0.2)},
    {"wyckoff_score": q.clip(q.mean("k_base", 5, 1), -1, 1), "k_stop": "close - 1.5 * atr", "k_tg": "coalesce(tr_upper * 2 - tr_lower, close * 1.05)"},
    {"k_ok": "close > 0 AND k_stop > 0 AND close > k_stop", "k_rr": "(k_tg - close) / nullif(close - k_stop, 0)"},
    {"k_v": "coalesce(k_ok AND k_rr >= 2, false)"},
    {"wyckoff_reason": "CASE WHEN n_bars < 50 THEN 'INSUFFICIENT_DATA' WHEN wyckoff_spring THEN 'SPRING' WHEN wyckoff_lps THEN CASE WHEN k_v THEN 'LPS' ELSE '' END WHEN vsa_sos AND wyckoff_score >= 0.4 THEN CASE WHEN k_v THEN 'SOS' ELSE '' END WHEN vsa_sow AND wyckoff_score <= -0.35 THEN 'SOW' WHEN wyckoff_score <= -0.5 THEN 'MARKDOWN' ELSE '' END"},
    {"wyckoff_signal": "CASE WHEN wyckoff_reason IN ('SPRING', 'LPS', 'SOS') THEN 1 WHEN wyckoff_reason IN ('SOW', 'MARKDOWN') THEN -1 ELSE 0 END"},
]
_c, WY_LAST = q.chain("wb", *WY_LAYERS, prefix="wy")
WY_CTES = [q.DAILY, *TRC, "wb AS (SELECT bars.*, tr_upper, tr_lower FROM bars LEFT JOIN trg USING (symbol))", *_c]
R.add("k2_phase_labels", lambda s, d: wy_table(s, d).select(*KEY, "wyckoff_phase"), q.sql(WY_CTES, sel(WY_LAST, ["wyckoff_phase"])))
R.add("k4_springs", lambda s, d: wy_table(s, d).select(*KEY, "wyckoff_spring"), q.sql(WY_CTES, sel(WY_LAST, ["wyckoff_spring"])))
R.add("k5_last_points_of_support", lambda s, d: wy_table(s, d).select(*KEY, "wyckoff_lps"), q.sql(WY_CTES, sel(WY_LAST, ["wyckoff_lps"])))
R.add("k7_wyckoff_signal", lambda s, d: rounded(wy_table(s, d), exact=["wyckoff_signal", "wyckoff_reason"], r6=["wyckoff_score"]), q.sql(WY_CTES, sel(WY_LAST, ["wyckoff_signal", "wyckoff_reason"], r6=["wyckoff_score"])))
_rr = lambda e, st: f"CASE WHEN {e} > 0 AND {st} > 0 AND {e} > {st} THEN round_even((k_tg - {e}) / ({e} - {st}), 2) ELSE 0 END"
R.add("k6_reward_risk", lambda s, d: wy_table(s, d).where(F.col("wyckoff_signal") == 1).select(*KEY, fix("wyckoff_rr", 2).alias("wyckoff_rr"), fix("wyckoff_target", 4).alias("wyckoff_target"), fix("wyckoff_stop", 4).alias("wyckoff_stop")),
      q.sql(WY_CTES, f"SELECT symbol, ts, {q.fix(_rr('close', 'k_stop'), 2)} AS wyckoff_rr, {q.fix('CASE WHEN k_ok THEN round_even(k_tg, 4) ELSE 0 END', 4)} AS wyckoff_target, {q.fix('k_stop', 4)} AS wyckoff_stop FROM {WY_LAST} WHERE wyckoff_signal = 1"))
R.add("k8_wyckoff_snapshot", lambda s, d: wk.wyckoff_state(wy_table(s, d)).select(*KEY, "phase", "signal", "vsa_label", "spring", "lps", fix("score", 3).alias("score"), fix("rr", 2).alias("rr"), fix("stop", 3).alias("stop"), "valid_trade"),
      q.sql([*WY_CTES, "fl AS (SELECT symbol, min(low) * 0.995 AS sp FROM bars WHERE bar_no >= n_bars - 60 GROUP BY symbol)"],
            f"SELECT symbol, ts, wyckoff_phase AS phase, wyckoff_signal AS signal, vsa_label, wyckoff_spring AS spring, wyckoff_lps AS lps, {q.fix('coalesce(round_even(nullif(wyckoff_score, 0), 3), 0)', 3)} AS score, {q.fix(f'CASE WHEN tr_upper IS NULL THEN 0 ELSE {_rr("close", "sp")} END', 2)} AS rr, {q.fix('round_even(sp, 4)', 3)} AS stop, coalesce(tr_upper IS NOT NULL AND close > sp AND sp > 0 AND (k_tg - close) / nullif(close - sp, 0) >= 2, false) AS valid_trade FROM {WY_LAST} JOIN fl USING (symbol) WHERE bar_no = n_bars - 1"))
QP = ["qa AS (SELECT symbol, max(high) AS hi, min(low) AS lo, arg_max(close, bar_no) AS c, any_value(n_bars) AS n, avg(CASE WHEN n_bars - bar_no > least(60, n_bars) // 2 THEN volume END) AS ve, avg(CASE WHEN n_bars - bar_no <= least(60, n_bars) // 2 THEN volume END) AS vl, min(CASE WHEN n_bars - bar_no <= 20 THEN low END) AS l1, min(CASE WHEN n_bars - bar_no > 20 AND n_bars - bar_no <= 40 THEN low END) AS l2, avg(CASE WHEN n_bars - bar_no <= 20 THEN close END) AS s20, avg(CASE WHEN n_bars - bar_no <= 50 THEN close END) AS s50 FROM bars WHERE n_bars >= 40 AND bar_no >= n_bars - 60 GROUP BY symbol)",
      "qb AS (SELECT *, (hi - lo) / lo < 0.25 AS rng, (c - lo) / (hi - lo) AS pos, vl / ve AS vt FROM qa)",
      "qc AS (SELECT *, greatest(-1, least(1, (CASE WHEN rng THEN CASE WHEN pos < 0.4 THEN 0.45 WHEN pos > 0.6 THEN 0.0 ELSE 0.2 END ELSE 0.0 END + CASE WHEN l1 > l2 THEN 0.2 ELSE 0 END + CASE WHEN vt > 1.15 THEN 0.15 WHEN vt < 0.8 THEN -0.1 ELSE 0 END)::DOUBLE)) AS sc FROM qb)",
      "qp AS (SELECT symbol, sc AS score, CASE WHEN NOT rng THEN CASE WHEN c > s20 AND s20 > s50 THEN 'Markup (Uptrend)' WHEN c < s20 AND s20 < s50 THEN 'Markdown (Downtrend)' ELSE 'Transition' END WHEN sc >= 0.3 AND pos < 0.5 THEN 'Accumulation (Phase C/D)' WHEN sc >= 0.1 THEN 'Re-Accumulation' WHEN sc <= -0.2 THEN 'Distribution' ELSE 'CONSOLIDATION' END AS phase FROM qc)"]
R.add("k9_quick_phase", lambda s, d: wk.quick_phase(bars_daily(s, d)).select("symbol", "phase", fix("score", 4).alias("score"), "in_accumulation"),
      q.sql([q.DAILY, *QP], f"SELECT symbol, phase, {q.fix('score', 4)} AS score, phase IN ('Re-Accumulation', 'CONSOLIDATION') AND score >= -0.2 AS in_accumulation FROM qp"))


def weekly(s, d):
    return derived_table(s, d, "bars_weekly", lambda: index_bars(rs.resample_bars(bars_daily(s, d), rs.week_end("ts")), chunk="year"))


def el_state(s, d):
    return derived_table(s, d, "elliott_state", lambda: el.elliott_state(weekly(s, d)))


WEEKLY = ["wk0 AS (" + coarse("bars", "CAST(date_trunc('week', bars.ts) + INTERVAL 6 DAY AS TIMESTAMP)") + ")", q.numbered("weeks", "wk0")]
ZIG = ["""zz AS (SELECT symbol, bar_no, ts, n_bars, high AS ref, CAST(NULL AS VARCHAR) AS kind, CAST(0 AS BIGINT) AS no, CAST(NULL AS DOUBLE) AS price, CAST(NULL AS BIGINT) AS pbar FROM weeks WHERE bar_no = 0 AND n_bars >= 10
 UNION ALL SELECT w.symbol, w.bar_no, w.ts, w.n_bars, CASE WHEN w.high > z.ref * 1.08 THEN w.high WHEN w.low < z.ref * 0.92 THEN w.low ELSE z.ref END,
 CASE WHEN w.high > z.ref * 1.08 THEN 'H' WHEN w.low < z.ref * 0.92 THEN 'L' ELSE z.kind END,
 z.no + CASE WHEN (w.high > z.ref * 1.08 AND z.kind IS DISTINCT FROM 'H') OR (NOT w.high > z.ref * 1.08 AND w.low < z.ref * 0.92 AND z.kind IS DISTINCT FROM 'L') THEN 1 ELSE 0 END,
 CASE WHEN w.high > z.ref * 1.08 THEN w.high WHEN w.low < z.ref * 0.92 THEN w.low ELSE z.price END,
 CASE WHEN w.high > z.ref * 1.08 OR w.low < z.ref * 0.92 THEN w.bar_no ELSE z.pbar END
 FROM zz z JOIN weeks w ON w.symbol = z.symbol AND w.bar_no = z.bar_no + 1)""",
       "pv0 AS (SELECT symbol, no AS pivot_no, arg_max(price, bar_no) AS price, arg_max(pbar, bar_no) AS bar_no, any_value(kind) AS kind FROM zz WHERE no > 0 GROUP BY symbol, no)",
       "pv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pivot_no DESC) AS r FROM pv0) WHERE r <= 14)"]
RW = "WITH RECURSIVE " + ", ".join([q.DAILY, *WEEKLY, *ZIG])
R.add("e1_zigzag_pivots", lambda s, d: el.zigzag(weekly(s, d)).select("symbol", "pivot_no", "bar_no", "price", "kind"), RW + " SELECT symbol, pivot_no, bar_no, price, kind FROM pv")
IMP = ["en AS (SELECT symbol, count(*) AS n_pivots, arg_max(price, pivot_no) > arg_min(price, pivot_no) AS uptrend FROM pv GROUP BY symbol)",
       "im0 AS (SELECT pv.*, uptrend, " + ", ".join(f"lead(price, {i}) OVER w AS p{i}, lead(pv.bar_no, {i}) OVER w AS i{i}" for i in range(6)) + " FROM pv JOIN en USING (symbol) WINDOW w AS (PARTITION BY symbol ORDER BY pivot_no))",
       "im1 AS (SELECT *, (p1 > p0 AND (p1 - p2) / nullif(p1 - p0, 0) > 1)::INT + (abs(p3 - p2) = least(abs(p1 - p0), abs(p3 - p2), abs(p5 - p4)))::INT + (p4 < p1)::INT AS nv FROM im0 WHERE p5 IS NOT NULL AND kind = CASE WHEN uptrend THEN 'L' ELSE 'H' END)",
       "im AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY nv, pivot_no) AS rk FROM im1) WHERE rk = 1)",
       "es AS (SELECT s.symbol, s.n_bars, im.* EXCLUDE (symbol), coalesce(n_pivots, 0) < 4 OR n_bars < 20 AS few, en.uptrend AS up FROM (SELECT symbol, max(n_bars) AS n_bars FROM weeks GROUP BY symbol) s LEFT JOIN en USING (symbol) LEFT JOIN im USING (symbol))",
       "ez AS (SELECT *, p5 IS NOT NULL AND NOT few AS found FROM es)"]
CONF = "CASE WHEN n_bars < 20 THEN 0 WHEN few THEN 10 WHEN found THEN greatest(10, least(90, 72 - nv * 20)) ELSE 30 END"
R.add("e2_impulse_count", lambda s, d: el.impulse(el.zigzag(weekly(s, d))).select("symbol", "p0", "p5", F.size("violations").alias("nv")).where("p5 IS NOT NULL"), RW + ", " + ", ".join(IMP) + " SELECT symbol, p0, p5, nv FROM im")
R.add("e3_wave_targets", lambda s, d: el_state(s, d).where("current_wave = '5'").select("symbol", fix("target_price", 2).alias("target_price"), fix("entry_zone_low", 2).alias("entry_zone_low"), fix("invalidation", 2).alias("invalidation")),
      RW + ", " + ", ".join(IMP) + f" SELECT symbol, {q.fix('round_even(p5 - (p5 - p0) * 0.382, 2)', 2)} AS target_price, {q.fix('round_even(p5 - (p5 - p0) * 0.618, 2)', 2)} AS entry_zone_low, {q.fix('round_even(p5, 2)', 2)} AS invalidation FROM ez WHERE found")
R.add("e4_wave_confidence", lambda s, d: el_state(s, d).select("symbol", "current_wave", "confidence", "wave_degree", "bias", F.when(F.col("current_wave") == "5", F.col("bars_remaining")).alias("bars_remaining")),
      RW + ", " + ", ".join(IMP) + f""" SELECT symbol, CASE WHEN few THEN 'Unknown' WHEN found THEN '5' WHEN (SELECT n_pivots FROM en WHERE en.symbol = ez.symbol) % 2 = 0 THEN 'B' ELSE 'C' END AS current_wave, {CONF} AS confidence, CASE WHEN n_bars > 100 THEN 'Primary' WHEN n_bars > 50 OR NOT found THEN 'Intermediate' ELSE 'Minor' END AS wave_degree,
 CASE WHEN few THEN 'Neutral' WHEN found = up THEN 'Bullish' ELSE 'Bearish' END AS bias, CASE WHEN found THEN greatest(0, (i2 - i0) - (n_bars - 1 - i4)) END AS bars_remaining FROM ez""")
R.add("e5_elliott_score", lambda s, d: el.elliott_score(el_state(s, d), bars_daily(s, d).where(is_last())).select("symbol", fix("elliott_score", 6).alias("elliott_score"), el.strategic_tag(F.col("current_wave"), F.col("confidence")).alias("tag")),
      RW + ", " + ", ".join(IMP) + f""", cl AS (SELECT symbol, close FROM bars WHERE bar_no = n_bars - 1), sc AS (SELECT ez.symbol, found, few, up, {CONF} AS conf, CASE WHEN found THEN CASE WHEN round_even(p5 - (p5 - p0) * 0.382, 2) > 0 THEN (round_even(p5 - (p5 - p0) * 0.382, 2) - close) / close * 100 ELSE 0 END ELSE 0 END AS us FROM ez JOIN cl USING (symbol))
 SELECT symbol, {q.fix("CASE WHEN NOT few AND found = up AND us > 0 THEN least(us / 50, 1) * conf / 100 * 0.5 + 0.5 WHEN NOT few AND found <> up THEN greatest(0, 0.5 - conf / 100 * 0.3) ELSE 0.5 END", 6)} AS elliott_score, CASE WHEN found AND conf >= 60 THEN 'CAUTION_WAVE5' WHEN conf >= 60 AND conf < 75 THEN 'STRATEGIC_ONLY' ELSE 'OK' END AS tag FROM sc""")
R.add("e6_wave_tier", lambda s, d: el_state(s, d).select("symbol", el.wave_tier(F.col("n_violations"), F.col("confidence")).alias("tier")),
      RW + ", " + ", ".join(IMP) + f" SELECT symbol, CASE WHEN found AND nv > 0 THEN 'INVALID' WHEN {CONF} >= 75 THEN 'ACTIONABLE' WHEN {CONF} >= 60 THEN 'STRATEGIC' ELSE 'WEAK' END AS tier FROM ez")

QUERIES, ORACLES = R.queries, R.oracles
