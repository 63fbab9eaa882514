"""Profiles, flow, positioning, regime, news, fundamentals and seasonality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.config import BankSettings, CotSettings
from tickloom.functions.series import is_last, tail
from tickloom.operators import context as cx
from tickloom.operators import flow, fundamentals, joins, news, profile, seasonality
from tickloom.operators import indicators as ind
from tickloom.operators import resample as rs
from tickloom.plans import sqlkit as q
from tickloom.plans.clean_join_checks import coarse
from tickloom.plans.indicator_checks import CMF_LAYERS, MFI_LAYERS, VWAP_LAYERS
from tickloom.plans.registry import KEY, Registry, fix, rounded, sel
from tickloom.sources.driver_tables import bars_daily, bars_hourly, benchmark_daily, positioning, table

R = Registry()


def add(name, op, layers, exact=(), r6=(), r4=(), base=q.DAILY, src="bars", where="", bars=bars_daily):
    ctes, last = q.chain(src, *layers)
    R.add(name, lambda s, d: rounded(op(bars(s, d)), exact, r6, r4), q.sql([base, *ctes], sel(last, exact, r6, r4, where=where)))


def case(x: str, outer, inner, labels) -> str:
    return f"CASE WHEN {x} > {outer} THEN '{labels[0]}' WHEN {x} > {inner} THEN '{labels[1]}' WHEN {x} < -{outer} THEN '{labels[4]}' WHEN {x} < -{inner} THEN '{labels[3]}' ELSE '{labels[2]}' END"


# ---- volume profiles ---------------------------------------------------------------------------


def bin_sql(x: str, lo: str, hi: str, n: int) -> str:
    st = f"(({hi} - {lo}) / {n})"
    k = f"floor(({x} - {lo}) / {st})"
    return f"CAST(greatest(0, least({n - 1}, CASE WHEN {lo} + ({k} + 1) * {st} <= {x} THEN {k} + 1 WHEN {lo} + {k} * {st} > {x} THEN {k} - 1 ELSE {k} END)) AS INT)"


def va_sql(n: int, src: str, key: str = "symbol") -> str:
    at = lambda i: f"(CASE WHEN {i} >= 0 AND {i} < {n} THEN v[CAST({i} AS INT) + 1] ELSE 0 END)"
    down, up = at("(l - 1)"), at("(h + 1)")
    go_down = f"({down} >= {up} AND l > 0)"
    return f"""va({key}, v, tot, poc, l, h, vol) AS (
 SELECT {key}, v, list_sum(v), list_position(v, list_max(v)) - 1, list_position(v, list_max(v)) - 1, list_position(v, list_max(v)) - 1, list_max(v) FROM {src}
 UNION ALL
 SELECT {key}, v, tot, poc, CASE WHEN {go_down} THEN l - 1 ELSE l END, CASE WHEN {go_down} THEN h ELSE h + 1 END, vol + CASE WHEN {go_down} THEN {down} ELSE {up} END
 FROM va WHERE vol < tot * 0.7 AND ({go_down} OR h < {n - 1})),
vz AS (SELECT {key}, any_value(v) AS v, any_value(tot) AS tot, any_value(poc) AS poc, min(l) AS l, max(h) AS h FROM va GROUP BY {key})"""


SPAN = lambda lb: f"""t AS (SELECT * FROM bars WHERE bar_no >= n_bars - {lb}), sp AS (SELECT symbol, min(low) AS lo, max(high) AS hi FROM t GROUP BY symbol)"""
BINS = lambda n: f"bn AS (SELECT t.symbol, lo, hi, {bin_sql('close', 'lo', 'hi', n)} AS b, volume FROM t JOIN sp USING (symbol)), bv AS (SELECT symbol, lo, hi, b, sum(volume) AS vol FROM bn GROUP BY symbol, lo, hi, b)"
R.add("a3_volume_profile", lambda s, d: profile.volume_profile(bars_daily(s, d)).select("symbol", fix("poc", 4).alias("poc"), fix("vah", 4).alias("vah"), fix("val", 4).alias("val"), "total_volume", F.size("histogram").alias("n_bins"), F.size(F.filter("histogram", lambda x: x["in_va"])).alias("va_bins")),
      "WITH RECURSIVE " + ", ".join([q.DAILY, SPAN(40), BINS(50),
          "dense AS (SELECT symbol, list(coalesce(vol, 0.0) ORDER BY i) AS v FROM (SELECT s.symbol, i, vol FROM (SELECT symbol, unnest(range(50)) AS i FROM sp) s LEFT JOIN bv ON bv.symbol = s.symbol AND bv.b = s.i) GROUP BY symbol)",
          va_sql(50, "dense")]) + f" SELECT symbol, {q.fix('(lo + poc * ((hi - lo) / 50) + (lo + (poc + 1) * ((hi - lo) / 50))) / 2', 4)} AS poc, {q.fix('lo + (h + 1) * ((hi - lo) / 50)', 4)} AS vah, {q.fix('lo + l * ((hi - lo) / 50)', 4)} AS val, tot AS total_volume, 50 AS n_bins, CAST(h - l + 1 AS INT) AS va_bins FROM vz JOIN sp USING (symbol)")
R.add("a4_profile_levels", lambda s, d: profile.profile_levels(bars_daily(s, d)).select("symbol", F.explode("levels").alias("level")).select("symbol", fix("level", 4).alias("level")),
      q.sql([q.DAILY, SPAN(80), BINS(24)], f"SELECT symbol, {q.fix('(lo + b * ((hi - lo) / 24) + (lo + (b + 1) * ((hi - lo) / 24))) / 2', 4)} AS level FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY vol DESC, b DESC) AS rn FROM bv) WHERE rn <= 3"))
W21_CTES = [q.DAILY,
    f"w0 AS (SELECT symbol, ts, bar_no, close, list({{'c': close, 'v': volume}}) OVER {q.back(20)} AS w, min(close) OVER {q.back(20)} AS lo, max(close) OVER {q.back(20)} AS hi FROM bars)",
    "w1 AS (SELECT * FROM w0 WHERE bar_no >= 20)",
    f"w2 AS (SELECT symbol, bar_no, lo, hi, u.v AS vol, {bin_sql('u.c', 'lo', 'hi', 10)} AS b FROM (SELECT symbol, bar_no, lo, hi, unnest(w) AS u FROM w1 WHERE hi > lo))",
    "w3 AS (SELECT symbol, bar_no, b, sum(vol) AS vol FROM w2 GROUP BY ALL)",
    "w4 AS (SELECT s.symbol || '|' || s.bar_no AS k, list(coalesce(vol, 0.0) ORDER BY i) AS v FROM (SELECT symbol, bar_no, unnest(range(10)) AS i FROM w1 WHERE hi > lo) s LEFT JOIN w3 ON w3.symbol = s.symbol AND w3.bar_no = s.bar_no AND w3.b = s.i GROUP BY 1)",
    va_sql(10, "w4", "k")]
R.add("w21_rolling_profile", lambda s, d: rounded(profile.rolling_profile(bars_daily(s, d)), exact=["inside_va"], r4=["poc_price"], r6=["poc_dist"]),
      "WITH RECURSIVE " + ", ".join(W21_CTES) + f""", fin AS (SELECT w0.*, poc, l, h, (hi - lo) / 10 AS st, (lo + poc * ((hi - lo) / 10) + (lo + (poc + 1) * ((hi - lo) / 10))) / 2 AS pp FROM w0 LEFT JOIN vz ON vz.k = w0.symbol || '|' || w0.bar_no)
 SELECT symbol, ts, {q.fix('CASE WHEN bar_no < 20 THEN NULL WHEN hi = lo THEN lo ELSE pp END', 4)} AS poc_price, {q.fix('CASE WHEN bar_no < 20 OR hi = lo THEN 0 ELSE (close - pp) / pp END', 6)} AS poc_dist,
 CASE WHEN bar_no < 20 THEN 0 WHEN hi = lo THEN 1 ELSE (close BETWEEN lo + l * st AND lo + (h + 1) * st)::INT END AS inside_va FROM fin""")
R.add("a6_fib_levels", lambda s, d: tail(bars_daily(s, d), 120).groupBy("symbol").agg(F.max("high").alias("hi"), F.min("low").alias("lo")).select("symbol", "hi", "lo", *[fix(F.col("hi") - (F.col("hi") - F.col("lo")) * r, 4).alias(f"fib_{int(r * 1000)}") for r in (0.236, 0.382, 0.5, 0.618)]),
      q.sql([q.DAILY, "a AS (SELECT symbol, max(high) AS hi, min(low) AS lo FROM bars WHERE bar_no >= n_bars - 120 GROUP BY symbol)"], "SELECT symbol, hi, lo, " + ", ".join(f"{q.fix(f'hi - (hi - lo) * {r}', 4)} AS fib_{int(r * 1000)}" for r in (0.236, 0.382, 0.5, 0.618)) + " FROM a"))

# ---- flow --------------------------------------------------------------------------------------
VP_LAYERS = [
    {"volume_ratio": f"volume / nullif({q.mean('volume', 20, 5)}, 0)", "price_change": f"close / {q.lag('close')} - 1",
     "sv": f"coalesce(sign(close - {q.lag('close')}), 0) * volume", "pt": f"coalesce(close - {q.lag('close', 20)}, 0)"},
    {"price_volatility": q.std("price_change", 20, 5), "vp_divergence_signed": "volume_ratio * price_change",
     "ot": f"CASE WHEN bar_no >= 20 THEN sum(sv) OVER {q.back(20)} ELSE 0 END"},
    {"spike": "coalesce(volume_ratio > 2.0, false)", "bull": "ot > 0 AND pt < 0", "bear": "ot < 0 AND pt > 0"},
    {"manip": "spike AND coalesce(price_change < -0.03, false)", "buy": "spike AND coalesce(price_change > 0.03, false)"},
    {"vp_reason": "CASE WHEN bull AND NOT buy AND NOT (manip OR (bear AND NOT manip)) THEN 'OBV_ACCUMULATION' WHEN buy THEN 'ACCUMULATION' WHEN bear AND NOT manip THEN 'OBV_DIVERGENCE' WHEN manip THEN 'MANIPULATION_ALERT' ELSE '' END"},
    {"vp_signal": "CASE WHEN vp_reason IN ('OBV_ACCUMULATION', 'ACCUMULATION') THEN 1 WHEN vp_reason <> '' THEN -1 ELSE 0 END"},
]
VP_CFG = flow.VolumePriceSettings(volume_spike_threshold=2.0)
add("g2_volume_price_detector", lambda b: flow.volume_price_detector(b, VP_CFG), VP_LAYERS, exact=["vp_reason", "vp_signal"], r6=["volume_ratio", "price_volatility", "vp_divergence_signed"])
QMF_LAYERS = [
    *MFI_LAYERS, *CMF_LAYERS,
    {"q_sv": f"coalesce(sign(close - {q.lag('close')}), 0) * volume", "q_vm": f"nullif({q.mean('volume', 20)}, 0)", "q_vs": f"nullif({q.std('volume', 20)}, 0)",
     "q_r": f"coalesce(close / {q.lag('close')} - 1, 0)", "q_cd": f"coalesce(cmf - {q.lag('cmf', 3)}, 0)"},
    {"q_os": f"CASE WHEN bar_no >= 10 THEN sum(q_sv) OVER {q.back(10)} ELSE 0 END", "q_as": f"CASE WHEN bar_no >= 10 THEN sum(mfv) OVER {q.back(10)} ELSE 0 END",
     "q_rz": f"coalesce(q_r / nullif({q.std('q_r', 20)}, 0), 0)"},
    {"qmf_score": q.clip("tanh((mfi - 50) / 20) * 0.35 + tanh(cmf * 3) * 0.30 + tanh(coalesce(q_os / q_vm, 0) * 4) * 0.20 + tanh(coalesce(q_as / q_vm, 0) * 4) * 0.15", -1, 1),
     "qmf_anomaly_score": q.clip("tanh(greatest(coalesce((volume - q_vm) / q_vs, 0), 0) / 2.5) * 0.35 + tanh(greatest(-q_rz, 0) / 2.5) * 0.30 + tanh(greatest(q_cd * -5, 0)) * 0.20 + tanh(greatest(-q_os / coalesce(q_vm, 1), 0) * 3) * 0.15", 0, 1)},
    {"qmf_signal": "CASE WHEN qmf_score > 0.15 THEN 1 WHEN qmf_score < -0.15 THEN -1 ELSE 0 END",
     "qmf_reason": "CASE WHEN qmf_score > 0.15 THEN 'QMF_INFLOW_CONFIRMED' WHEN qmf_score < -0.15 THEN 'QMF_OUTFLOW_WARNING' ELSE 'QMF_NEUTRAL' END",
     "qmf_anomaly_flag": "(qmf_anomaly_score >= 0.55)::INT"},
]
add("g5_quant_money_flow", flow.quant_money_flow, QMF_LAYERS, exact=["qmf_signal", "qmf_reason", "qmf_anomaly_flag"], r6=["qmf_score", "qmf_anomaly_score"])


def with_flow(b):
    n = F.col("bar_no") % 7
    return b.withColumns({"foreign_buy": F.col("volume") * (n / 8.0), "foreign_sell": F.col("volume") * ((6 - n) / 8.0), "block_volume": F.col("volume") * ((F.col("bar_no") % 5) / 10.0)})


FLOWED = "fb AS (SELECT *, volume * ((bar_no % 7) / 8.0::DOUBLE) AS foreign_buy, volume * ((6 - bar_no % 7) / 8.0::DOUBLE) AS foreign_sell, volume * ((bar_no % 5) / 10.0::DOUBLE) AS block_volume FROM bars)"
RF_LAYERS = [
    *VWAP_LAYERS,
    {"foreign_net_flow_ratio": q.clip("coalesce((foreign_buy - foreign_sell) / nullif(volume, 0), 0)", -2, 2), "block_trade_ratio": q.clip("coalesce(block_volume / nullif(volume, 0), 0)", 0, 2)},
    {"real_flow_score": q.clip("tanh(foreign_net_flow_ratio * 3) * 0.45 + tanh((block_trade_ratio - 0.12) * 3) * 0.25 + tanh((session_rel_volume - 1) * 1.5) * 0.15 + tanh(vwap_dev * 12) * 0.15", -1, 1)},
    {"real_flow_signal": "CASE WHEN real_flow_score > 0.20 THEN 1 WHEN real_flow_score < -0.20 THEN -1 ELSE 0 END",
     "real_flow_reason": "CASE WHEN real_flow_score > 0.20 THEN 'REAL_FLOW_BULLISH' WHEN real_flow_score < -0.20 THEN 'REAL_FLOW_BEARISH' ELSE 'REAL_FLOW_NEUTRAL' END"},
]
add("g6_real_flow", lambda b: flow.real_flow(with_flow(b)), RF_LAYERS, exact=["real_flow_signal", "real_flow_reason"], r6=["real_flow_score", "foreign_net_flow_ratio", "block_trade_ratio"],
    base=f"{q.DAILY}, {FLOWED}", src="fb")
add("g6_real_flow_missing", flow.real_flow, [{"real_flow_score": "0.0::DOUBLE", "real_flow_signal": "0", "real_flow_reason": "'MISSING_REAL_FLOW_COLUMNS'", "real_flow_available": "false"}],
    exact=["real_flow_score", "real_flow_signal", "real_flow_reason", "real_flow_available"])
ctes, last = q.chain("fb", *RF_LAYERS)
R.add("a19_flow_score_3d", lambda s, d: flow.flow_score_3d(with_flow(bars_daily(s, d))).select("symbol", "flow_available", "flow_signal", fix("flow_norm", 6).alias("flow_norm"), fix("flow_net_3d", 6).alias("flow_net_3d")),
      q.sql([q.DAILY, FLOWED, *ctes, f"m AS (SELECT symbol, avg(real_flow_score) AS r, avg(foreign_net_flow_ratio) AS n FROM {last} WHERE bar_no >= n_bars - 3 GROUP BY symbol)"],
            f"SELECT symbol, true AS flow_available, CASE WHEN r > 0.2 THEN 'KN Mua rong' WHEN r < -0.2 THEN 'KN Ban rong' ELSE 'Trung lap' END AS flow_signal, {q.fix('greatest(0, least(1, (r + 1) / 2))', 6)} AS flow_norm, {q.fix('n', 6)} AS flow_net_3d FROM m"))
OBV10 = [f"ob0 AS (SELECT *, coalesce(sign(close - {q.lag('close')}), 0) * volume AS sv FROM bars)", f"ob1 AS (SELECT *, sum(sv) OVER {q.RUN} AS obv FROM ob0)",
         "ob2 AS (SELECT symbol, arg_max(obv, bar_no) AS obv_current, avg(CASE WHEN bar_no >= n_bars - 5 THEN obv END) AS nw, avg(CASE WHEN bar_no < n_bars - 5 THEN obv END) AS od FROM ob1 WHERE bar_no >= n_bars - 10 GROUP BY symbol)",
         "obt AS (SELECT *, (nw - od) / (abs(od) + 1e-9) * 100 AS chg FROM ob2)"]
R.add("w15_obv_trend", lambda s, d: flow.obv_trend(bars_daily(s, d)),
      q.sql([q.DAILY, *OBV10], f"SELECT symbol, obv_current, round_even(chg, 1) AS obv_change_pct, {case('chg', 5, 1, flow.OBV_LABELS)} AS obv_trend, chg > 0 AS obv_bullish FROM obt"))
VW = "vw AS (SELECT symbol, sum((high + low + close) / 3 * volume) / (sum(volume) + 1e-9) AS v, arg_max(close, bar_no) AS c FROM bars WHERE bar_no >= n_bars - 20 GROUP BY symbol)"
R.add("a17_tail_vwap", lambda s, d: flow.tail_vwap(bars_daily(s, d)),
      q.sql([q.DAILY, VW], f"SELECT symbol, round_even(v, 2) AS vwap, round_even((c - v) / v * 100, 2) AS vwap_deviation, {case('((c - v) / v * 100)', 3, 0.5, flow.VWAP_LABELS)} AS vwap_signal, (c - v) / v * 100 >= 0 AS price_above_vwap FROM vw"))
CM = "cm AS (SELECT symbol, greatest(-1, least(1, sum(((close - low) - (high - close)) / CASE WHEN high = low THEN 1e-9 ELSE high - low END * volume) / (sum(volume) + 1e-9))) AS c FROM bars WHERE bar_no >= n_bars - 14 GROUP BY symbol)"
R.add("a18_tail_cmf", lambda s, d: flow.tail_cmf(bars_daily(s, d)),
      q.sql([q.DAILY, CM], f"SELECT symbol, round_even(c, 3) AS cmf_14, {case('c', 0.2, 0.05, flow.CMF_LABELS)} AS cmf_signal, c > 0 AS cmf_bullish FROM cm"))
BT = """bt0 AS (SELECT *, avg(volume) OVER (PARTITION BY symbol) AS av FROM bars WHERE bar_no >= n_bars - 20),
bt AS (SELECT symbol, any_value(av) AS av, count(*) AS n, CAST(count_if(volume > 2 * av) AS INT) AS nb, CAST(count_if(volume > 2 * av AND close >= open) AS INT) AS buy, avg(CASE WHEN bar_no >= n_bars - 5 THEN volume END) AS v5 FROM bt0 GROUP BY symbol)"""
BT_DIR = f"CASE WHEN nb = 0 THEN '{flow.BLOCK_LABELS[2]}' WHEN buy >= nb - buy THEN '{flow.BLOCK_LABELS[0]}' ELSE '{flow.BLOCK_LABELS[1]}' END"
R.add("a5_block_trades", lambda s, d: flow.block_trades(bars_daily(s, d)),
      q.sql([q.DAILY, BT], f"SELECT symbol, round_even(nb / n * 100, 1) AS block_ratio_pct, {BT_DIR} AS block_direction, buy AS block_buy_days, nb - buy AS block_sell_days, round_even(v5 / (av + 1e-9) * 100, 1) AS vol_ratio_5d_pct FROM bt"))
S0, S1, S2, S3, S4 = flow.SMART_LABELS
R.add("g7_volume_intelligence", lambda s, d: flow.volume_intelligence(bars_daily(s, d)).select("symbol", "smart_money_points", "smart_money_signal", "volume_delta_pct", "cmf_14", "obv_trend"),
      q.sql([q.DAILY, *OBV10, CM, BT, f"pt AS (SELECT symbol, round_even(cm.c, 3) AS c, {case('chg', 5, 1, flow.OBV_LABELS)} AS obv_trend, round_even((v5 - av) / (av + 1e-9) * 100, 1) AS dv, CASE WHEN chg > 0 THEN 2 ELSE 0 END AS p1, CASE WHEN nb = 0 THEN 0 WHEN buy >= nb - buy THEN 2 ELSE -2 END AS p2 FROM obt JOIN cm USING (symbol) JOIN bt USING (symbol))",
             "pz AS (SELECT *, p1 + p2 + CASE WHEN c > 0.1 THEN 3 WHEN c > 0 THEN 1 WHEN c < -0.1 THEN -3 WHEN c < 0 THEN -1 ELSE 0 END + CASE WHEN dv > 10 THEN 1 WHEN dv < -10 THEN -1 ELSE 0 END AS p FROM pt)"],
            f"SELECT symbol, p AS smart_money_points, CASE WHEN p >= 5 THEN '{S0}' WHEN p >= 2 THEN '{S1}' WHEN p <= -5 THEN '{S4}' WHEN p <= -2 THEN '{S3}' ELSE '{S2}' END AS smart_money_signal, dv AS volume_delta_pct, c AS cmf_14, obv_trend FROM pz"))


def depth(s, d):
    return table(s, d, "orders").select(F.col("o_orderpriority").alias("symbol"), *[F.col("o_totalprice").alias(f"bid_vol_{i}") if i < 3 else (F.col("o_custkey") * 200.0).alias(f"ask_vol_{i - 2}") for i in range(1, 5)])


R.add("a13_depth_imbalance", lambda s, d: flow.depth_imbalance(depth(s, d)).select("symbol", "buy_pressure", "sell_pressure", "imbalance", "net_flow", "retail_signal"),
      q.sql("t AS (SELECT o_orderpriority AS symbol, sum(o_totalprice * 2) AS b, sum(o_custkey * 400.0::DOUBLE) AS a FROM orders GROUP BY 1), u AS (SELECT symbol, round_even(b / (a + b) * 100, 1) AS buy_pressure, round_even(a / (a + b) * 100, 1) AS sell_pressure FROM t)",
            f"SELECT symbol, buy_pressure, sell_pressure, round_even(buy_pressure - sell_pressure, 1) AS imbalance, {case('(buy_pressure - sell_pressure)', 15, 5, flow.DEPTH_LABELS)} AS net_flow, {case('(buy_pressure - sell_pressure)', 20, 8, flow.RETAIL_LABELS)} AS retail_signal FROM u"))


def ticks(s, d):
    side = F.when(F.col("user_id") % 3 == 0, "bu").when(F.col("user_id") % 3 == 1, "SELL").otherwise("x")
    return table(s, d, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("tick_id"), F.col("value").alias("volume"), side.alias("side"))


R.add("a14_tick_imbalance", lambda s, d: flow.tick_imbalance(ticks(s, d)).select("symbol", "buy_pressure", "sell_pressure", "imbalance", "net_flow"),
      q.sql("t AS (SELECT event_type AS symbol, value AS v, user_id % 3 AS sd, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events), u AS (SELECT symbol, sum(CASE WHEN sd = 0 THEN v ELSE 0 END) AS b, sum(CASE WHEN sd = 1 THEN v ELSE 0 END) AS s FROM t WHERE rn <= 200 GROUP BY symbol), w AS (SELECT symbol, round_even(b / (b + s) * 100, 1) AS bp, round_even(s / (b + s) * 100, 1) AS sp FROM u)",
            f"SELECT symbol, bp AS buy_pressure, sp AS sell_pressure, round_even(bp - sp, 1) AS imbalance, CASE WHEN bp > sp + 10 THEN '{flow.TICK_LABELS[0]}' WHEN sp > bp + 10 THEN '{flow.TICK_LABELS[2]}' ELSE '{flow.TICK_LABELS[1]}' END AS net_flow FROM w"))
R.add("a15_close_pressure", lambda s, d: flow.close_pressure(bars_daily(s, d)),
      q.sql([q.DAILY, "p AS (SELECT *, CASE WHEN high - low >= 1e-9 THEN (close - low) / (high - low) END AS pos FROM bars WHERE bar_no >= n_bars - 10)", "c AS (SELECT symbol, count_if(pos > 0.6) AS b, count_if(pos < 0.4) AS s, count(*) AS n FROM p GROUP BY symbol)", "u AS (SELECT *, coalesce(round_even(nullif(b, 0) / n * 100, 1), 0) AS bp, coalesce(round_even(nullif(s, 0) / n * 100, 1), 0) AS sp FROM c)"],
            f"SELECT symbol, bp AS buy_pressure, sp AS sell_pressure, coalesce(round_even(nullif(bp - sp, 0), 1), 0) AS imbalance, {case('(bp - sp)', 20, 8, flow.RETAIL_LABELS)} AS retail_signal, CASE WHEN b > s + 2 THEN '{flow.PRESSURE_LABELS[0]}' WHEN s > b + 2 THEN '{flow.PRESSURE_LABELS[2]}' ELSE '{flow.PRESSURE_LABELS[1]}' END AS net_flow FROM u"))
SHOCK = [
    {"rt": f"coalesce(close / {q.lag('close')} - 1, 0)"},
    {"vz": f"coalesce((volume - {q.mean('volume', 20)}) / nullif({q.std('volume', 20)}, 0), 0)", "rz": f"coalesce(rt / nullif({q.std('rt', 20)}, 0), 0)", "bd": "coalesce((close - open) / nullif(open, 0), 0)"},
    {"shock": q.clip("tanh(greatest(-bd, 0) * 40) * 0.35 + tanh(greatest(vz, 0) / 2.2) * 0.35 + tanh(greatest(-rz, 0) / 2.0) * 0.30", 0, 1)},
    {"shock_ema": f"sum(shock * exp(0.405465108108164 * (bar_no - 500)) * CASE WHEN bar_no = 0 THEN 1.0 ELSE 0.3333333333333333 END) OVER {q.RUN} / exp(0.405465108108164 * (bar_no - 500))"},
    {"shock_severity": "CASE WHEN shock_ema >= 0.7 THEN 'HIGH' WHEN shock_ema >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END"},
]
for nm in ("w7_ewm_unadjusted", "g14_flow_shock"):
    add(nm, flow.flow_shock, SHOCK, exact=["shock_severity"] if nm[0] == "g" else [], r6=["shock", "shock_ema"] if nm[0] == "g" else ["shock_ema"], base=q.HOURLY, src="hours", bars=bars_hourly)

# ---- positioning and regime --------------------------------------------------------------------
POS_LAYERS = [{"commercial_net": "commercial_long - commercial_short", "short_ratio": "commercial_short / nullif(open_interest, 0)",
               "short_change": f"commercial_short - {q.lag('commercial_short')}", "short_change_pct": f"(commercial_short / {q.lag('commercial_short')} - 1) * 100"}]
add("s6_positioning_columns", cx.positioning_columns, POS_LAYERS, exact=["commercial_net", "short_ratio", "short_change", "short_change_pct"], base=q.POSITIONING, src="pos", bars=positioning)
COT_CFG = CotSettings(short_ratio_threshold=0.33, anomaly_multiplier=1.5)


def with_positioning(s, d):
    cols = ["open_interest", "commercial_short", "short_ratio", "short_change"]
    return joins.asof_calendar(bars_daily(s, d), cx.positioning_columns(positioning(s, d)), cols)


POSC, _pl = q.chain("pos", *POS_LAYERS, prefix="pp")
MERGED = [q.DAILY, q.POSITIONING, *POSC, f"mg AS (SELECT b.*, p.open_interest, p.commercial_short, p.short_ratio, p.short_change FROM bars b ASOF LEFT JOIN {_pl} p ON b.ts >= p.ts)"]
TREND = lambda k: f"coalesce(sign(coalesce(short_ratio - {q.lag('short_ratio', k)}, 0)), 0)"
COT_LAYERS = [
    {"rt": f"close / {q.lag('close')} - 1", "ab": "abs(short_change)"},
    {"vl": f"{q.std('rt', 20, 5)} * sqrt(252)", "avc": q.mean("ab", 8, 1)},
    {"hot": f"coalesce(vl > {q.mean('vl', 60, 10)} * 1.5, false)", "t4": TREND(4), "t12": TREND(12)},
    {"hi": "coalesce(short_ratio > 0.33, false)", "odd": "coalesce(ab > avc * 1.5, false)", "agree": "t4 = t12"},
    {"buy": "odd AND coalesce(short_change < 0, false) AND coalesce(short_ratio < 0.33, false)", "strong": "hi AND odd AND hot", "moderate": "hi AND odd AND NOT hot AND agree"},
    {"cot_signal": "CASE WHEN buy THEN 1 WHEN strong OR moderate THEN -1 ELSE 0 END",
     "cot_reason": "CASE WHEN buy AND agree THEN 'COT_REVERSAL_MTF' WHEN buy THEN 'COT_REVERSAL' WHEN strong THEN 'FLUSH_ALERT' WHEN moderate THEN 'COT_ANOMALY' ELSE '' END"},
]
_c, _l = q.chain("mg", *COT_LAYERS)
R.add("g1_cot_monitor", lambda s, d: cx.cot_monitor(with_positioning(s, d), COT_CFG).select(*KEY, "cot_signal", "cot_reason"), q.sql([*MERGED, *_c], f"SELECT symbol, ts, cot_signal, cot_reason FROM {_l}"))
R.add("g1_cot_reading", lambda s, d: cx.cot_reading(with_positioning(s, d), COT_CFG),
      q.sql([*MERGED, *_c], f"SELECT symbol, ts, printf('%.2f%%', short_ratio * 100) AS short_ratio_text, cot_signal, cot_reason, CASE WHEN odd THEN 'HIGH' ELSE 'NORMAL' END AS alert_level FROM {_l} WHERE bar_no = n_bars - 1"))
REG_LAYERS = [*q.ADX_LAYERS, {"rg_tr": q.TR}, {"rg_atr": q.mean("rg_tr", 14, 1)},
              {"market_regime": f"CASE WHEN adx > 20 AND coalesce(rg_atr > {q.mean('rg_atr', 50, 10)}, false) THEN 'TRENDING' ELSE 'RANGING' END"}]
add("g3b_regime_filter", cx.regime_filter, REG_LAYERS, exact=["market_regime"], r4=["adx"])
BANK_CFG = BankSettings(concentration_threshold=0.34, usd_strength_threshold=0.02)
BANK_LAYERS = [*REG_LAYERS, {"rat": "commercial_short / nullif(open_interest, 0)"},
               {"bank_concentration": q.clip(q.mean("rat", 3, 1), 0.15, 0.75), "usd_trend": f"usd_close / {q.lag('usd_close', 10)} - 1"},
               {"al": "coalesce(bank_concentration > 0.34, false)", "us": "coalesce(usd_trend > 0.02, false)", "buy": "coalesce(bank_concentration < 0.30 AND usd_trend < -0.02, false)"},
               {"bank_signal": "CASE WHEN buy THEN 1 WHEN al AND us THEN -1 WHEN al AND NOT us AND market_regime <> 'RANGING' THEN -1 ELSE 0 END",
                "bank_reason": "CASE WHEN buy THEN 'BANK_COVERING' WHEN al AND us THEN 'BANK_DOMINANCE' WHEN al AND NOT us AND market_regime <> 'RANGING' THEN 'BANK_WARNING' WHEN bank_concentration IS NULL THEN 'NO_REAL_BANK_FLOW_DATA' ELSE '' END"}]
_c, _l = q.chain("mu", *BANK_LAYERS)


def with_usd(s, d):
    return joins.asof_calendar(with_positioning(s, d), benchmark_daily(s, d).where(F.col("bar_no") % 5 == 0).withColumn("usd_close", F.col("close")), ["usd_close"])


R.add("g3_bank_monitor", lambda s, d: cx.bank_monitor(with_usd(s, d), BANK_CFG).select(*KEY, "bank_signal", "bank_reason", fix("bank_concentration", 6).alias("bank_concentration")),
      q.sql([*MERGED, q.BENCH, "mu AS (SELECT m.*, u.close AS usd_close FROM mg m ASOF LEFT JOIN (SELECT * FROM bench WHERE bar_no % 5 = 0) u ON m.ts >= u.ts)", *_c],
            f"SELECT symbol, ts, bank_signal, bank_reason, {q.fix('bank_concentration', 6)} AS bank_concentration FROM {_l}"))
G4_LAYERS = [*q.ADX_LAYERS, *q.RSI_LAYERS, {"sma50": q.mean("close", 50), "sma200": q.mean("close", 200)},
             {"regime": "CASE WHEN close > sma50 AND sma50 > sma200 THEN CASE WHEN adx > 20 THEN 'BULL' ELSE 'ACCUMULATION' END WHEN close < sma50 AND sma50 < sma200 THEN CASE WHEN adx > 20 THEN 'BEAR' ELSE 'DISTRIBUTION' END ELSE 'SIDEWAYS' END"}]
_c, _l = q.chain("bars", *G4_LAYERS)
R.add("g4_market_regime", lambda s, d: cx.market_regime(bars_daily(s, d)),
      q.sql([q.DAILY, *_c], f"""SELECT symbol, ts, close, CASE WHEN n_bars < 200 THEN 'UNKNOWN' ELSE regime END AS regime, CASE WHEN n_bars < 200 THEN 0 ELSE round_even(adx, 2) END AS adx,
 CASE WHEN n_bars >= 200 THEN round_even(rsi, 2) END AS rsi, CASE WHEN n_bars >= 200 THEN round_even(sma50, 2) END AS sma50, CASE WHEN n_bars >= 200 THEN round_even(sma200, 2) END AS sma200,
 CASE WHEN n_bars >= 200 THEN rsi > 75 OR rsi < 25 END AS is_overextended, CASE WHEN n_bars >= 200 THEN round_even((close - sma200) / sma200 * 100, 2) END AS distance_to_sma200 FROM {_l} WHERE bar_no = n_bars - 1"""))
RS_CTE = """bx AS (SELECT max(n_bars) AS bl, arg_max(close, bar_no) AS bc FROM bench), e AS (SELECT symbol, max(n_bars) AS n, arg_max(close, bar_no) AS c FROM bars GROUP BY symbol),
e2 AS (SELECT *, CASE WHEN least(n, bl) < 120 THEN least(n, bl) - 1 ELSE 120 END AS w FROM e, bx),
rs AS (SELECT e2.symbol, coalesce(round_even(((c / b.close - 1) - (bc / x.close - 1)) * 100, 2), 0) AS rs_score FROM e2 JOIN bars b ON b.symbol = e2.symbol AND b.bar_no = e2.n - e2.w JOIN bench x ON x.bar_no = e2.bl - e2.w)"""
R.add("w35_relative_strength", lambda s, d: cx.relative_strength(bars_daily(s, d), benchmark_daily(s, d)), q.sql([q.DAILY, q.BENCH, RS_CTE], "SELECT symbol, rs_score FROM rs"))
_c, _l = q.chain("bars", *G4_LAYERS)
R.add("strongest_regimes", lambda s, d: cx.strongest_regimes(bars_daily(s, d), benchmark_daily(s, d)).select("symbol", "regime", "rs_score"),
      q.sql([q.DAILY, q.BENCH, RS_CTE, *_c], f"SELECT symbol, CASE WHEN n_bars < 200 THEN 'UNKNOWN' ELSE regime END AS regime, rs_score FROM {_l} JOIN rs USING (symbol) WHERE bar_no = n_bars - 1 ORDER BY rs_score DESC, symbol LIMIT 10"))
PA_LAYERS = [*q.RSI_LAYERS, {"hi20": q.high("high", 20, 1), "lo20": q.low("low", 20, 1), "va20": q.mean("volume", 20)},
             {"structure": f"CASE WHEN close >= hi20 * 0.98 THEN '{cx.STRUCTURE[0]}' WHEN close <= lo20 * 1.02 THEN '{cx.STRUCTURE[1]}' ELSE '{cx.STRUCTURE[2]}' END",
              "volume_ratio": "CASE WHEN va20 > 0 THEN volume / va20 ELSE 1.0 END"},
             {"volume_status": f"CASE WHEN volume_ratio > 2.0 THEN '{cx.VOLUME_STATUS[0]}' WHEN volume_ratio > 1.2 THEN '{cx.VOLUME_STATUS[1]}' ELSE '{cx.VOLUME_STATUS[2]}' END",
              "momentum_bias": "CASE WHEN rsi > 60 THEN 'Bullish' WHEN rsi < 40 THEN 'Bearish' ELSE 'Neutral' END"}]
_c, PA_LAST = q.chain("bars", *PA_LAYERS, prefix="pa")
PA_CTES = [q.DAILY, q.BENCH, RS_CTE, *_c]
R.add("g8_price_action", lambda s, d: cx.price_action(bars_daily(s, d), benchmark_daily(s, d)).select(*KEY, "structure", "volume_status", "momentum_bias", "rs_score", fix("rsi", 4).alias("rsi"), fix("volume_ratio", 6).alias("volume_ratio")),
      q.sql(PA_CTES, f"SELECT symbol, ts, structure, volume_status, momentum_bias, rs_score, {q.fix('rsi', 4)} AS rsi, {q.fix('volume_ratio', 6)} AS volume_ratio FROM {PA_LAST} JOIN rs USING (symbol) WHERE bar_no = n_bars - 1"))
FLAG = lambda src, p: [f"{p}0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_no) AS i FROM {src} WHERE bar_no >= n_bars - 15 AND n_bars >= 15)",
        f"{p}1 AS (SELECT symbol, avg(CASE WHEN i >= 2 THEN high - low END) AS ms, (max(high) - min(low)) / 10 AS fb, max(CASE WHEN i = 1 THEN close END) AS st, max(CASE WHEN i = 10 THEN close END) - max(CASE WHEN i = 1 THEN close END) AS mv, max(CASE WHEN i >= 11 THEN high END) AS tp, min(CASE WHEN i >= 11 THEN low END) AS bt FROM {p}0 GROUP BY symbol)",
        f"{p}2 AS (SELECT *, CASE WHEN ms > 0 THEN ms ELSE fb END AS vl FROM {p}1)",
        f"{p} AS (SELECT symbol, CASE WHEN mv > vl * 2.5 AND tp - bt < mv * 0.4 AND bt > st + mv * 0.5 THEN 'BULL FLAG' WHEN mv < vl * -2.5 AND tp - bt < abs(mv) * 0.4 AND tp < st + mv * 0.5 THEN 'BEAR PENNANT' ELSE 'None' END AS pattern FROM {p}2)"]
R.add("g12_flag_patterns", lambda s, d: cx.flags(bars_daily(s, d)), q.sql([q.DAILY, *FLAG("bars", "fg")], "SELECT symbol, pattern FROM fg"))
FOUR = lambda s, d: __import__("tickloom.functions.series", fromlist=["x"]).index_bars(rs.resample_bars(bars_hourly(s, d), rs.four_hours("ts")), chunk="day")
FOUR_SQL = [q.HOURLY, "f40 AS (" + coarse("hours", "CAST(time_bucket(INTERVAL 4 HOUR, hours.ts) AS TIMESTAMP)") + ")", q.numbered("four", "f40")]
R.add("g11_multi_tf_synergy", lambda s, d: cx.multi_tf_synergy(bars_hourly(s, d), FOUR(s, d)).select("symbol", "pattern", "health", "bias", "next_day_forecast", fix("mom_1h", 4).alias("mom_1h"), fix("struct_4h", 4).alias("struct_4h")),
      q.sql([*FOUR_SQL, *FLAG("hours", "fg"), f"a1 AS (SELECT * FROM (SELECT symbol, bar_no, n_bars, close / {q.lag('close', 4)} - 1 AS r1 FROM hours) WHERE bar_no = n_bars - 1)",
             f"a4 AS (SELECT * FROM (SELECT symbol, bar_no, n_bars, close / {q.lag('close', 4)} - 1 AS r4, coalesce(close > {q.mean('close', 20)}, false) AS ab FROM four) WHERE bar_no = n_bars - 1)",
             "z AS (SELECT symbol, r1, r4, ab, coalesce(pattern, 'None') AS pattern FROM a1 JOIN a4 USING (symbol) LEFT JOIN fg USING (symbol))"],
            f"""SELECT symbol, pattern, CASE WHEN r1 > 0.005 AND r4 > 0 AND ab THEN '🔥🔥 STRONG BUY' WHEN pattern <> 'None' THEN '🎯 ' || pattern WHEN r1 > 0.005 AND (r4 < 0 OR NOT ab) THEN '⚠️ WEAK REBOUND' WHEN r1 < -0.005 AND r4 < 0 THEN '💀 BEARISH SYNC' ELSE 'Neutral' END AS health,
 CASE WHEN r1 > 0.005 AND r4 > 0 AND ab THEN 'Bullish Synergy' WHEN pattern <> 'None' THEN 'Continuation' WHEN r1 > 0.005 AND (r4 < 0 OR NOT ab) THEN 'Micro-Only' WHEN r1 < -0.005 AND r4 < 0 THEN 'Full Flush' ELSE 'Neutral' END AS bias,
 CASE WHEN r4 > 0.01 AND ab THEN '75% Bullish Continuation' WHEN r4 < -0.01 THEN '75% Bearish Carryover' ELSE '50% Neutral' END AS next_day_forecast, {q.fix('r1 * 100', 4)} AS mom_1h, {q.fix('r4 * 100', 4)} AS struct_4h FROM z"""))
R.add("g13_afternoon_bias", lambda s, d: cx.afternoon_bias(bars_hourly(s, d).withColumn("volume", F.col("low"))).select("symbol", "bias", "confidence", fix("morning_return", 4).alias("morning_return"), fix("volume_delta", 4).alias("volume_delta")),
      q.sql([q.HOURLY, "a AS (SELECT symbol, avg(low) AS v20, avg(CASE WHEN bar_no >= n_bars - 5 THEN low END) AS v5, arg_max(close, bar_no) / max(CASE WHEN bar_no = n_bars - 5 THEN open END) - 1 AS r FROM hours WHERE bar_no >= n_bars - 20 GROUP BY symbol)", "b AS (SELECT symbol, r, v5 / v20 AS sp FROM a)"],
            f"SELECT symbol, CASE WHEN r > 0.01 AND sp > 1.1 THEN 'Bullish Continuation' WHEN r < -0.01 AND sp > 1.1 THEN 'Bearish Flush' WHEN abs(r) < 0.005 AND sp < 0.8 THEN 'Range Bound / Sideways' ELSE 'Neutral' END AS bias, CASE WHEN abs(r) > 0.01 AND sp > 1.1 THEN 0.75 WHEN abs(r) < 0.005 AND sp < 0.8 THEN 0.6 ELSE 0.5 END::DOUBLE AS confidence, {q.fix('r * 100', 4)} AS morning_return, {q.fix('(sp - 1) * 100', 4)} AS volume_delta FROM b"))
K10_LAYERS = [*REG_LAYERS, {"va": q.mean("volume", 20), "mid": q.mean("close", 20), "sd": q.std("close", 20), "body": "abs(close - open)"},
              {"phase": f"CASE WHEN volume > va * 1.8 AND (high - low - body) / greatest(body, 1e-6) > 1.5 THEN '{cx.PHASES[0]}' WHEN market_regime = 'TRENDING' THEN '{cx.PHASES[1]}' WHEN close > (mid + sd * 2) * 0.95 THEN '{cx.PHASES[2]}' WHEN close < (mid - sd * 2) * 1.05 THEN '{cx.PHASES[3]}' ELSE '{cx.PHASES[4]}' END"}]
_c, _l = q.chain("bars", *K10_LAYERS)
R.add("k10_market_phase", lambda s, d: cx.market_phase(bars_daily(s, d)), q.sql([q.DAILY, *_c], f"SELECT symbol, ts, CASE WHEN n_bars < 50 THEN 'UNKNOWN' ELSE phase END AS phase FROM {_l} WHERE bar_no = n_bars - 1"))


def with_votes(b):
    n = F.col("bar_no")
    return b.withColumns({"smc_signal": (n % 3).cast("int") - 1, "wyckoff_signal": (n % 5 == 0).cast("int"), "bank_signal": -(n % 7 == 0).cast("int"), "ai_bias": (n % 2).cast("int")})


VOTED = "vt AS (SELECT *, bar_no % 3 - 1 AS smc_signal, (bar_no % 5 = 0)::INT AS wyckoff_signal, -((bar_no % 7 = 0)::INT) AS bank_signal, bar_no % 2 AS ai_bias FROM bars)"
DEB_LAYERS = [*q.RSI_LAYERS, {"sma_200": q.mean("close", 200)},
              {"debate_score": q.clip("smc_signal * 1.2 + wyckoff_signal * 1.0 + bank_signal * 0.7 + ai_bias * 0.6 + CASE WHEN close > coalesce(sma_200, close) THEN 0.25 ELSE -0.25 END + CASE WHEN rsi < 30 THEN 0.3 WHEN rsi > 70 THEN -0.3 ELSE 0 END", -5, 5)},
              {"debate_signal": "CASE WHEN debate_score >= 1 THEN 1 WHEN debate_score <= -1 THEN -1 ELSE 0 END"}]
add("g15_debate_score", lambda b: cx.debate_score(with_votes(ind.sma(b, (200,)))), DEB_LAYERS, exact=["debate_signal"], r6=["debate_score"], base=f"{q.DAILY}, {VOTED}", src="vt")
_c, _l = q.chain("vt", *DEB_LAYERS, *G4_LAYERS[len(q.ADX_LAYERS) + len(q.RSI_LAYERS):-1], prefix="dv")
_c2, _l2 = q.chain("bars", *G4_LAYERS, prefix="dg")
R.add("g15_debate_verdict", lambda s, d: cx.debate_verdict(with_votes(ind.sma(bars_daily(s, d), (200,)))).select("symbol", fix("net_score", 2).alias("net_score"), "bull_score", "bear_score", "verdict", "regime", "debate_signal"),
      q.sql([q.DAILY, VOTED, *_c, *_c2, f"""z AS (SELECT v.symbol, v.debate_score, v.debate_signal, CASE WHEN g.n_bars < 200 THEN 'UNKNOWN' ELSE g.regime END AS regime,
 CAST((CASE WHEN regime = 'BULL' AND g.n_bars >= 200 THEN 1 ELSE 0 END) + (CASE WHEN smc_signal > 0 THEN 2 ELSE 0 END) + (CASE WHEN wyckoff_signal > 0 THEN 1.5 ELSE 0 END) + (CASE WHEN ai_bias > 0 THEN 0.8 ELSE 0 END) + (CASE WHEN v.rsi < 30 THEN 0.5 ELSE 0 END) AS DOUBLE) AS bull,
 CAST(-(CASE WHEN regime = 'BEAR' AND g.n_bars >= 200 THEN 1 ELSE 0 END) - (CASE WHEN smc_signal < 0 THEN 2 ELSE 0 END) - (CASE WHEN bank_signal < 0 THEN 1 ELSE 0 END) - (CASE WHEN v.rsi > 70 THEN 0.5 ELSE 0 END) AS DOUBLE) AS bear FROM {_l} v JOIN {_l2} g ON v.symbol = g.symbol AND v.bar_no = g.bar_no WHERE v.bar_no = v.n_bars - 1)""",
             "y AS (SELECT *, round_even(bull + bear + debate_score * 0.25, 2) AS n FROM z)"],
            f"SELECT symbol, {q.fix('n', 2)} AS net_score, bull AS bull_score, bear AS bear_score, CASE WHEN n >= 3 THEN '🔥 STRONG CONVICTION BUY' WHEN n >= 1 THEN '🟢 MODERATE BUY' WHEN n <= -3 THEN '🚫 HIGH RISK: AVOID / EMERGENCY EXIT' WHEN n <= -1 THEN '🔴 WEAK: BEARISH PRESSURE' ELSE '↔️ NEUTRAL: WAIT FOR SETUP' END AS verdict, regime, debate_signal FROM y"))
COMB_LAYERS = [*q.ADX_LAYERS, *q.RSI_LAYERS, {"fs": q.mean("close", 50), "sl": q.mean("close", 200)},
               {"sh": "bank_signal * 0.25", "signal_score": "coalesce(CASE WHEN adx > 20 THEN CASE WHEN fs > sl THEN 1.0 WHEN fs < sl THEN -1.0 END ELSE 0.0 END, 0) * 0.7 + bank_signal * 0.25 * 0.3 + smc_signal * 0.45 + wyckoff_signal * 0.40"},
               {"combined_signal": "CASE WHEN (signal_score <= -0.45 AND rsi > 25) OR sh <= -0.55 THEN -1 WHEN signal_score >= 0.45 AND rsi < 75 AND sh > -0.35 THEN 1 ELSE 0 END"}]
add("g16_combined_signal", lambda b: cx.combine_signals(with_votes(b), cx.CombinerSettings(require_real_flow=False)), COMB_LAYERS, exact=["combined_signal"], r6=["signal_score"], base=f"{q.DAILY}, {VOTED}", src="vt")


def indices(s, d):
    names = F.create_map(*[F.lit(x) for x in ("Brand#1", "US", "Brand#2", "VN", "Brand#3", "TW", "Brand#4", "VIX", "Brand#5", "GOLD", "Brand#6", "JP")])
    return rs.latest_quote(bars_daily(s, d)).where(names[F.col("symbol")].isNotNull()).select(names[F.col("symbol")].alias("name"), F.col("change_pct"), (F.col("price") % 40).alias("price"))


IDX = f"""ix0 AS (SELECT *, {q.lag('close')} AS pc FROM bars), ix AS (SELECT CASE symbol WHEN 'Brand#1' THEN 'US' WHEN 'Brand#2' THEN 'VN' WHEN 'Brand#3' THEN 'TW' WHEN 'Brand#4' THEN 'VIX' WHEN 'Brand#5' THEN 'GOLD' ELSE 'JP' END AS name,
 (close - pc) / pc * 100 AS ch, close % 40 AS price FROM ix0 WHERE bar_no = n_bars - 1 AND symbol IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5', 'Brand#6'))"""
BRD = "br AS (SELECT count_if(name NOT IN ('VIX', 'DXY', 'GOLD') AND ch <= -2) AS significant_drops, count_if(name NOT IN ('VIX', 'DXY', 'GOLD') AND ch <= -1) AS minor_drops, avg(CASE WHEN name IN ('US', 'VN', 'TW') THEN ch END) AS equity_avg, coalesce(max(CASE WHEN name = 'VIX' THEN price END), 0) AS vix, coalesce(max(CASE WHEN name = 'GOLD' THEN ch END), 0) AS gold FROM ix)"
R.add("a10_market_breadth", lambda s, d: cx.breadth(indices(s, d)).select("significant_drops", "minor_drops", fix("equity_avg", 4).alias("equity_avg")),
      q.sql([q.DAILY, IDX, BRD], f"SELECT CAST(significant_drops AS BIGINT) AS significant_drops, CAST(minor_drops AS BIGINT) AS minor_drops, {q.fix('equity_avg', 4)} AS equity_avg FROM br"))
R.add("g18_crash_shield", lambda s, d: cx.crash_shield(indices(s, d)).select("level", "flight_to_safety", "size_multiplier"),
      q.sql([q.DAILY, IDX, BRD, "lv AS (SELECT *, CASE WHEN significant_drops >= 3 OR vix > 32 THEN 3 WHEN significant_drops >= 1 OR minor_drops >= 3 OR vix > 25 THEN 2 WHEN minor_drops >= 1 OR vix > 20 THEN 1 ELSE 0 END AS level FROM br)"],
            "SELECT level, equity_avg < -1 AND gold > 0.5 AS flight_to_safety, CASE level WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 ELSE 0 END::DOUBLE AS size_multiplier FROM lv"))

# ---- news and geo ------------------------------------------------------------------------------


PHRASES = ("record growth lifts bullish mood", "Hormuz tanker strike", "missile war fear", "sanction embargo in the gulf", "insurance stress",
           "pipeline outage", "ceasefire agreement", "fertilizer supply drop", "quiet day", "Iran crisis inflation", "higher rates, lower demand")
PUBLISHERS = ("Reuters", "CNBC", "Investing.com", "", "Local Wire")


def headlines(s, d):
    """Every document's whole text, led by a market phrase, as a headline of its source."""
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % len(values) + 1).cast("int"))
    return table(s, d, "documents").select(
        "doc_id", F.col("source").alias("symbol"), pick(PUBLISHERS).alias("publisher"), F.concat_ws(" ", pick(PHRASES), "text").alias("headline"),
        F.when(F.col("doc_id") % 3 == 0, "Geopolitics").when(F.col("doc_id") % 3 == 1, "Energy").otherwise("Economy").alias("category"))


_pick = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + f"][doc_id % {len(values)} + 1]"
HL = f"hl AS (SELECT *, lower(headline) AS low FROM (SELECT doc_id, source AS symbol, {_pick(PUBLISHERS)} AS publisher, {_pick(PHRASES)} || ' ' || text AS headline, CASE doc_id % 3 WHEN 0 THEN 'Geopolitics' WHEN 1 THEN 'Energy' ELSE 'Economy' END AS category FROM documents))"
KW = "greatest(-1.0, least(1.0, " + " + ".join(f"CASE WHEN contains(low, '{w}') THEN {v}::DOUBLE ELSE 0 END" for w, v in news.SENTIMENT_WEIGHTS.items()) + "))"
R.add("a11_headline_sentiment", lambda s, d: news.headline_sentiment(headlines(s, d), order="doc_id"),
      q.sql([HL, f"r AS (SELECT symbol, {KW} AS s, row_number() OVER (PARTITION BY symbol ORDER BY doc_id DESC) AS rn FROM hl)", "m AS (SELECT symbol, avg(s) AS s, count(*) AS n FROM r WHERE rn <= 10 GROUP BY symbol)"],
            "SELECT symbol, round_even(s, 4) AS score, CASE WHEN s > 0.1 THEN 'BULLISH' WHEN s < -0.1 THEN 'BEARISH' ELSE 'NEUTRAL' END AS label, n AS n_headlines FROM m"))
R.add("g19_composite_sentiment", lambda s, d: news.composite_sentiment(headlines(s, d).select("doc_id", news.keyword_score(F.col("headline")).alias("news_score"), ((F.col("doc_id") % 9 - 4) / 10.0).alias("social_score"), (F.col("doc_id") % 101).alias("fear_greed"))).select("doc_id", "composite_score", "confidence", "sentiment_bias"),
      q.sql([HL, f"r AS (SELECT doc_id, {KW} AS nw, (doc_id % 9 - 4) / 10.0::DOUBLE AS so, doc_id % 101 AS fg FROM hl)", "c AS (SELECT *, nw * 0.6 + so * 0.3 + (fg - 50) / 50 * 0.1 AS cs FROM r)"],
            "SELECT doc_id, round_even(cs, 4) AS composite_score, round_even(least((abs(cs) * 0.5 + 0.5) * CASE WHEN nw * so > 0 THEN 1.0 ELSE 0.7 END * 100, 99), 1) AS confidence, CASE WHEN cs >= 0.2 THEN 1 WHEN cs <= -0.2 THEN -1 ELSE 0 END AS sentiment_bias FROM c"))
IMP = lambda pick: "CASE " + " ".join(f"WHEN contains(low, '{r[0]}') THEN {pick(r)}" for r in news.IMPACT_RULES) + " END"
for nm in ("g20_news_impact", "j14_first_match_rules"):
    R.add(nm, lambda s, d: news.news_impact(headlines(s, d).select("doc_id", "headline")).select("doc_id", "impact", "direction", "reason", "asset"),
          q.sql([HL, f"m AS (SELECT doc_id, {IMP(lambda r: repr(r[1]))} AS impact, {IMP(lambda r: repr(r[2]))} AS direction, {IMP(lambda r: repr(r[4]))} AS reason, {IMP(lambda r: '[' + ', '.join(repr(t) for t in r[3]) + ']')} AS targets FROM hl)"],
                "SELECT doc_id, impact, direction, reason, unnest(targets) AS asset FROM m WHERE impact IS NOT NULL"))
EV = lambda pick: "CASE " + " ".join(f"WHEN regexp_matches(headline, '(?i)({chr(124).join(r[0])})') THEN {pick(r)}" for r in news.EVENT_RULES) + " END"
EVENTS_SQL = [HL, f"ev0 AS (SELECT *, {EV(lambda r: repr(r[1]))} AS event_type, {EV(lambda r: repr(r[2]))} AS severity, {EV(lambda r: f'{r[3]}::DOUBLE')} AS base FROM hl WHERE trim(headline) <> '')",
              f"ev AS (SELECT doc_id, event_type, severity, CASE publisher WHEN 'Reuters' THEN 'A' WHEN 'CNBC' THEN 'B' WHEN 'Local Wire' THEN 'B' ELSE 'C' END AS source_quality, greatest(0.2, least(0.98, base + CASE category WHEN 'Geopolitics' THEN 0.07 WHEN 'Energy' THEN 0.04 ELSE 0 END::DOUBLE + CASE publisher WHEN 'Reuters' THEN 0.06 ELSE 0 END::DOUBLE)) AS confidence, CASE WHEN regexp_matches(headline, '(?i)({chr(124).join(news.REGION_WORDS)})') THEN 'Hormuz' ELSE 'Global' END AS region, TIMESTAMP '2024-01-01' - (doc_id % 72) * INTERVAL 1 HOUR AS event_ts FROM ev0 WHERE event_type IS NOT NULL)"]
EVENTS = lambda s, d: news.headline_events(headlines(s, d)).withColumn("event_ts", F.lit("2024-01-01").cast("timestamp_ntz") - F.make_dt_interval(hours=(F.col("doc_id") % 72).cast("int")))
R.add("g21_headline_events", lambda s, d: EVENTS(s, d).select("doc_id", "event_type", "severity", "source_quality", "region", fix("confidence", 4).alias("confidence")),
      q.sql(EVENTS_SQL, f"SELECT doc_id, event_type, severity, source_quality, region, {q.fix('confidence', 4)} AS confidence FROM ev"))


def raw_events(s, d):
    return table(s, d, "events").select("event_id", F.col("ts").alias("time"), F.concat(F.lit(" "), "event_type").alias("type"), F.when(F.col("event_id") % 3 == 0, F.lit("bad")).otherwise((F.col("value") / 100).cast("string")).alias("conf"))


R.add("c20_normalized_events", lambda s, d: news.normalize_events(raw_events(s, d)).select("event_id", "event_ts", "event_type", "severity", "source_quality", "region", "confidence"),
      "SELECT event_id, ts AS event_ts, upper(trim(event_type)) AS event_type, 'MEDIUM' AS severity, 'B' AS source_quality, 'Hormuz' AS region, CASE WHEN event_id % 3 = 0 THEN 0.6 ELSE greatest(0, least(1, value / 100)) END::DOUBLE AS confidence FROM events")


def now():
    return F.lit("2024-01-01 01:00:00").cast("timestamp_ntz")


SCORED = [*EVENTS_SQL, "sc AS (SELECT CASE event_type WHEN 'SANCTIONS_ENFORCEMENT' THEN 0.7 WHEN 'DIPLOMATIC_DEESCALATION' THEN -0.8 WHEN 'INSURANCE_STRESS' THEN 0.6 ELSE 1.0 END::DOUBLE AS k, CASE severity WHEN 'MEDIUM' THEN 0.5 WHEN 'HIGH' THEN 0.8 ELSE 1.0 END::DOUBLE * CASE source_quality WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.8 ELSE 0.6 END::DOUBLE AS sv, confidence, event_ts, epoch(TIMESTAMP '2024-01-01 01:00:00' - event_ts) / 3600 AS age FROM ev)",
          "rk AS (SELECT avg(k * sv * confidence * exp(-ln(2.0) * age / 36)) AS m, max(k * sv * confidence * exp(-ln(2.0) * age / 36)) AS x, count_if(k > 0)::DOUBLE AS support_count, count_if(k < 0)::DOUBLE AS deescalation_count, count(*) AS n_events, max(event_ts) AS latest FROM sc)",
          "gr AS (SELECT *, coalesce(greatest(0, least(1, (greatest(-1, least(1, m + x * 0.35)) + 1) / 2)), 0) AS g FROM rk)"]
R.add("a12_geo_risk", lambda s, d: news.geo_risk(EVENTS(s, d), now()).select(fix("geo_risk_score", 6).alias("geo_risk_score"), "support_count", "deescalation_count", "n_events"),
      q.sql(SCORED, f"SELECT {q.fix('g', 6)} AS geo_risk_score, support_count, deescalation_count, n_events FROM gr"))
R.add("g22_causal_map", lambda s, d: news.causal_map(news.geo_risk(EVENTS(s, d), now())).select(fix("prob_oil_up_1d", 6).alias("prob_oil_up_1d"), fix("expected_oil_move_1d_pct", 6).alias("expected_oil_move_1d_pct"), "tail_risk_flag"),
      q.sql(SCORED, f"SELECT {q.fix('1 / (1 + exp(-7 * (g - 0.5)))', 6)} AS prob_oil_up_1d, {q.fix('(1 / (1 + exp(-7 * (g - 0.5))) - 0.5) * 12', 6)} AS expected_oil_move_1d_pct, (g >= 0.7)::DOUBLE AS tail_risk_flag FROM gr"))
R.add("g23_execution_gate", lambda s, d: news.execution_gate(news.geo_risk(EVENTS(s, d), now()), now()).select("gate_stale", "gate_action", "gate_multiplier"),
      q.sql([*SCORED, "z AS (SELECT *, n_events < 2 OR coalesce(epoch(TIMESTAMP '2024-01-01 01:00:00' - latest) / 60 > 180, true) AS st FROM gr)"],
            "SELECT st AS gate_stale, CASE WHEN st THEN 'REDUCE_SIZE' WHEN g >= 0.7 THEN 'PAUSE_NEW_LONGS' WHEN g >= 0.45 THEN 'REDUCE_SIZE' ELSE 'NORMAL' END AS gate_action, CASE WHEN st THEN 0.6 WHEN g >= 0.7 THEN 0.0 WHEN g >= 0.45 THEN 0.5 ELSE 1.0 END::DOUBLE AS gate_multiplier FROM z"))
R.add("se2_deduped_headlines", lambda s, d: news.dedupe_headlines(table(s, d, "documents").select("doc_id", F.col("text").alias("headline"), "source"), "doc_id").select("doc_id", "source"),
      "SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text")

# ---- fundamentals and seasonality ----------------------------------------------------------------
QUARTER = "concat(CAST(year(o_orderdate) AS VARCHAR), '-Q', CAST(quarter(o_orderdate) AS VARCHAR))"


def statement(s, d):
    """Quarterly order totals of every nation as statement items."""
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    qd = F.concat(F.year("o_orderdate").cast("string"), F.lit("-Q"), F.quarter("o_orderdate").cast("string"))
    status = F.col("o_orderstatus")
    item = F.when(status == "F", "sales").when(status == "O", "assets").otherwise("equity")
    money = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    base = o.groupBy(F.col("c_nationkey").alias("symbol"), qd.alias("quarter"), item.alias("item")).agg(money.alias("value"))
    more = [base.where(F.col("item") == "sales").withColumns({"item": F.lit(n), "value": F.col("value") * k}) for n, k in (("profit", 0.125), ("ocf", 0.25), ("capex", -0.0625))]
    for m in more:
        base = base.unionByName(m)
    return base


STMT = [f"st0 AS (SELECT c_nationkey AS symbol, {QUARTER} AS quarter, CASE o_orderstatus WHEN 'F' THEN 'sales' WHEN 'O' THEN 'assets' ELSE 'equity' END AS item, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)",
        "st AS (SELECT * FROM st0 UNION ALL SELECT symbol, quarter, 'profit', value * 0.125 FROM st0 WHERE item = 'sales' UNION ALL SELECT symbol, quarter, 'ocf', value * 0.25 FROM st0 WHERE item = 'sales' UNION ALL SELECT symbol, quarter, 'capex', value * -0.0625 FROM st0 WHERE item = 'sales')",
        "sr AS (SELECT *, row_number() OVER (PARTITION BY symbol, item ORDER BY quarter DESC) AS r, max(quarter) OVER (PARTITION BY symbol) AS ql, min(quarter) OVER (PARTITION BY symbol) AS qo FROM st)"]
_ttm = lambda n: f"sum(CASE WHEN item = '{n}' AND r <= 4 THEN value END) * CASE WHEN count_if(item = '{n}' AND r <= 4) < 4 THEN 4.0 / nullif(count_if(item = '{n}' AND r <= 4), 0) ELSE 1.0 END"
_at = lambda n, w: f"max(CASE WHEN item = '{n}' AND quarter = {w} THEN value END)"
STMT.append("sa AS (SELECT symbol, " + ", ".join([f"{_ttm(n)} AS {n}" for n in ("sales", "profit", "ocf", "capex")] + [f"{_at(n, 'ql')} AS {n}_n" for n in ("equity", "assets", "sales", "profit")] + [f"{_at(n, 'qo')} AS {n}_o" for n in ("sales", "profit")]) + " FROM sr GROUP BY symbol)")
STMT.append("ra AS (SELECT symbol, profit / nullif(equity_n, 0) AS roe, (nullif(assets_n, 0) - equity_n) / nullif(equity_n, 0) AS debt_to_equity, (profit_n - profit_o) / nullif(abs(profit_o), 0) AS eps_growth, (sales_n - sales_o) / nullif(abs(sales_o), 0) AS revenue_growth, profit / nullif(sales, 0) AS profit_margin, (ocf + capex) / (500000000.0 + symbol * 1e8) AS fcf_yield, CASE WHEN profit / ((500000000.0 + symbol * 1e8) / 100.0) > 0 THEN 100.0 / (profit / ((500000000.0 + symbol * 1e8) / 100.0)) END AS pe_ratio FROM sa)")
QUOTES = lambda s, d: table(s, d, "nation").select(F.col("n_nationkey").alias("symbol"), F.lit(100.0).alias("price"), (F.col("n_nationkey") * 1e8 + 500000000.0).alias("market_cap"))
RAT = ["roe", "debt_to_equity", "eps_growth", "revenue_growth", "profit_margin", "fcf_yield", "pe_ratio"]
R.add("a16_ttm_ratios", lambda s, d: fundamentals.ttm_ratios(statement(s, d), QUOTES(s, d)).select("symbol", *[fix(c, 6).alias(c) for c in RAT]), q.sql(STMT, sel("ra", r6=RAT, keys=["symbol"])))


def tiers_sql(m: str) -> str:
    if m == "debt_to_equity":
        body = " ".join(f"WHEN {m} <= {t} THEN {p}" for t, p in fundamentals.DEBT_AT_MOST)
    elif m == "pe_ratio":
        body = " ".join(f"WHEN {m} < {t} AND {m} > 0 THEN {p}" for t, p in fundamentals.PE_BELOW)
    else:
        body = " ".join(f"WHEN {m} >= {t} THEN {p}" for t, p in fundamentals.AT_LEAST[m])
    return f"(CASE {body} ELSE 0 END)"


_pres = {m: f"({m} > 0)" if m == "pe_ratio" else f"({m} IS NOT NULL)" for m in fundamentals.METRICS}
FS = [*STMT, "fs0 AS (SELECT *, " + " + ".join(tiers_sql(m) for m in fundamentals.METRICS) + " AS raw, " + " + ".join(f"coalesce({_pres[m]}, false)::INT" for m in fundamentals.METRICS) + " AS nf, " + " + ".join(f"(CASE WHEN {_pres[m]} THEN {fundamentals.MAX_POINTS[m]} ELSE 0 END)" for m in fundamentals.METRICS) + " AS poss FROM ra)",
      "fs AS (SELECT symbol, CAST(floor(nf / 7 * 100) AS INT) AS data_coverage, CAST(least(100, floor(raw / greatest(poss, 1) * 100)) AS INT) AS tot FROM fs0)"]
GR = "CASE WHEN data_coverage < 40 THEN 'N/A' " + " ".join(f"WHEN tot >= {lim} THEN '{g}'" for lim, g, _ in fundamentals.GRADES) + " END"
R.add("g24_fundamental_score", lambda s, d: fundamentals.fundamental_score(fundamentals.ttm_ratios(statement(s, d), QUOTES(s, d))).select("symbol", "data_coverage", "total_score", "grade"),
      q.sql(FS, f"SELECT symbol, data_coverage, CASE WHEN data_coverage < 40 THEN 0 ELSE tot END AS total_score, {GR} AS grade FROM fs"))
R.add("a20_data_coverage", lambda s, d: bars_daily(s, d).groupBy("market").agg(F.countDistinct("symbol").alias("n_symbols"), F.round(F.count(F.when(F.col("volume") > 30, 1)) / F.count(F.lit(1)) * 100, 2).alias("traded_pct"), F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("symbols")),
      q.sql(q.DAILY, "SELECT market, count(DISTINCT symbol) AS n_symbols, round(count_if(volume > 30) / count(*) * 100, 2) AS traded_pct, array_to_string(list_sort(list(DISTINCT symbol)), ',') AS symbols FROM bars GROUP BY market"))
SEAS = lambda f: "CASE market " + " ".join(f"WHEN '{m}' THEN {f(seasonality.CALENDAR[m])}" for m in ("VN", "TW", "US")) + " END"
_arr = lambda vals: "[" + ", ".join(map(str, vals)) + "][month(ts)]"
SEAS_NOW = SEAS(_arr)
R.add("g17_seasonality", lambda s, d: seasonality.seasonality(bars_daily(s, d)).select(*KEY, "asset_type", "seasonality_score", fix("seasonality_weight", 4).alias("seasonality_weight"), "seasonality_adverse", "months_to_strong"),
      q.sql([q.DAILY, f"z AS (SELECT symbol, ts, market, CAST({SEAS(_arr)} AS DOUBLE) AS sc, nullif({SEAS(lambda s: _arr(seasonality._next_strong(s)))}, 0) AS aw FROM bars)"],
            f"SELECT symbol, ts, market AS asset_type, sc AS seasonality_score, {q.fix('greatest(0.5, least(1.5, 1 + sc * 0.5))', 4)} AS seasonality_weight, sc <= -0.3 AS seasonality_adverse, aw AS months_to_strong FROM z"))

QUERIES, ORACLES = R.queries, R.oracles
