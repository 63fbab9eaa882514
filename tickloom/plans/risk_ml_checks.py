"""Risk, portfolio, outcome studies and machine-learning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.config import ForecastSettings, VolumePriceSettings
from tickloom.functions.series import is_last, per_block, tail
from tickloom.operators import flow, joins, ml, risk, walkforward
from tickloom.operators import indicators as ind
from tickloom.operators import scanner as sc
from tickloom.operators import wyckoff
from tickloom.plans import sqlkit as q
from tickloom.plans.flow_context_checks import SEAS_NOW, VP_LAYERS, W21_CTES
from tickloom.plans.registry import KEY, Registry, fix, rounded, sel
from tickloom.plans.scanner_checks import SCAN, scan
from tickloom.plans.smc_checks import MEMBER, SCORE, smc_table, state
from tickloom.plans.wyckoff_elliott_checks import wy_table
from tickloom.sources.driver_tables import bars_daily, bars_hourly, benchmark_daily, derived_table, table

R = Registry()
RET = f"rt AS (SELECT *, close / {q.lag('close')} - 1 AS r FROM bars)"


def var_sql(where: str) -> list[str]:
    return [q.DAILY, f"v0 AS (SELECT *, close / lag(close) OVER ({q.P}) - 1 AS r FROM bars WHERE {where} AND bar_no >= n_bars - 252)", "v1 AS (SELECT symbol, any_value(n_bars) AS n, quantile_cont(r, 0.05) AS v, arg_max(close, bar_no) AS last FROM v0 GROUP BY symbol)",
            "v2 AS (SELECT v1.symbol, n, v, last, avg(r) AS cv FROM v1 JOIN v0 USING (symbol) WHERE r <= v GROUP BY ALL)"]


R.add("r1_value_at_risk", lambda s, d: risk.value_at_risk(bars_daily(s, d)).select("symbol", fix("var_pct", 6).alias("var_pct"), fix("var_value", 3).alias("var_value"), fix("cvar_pct", 6).alias("cvar_pct")),
      q.sql(var_sql("true"), f"SELECT symbol, {q.fix('abs(v)', 6)} AS var_pct, {q.fix('abs(v * last)', 3)} AS var_value, {q.fix('abs(cv)', 6)} AS cvar_pct FROM v2"))
R.add("r2_var_gate", lambda s, d: risk.var_gate(bars_daily(s, d)).select("symbol", fix("var_pct", 6).alias("var_pct"), "blocked"), q.sql(var_sql("bar_no >= 1"), f"SELECT symbol, {q.fix('abs(v)', 6)} AS var_pct, abs(v) > 0.03 AS blocked FROM v2"))


def pairs(s, d):
    ret = ind.lagged_returns(bars_daily(s, d), 1).select(*KEY, F.col("log_ret").alias("ret"))
    return derived_table(s, d, "pairs", lambda: joins.pairwise(ret))


PAIR = [q.DAILY, f"lr AS (SELECT symbol, ts, ln(close / {q.lag('close')}) AS ret FROM bars)", "pr AS (SELECT x.symbol AS a, y.symbol AS b, corr(x.ret, y.ret) AS c, covar_samp(x.ret, y.ret) AS v FROM lr x JOIN lr y ON x.ts = y.ts AND x.symbol <= y.symbol WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2)"]
R.add("r3_covariance_pairs", lambda s, d: pairs(s, d).where("a < b").select("a", "b", fix("corr", 6).alias("corr"), fix("cov", 6).alias("cov")), q.sql(PAIR, f"SELECT a, b, {q.fix('c', 6)} AS corr, {q.fix('v', 6)} AS cov FROM pr WHERE a < b"))
R.add("r4_hrp_weights", lambda s, d: risk.hrp_weights(pairs(s, d).withColumn("portfolio_id", F.lit("all"))).select("symbol", F.round("weight", 6).alias("weight")))
R.add("r5_risk_budget", lambda s, d: risk.risk_budget(ind.volatility(tail(bars_daily(s, d), 30)).where(is_last()).select(F.col("market").alias("portfolio_id"), "symbol", F.col("ret_std").alias("risk"))).select("symbol", fix("budget", 6).alias("budget")),
      q.sql([q.DAILY, RET, f"sd AS (SELECT symbol, market, bar_no, n_bars, {q.std('r', 20)} AS k FROM rt)", "z AS (SELECT symbol, market, 1 / greatest(k, 1e-6) AS i FROM sd WHERE bar_no = n_bars - 1)"], f"SELECT symbol, {q.fix('i / sum(i) OVER (PARTITION BY market)', 6)} AS budget FROM z"))


def add(name, op, ctes, select, last="scan"):
    cols = ", ".join(f"{q.fix(v[0], v[1])} AS {c}" if isinstance(v, tuple) else f"{v} AS {c}" for c, v in select.items())
    R.add(name, lambda s, d: op(scan(s, d)).select(*[fix(c, v[1]).alias(c) if isinstance(v, tuple) else F.col(c) for c, v in select.items()]), q.sql([SCAN, *ctes], f"SELECT {cols} FROM {last}"))


add("r6_volatility_size", lambda x: risk.volatility_size(x.select("symbol", F.lit(100000.0).alias("capital"), F.col("last_close").alias("entry_price"), F.col("atr_pct").alias("atr"), (F.col("crash_level") / 4).alias("crash_multiplier"))),
    ["w AS (SELECT * FROM scan)"], {"symbol": "symbol", "shares": ("CASE WHEN atr_pct > 0 AND last_close > 0 THEN least(2000 / (atr_pct * 2), 25000 / last_close) * crash_level / 4 ELSE 0 END", 4)}, "w")


def trades(s, d):
    """Every order as a trade of its customer segment, won or lost around the overall level."""
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("c_mktsegment").alias("strategy"), (F.col("o_totalprice") - 240000.0).alias("pnl"))


TRD = "td AS (SELECT c_mktsegment AS strategy, o_totalprice - 240000.0 AS pnl FROM orders JOIN customer ON o_custkey = c_custkey)"
MET = "mt AS (SELECT strategy, count(*) AS n, sum(pnl) AS tp, count_if(pnl > 0) / count(*) AS wr, avg(CASE WHEN pnl > 0 THEN pnl END) AS aw, avg(CASE WHEN pnl <= 0 THEN pnl END) AS al, sum(CASE WHEN pnl > 0 THEN pnl END) / abs(sum(CASE WHEN pnl <= 0 THEN pnl END)) AS pf, max(pnl) AS bt, min(pnl) AS wt, avg(pnl) AS ex FROM td GROUP BY strategy)"
R.add("r7_kelly_from_trades", lambda s, d: risk.kelly_from_trades(trades(s, d), base=0.25).select("strategy", fix("kelly_weight", 6).alias("kelly_weight")),
      q.sql([TRD, MET], f"SELECT strategy, {q.fix('greatest(0, least(0.25, greatest(0, least(0.25, (wr * (aw / abs(al)) - (1 - wr)) / (aw / abs(al)) * 0.5))))', 6)} AS kelly_weight FROM mt"))
R.add("r11_trade_metrics", lambda s, d: risk.trade_metrics(trades(s, d)).select("strategy", "num_trades", fix("win_rate", 6).alias("win_rate"), fix("avg_win", 2).alias("avg_win"), fix("avg_loss", 2).alias("avg_loss"), fix("profit_factor", 5).alias("profit_factor"), fix("expectancy", 2).alias("expectancy"), fix("best_trade", 2).alias("best_trade"), fix("worst_trade", 2).alias("worst_trade")),
      q.sql([TRD, MET], f"SELECT strategy, n AS num_trades, {q.fix('wr', 6)} AS win_rate, {q.fix('aw', 2)} AS avg_win, {q.fix('al', 2)} AS avg_loss, {q.fix('pf', 5)} AS profit_factor, {q.fix('ex', 2)} AS expectancy, {q.fix('bt', 2)} AS best_trade, {q.fix('wt', 2)} AS worst_trade FROM mt"))


def order_targets(x):
    return x.select("symbol", "market", (F.col("mtf_norm") / 10).alias("weight"), F.col("last_close").alias("price"), F.lit(1e6).alias("capital"), F.expr("CASE WHEN k % 3 = 0 THEN 500.0e0 ELSE NULL END").alias("position"))


ORD = ["o0 AS (SELECT symbol, market, last_close AS price, CASE market WHEN 'VN' THEN 100 ELSE 1 END AS lot, mtf_norm / 10 AS w, CASE WHEN k % 3 = 0 THEN 500.0e0 ELSE 0 END AS pos FROM scan WHERE last_close > 0)", "o1 AS (SELECT *, floor(1e6 * w / price / lot) * lot - pos AS df FROM o0)", "o2 AS (SELECT *, abs(df) * price AS v FROM o1 WHERE abs(df) >= lot)"]
add("r8_orders", lambda x: risk.orders(order_targets(x)), ORD, {"symbol": "symbol", "action": "CASE WHEN df > 0 THEN 'BUY' ELSE 'SELL' END", "quantity": "CAST(abs(df) AS DOUBLE)", "value": ("v", 3), "commission": ("v * 0.001", 4), "slippage": ("v * 0.0005", 4)}, "o2")
R.add("r9_capital_check", lambda s, d: risk.capital_check(risk.orders(order_targets(scan(s, d)))).select(fix("required", 0).alias("required"), "ok"),
      q.sql([SCAN, *ORD, "z AS (SELECT sum(CASE WHEN df > 0 THEN v * 1.0015 ELSE 0 END) AS r FROM o2)"], f"SELECT {q.fix('r', 0)} AS required, r <= 1e6 AS ok FROM z"))
SIG = lambda b: b.withColumn("signal", F.when(F.col("bar_no") % 37 == 5, 1).when(F.col("bar_no") % 53 == 7, -1).otherwise(0))
OUT = [q.DAILY, f"a0 AS (SELECT *, CASE WHEN bar_no % 37 = 5 THEN 1 WHEN bar_no % 53 = 7 THEN -1 ELSE 0 END AS signal, {q.TR} AS tr FROM bars)", f"a1 AS (SELECT *, {q.mean('tr', 14, 1)} AS atr0, coalesce({q.lag('signal')}, 0) AS sg FROM a0)", "a2 AS (SELECT *, CASE WHEN atr0 > 0 THEN atr0 ELSE close * 0.02 END AS a FROM a1)",
       "en AS (SELECT symbol, bar_no AS entry_no, open * (1 + 0.0005) AS ep, open * (1 + 0.0005) - a * 3 AS ini FROM a2 WHERE sg = 1)",
       "pa AS (SELECT en.*, b.bar_no, b.open, b.close, b.sg, greatest(ini, max(b.close - b.a * 3) OVER (PARTITION BY en.symbol, entry_no ORDER BY b.bar_no ROWS UNBOUNDED PRECEDING)) AS stp FROM en JOIN a2 b ON b.symbol = en.symbol AND b.bar_no BETWEEN entry_no + 1 AND entry_no + 60)",
       "pb AS (SELECT *, CASE WHEN close <= stp THEN 'TRAILING_STOP' WHEN (close - ep) / ep >= 0.10 THEN 'TAKE_PROFIT' WHEN sg = -1 THEN 'SIGNAL_EXIT' END AS why FROM pa)",
       "pc AS (SELECT *, row_number() OVER (PARTITION BY symbol, entry_no ORDER BY (why IS NULL)::INT, CASE WHEN why IS NULL THEN -bar_no ELSE bar_no END) AS rn FROM pb)",
       "pd AS (SELECT *, CASE WHEN why = 'SIGNAL_EXIT' THEN open ELSE close END * (1 - 0.0005) AS xp FROM pc WHERE rn = 1)"]
R.add("r10_entry_outcomes", lambda s, d: risk.entry_outcomes(SIG(bars_daily(s, d))).select("symbol", "entry_no", "exit_no", "exit_reason", fix("pnl_pct", 6).alias("pnl_pct"), fix("pnl_net_pct", 6).alias("pnl_net_pct")),
      q.sql(OUT, f"SELECT symbol, entry_no, bar_no AS exit_no, coalesce(why, 'END_OF_DATA') AS exit_reason, {q.fix('(xp - ep) / ep', 6)} AS pnl_pct, {q.fix('(xp * 0.999 - ep) / ep', 6)} AS pnl_net_pct FROM pd"))
CUR = [q.DAILY, f"c0 AS (SELECT *, close / {q.lag('close')} - 1 AS r, max(close) OVER {q.RUN} AS pk FROM bars)", "c1 AS (SELECT symbol, avg(r) AS m, stddev_pop(r) AS s, count_if(r < 0) AS nd, stddev_pop(CASE WHEN r < 0 THEN r END) AS sd, min((close - pk) / pk) AS dd, arg_min(close, bar_no) AS f, arg_max(close, bar_no) AS l FROM c0 GROUP BY symbol)"]
R.add("r12_curve_metrics", lambda s, d: risk.curve_metrics(bars_daily(s, d), trades_per_year=12.0).select("symbol", *[fix(c, 5).alias(c) for c in ("total_return", "sharpe", "sortino", "max_drawdown", "calmar", "turnover_adjusted_sharpe")]),
      q.sql(CUR, f"SELECT symbol, {q.fix('(l - f) / f', 5)} AS total_return, {q.fix('m / s * sqrt(252)', 5)} AS sharpe, {q.fix('m / sd * sqrt(252)', 5)} AS sortino, {q.fix('dd', 5)} AS max_drawdown, {q.fix('abs((l - f) / f / dd)', 5)} AS calmar, {q.fix('m / s * sqrt(252) / 13', 5)} AS turnover_adjusted_sharpe FROM c1"))
R.add("r13_hit_rate", lambda s, d: risk.hit_rate(SIG(bars_daily(s, d))).select("symbol", fix("hit_rate", 4).alias("hit_rate"), "n_active"),
      q.sql([q.DAILY, f"h AS (SELECT symbol, CASE WHEN bar_no % 37 = 5 THEN 1 WHEN bar_no % 53 = 7 THEN -1 ELSE 0 END AS g, {q.lead('close')} / close - 1 AS nx FROM bars)"], f"SELECT symbol, {q.fix('avg(coalesce((g > 0 AND nx > 0) OR (g < 0 AND nx < 0), false)::INT) * 100', 4)} AS hit_rate, count(*) AS n_active FROM h WHERE g <> 0 GROUP BY symbol"))
add("r14_entry_filters", lambda x: risk.filter_entries(x.select("symbol", F.col("smc_signal").alias("signal"), (F.col("qmf_signal")).alias("sentiment_bias"), F.expr("CAST(k % 2 AS INT)").alias("ai_bias"), "ai_confidence")),
    ["f0 AS (SELECT *, CASE WHEN smc_signal = 1 AND qmf_signal = -1 THEN 0 ELSE smc_signal END AS eff FROM scan)", "f1 AS (SELECT *, ai_confidence > 0.25 AND eff <> 0 AND eff <> k % 2 AS cf FROM f0)"],
    {"symbol": "symbol", "effective_signal": "eff", "ai_conflict": "cf", "weight": ("CASE WHEN eff <> 1 THEN 0 WHEN cf THEN 0.02 ELSE ai_confidence * 0.1 END", 6)}, "f1")
BRK = [q.DAILY, f"k0 AS (SELECT *, max(close) OVER {q.RUN} AS pk FROM bars)", "k1 AS (SELECT *, (pk - close) / pk AS dd FROM k0)", "k2 AS (SELECT *, CASE WHEN dd >= 0.15 THEN true WHEN dd <= 0.05 THEN false END AS mk FROM k1)"]
for nm in ("r15_circuit_breaker", "w38_hysteresis"):
    R.add(nm, lambda s, d: risk.circuit_breaker(bars_daily(s, d)).select(*KEY, "halted"), q.sql(BRK, f"SELECT symbol, ts, coalesce(last_value(mk IGNORE NULLS) OVER {q.RUN}, false) AS halted FROM k2"))


def open_entries(s, d):
    b = ind.atr(bars_daily(s, d))
    return b.withColumn("entry_id", F.floor(F.col("bar_no") / 30))


R.add("w39_trailing_stops", lambda s, d: risk.trailing_stops(open_entries(s, d)).select(*KEY, fix("trail_stop", 4).alias("trail_stop"), "triggered"),
      q.sql([q.DAILY, *q.chain("bars", *q.ATR_LAYERS)[0], f"z AS (SELECT *, max(close - atr * 3) OVER (PARTITION BY symbol, bar_no // 30 ORDER BY bar_no ROWS UNBOUNDED PRECEDING) AS st FROM {q.chain('bars', *q.ATR_LAYERS)[1]})"], f"SELECT symbol, ts, {q.fix('st', 4)} AS trail_stop, close <= st AS triggered FROM z"))

# ---- forecasts and anomaly -------------------------------------------------------------------------
FEAT = {"lag_ret_1": f"ln(close / {q.lag('close')})", "lag_ret_5": f"ln(close / {q.lag('close', 5)})", "ma_5_rel": f"close / {q.mean('close', 5)}", "ma_15_rel": f"close / {q.mean('close', 15)}",
        "roc_20": f"close / {q.lag('close', 20)} - 1", "volume_ratio": f"volume / nullif({q.mean('volume', 20, 5)}, 0)"}
_rsi, _rl = q.chain("bars", *q.RSI_LAYERS, FEAT)
R.add("m1_feature_table", lambda s, d: (lambda t: t.select(*KEY, *[fix(c, 5).alias(c) for c in ("rsi_14", *FEAT)]))(ml.feature_table(bars_daily(s, d))[0]),
      q.sql([q.DAILY, *_rsi], f"SELECT symbol, ts, {q.fix('rsi', 5)} AS rsi_14, " + ", ".join(f"{q.fix(f'coalesce({c}, 0)', 5)} AS {c}" for c in FEAT) + f" FROM {_rl}"))
# All base features and those of the structure steps, each against its own computation.
ALL_FEAT = {**{f"lag_ret_{k}": f"ln(close / {q.lag('close', k)})" for k in range(1, 6)}, **{k: FEAT[k] for k in ("ma_5_rel", "ma_15_rel", "roc_20", "volume_ratio")},
            "roc_5": f"close / {q.lag('close', 5)} - 1", "atr_14_rel": "atr / close", "macd_hist_rel": "(macd - macd_signal) / close"}
_fa, _fl = q.chain("bars", *q.RSI_LAYERS, *q.ATR_LAYERS, {"macd": f"{q.ewm('close', 2 / 13, 12)} - {q.ewm('close', 2 / 27, 26)}"}, {"macd_signal": q.ewm("macd", 2 / 10, 9)}, ALL_FEAT, prefix="fa")
_FLAGS = ["smc_bos_bull", "smc_bos_bear", "smc_choch", "smc_idm_bull", "smc_idm_bear"]
_IN = ["smc_in_bull_ob", "smc_in_bear_ob", "smc_in_bull_fvg", "smc_in_bear_fvg"]
ALL_NAMES = ["rsi_14", *ALL_FEAT, "poc_dist", "inside_va", "rel_strength", "seasonality_score", "seasonality_weight", "smc_score", *_IN, *_FLAGS]
R.add("m1_all_features", lambda s, d: (lambda t: t.select(*KEY, *[fix(c, 5).alias(c) for c in ALL_NAMES]))(ml.feature_table(bars_daily(s, d), extra=[smc_table(s, d)])[0]),
      "WITH RECURSIVE " + ", ".join([*W21_CTES, *_fa, *SCORE, f"mb AS (SELECT symbol, bar_no, {MEMBER} FROM bars b)", f"se AS (SELECT symbol, bar_no, CAST({SEAS_NOW} AS DOUBLE) AS seasonality_score FROM bars)",
          "pf AS (SELECT w0.symbol, w0.bar_no, close, lo, hi, l, h, (hi - lo) / 10 AS st, (lo + poc * ((hi - lo) / 10) + (lo + (poc + 1) * ((hi - lo) / 10))) / 2 AS pp FROM w0 LEFT JOIN vz ON vz.k = w0.symbol || '|' || w0.bar_no)",
          "pg AS (SELECT symbol, bar_no, CASE WHEN bar_no < 20 OR hi = lo THEN 0 ELSE (close - pp) / pp END AS poc_dist, CASE WHEN bar_no < 20 THEN 0 WHEN hi = lo THEN 1 ELSE (close BETWEEN lo + l * st AND lo + (h + 1) * st)::INT END AS inside_va FROM pf)",
          f"af AS (SELECT a.symbol, a.ts, a.rsi AS rsi_14, {', '.join('a.' + c for c in ALL_FEAT)}, poc_dist, inside_va, 1.0 AS rel_strength, seasonality_score, greatest(0.5, least(1.5, 1 + seasonality_score * 0.5)) AS seasonality_weight, sc.smc_score, {', '.join('mb.' + c + '::INT AS ' + c for c in _IN)}, {', '.join('sc.' + c + '::INT AS ' + c for c in _FLAGS)}"
          f" FROM {_fl} a JOIN pg USING (symbol, bar_no) JOIN se USING (symbol, bar_no) JOIN sc USING (symbol, bar_no) JOIN mb USING (symbol, bar_no))"])
      + " SELECT symbol, ts, " + ", ".join(f"{q.fix(f'coalesce({c}, 0)::DOUBLE', 5)} AS {c}" for c in ALL_NAMES) + " FROM af")
FC_CFG = ForecastSettings()


def features(s, d):
    t = derived_table(s, d, "features", lambda: ml.feature_table(bars_daily(s, d), horizons=FC_CFG.horizons)[0])
    return t, list(ml.BASE_FEATURES)


_MODELS: dict = {}


def models(s, d):
    key = (s.sparkContext.applicationId, d)
    if key not in _MODELS:
        t, names = features(s, d)
        _MODELS[key] = ml.train(t, names, FC_CFG)
    return _MODELS[key]


R.add("m2_panel_forecasts", lambda s, d: ml.forecast(features(s, d)[0].where(is_last()), models(s, d), FC_CFG).select("symbol", *[F.round(c, 2).alias(c) for h in FC_CFG.horizons for c in (f"ai_target_{h}d", f"ai_lower_{h}d", f"ai_upper_{h}d")]))
R.add("x_universe_scan", lambda s, d: sc.universe_scan(bars_daily(s, d), benchmark_daily(s, d), ml.scan_forecasts(ml.forecast(features(s, d)[0].where(is_last()), models(s, d), FC_CFG)), state(s, d), wyckoff.wyckoff_state(wy_table(s, d))))
M3 = ["m3a AS (SELECT symbol, last_close AS c, last_close * (0.97 + (k % 60) / 1000.0e0) AS lo, last_close * (0.975 + (k % 90) / 1000.0e0) AS hi FROM scan)", "m3b AS (SELECT *, CASE WHEN c > 0 THEN greatest(0, least(1, 1 - (hi - lo) / c / 0.05)) ELSE 0 END AS cf FROM m3a)"]
add("m3_forecast_signals", lambda x: ml.forecast_signals(x.select("symbol", F.col("last_close").alias("close"), F.expr("last_close * (0.97 + (k % 60) / 1000.0e0)").alias("ai_lower_1d"), F.expr("last_close * (0.975 + (k % 90) / 1000.0e0)").alias("ai_upper_1d"))), M3,
    {"symbol": "symbol", "ai_confidence": ("cf", 5), "ai_veto": "cf < 0.25", "ai_bias": "CASE WHEN cf < 0.25 THEN 0 WHEN ln(hi / c) < -0.001 THEN -1 WHEN ln(lo / c) > 0.001 THEN 1 ELSE 0 END"}, "m3b")
AN_CFG = VolumePriceSettings()


def anomalies(s, d):
    v = flow.volume_price_detector(bars_daily(s, d))
    return derived_table(s, d, "anomalies", lambda: ml.anomaly_scores(v, ml.anomaly_forest(v, cfg=AN_CFG), cfg=AN_CFG))


R.add("m4_anomaly_forest", lambda s, d: anomalies(s, d).select(*KEY, F.round("vp_ml_score", 6).alias("vp_ml_score"), "vp_ml_anomaly"))
R.add("m4_anomaly_signals", lambda s, d: flow.volume_price_detector(bars_daily(s, d).join(anomalies(s, d).select("symbol", "bar_no", "vp_ml_anomaly"), ["symbol", "bar_no"], "left")).groupBy("vp_reason", "vp_signal").agg(F.count(F.lit(1)).alias("n")))
R.add("m5_fit_report", lambda s, d: ml.fit_report(features(s, d)[0], models(s, d), features(s, d)[1]).withColumns({"importance": F.round("importance", 6), "r2": F.round("r2", 6), "mae": F.round("mae", 6)}))


def forecast_rows_by_horizon(s, d):
    """One row per symbol and horizon: is the band in order around the target, and is there a model."""
    f = ml.forecast(features(s, d)[0].where(is_last()), models(s, d), FC_CFG)
    each = [F.struct(F.lit(h).alias("horizon"), F.col(f"ai_status_{h}d").alias("status"), F.coalesce((F.col(f"ai_lower_{h}d") <= F.col(f"ai_upper_{h}d")) & (F.col(f"ai_target_{h}d") > 0), F.lit(False)).alias("in_order"),
                     F.coalesce(F.col(f"ai_lower_{h}d") >= F.col("close") * 0.36, F.lit(False)).alias("clipped")) for h in FC_CFG.horizons]
    return f.select("symbol", F.explode(F.array(*each)).alias("r")).select("symbol", "r.*")


R.add("m2_forecast_bands", forecast_rows_by_horizon,
      q.sql([q.DAILY, f"h AS (SELECT unnest({list(FC_CFG.horizons)}) AS horizon)", "l AS (SELECT h.horizon, count(*) AS n FROM h JOIN bars ON bar_no < n_bars - h.horizon WHERE close > 0 GROUP BY 1)",
             "y AS (SELECT symbol, arg_max(close, bar_no) AS last FROM bars GROUP BY symbol)"],
            f"SELECT symbol, horizon, CASE WHEN n >= {FC_CFG.min_rows} THEN 'OK' ELSE 'NO_MODEL' END AS status, n >= {FC_CFG.min_rows} AND last > 0 AS in_order, n >= {FC_CFG.min_rows} AS clipped FROM y, l"))


def coverage(s, d):
    """The band on every fifth bar of all symbols, which neither the trees nor its calibration have seen."""
    t, names = features(s, d)
    fold = F.pmod(F.col("bar_no"), F.lit(5))
    model = ml.train(t.where(fold != 3), names, FC_CFG, calibrate=fold == 4)
    c = ml.band_coverage(t.where(fold == 3), model)
    # beside the two points, what chance does to a share of so many rows; clipped outcomes can only come in together
    off = 0.02 + 1.2 / F.sqrt("n_rows")
    covered = (F.col("coverage") >= 0.8 - off) & (F.col("coverage") - F.col("at_limit") <= 0.8 + off)
    return c.select("horizon", "n_rows", covered.alias("covered"), ((F.col("width") > 0) & (F.col("width") < 2)).alias("bounded"))


R.add("m2_band_coverage", coverage,
      q.sql([q.DAILY, f"h AS (SELECT unnest({list(FC_CFG.horizons)}) AS horizon)", "l AS (SELECT h.horizon, count(*) AS n, count(*) FILTER (bar_no % 5 = 3) AS k FROM h JOIN bars ON bar_no < n_bars - h.horizon WHERE close > 0 GROUP BY 1)"],
            f"SELECT horizon, k AS n_rows, true AS covered, true AS bounded FROM l WHERE n - k >= {FC_CFG.min_rows} AND k > 0"))
MORE = {"volume_z": f"(volume - {q.mean('volume', 20, 5)}) / nullif({q.std('volume', 20, 5)}, 0)", "price_range": "(high - low) / nullif(close, 0)", "vp_divergence": "volume_ratio * abs(price_change)"}
COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in ml.ANOMALY_FEATURES)


def forest_invariants(s, d):
    """Rows with all features, flagged rows, and whether every flagged row scores below every other one."""
    a = anomalies(s, d).where(F.expr(COMPLETE))
    low, high = F.max(F.when(F.col("vp_ml_anomaly"), F.col("vp_ml_score"))), F.min(F.when(~F.col("vp_ml_anomaly"), F.col("vp_ml_score")))
    n = F.count(F.lit(1))
    share = F.count_if("vp_ml_anomaly") / n
    return a.agg(n.alias("n_complete"), (low < high).alias("below_the_rest"), F.min(F.col("vp_ml_score").between(-1, 0)).alias("in_range"),
                 (F.abs(share - AN_CFG.contamination) <= 0.005).alias("share_as_set"))


R.add("m4_forest_invariants", forest_invariants,
      q.sql([q.DAILY, *q.chain("bars", *VP_LAYERS, MORE)[0]], f"SELECT count(*) AS n_complete, true AS below_the_rest, true AS in_range, true AS share_as_set FROM {q.chain('bars', *VP_LAYERS, MORE)[1]} WHERE {COMPLETE}"))
R.add("m5_feature_ranks", lambda s, d: ml.fit_report(features(s, d)[0], models(s, d), features(s, d)[1]).agg(
    F.count(F.lit(1)).alias("features"), F.sum("rank").alias("ranks"), F.round(F.sum("importance"), 6).alias("importance"), F.bool_and(F.col("certified") == (F.col("r2") > 0)).alias("certified_by_r2")),
      f"SELECT count(*) AS features, sum(r)::BIGINT AS ranks, 1.0::DOUBLE AS importance, true AS certified_by_r2 FROM (SELECT unnest(range(1, {len(ml.BASE_FEATURES)} + 1)) AS r)")
R.add("m6_walk_forward_cutoffs", lambda s, d: ml.walk_forward_cutoffs(bars_daily(s, d)).select("symbol", "ts", "cut_no"),
      q.sql(q.DAILY, "SELECT symbol, ts, bar_no AS cut_no FROM (SELECT *, max(ts) OVER (PARTITION BY symbol) AS e FROM bars) WHERE n_bars >= 260 AND bar_no >= 120 AND bar_no < n_bars - 64 AND (bar_no - 120) % 21 = 0 AND ts >= CAST(CAST(e AS DATE) - INTERVAL 12 MONTH AS TIMESTAMP)"))

WF_H = (1, 5, 21, 63)


def refits(s, d):
    """Walk-forward forecasts of a model with one feature, which SQL can fit too."""
    def table():
        def fn(t, f):
            move = lambda h: F.greatest(F.least(F.log(F.try_divide(f.lead("close", h), F.col("close"))), F.lit(1.0)), F.lit(-1.0))
            return t.withColumns({"roc_20": F.coalesce(f.pct_change("close", 20), F.lit(0.0)), **{f"target_{h}": F.when(f.lead("close", h).isNotNull(), move(h)) for h in WF_H}})
        b = bars_daily(s, d)
        t = per_block(b, fn, lookback=20, lookahead=max(WF_H))
        return walkforward.walk_forward(t, ml.walk_forward_cutoffs(b), ["roc_20"], WF_H, ridge=0.0)
    return derived_table(s, d, "walk_forward", table)


WF = [q.DAILY, f"wf AS (SELECT *, coalesce(close / {q.lag('close', 20)} - 1, 0) AS x, max(ts) OVER (PARTITION BY symbol) AS e FROM bars)",
      "wc AS (SELECT symbol, bar_no AS cut_no, close AS cur, x AS x0 FROM wf WHERE n_bars >= 260 AND bar_no >= 120 AND bar_no < n_bars - 64 AND (bar_no - 120) % 21 = 0 AND ts >= CAST(CAST(e AS DATE) - INTERVAL 12 MONTH AS TIMESTAMP))",
      f"wy AS (SELECT a.symbol, a.bar_no + h AS known, h, a.x, greatest(-1, least(1, ln(b.close / a.close))) AS y FROM wf a, (SELECT unnest({list(WF_H)}) AS h) JOIN wf b ON b.symbol = a.symbol AND b.bar_no = a.bar_no + h)",
      """wm AS (SELECT wc.symbol, cut_no, h, any_value(cur) AS cur, any_value(x0) AS x0, count(*) AS n_train, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_syy(y, x) / count(*) AS syy, regr_sxy(y, x) / count(*) AS sxy
 FROM wc JOIN wy ON wy.symbol = wc.symbol AND known <= cut_no GROUP BY wc.symbol, cut_no, h HAVING count(*) >= 50)""",
      "wv AS (SELECT *, greatest(-1, least(1, a + b * x0)) AS mv, sqrt(greatest(syy - b * sxy, 0)) AS sg FROM wm)",
      f"fr AS (SELECT symbol, cut_no, h, n_train, cur, cur * exp(mv) AS pr, cur * exp(mv * abs(mv) / greatest(abs(mv) + sg, 1e-12)) AS pc, cur * exp(greatest(-1, mv - {walkforward.BAND!r} * sg)) AS pl, cur * exp(least(1, mv + {walkforward.BAND!r} * sg)) AS pu FROM wv)",
      "fe AS (SELECT fr.*, b.close AS a FROM fr JOIN bars b ON b.symbol = fr.symbol AND b.bar_no = cut_no + h)"]
R.add("m6_walk_forward_refits", lambda s, d: refits(s, d).select("symbol", "cut_no", "horizon", "n_train", *[fix(c, 3).alias(c) for c in ("price_raw", "price_cal", "price_lower", "price_upper")]),
      q.sql(WF, "SELECT symbol, cut_no, h AS horizon, n_train, " + ", ".join(f"{q.fix(c, 3)} AS {n}" for c, n in (("pr", "price_raw"), ("pc", "price_cal"), ("pl", "price_lower"), ("pu", "price_upper"))) + " FROM fr"))
R.add("a7_walk_forward_accuracy", lambda s, d: ml.ab_accuracy(ml.forecast_errors(refits(s, d), bars_daily(s, d))).select("horizon", *[fix(c, 3).alias(c) for c in ("mae_raw", "mae_cal", "mape_raw", "hit_raw", "hit_cal", "mae_improve_pct")]),
      q.sql([*WF, "z AS (SELECT h, avg(abs(pr - a)) AS r, avg(abs(pc - a)) AS c, avg(abs(pr - a) / greatest(a, 1e-9)) AS mr, avg((sign(pr - cur) = sign(a - cur))::INT) AS hr, avg((sign(pc - cur) = sign(a - cur))::INT) AS hc FROM fe GROUP BY h)"],
            f"SELECT h AS horizon, {q.fix('r', 3)} AS mae_raw, {q.fix('c', 3)} AS mae_cal, {q.fix('mr', 3)} AS mape_raw, {q.fix('hr', 3)} AS hit_raw, {q.fix('hc', 3)} AS hit_cal, {q.fix('(r - c) / nullif(r, 0) * 100', 3)} AS mae_improve_pct FROM z"))
R.add("a8_walk_forward_errors", lambda s, d: ml.reality_check(refits(s, d), bars_daily(s, d)).select("symbol", "cut_no", "horizon", fix("abs_err", 3).alias("abs_err"), fix("ape", 5).alias("ape"), "hit_2pct", fix("dir_hit", 1).alias("dir_hit")),
      q.sql(WF, f"SELECT symbol, cut_no, h AS horizon, {q.fix('abs(pr - a)', 3)} AS abs_err, {q.fix('abs(pr - a) / greatest(a, 1e-9)', 5)} AS ape, (abs(pr - a) / greatest(a, 1e-9) <= 0.02)::INT AS hit_2pct, {q.fix('(sign(pr - cur) = sign(a - cur))::INT::DOUBLE', 1)} AS dir_hit FROM fe"))


def forecast_rows(s, d):
    """Forecast rows at every 21st bar from plain momentum, for the error studies."""
    b = per_block(bars_daily(s, d), lambda t, f: t.withColumn("_m", f.mean("close", 20)), lookback=20).where((F.col("bar_no") >= 120) & (F.col("bar_no") % 21 == 0))
    d_ = b.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in (1, 5, 21, 63)])))
    return d_.select("symbol", F.col("bar_no").alias("cut_no"), "horizon", F.col("close").alias("current_price"), F.col("_m").alias("price_raw"), ((F.col("_m") + F.col("close")) / 2).alias("price_cal"))


FR = [q.DAILY, f"fm AS (SELECT *, {q.mean('close', 20)} AS m FROM bars)", "fr AS (SELECT symbol, bar_no AS cut_no, h, close AS cur, m AS pr, (m + close) / 2 AS pc FROM fm, (SELECT unnest([1, 5, 21, 63]) AS h) WHERE bar_no >= 120 AND bar_no % 21 = 0)", "fe AS (SELECT fr.*, b.close AS a FROM fr JOIN bars b ON b.symbol = fr.symbol AND b.bar_no = cut_no + h)"]
R.add("a7_forecast_accuracy", lambda s, d: ml.ab_accuracy(ml.forecast_errors(forecast_rows(s, d), bars_daily(s, d))).select("horizon", *[fix(c, 3).alias(c) for c in ("mae_raw", "mae_cal", "mape_raw", "hit_raw", "hit_cal", "mae_improve_pct")]),
      q.sql([*FR, "z AS (SELECT h, avg(abs(pr - a)) AS r, avg(abs(pc - a)) AS c, avg(abs(pr - a) / greatest(a, 1e-9)) AS mr, avg((sign(pr - cur) = sign(a - cur))::INT) AS hr, avg((sign(pc - cur) = sign(a - cur))::INT) AS hc FROM fe GROUP BY h)"],
            f"SELECT h AS horizon, {q.fix('r', 3)} AS mae_raw, {q.fix('c', 3)} AS mae_cal, {q.fix('mr', 3)} AS mape_raw, {q.fix('hr', 3)} AS hit_raw, {q.fix('hc', 3)} AS hit_cal, {q.fix('(r - c) / nullif(r, 0) * 100', 3)} AS mae_improve_pct FROM z"))
R.add("a8_reality_check", lambda s, d: ml.reality_check(forecast_rows(s, d), bars_daily(s, d)).select("symbol", "cut_no", "horizon", fix("abs_err", 4).alias("abs_err"), fix("ape", 6).alias("ape"), "hit_2pct", fix("dir_hit", 1).alias("dir_hit")),
      q.sql(FR, f"SELECT symbol, cut_no, h AS horizon, {q.fix('abs(pr - a)', 4)} AS abs_err, {q.fix('abs(pr - a) / greatest(a, 1e-9)', 6)} AS ape, (abs(pr - a) / greatest(a, 1e-9) <= 0.02)::INT AS hit_2pct, {q.fix('(sign(pr - cur) = sign(a - cur))::INT::DOUBLE', 1)} AS dir_hit FROM fe"))
R.add("j13_horizon_lead", lambda s, d: per_block(bars_daily(s, d), lambda t, f: t.withColumns({f"close_{h}": f.lead("close", h) for h in (1, 5, 21, 63)}), lookahead=63).select(*KEY, "close_1", "close_5", "close_21", "close_63"),
      q.sql(q.DAILY, "SELECT symbol, ts, " + ", ".join(f"{q.lead('close', h)} AS close_{h}" for h in (1, 5, 21, 63)) + " FROM bars"))
R.add("a21_annualized_vol", lambda s, d: ind.volatility(tail(bars_daily(s, d), 30)).where(is_last()).select("symbol", fix(F.when(F.col("n_bars") < 21, 50.0).otherwise(F.coalesce(F.when(F.col("annual_vol") > 0, F.col("annual_vol") * 100), F.lit(50.0))), 4).alias("annual_vol_pct")),
      q.sql([q.DAILY, RET, f"z AS (SELECT symbol, bar_no, n_bars, {q.std('r', 20)} AS s FROM rt)"], f"SELECT symbol, {q.fix('CASE WHEN n_bars < 21 OR coalesce(s, 0) <= 0 THEN 50 ELSE s * sqrt(252) * 100 END', 4)} AS annual_vol_pct FROM z WHERE bar_no = n_bars - 1"))

QUERIES, ORACLES = R.queries, R.oracles
