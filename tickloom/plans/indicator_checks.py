"""Rolling, exponential and cumulative indicators on daily bars."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tickloom.functions.series import is_last, running_from_end, tail
from tickloom.operators import indicators as ind
from tickloom.plans import sqlkit as q
from tickloom.plans.registry import KEY, Registry, fix, rounded, sel
from tickloom.sources.driver_tables import bars_daily, bars_hourly

R = Registry()
def add(name, op, layers, exact=(), r6=(), r4=(), bars=bars_daily, base=q.DAILY, src="bars"):
    ctes, last = q.chain(src, *layers)
    R.add(name, lambda s, d: rounded(op(bars(s, d)), exact, r6, r4), q.sql([base, *ctes], sel(last, exact, r6, r4)))


R.add(
    "a1_daily_bars",
    lambda s, d: bars_daily(s, d).select("symbol", "ts", "open", "high", "low", "close", "volume", F.col("bar_no").cast("long").alias("bar_no")),
    q.sql(q.DAILY, "SELECT symbol, ts, open, high, low, close, volume, bar_no FROM bars"),
)
add(
    "w1_lagged_returns", ind.lagged_returns,
    [
        {"diff_1": f"close - {q.lag('close')}", **{f"ret_{k}": f"close / {q.lag('close', k)} - 1" for k in (1, 2, 5, 10)},
         "log_ret": f"ln(close / {q.lag('close')})"},
        {f"log_ret_lag_{k}": q.lag("log_ret", k) for k in range(1, 6)},
    ],
    exact=["diff_1", "ret_1", "ret_2", "ret_5", "ret_10"], r6=["log_ret", *[f"log_ret_lag_{k}" for k in range(1, 6)]],
)
add("w2_moving_averages", ind.sma, [{f"sma_{n}": q.mean("close", n) for n in (5, 10, 15, 20, 50, 200)}],
    r4=[f"sma_{n}" for n in (5, 10, 15, 20, 50, 200)])
add("w3_rolling_volatility", ind.volatility,
    [{"ret_1": f"close / {q.lag('close')} - 1"}, {"ret_std": q.std("ret_1", 20)}, {"annual_vol": f"ret_std * {math.sqrt(252)!r}"}],
    r6=["ret_std", "annual_vol"])
add("w4_rolling_sums",
    lambda b: ind.per_block(b, lambda d, f: d.withColumns({"vol_20": f.sum("volume", 20), "vol_share": F.col("volume") / f.sum("volume", 20, 5)}), lookback=20),
    [{"vol_20": q.total("volume", 20), "vol_share": f"volume / {q.total('volume', 20, 5)}"}], exact=["vol_20"], r6=["vol_share"])
add("w5_rolling_extremes", ind.rolling_extremes, [{"lowest": q.low("low", 14, 1), "highest": q.high("high", 14, 1)}],
    exact=["lowest", "highest"])
add("w6_ewm_mean", lambda b: ind.ema(ind.ema(b, 12), 26), [{"ema_12": q.ewm("close", 2 / 13, 12), "ema_26": q.ewm("close", 2 / 27, 26)}],
    r4=["ema_12", "ema_26"])
add("w8_true_range_atr", ind.atr_variants,
    [*q.ATR_LAYERS, {"strict": q.mean("tr", 14)},
     {"atr_radar": "coalesce(strict, close * 0.02)", "atr_intraday": "coalesce(strict, close * 0.01)",
      "atr_pct": "coalesce(CASE WHEN close > 0 THEN strict / close * 100 END, 5.0)"}],
    r4=["atr", "atr_radar", "atr_intraday", "atr_pct"])
add("w9_rsi", ind.rsi, q.RSI_LAYERS, r4=["rsi"])
add("w9_rsi_simple", ind.rsi_simple,
    [{"dlt": f"close - {q.lag('close')}"},
     {"rs": f"{q.mean('greatest(dlt, CASE WHEN dlt IS NOT NULL THEN 0 END)', 14)} / nullif({q.mean('greatest(-dlt, CASE WHEN dlt IS NOT NULL THEN 0 END)', 14)}, 0)"},
     {"rsi_simple": "100 - 100 / (1 + rs)"}], r4=["rsi_simple"])
add("w10_adx", ind.adx, q.ADX_LAYERS, r4=["adx"])
add("w11_macd", ind.macd,
    [{"macd": f"{q.ewm('close', 2 / 13, 12)} - {q.ewm('close', 2 / 27, 26)}"}, {"macd_signal": q.ewm("macd", 2 / 10, 9)},
     {"macd_hist": "macd - macd_signal"}], r4=["macd", "macd_signal", "macd_hist"])
add("w12_stochastic", ind.stochastic,
    [*q.STOCH_LAYERS, {
        "stoch_signal": "CASE WHEN stoch_crossunder AND st_k >= 70 THEN -1 WHEN stoch_crossover AND st_k <= 30 THEN 1 ELSE 0 END",
        "stoch_reason": "CASE WHEN stoch_crossunder AND st_k >= 70 THEN 'STOCH_BEAR' WHEN stoch_crossover AND st_k <= 30 THEN 'STOCH_BULL' ELSE '' END"}],
    exact=["stoch_status", "stoch_crossover", "stoch_crossunder", "stoch_signal", "stoch_reason"], r4=["stoch_k", "stoch_d"])
add("w13_spread_percent_rank", ind.spread_rank,
    [{"spread": "greatest(high - low, 1e-6)"},
     {"vals": f"list(spread) OVER {q.back(20)}"},
     {"spread_rank_pct": "CASE WHEN len(vals) >= 20 THEN (len(list_filter(vals, lambda x: x < spread)) + (len(list_filter(vals, lambda x: x = spread)) + 1) / 2.0) / 20 END"}],
    r6=["spread_rank_pct"])
add("w14_zscores", ind.zscores,
    [{"ret_1": f"close / {q.lag('close')} - 1"},
     {"volume_z": f"(volume - {q.mean('volume', 20, 5)}) / nullif({q.std('volume', 20, 5)}, 0)",
      "return_z": f"ret_1 / nullif({q.std('ret_1', 20, 5)}, 0)"}], r4=["volume_z", "return_z"])
OBV_LAYERS = [
    {"dirn": f"coalesce(sign(close - {q.lag('close')}), 0)", "mfm": q.MFM},
    {"obv": f"sum(dirn * volume) OVER {q.RUN}", "ad_line": f"sum(mfm * volume) OVER {q.RUN}"},
    {"obv_slope": f"coalesce(obv - {q.lag('obv', 10)}, 0)", "ad_slope": f"coalesce(ad_line - {q.lag('ad_line', 10)}, 0)"},
]
add("w15_obv_ad_lines", ind.obv_ad, OBV_LAYERS, exact=["obv", "obv_slope"], r4=["ad_line", "ad_slope"])
MFI_LAYERS = [
    {"tp": "(high + low + close) / 3.0"}, {"ptp": q.lag("tp")},
    {"pf": "CASE WHEN tp > ptp THEN tp * volume ELSE 0 END", "nf": "CASE WHEN tp < ptp THEN tp * volume ELSE 0 END"},
    {"mfi": q.clip(f"coalesce(100 - 100 / (1 + {q.total('pf', 14)} / nullif({q.total('nf', 14)}, 0)), 50)", 0, 100)},
]
add("w16_money_flow_index", ind.mfi, MFI_LAYERS, r4=["mfi"])
CMF_LAYERS = [{"mfv": f"{q.MFM} * volume"}, {"cmf": q.clip(f"coalesce({q.total('mfv', 20)} / nullif({q.total('volume', 20)}, 0), 0)", -1, 1)}]
add("w17_chaikin_money_flow", ind.cmf, CMF_LAYERS, r6=["cmf"])
VWAP_LAYERS = [
    {"tpv": "(high + low + close) / 3.0 * volume"},
    {"vw": f"{q.total('tpv', 20, 5)} / nullif({q.total('volume', 20, 5)}, 0)", "vma": f"nullif({q.mean('volume', 20, 5)}, 0)"},
    {"session_rel_volume": q.clip("coalesce(volume / vma, 1)", 0, 10), "vwap_dev": q.clip("coalesce((close - vw) / vw, 0)", -0.2, 0.2)},
]
add("w18_vwap_deviation", ind.vwap_dev, VWAP_LAYERS, r6=["session_rel_volume", "vwap_dev"])
add("w23_ma_crossover", lambda b: ind.crossover(ind.sma(b, (5, 20)), "sma_5", "sma_20"),
    [{"a": q.mean("close", 5), "b": q.mean("close", 20)}, {"pa": q.lag("a"), "pb": q.lag("b")},
     {"crossover": "coalesce(a > b AND pa <= pb, false)", "crossunder": "coalesce(a < b AND pa >= pb, false)"}],
    exact=["crossover", "crossunder"])
add("w24_forward_targets", ind.forward_columns,
    [{"next_ret": f"{q.lead('close')} / close - 1", "target_1": q.clip(f"ln({q.lead('close')} / close)", -1, 1),
      "target_21": q.clip(f"ln({q.lead('close', 21)} / close)", -1, 1)}], exact=["next_ret"], r6=["target_1", "target_21"])
add("w25_running_drawdown", ind.drawdown, [{"peak": f"max(close) OVER {q.RUN}"}, {"drawdown": "(close - peak) / peak"}],
    exact=["peak", "drawdown"])
R.add(
    "w26_tail_quantiles",
    lambda s, d: tail(bars_daily(s, d), 60).groupBy("symbol").agg(
        fix(F.percentile("high", 0.85), 4).alias("q85_high"), fix(F.percentile("low", 0.15), 4).alias("q15_low")),
    q.sql(q.DAILY, "SELECT symbol, " + q.fix("quantile_cont(high, 0.85)", 4) + " AS q85_high, " + q.fix("quantile_cont(low, 0.15)", 4) + " AS q15_low FROM bars WHERE bar_no >= n_bars - 60 GROUP BY symbol"),
)
add("w27_fill", lambda b: ind.fill(b.withColumn("spike", F.when(F.col("volume") > 100, F.col("close"))), ["spike"], back=True),
    [{"sp": "CASE WHEN volume > 100 THEN close END"}, {"ff": f"last_value(sp IGNORE NULLS) OVER {q.RUN}"},
     {"spike": f"first_value(ff IGNORE NULLS) OVER ({q.P} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"}], exact=["spike"])
add("w29_prior_extremes", ind.prior_extremes,
    [{"prior_high": f"max(high) OVER {q.rows(-4, -1)}", "prior_low": f"min(low) OVER {q.rows(-4, -1)}"}], exact=["prior_high", "prior_low"])
add("w30_following_extremes",
    lambda b: ind.per_block(
        running_from_end(b, {"_lo": ("min", "low"), "_hi": ("max", "high")}),
        lambda d, f: d.withColumns({"later_low": f.lead("_lo"), "later_high": f.lead("_hi")}), lookahead=1),
    [{"later_low": f"min(low) OVER ({q.P} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)",
      "later_high": f"max(high) OVER ({q.P} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"}], exact=["later_low", "later_high"])
add("w31_lookahead_recovery",
    lambda b: ind.per_block(b, lambda d, f: d.withColumn("recovers", F.coalesce(F.max("close").over(f.rows(1, 3)) >= F.col("open"), F.lit(False))), lookahead=3),
    [{"recovers": f"coalesce(max(close) OVER {q.rows(1, 3)} >= open, false)"}], exact=["recovers"])
BB_LAYERS = [
    {"bb_mid": q.mean("close", 20), "sd": q.std("close", 20)},
    {"bb_upper": "bb_mid + 2.0 * sd", "bb_lower": "bb_mid - 2.0 * sd"},
    {"bb_width": "(bb_upper - bb_lower) / bb_mid"},
    {"bb_position": "(close - bb_lower) / nullif(bb_upper - bb_lower, 0)", "bb_squeeze": f"coalesce(bb_width < 0.8 * {q.mean('bb_width', 100, 20)}, false)"},
]
add("w34_bollinger", ind.bollinger, BB_LAYERS, exact=["bb_squeeze"], r4=["bb_mid", "bb_upper", "bb_lower", "bb_width", "bb_position"])
add("w36_smoothed_score",
    lambda b: ind.per_block(ind.cmf(b), lambda d, f: d.withColumn("smoothed", ind.clip(f.mean("cmf", 5, 1), -1.0, 1.0)), lookback=5),
    [*CMF_LAYERS, {"smoothed": q.clip(q.mean("cmf", 5, 1), -1, 1)}], r6=["smoothed"])
add("w37_price_volume_divergence", ind.price_volume_divergence,
    [*OBV_LAYERS, {"ot": f"coalesce(obv - {q.lag('obv', 20)}, 0)", "pt": f"coalesce(close - {q.lag('close', 20)}, 0)"},
     {"obv_bullish_div": "ot > 0 AND pt < 0", "obv_bearish_div": "ot < 0 AND pt > 0"}], exact=["obv_bullish_div", "obv_bearish_div"])

QUERIES, ORACLES = R.queries, R.oracles
