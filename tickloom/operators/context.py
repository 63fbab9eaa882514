"""Positioning, regime, price action and cross-timeframe context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.config import BankSettings, CombinerSettings, CotSettings
from tickloom.functions.series import Frame, at_last, ewm_reach, is_last, per_block, recent, tail
from tickloom.operators.clean import missing, neutral
from tickloom.operators.indicators import (
    ADX_REACH, WILDER, add_adx, add_atr, add_rsi, clip, nonzero, truthy,
)

# Structure and phase labels, directional-score weights.
STRUCTURE = ("🚀 HH-HL (Bullish)", "📉 LH-LL (Bearish)", "↔️ Sideways")
VOLUME_STATUS = ("⚡ Climax", "🟢 Strong", "⚪ Normal")
PHASES = ("🕵️ MANIPULATION", "🚀 EXPANSION", "📉 DISTRIBUTION", "📦 ACCUMULATION", "↔️ CONSOLIDATION")
DEBATE_WEIGHTS = {"smc_signal": 1.20, "wyckoff_signal": 1.00, "bank_signal": 0.70, "ai_bias": 0.60, "real_flow_signal": 0.80}
CONC_MIN, CONC_MAX, CONC_BUY = 0.15, 0.75, 0.30


def positioning_columns(pos: DataFrame) -> DataFrame:
    """Net, short ratio and change columns of a weekly positioning table."""

    def fn(d: DataFrame, f: Frame) -> DataFrame:
        return d.withColumns({
            "commercial_net": F.col("commercial_long") - F.col("commercial_short"),
            "short_ratio": F.col("commercial_short") / nonzero(F.col("open_interest")),
            "short_change": F.col("commercial_short") - f.lag("commercial_short"),
            "short_change_pct": f.pct_change("commercial_short") * 100,
        })

    return per_block(pos, fn, lookback=1)


def cot_monitor(df: DataFrame, cfg: CotSettings = CotSettings()) -> DataFrame:
    """Short-crowding alerts on bars that carry ``short_ratio`` and ``short_change``."""
    if missing(df, ["short_ratio", "short_change"]):
        return neutral(df, {"cot_signal": 0, "cot_reason": ""})

    def fn(d: DataFrame, f: Frame) -> DataFrame:
        d = d.withColumns({"_ret": f.pct_change("close"), "_abs": F.abs("short_change")})
        d = d.withColumns({"_vol": f.std("_ret", cfg.volatility_window, 5) * 252 ** 0.5, "_avg": f.mean("_abs", cfg.change_lookback, 1)})
        trend = lambda k: F.coalesce(F.signum(F.coalesce(F.col("short_ratio") - f.lag("short_ratio", k), F.lit(0.0))), F.lit(0.0))
        return d.withColumns({"_hot": truthy(F.col("_vol") > f.mean("_vol", 60, 10) * 1.5), "cot_4w_trend": trend(4), "cot_12w_trend": trend(12)})

    d = per_block(df, fn, lookback=cfg.volatility_window + 62)
    high = truthy(F.col("short_ratio") > cfg.short_ratio_threshold)
    odd = truthy(F.col("_abs") > F.col("_avg") * cfg.anomaly_multiplier)
    agree = F.col("cot_4w_trend") == F.col("cot_12w_trend")
    buy = odd & truthy(F.col("short_change") < 0) & truthy(F.col("short_ratio") < cfg.short_ratio_threshold)
    strong, moderate = high & odd & F.col("_hot"), high & odd & ~F.col("_hot") & agree
    return d.withColumns({
        "cot_short_ratio_alert": high, "cot_anomaly_alert": odd, "cot_mtf_agree": agree,
        "cot_signal": F.when(buy, 1).when(strong | moderate, -1).otherwise(0),
        "cot_reason": F.when(buy & agree, "COT_REVERSAL_MTF").when(buy, "COT_REVERSAL").when(strong, "FLUSH_ALERT")
        .when(moderate, "COT_ANOMALY").otherwise(""),
    }).drop("_ret", "_abs", "_vol", "_avg", "_hot")


def cot_reading(df: DataFrame, cfg: CotSettings = CotSettings()) -> DataFrame:
    d = cot_monitor(df, cfg).where(is_last())
    return d.select(
        "symbol", "ts", F.format_string("%.2f%%", F.col("short_ratio") * 100).alias("short_ratio_text"), "cot_signal", "cot_reason",
        F.when(F.col("cot_anomaly_alert"), "HIGH").otherwise("NORMAL").alias("alert_level"),
    )


def add_regime(d: DataFrame, f: Frame) -> DataFrame:
    """TRENDING when ADX is above 20 and ATR above its 50-bar mean."""
    d = add_atr(add_adx(d, f, name="adx"), f, name="_atr")
    trending = (F.col("adx") > 20) & truthy(F.col("_atr") > f.mean("_atr", 50, 10))
    return d.withColumn("market_regime", F.when(trending, "TRENDING").otherwise("RANGING")).drop("_atr")


def regime_filter(bars: DataFrame) -> DataFrame:
    return per_block(bars, add_regime, lookback=ADX_REACH)


def bank_monitor(df: DataFrame, cfg: BankSettings = BankSettings(), fail_closed: bool = True) -> DataFrame:
    """Short-concentration signals. Uses ``bank_short_concentration`` or short/open interest, and
    ``usd_close`` where attached (as-of joined by the caller), else an inverse-price stand-in."""
    have = not missing(df, ["bank_short_concentration"])
    derivable = not missing(df, ["commercial_short", "open_interest"])
    usd = "usd_close" in df.columns

    def fn(d: DataFrame, f: Frame) -> DataFrame:
        if have:
            conc = F.col("bank_short_concentration").cast("double")
        elif derivable:
            d = d.withColumn("_ratio", F.col("commercial_short") / nonzero(F.col("open_interest")))
            conc = f.mean("_ratio", 3, 1)
        else:
            conc = F.lit(None).cast("double")
        n = cfg.usd_strength_window
        trend = f.pct_change("usd_close", n) if usd else F.coalesce(f.pct_change("close", n), F.lit(0.0)) * -0.5
        d = d.withColumns({"bank_concentration": clip(conc, CONC_MIN, CONC_MAX), "usd_trend": trend})
        return add_regime(d, f).drop("_ratio")

    d = per_block(df, fn, lookback=ADX_REACH)
    available = F.col("bank_concentration").isNotNull()
    alert = truthy(F.col("bank_concentration") > cfg.concentration_threshold)
    usd_strong = truthy(F.col("usd_trend") > cfg.usd_strength_threshold)
    buy = truthy((F.col("bank_concentration") < CONC_BUY) & (F.col("usd_trend") < -cfg.usd_strength_threshold))
    strong = alert & usd_strong
    moderate = alert & ~usd_strong & (F.col("market_regime") != "RANGING")
    empty = F.when(~available, "NO_REAL_BANK_FLOW_DATA").otherwise("") if fail_closed else F.lit("")
    return d.withColumns({
        "bank_data_available": available, "bank_alert": alert, "usd_strong": usd_strong,
        "bank_signal": F.when(buy, 1).when(strong | moderate, -1).otherwise(0),
        "bank_reason": F.when(buy, "BANK_COVERING").when(strong, "BANK_DOMINANCE").when(moderate, "BANK_WARNING").otherwise(empty),
    })


def market_regime(bars: DataFrame) -> DataFrame:
    """BULL / BEAR / ACCUMULATION / DISTRIBUTION / SIDEWAYS per symbol at its newest bar."""

    def fn(d: DataFrame, f: Frame) -> DataFrame:
        d = add_rsi(add_adx(d, f), f)
        return d.withColumns({"sma50": f.mean("close", 50), "sma200": f.mean("close", 200)})

    d = at_last(bars, fn, ADX_REACH + 20)
    up = (F.col("close") > F.col("sma50")) & (F.col("sma50") > F.col("sma200"))
    down = (F.col("close") < F.col("sma50")) & (F.col("sma50") < F.col("sma200"))
    strong, short = F.col("adx") > 20, F.col("n_bars") < 200
    regime = (
        F.when(short, "UNKNOWN").when(truthy(up) & strong, "BULL").when(truthy(up), "ACCUMULATION")
        .when(truthy(down) & strong, "BEAR").when(truthy(down), "DISTRIBUTION").otherwise("SIDEWAYS")
    )
    long_only = lambda c: F.when(~short, c)
    return d.select(
        "symbol", "ts", "close", regime.alias("regime"), F.when(short, 0.0).otherwise(F.bround("adx", 2)).alias("adx"),
        long_only(F.bround("rsi", 2)).alias("rsi"), long_only(F.bround("sma50", 2)).alias("sma50"),
        long_only(F.bround("sma200", 2)).alias("sma200"),
        long_only((F.col("rsi") > 75) | (F.col("rsi") < 25)).alias("is_overextended"),
        long_only(F.bround((F.col("close") - F.col("sma200")) / F.col("sma200") * 100, 2)).alias("distance_to_sma200"),
    )


def relative_strength(bars: DataFrame, bench: DataFrame, window: int = 120) -> DataFrame:
    """Return over the window minus the benchmark's, in points; a short series on either side shrinks it."""
    bench_len = F.col("_bn")
    b = tail(bench, window).select((F.col("n_bars") - F.col("bar_no")).cast("int").alias("_back"), F.col("close").alias("_bc"), F.col("n_bars").alias("_bn"))
    newest = b.where(F.col("_back") == 1).select(F.col("_bc").alias("_b1"), "_bn")
    ends = tail(bars, window).groupBy("symbol").agg(
        F.max_by("close", "bar_no").alias("_last"), F.max("n_bars").alias("_n"),
        F.map_from_entries(F.collect_list(F.struct((F.col("n_bars") - F.col("bar_no")).cast("int"), "close"))).alias("_m"),
    )
    b_close, b_len = newest.select("_b1").scalar(), newest.select("_bn").scalar()
    n = F.least(F.col("_n"), b_len)
    ends = ends.withColumn("_back", F.when(n < window, n - 1).otherwise(F.lit(window)).cast("int"))
    d = ends.join(b.select("_back", "_bc"), "_back", "left")
    score = ((F.col("_last") / F.col("_m")[F.col("_back")] - 1) - (b_close / F.col("_bc") - 1)) * 100
    return d.select("symbol", F.coalesce(F.bround(score, 2), F.lit(0.0)).alias("rs_score"))


def strongest_regimes(bars: DataFrame, bench: DataFrame, n: int = 10) -> DataFrame:
    """Regime snapshot of the ``n`` symbols with the best relative strength."""
    d = market_regime(bars).join(relative_strength(bars, bench), "symbol")
    return d.orderBy(F.desc("rs_score"), "symbol").limit(n)


def price_action(bars: DataFrame, bench: DataFrame | None = None) -> DataFrame:
    """20-bar structure, volume status, relative strength and RSI bias per symbol (20 bars at least)."""

    def fn(d: DataFrame, f: Frame) -> DataFrame:
        return add_rsi(d, f).withColumns({
            "_hi": f.max("high", 20, 1), "_lo": f.min("low", 20, 1), "_va": f.mean("volume", 20),
        })

    d = at_last(bars.where(F.col("n_bars") >= 20), fn, WILDER + 1)
    ratio = F.when(F.col("_va") > 0, F.col("volume") / F.col("_va")).otherwise(1.0)
    d = d.select(
        "symbol", "ts", "close",
        F.when(F.col("close") >= F.col("_hi") * 0.98, STRUCTURE[0]).when(F.col("close") <= F.col("_lo") * 1.02, STRUCTURE[1])
        .otherwise(STRUCTURE[2]).alias("structure"),
        F.when(ratio > 2.0, VOLUME_STATUS[0]).when(ratio > 1.2, VOLUME_STATUS[1]).otherwise(VOLUME_STATUS[2]).alias("volume_status"),
        ratio.alias("volume_ratio"), "rsi",
        F.when(F.col("rsi") > 60, "Bullish").when(F.col("rsi") < 40, "Bearish").otherwise("Neutral").alias("momentum_bias"),
    )
    if bench is None:
        return d.withColumn("rs_score", F.lit(0.0))
    return d.join(relative_strength(bars, bench), "symbol", "left").fillna({"rs_score": 0.0})


def flags(bars: DataFrame, window: int = 15) -> DataFrame:
    """Bull flag / bear pennant: a pole over the first bars of the window, a tight flag over the last five."""
    d = recent(bars.where(F.col("n_bars") >= window), window, "close", "high", "low")
    item = lambda i: F.element_at("r", i)
    part = lambda a, b, c: F.transform(F.slice("r", a, b), lambda x: x[c])
    spans = F.transform(F.slice("r", window - 13, 14), lambda x: x["high"] - x["low"])
    mean_span = F.aggregate(spans, F.lit(0.0), lambda a, x: a + x) / 14
    fallback = (F.array_max(F.transform("r", lambda x: x["high"])) - F.array_min(F.transform("r", lambda x: x["low"]))) / 10
    d = d.withColumns({
        "_vol": F.when(mean_span > 0, mean_span).otherwise(fallback), "_start": item(1)["close"], "_move": item(window - 5)["close"] - item(1)["close"],
        "_top": F.array_max(part(window - 4, 5, "high")), "_bot": F.array_min(part(window - 4, 5, "low")),
    })
    rng, move, half = F.col("_top") - F.col("_bot"), F.col("_move"), F.col("_start") + F.col("_move") * 0.5
    bull = (move > F.col("_vol") * 2.5) & (rng < move * 0.4) & (F.col("_bot") > half)
    bear = (move < F.col("_vol") * -2.5) & (rng < F.abs(move) * 0.4) & (F.col("_top") < half)
    return d.select("symbol", F.when(bull, "BULL FLAG").when(bear, "BEAR PENNANT").otherwise("None").alias("pattern"))


def multi_tf_synergy(hourly: DataFrame, four_hourly: DataFrame) -> DataFrame:
    """1-hour momentum checked against 4-hour structure, with a next-day text."""
    one = at_last(hourly, lambda d, f: d.withColumn("ret_1h", f.pct_change("close", 4)), 5).select("symbol", "ret_1h")
    four = at_last(four_hourly, lambda d, f: d.withColumns({
        "ret_4h": f.pct_change("close", 4), "_above": truthy(F.col("close") > f.mean("close", 20))}), 21).select("symbol", "ret_4h", "_above")
    d = one.join(four, "symbol").join(flags(hourly), "symbol", "left").fillna({"pattern": "None"})
    r1, r4, above = F.col("ret_1h"), F.col("ret_4h"), F.col("_above")
    strong = truthy((r1 > 0.005) & (r4 > 0)) & above
    pattern = F.col("pattern") != "None"
    weak = truthy(r1 > 0.005) & (truthy(r4 < 0) | ~above)
    sync = truthy((r1 < -0.005) & (r4 < 0))
    return d.select(
        "symbol", "pattern", (r1 * 100).alias("mom_1h"), (r4 * 100).alias("struct_4h"),
        F.when(strong, "🔥🔥 STRONG BUY").when(pattern, F.concat(F.lit("🎯 "), "pattern")).when(weak, "⚠️ WEAK REBOUND")
        .when(sync, "💀 BEARISH SYNC").otherwise("Neutral").alias("health"),
        F.when(strong, "Bullish Synergy").when(pattern, "Continuation").when(weak, "Micro-Only").when(sync, "Full Flush")
        .otherwise("Neutral").alias("bias"),
        F.when(truthy(r4 > 0.01) & above, "75% Bullish Continuation").when(truthy(r4 < -0.01), "75% Bearish Carryover")
        .otherwise("50% Neutral").alias("next_day_forecast"),
    )


def afternoon_bias(intraday: DataFrame) -> DataFrame:
    """Close bias from the last five candles: their return and volume against the 20-bar mean."""
    d = tail(intraday.where(F.col("n_bars") >= 5), 20).groupBy("symbol").agg(
        F.max("n_bars").alias("_n"), F.avg("volume").alias("_v20"),
        F.avg(F.when(F.col("bar_no") >= F.col("n_bars") - 5, F.col("volume"))).alias("_v5"),
        F.max_by("close", "bar_no").alias("_c"), F.max(F.when(F.col("bar_no") == F.col("n_bars") - 5, F.col("open"))).alias("_o"),
    )
    ret = F.col("_c") / F.col("_o") - 1
    spike = F.when(F.col("_n") >= 20, F.col("_v5") / F.col("_v20"))
    up, down = truthy((ret > 0.01) & (spike > 1.1)), truthy((ret < -0.01) & (spike > 1.1))
    flat = truthy((F.abs(ret) < 0.005) & (spike < 0.8))
    return d.select(
        "symbol", F.when(up, "Bullish Continuation").when(down, "Bearish Flush").when(flat, "Range Bound / Sideways").otherwise("Neutral").alias("bias"),
        F.when(up | down, 0.75).when(flat, 0.6).otherwise(0.5).alias("confidence"),
        (ret * 100).alias("morning_return"), ((spike - 1) * 100).alias("volume_delta"),
    )


def market_phase(bars: DataFrame) -> DataFrame:
    """Manipulation / expansion / distribution / accumulation / consolidation at the newest bar (50 bars)."""

    def fn(d: DataFrame, f: Frame) -> DataFrame:
        d = add_regime(d, f)
        return d.withColumns({"_va": f.mean("volume", 20), "_mid": f.mean("close", 20), "_sd": f.std("close", 20)})

    d = at_last(bars, fn, ADX_REACH)
    body = F.abs(F.col("close") - F.col("open"))
    wick = (F.col("high") - F.col("low") - body) / F.greatest(body, F.lit(1e-6))
    manip = (F.col("volume") > F.col("_va") * 1.8) & (wick > 1.5)
    upper, lower = F.col("_mid") + F.col("_sd") * 2, F.col("_mid") - F.col("_sd") * 2
    phase = (
        F.when(F.col("n_bars") < 50, "UNKNOWN").when(truthy(manip), PHASES[0]).when(F.col("market_regime") == "TRENDING", PHASES[1])
        .when(truthy(F.col("close") > upper * 0.95), PHASES[2]).when(truthy(F.col("close") < lower * 1.05), PHASES[3]).otherwise(PHASES[4])
    )
    return d.select("symbol", "ts", phase.alias("phase"))


def debate_score(df: DataFrame) -> DataFrame:
    """Weighted sum of the available signal columns, trend and RSI extremes, clipped to +-5."""
    votes = sum((F.coalesce(F.col(c), F.lit(0)) * w for c, w in DEBATE_WEIGHTS.items() if c in df.columns), F.lit(0.0))
    if "sma_200" in df.columns:
        votes = votes + F.when(F.col("close") > F.coalesce("sma_200", "close"), 0.25).otherwise(-0.25)
    d = per_block(df, lambda d, f: add_rsi(d, f, name="_rsi"), lookback=WILDER + 1)
    score = votes + F.when(F.col("_rsi") < 30, 0.30).when(F.col("_rsi") > 70, -0.30).otherwise(0.0)
    d = d.withColumn("debate_score", clip(score, -5.0, 5.0))
    s = F.col("debate_score")
    return d.withColumn("debate_signal", F.when(s >= 1.0, 1).when(s <= -1.0, -1).otherwise(0)).withColumnRenamed("_rsi", "rsi")


def debate_verdict(df: DataFrame) -> DataFrame:
    """Bull and bear evidence at the newest bar and the resulting verdict."""
    d = debate_score(df).where(is_last()).join(market_regime(df).select("symbol", "regime", "is_overextended"), "symbol")
    sig = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in df.columns else F.lit(0)
    tests = [
        (F.col("regime") == "BULL", 1.0, "BULL"), (F.col("regime") == "BEAR", -1.0, "BEAR"),
        *[(sig(c) > 0, w, f"{tag}+") for c, w, tag in (("smc_signal", 2.0, "SMC"), ("wyckoff_signal", 1.5, "WYCKOFF"), ("bank_signal", 1.0, "BANK"), ("ai_bias", 0.8, "AI"))],
        *[(sig(c) < 0, -w, f"{tag}-") for c, w, tag in (("smc_signal", 2.0, "SMC"), ("wyckoff_signal", 1.5, "WYCKOFF"), ("bank_signal", 1.0, "BANK"), ("ai_bias", 0.8, "AI"))],
        (F.col("rsi") > 70, -0.5, "RSI-"), (F.col("rsi") < 30, 0.5, "RSI+"),
    ]
    bull = sum((F.when(c, w).otherwise(0.0) for c, w, _ in tests if w > 0), F.lit(0.0))
    bear = sum((F.when(c, w).otherwise(0.0) for c, w, _ in tests if w < 0), F.lit(0.0))
    d = d.withColumns({
        "bull_score": bull, "bear_score": bear, "evidence": F.array_compact(F.array(*[F.when(c, t) for c, _, t in tests])),
        "net_score": F.bround(bull + bear + F.col("debate_score") * 0.25, 2),
    })
    n = F.col("net_score")
    verdict = (
        F.when(n >= 3.0, "🔥 STRONG CONVICTION BUY").when(n >= 1.0, "🟢 MODERATE BUY").when(n <= -3.0, "🚫 HIGH RISK: AVOID / EMERGENCY EXIT")
        .when(n <= -1.0, "🔴 WEAK: BEARISH PRESSURE").otherwise("↔️ NEUTRAL: WAIT FOR SETUP")
    )
    return d.select("symbol", "net_score", "bull_score", "bear_score", verdict.alias("verdict"), "evidence", "regime", "debate_signal", "debate_score")


def combine_signals(df: DataFrame, cfg: CombinerSettings = CombinerSettings()) -> DataFrame:
    """One signal from trend (moving-average order, ADX-gated), shield (positioning, volume, bank) and the
    optional structure signals; danger cut-offs and the real-flow gate close entries. Emits
    ``combined_signal, signal_score, rsi, adx, bb_squeeze``."""
    from tickloom.operators.indicators import bollinger

    have = set(df.columns)
    sig = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in have else F.lit(0)

    def fn(d: DataFrame, f: Frame) -> DataFrame:
        d = add_rsi(add_adx(d, f), f)
        return d.withColumns({"_fast": f.mean("close", cfg.sma_fast), "_slow": f.mean("close", cfg.sma_slow)})

    d = bollinger(per_block(df, fn, lookback=ADX_REACH)).drop("bb_mid", "bb_upper", "bb_lower", "bb_width", "bb_position")
    trend = F.when(F.col("adx") > cfg.adx_threshold, F.when(F.col("_fast") > F.col("_slow"), 1.0).when(F.col("_fast") < F.col("_slow"), -1.0)).otherwise(0.0)
    shield = sig("cot_signal") * cfg.cot_weight + sig("vp_signal") * cfg.vp_weight + sig("bank_signal") * cfg.bank_weight
    extras = (
        sig("smc_signal") * cfg.smc_weight + sig("wyckoff_signal") * cfg.wyckoff_weight + sig("debate_signal") * cfg.debate_weight
        + sig("real_flow_signal") * cfg.real_flow_weight + sig("qmf_signal") * cfg.qmf_weight
    )
    d = d.withColumns({"_shield": shield, "signal_score": F.coalesce(trend, F.lit(0.0)) * cfg.trend_weight + shield * cfg.shield_weight + extras})
    flow_ok = F.coalesce(F.col("real_flow_available"), F.lit(False)) if "real_flow_available" in have else F.lit(False)
    gate = flow_ok if cfg.require_real_flow else F.lit(True)
    s = F.col("signal_score")
    buy = (s >= cfg.buy_threshold) & (F.col("rsi") < cfg.rsi_overbought) & (F.col("_shield") > cfg.manipulation_danger) & gate
    sell = ((s <= cfg.sell_threshold) & (F.col("rsi") > cfg.rsi_oversold)) | (F.col("_shield") <= cfg.extreme_danger)
    return d.withColumn("combined_signal", F.when(sell, -1).when(buy, 1).otherwise(0)).drop("_fast", "_slow", "_shield")


def breadth(indices: DataFrame) -> DataFrame:
    """One row from (name, change_pct, price): how many indices fall by 2 % and 1 %, mean equity change."""
    index = ~F.col("name").isin("VIX", "DXY", "GOLD")
    return indices.agg(
        F.count_if(index & (F.col("change_pct") <= -2.0)).alias("significant_drops"),
        F.count_if(index & (F.col("change_pct") <= -1.0)).alias("minor_drops"),
        F.avg(F.when(F.col("name").isin("US", "VN", "TW"), F.col("change_pct"))).alias("equity_avg"),
        F.coalesce(F.max(F.when(F.col("name") == "VIX", F.col("price"))), F.lit(0.0)).alias("vix"),
        F.coalesce(F.max(F.when(F.col("name") == "GOLD", F.col("change_pct"))), F.lit(0.0)).alias("gold_change"),
    )


def crash_shield(indices: DataFrame) -> DataFrame:
    """Risk level 0-3, flight-to-safety flag and size multiplier."""
    d = breadth(indices)
    big, small, vix = F.col("significant_drops"), F.col("minor_drops"), F.col("vix")
    level = F.when((big >= 3) | (vix > 32), 3).when((big >= 1) | (small >= 3) | (vix > 25), 2).when((small >= 1) | (vix > 20), 1).otherwise(0)
    return d.withColumn("level", level).withColumns({
        "flight_to_safety": truthy((F.col("equity_avg") < -1.0) & (F.col("gold_change") > 0.5)),
        "size_multiplier": F.element_at(F.array(F.lit(1.0), F.lit(0.7), F.lit(0.4), F.lit(0.0)), F.col("level") + 1),
    })
