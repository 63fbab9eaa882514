"""Trading range, phases, volume-spread flags, springs, support points, score and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.config import WyckoffSettings
from tickloom.functions.series import Frame, at_last, is_last, per_block, recent, tail
from tickloom.operators.clean import missing, neutral
from tickloom.operators.indicators import add_atr, clip, nonzero, rolling_rank_pct, truthy

# Phase labels with their scores, bar-event labels, quick phases accepted by the scanner.
PHASE_B, PHASE_C, PHASE_D = "📦 PHASE B (Accumulation)", "🌀 PHASE C (Spring Zone)", "🚀 PHASE D (SOS Markup)"
PHASE_E, MARKUP, DISTRIBUTION, MARKDOWN = "⚡ PHASE E (Markup Escape)", "📈 MARKUP", "📉 DISTRIBUTION", "📉 MARKDOWN"
PHASE_SCORE = {PHASE_B: 0.1, PHASE_C: 0.3, PHASE_D: 0.4, PHASE_E: 0.2, MARKUP: 0.15, DISTRIBUTION: -0.3, MARKDOWN: -0.2}
VSA_LABELS = {
    "vsa_sow": "🔴 Sign of Weakness (SOW)", "vsa_sos": "💚 Sign of Strength (SOS)", "vsa_shakeout": "⚡ Shakeout",
    "vsa_no_supply": "🌬️ No Supply", "vsa_stopping_vol": "🛑 Stopping Volume",
}
VSA_SCORE = {"vsa_sos": 0.25, "vsa_sow": -0.25, "vsa_no_supply": 0.15, "vsa_stopping_vol": 0.10, "vsa_shakeout": 0.10}
NORMAL_BAR = "⚪ Normal"
ACCEPTED_QUICK_PHASES = ("Phase A", "Phase B", "Phase C", "Phase D", "Re-Accumulation", "ACCUMULATION", "CONSOLIDATION")


def trading_range(bars: DataFrame, cfg: WyckoffSettings = WyckoffSettings()) -> DataFrame:
    """Upper and lower bound per symbol when the recent ATR has contracted and both bounds were touched;
    symbols without a range do not appear. Reads only the recent bars."""
    n = cfg.tr_lookback
    d = tail(bars.where(F.col("n_bars") >= n + 20), 3 * n + 16)
    d = tail(per_block(d, lambda d, f: add_atr(d, f), lookback=16), 3 * n)
    window = F.col("bar_no") >= F.col("n_bars") - n
    s = d.groupBy("symbol").agg(
        F.avg(F.when(window, F.col("atr"))).alias("_now"), F.avg("atr").alias("_long"),
        F.percentile(F.when(window, F.col("high")), 0.85).alias("tr_upper"), F.percentile(F.when(window, F.col("low")), 0.15).alias("tr_lower"),
        F.collect_list(F.when(window, F.struct("high", "low"))).alias("_w"),
    )
    tol = F.col("_now") * 0.5
    near = lambda c, level: F.size(F.filter("_w", lambda x: (x[c] >= F.col(level) - tol) & (x[c] <= F.col(level) + tol)))
    ok = ~((F.col("_long") > 0) & (F.col("_now") > F.col("_long") * cfg.tr_atr_ratio))
    return s.where(ok & (near("high", "tr_upper") >= cfg.tr_min_touches) & (near("low", "tr_lower") >= cfg.tr_min_touches)).select(
        "symbol", "tr_upper", "tr_lower")


def tr_position(price: Column) -> Column:
    span = nonzero(F.col("tr_upper") - F.col("tr_lower"))
    return F.when(F.col("tr_upper").isNull(), F.lit(0.5)).otherwise(F.coalesce((price - F.col("tr_lower")) / span, F.lit(0.5)))


def add_vsa(d: DataFrame, f: Frame, cfg: WyckoffSettings, mode: str = "reference") -> DataFrame:
    """Volume-spread flags. The shakeout is stamped on the drop by ``mode="reference"`` (it then needs the
    next bar) and on the recovery bar by ``"causal"``."""
    n = cfg.evr_lookback
    prev = f.lag("close")
    d = d.withColumns({
        "_sp": F.greatest(F.col("high") - F.col("low"), F.lit(1e-6)), "_vr": F.col("volume") / nonzero(f.mean("volume", n, 5)),
        "_up": truthy(F.col("close") > prev), "_chg": f.pct_change("close"), "_m20": f.mean("close", 20), "_m5": f.mean("close", 5),
    })
    d = d.withColumns({
        "_rk": rolling_rank_pct(f, "_sp", n) * 100, "_nx": f.lead("_chg"), "_pc": f.lag("_chg"), "_pv": f.lag("_vr"),
        "_er": F.coalesce(F.col("_sp") / nonzero(f.mean("_sp", n)), F.lit(1.0)) / F.coalesce("_vr", F.lit(1.0)),
        "_ww": f.sum(F.when(F.col("_up"), F.col("volume")).otherwise(0.0), n, 5) / nonzero(f.sum(F.when(F.col("_up"), 0.0).otherwise(F.col("volume")), n, 5)),
    })
    down, wide = ~F.col("_up"), (F.col("_vr") >= cfg.sos_volume_multiplier) & (F.col("_rk") >= cfg.sos_spread_percentile)
    drop, vol, back = (F.col("_chg"), F.col("_vr"), F.col("_nx")) if mode == "reference" else (F.col("_pc"), F.col("_pv"), F.col("_chg"))
    d = d.withColumns({
        "vsa_stopping_vol": truthy((F.col("_vr") >= cfg.stopping_vol_multiplier) & (F.col("_rk") <= cfg.stopping_spread_percentile) & down & (F.col("close") < F.col("_m20"))),
        "vsa_no_supply": truthy((F.col("_vr") <= cfg.no_supply_vol_ratio) & down & (F.col("_rk") <= 50)),
        "vsa_shakeout": truthy((drop <= cfg.shakeout_drop_pct) & (back >= cfg.shakeout_recovery_pct) & (vol < 1.5)),
        "vsa_sos": truthy(wide & F.col("_up") & (F.col("close") > F.col("_m5"))),
        "vsa_sow": truthy(wide & down & (F.col("close") < F.col("_m5"))),
        "effort_vs_result": clip(F.col("_er"), 0.0, 5.0), "weis_wave_ratio": clip(F.col("_ww"), 0.1, 10.0),
    })
    label = F
    for flag, text in VSA_LABELS.items():
        label = label.when(F.col(flag), text)
    return d.withColumn("vsa_label", label.otherwise(NORMAL_BAR)).drop("_sp", "_up", "_m20", "_m5", "_rk", "_nx", "_pc", "_pv", "_er", "_ww")


def vsa(bars: DataFrame, cfg: WyckoffSettings = WyckoffSettings(), mode: str = "reference") -> DataFrame:
    return per_block(bars, lambda d, f: add_vsa(d, f, cfg, mode), lookback=cfg.evr_lookback + 2, lookahead=1).drop("_vr", "_chg")


def add_phase(d: DataFrame, f: Frame, cfg: WyckoffSettings) -> DataFrame:
    """Phase label from the position in the range and the long mean; later rules win."""
    d = d.withColumn("_above", truthy(F.col("close") > f.mean("close", cfg.ma_long_period, 50)))
    has, window = F.col("tr_upper").isNotNull(), F.col("bar_no") >= F.col("n_bars") - cfg.tr_lookback
    pos = tr_position(F.col("close"))
    escape = (F.col("close") > F.col("tr_upper")) & F.coalesce(~f.lag("_above", 10), F.lit(True))
    spring = F.col("low") < F.col("tr_lower") * (1 - cfg.spring_penetration)
    phase = (
        F.when(~has, F.when(F.col("_above"), MARKUP).otherwise(MARKDOWN)).when(window & F.col("_above"), DISTRIBUTION)
        .when(truthy(escape), PHASE_E).when(window & truthy(spring) & ~F.col("_above"), PHASE_C).when(window & (pos > 0.80), PHASE_D)
        .when(window & (pos >= 0.2) & (pos <= 0.80), PHASE_B).otherwise("UNKNOWN")
    )
    return d.withColumn("wyckoff_phase", phase).drop("_above")


def add_events(d: DataFrame, f: Frame, cfg: WyckoffSettings) -> DataFrame:
    """Spring and last-point-of-support flags (need ``_vr``, ``_chg``, ``atr`` and the range columns)."""
    below = F.try_divide(F.col("tr_lower") - F.col("low"), F.col("tr_lower"))
    calm = F.coalesce("_vr", F.lit(1.0))
    recovered = F.max("close").over(f.rows(1, cfg.spring_recovery_bars)) >= F.col("tr_lower")
    spring = below.between(cfg.spring_penetration, cfg.spring_max_penetration) & (calm < cfg.spring_volume_ratio) & (F.col("close") >= F.col("tr_lower") * 0.995) & recovered
    depth = f.lag("close") - F.col("close")
    lps = (
        (F.col("bar_no") >= 2) & (F.col("close") >= (F.col("tr_upper") + F.col("tr_lower")) / 2) & (F.col("_chg") < 0)
        & ~((F.col("atr") > 0) & (depth > F.col("atr") * cfg.lps_pullback_atr_mult)) & (calm < cfg.lps_volume_ratio)
        & (F.coalesce(F.sum("_chg").over(f.rows(-3, -1)), F.lit(0.0)) > 0)
    )
    return d.withColumns({"wyckoff_spring": truthy(spring), "wyckoff_lps": truthy(lps)})


def reward_risk(entry: Column, stop: Column, target: Column) -> Column:
    """struct(rr, target, valid): zero and invalid without a positive risk."""
    ok = (entry > 0) & (stop > 0) & (entry > stop)
    rr = F.try_divide(target - entry, entry - stop)
    return F.struct(
        F.when(ok, F.bround(rr, 2)).otherwise(0.0).alias("rr"), F.when(ok, F.bround(target, 4)).otherwise(0.0).alias("target"),
        F.coalesce(ok & (rr >= 2.0), F.lit(False)).alias("valid"),
    )


def range_target(entry: Column) -> Column:
    """One range width above the upper bound; 5 % above the entry without a range."""
    return F.coalesce(F.col("tr_upper") * 2 - F.col("tr_lower"), entry * 1.05)


def wyckoff_signals(bars: DataFrame, cfg: WyckoffSettings = WyckoffSettings(), mode: str = "reference") -> DataFrame:
    """Phases, flags, score in [-1, 1] and SPRING / LPS / SOS / SOW / MARKDOWN signals with stop, target
    and reward:risk. Symbols under 50 bars stay neutral."""
    if missing(bars, ["high", "low", "close", "volume"]):
        return neutral(bars, {"wyckoff_signal": 0, "wyckoff_reason": "MISSING_DATA"})
    d = bars.join(trading_range(bars, cfg), "symbol", "left")

    def fn(d: DataFrame, f: Frame) -> DataFrame:
        d = add_phase(add_atr(d, f), f, cfg)
        d = add_events(add_vsa(d, f, cfg, mode), f, cfg)
        base = F.coalesce(F.create_map(*[F.lit(x) for kv in PHASE_SCORE.items() for x in kv])[F.col("wyckoff_phase")], F.lit(0.0))
        for flag, w in VSA_SCORE.items():
            base = base + F.when(F.col(flag), w).otherwise(0.0)
        base = base + F.when(F.col("wyckoff_spring"), 0.30).otherwise(0.0) + F.when(F.col("wyckoff_lps"), 0.20).otherwise(0.0)
        base = base + clip((F.coalesce("weis_wave_ratio", F.lit(1.0)) - 1.0) * 0.1, -0.2, 0.2)
        d = d.withColumn("_base", base)
        return d.withColumn("wyckoff_score", clip(f.mean("_base", cfg.score_smoothing, 1), -1.0, 1.0))

    d = per_block(d, fn, lookback=cfg.ma_long_period + 16, lookahead=cfg.spring_recovery_bars)
    stop = F.col("close") - F.coalesce("atr", F.col("close") * 0.02) * 1.5
    d = d.withColumn("_rr", reward_risk(F.col("close"), stop, range_target(F.col("close"))))
    s, valid = F.col("wyckoff_score"), F.col("_rr.valid")
    reason = (
        F.when(F.col("n_bars") < 50, "INSUFFICIENT_DATA").when(F.col("wyckoff_spring"), "SPRING")
        .when(F.col("wyckoff_lps"), F.when(valid, "LPS").otherwise("")).when(F.col("vsa_sos") & (s >= 0.4), F.when(valid, "SOS").otherwise(""))
        .when(F.col("vsa_sow") & (s <= -0.35), "SOW").when(s <= -0.5, "MARKDOWN").otherwise("")
    )
    d = d.withColumn("wyckoff_reason", reason)
    buy = F.col("wyckoff_reason").isin("SPRING", "LPS", "SOS")
    return d.withColumns({
        "wyckoff_signal": F.when(buy, 1).when(F.col("wyckoff_reason").isin("SOW", "MARKDOWN"), -1).otherwise(0),
        "wyckoff_tr_position": tr_position(F.col("close")), "wyckoff_rr": F.when(buy, F.col("_rr.rr")).otherwise(0.0),
        "wyckoff_target": F.when(buy, F.col("_rr.target")), "wyckoff_stop": F.when(buy, stop),
    }).drop("_rr", "_vr", "_chg", "_base")


def wyckoff_state(signals: DataFrame) -> DataFrame:
    """Snapshot per symbol from the signal table; the stop sits half a percent under the 60-bar low."""
    floor = tail(signals, 60).groupBy("symbol").agg((F.min("low") * 0.995).alias("_stop"))
    d = signals.where(is_last()).join(floor, "symbol")
    rr = F.when(F.col("tr_upper").isNotNull(), reward_risk(F.col("close"), F.col("_stop"), range_target(F.col("close"))))
    d = d.withColumn("_rr", rr)
    short = F.col("n_bars") < 50
    return d.select(
        "symbol", "ts", "close", F.when(short, "UNKNOWN").otherwise(F.col("wyckoff_phase")).alias("phase"),
        F.when(short, 0.0).otherwise(F.bround("wyckoff_score", 3)).alias("score"), F.col("wyckoff_signal").alias("signal"), "vsa_label",
        F.col("wyckoff_spring").alias("spring"), F.col("wyckoff_lps").alias("lps"), F.bround("effort_vs_result", 3).alias("effort_vs_result"),
        F.coalesce(F.bround("weis_wave_ratio", 3), F.lit(1.0)).alias("weis_wave_ratio"), "tr_upper", "tr_lower",
        F.bround("wyckoff_tr_position", 3).alias("tr_position"), F.coalesce("_rr.rr", F.lit(0.0)).alias("rr"),
        F.coalesce("_rr.target", F.lit(0.0)).alias("target"), F.bround("_stop", 4).alias("stop"), F.coalesce("_rr.valid", F.lit(False)).alias("valid_trade"),
        F.bround("atr", 4).alias("atr"),
    )


def quick_phase(bars: DataFrame) -> DataFrame:
    """Cheap phase for pre-filtering (40 bars at least): one aggregate over the last 60 bars."""
    back = F.col("n_bars") - F.col("bar_no")
    d = tail(bars.where(F.col("n_bars") >= 40), 60)
    period = F.least(F.lit(60), F.col("n_bars"))
    half = F.floor(period / 2)
    s = d.groupBy("symbol").agg(
        F.max("high").alias("_hi"), F.min("low").alias("_lo"), F.max_by("close", "bar_no").alias("_c"), F.max("n_bars").alias("_n"),
        F.avg(F.when(back > half, F.col("volume"))).alias("_ve"), F.avg(F.when(back <= half, F.col("volume"))).alias("_vl"),
        F.min(F.when(back <= 20, F.col("low"))).alias("_l1"), F.min(F.when((back > 20) & (back <= 40), F.col("low"))).alias("_l2"),
        F.avg(F.when(back <= 20, F.col("close"))).alias("_s20"), F.avg(F.when(back <= 50, F.col("close"))).alias("_s50"),
    )
    span = F.col("_hi") - F.col("_lo")
    width = F.when(F.col("_lo") > 0, F.try_divide(span, F.col("_lo"))).otherwise(1.0)
    pos = F.when(span > 0, F.try_divide(F.col("_c") - F.col("_lo"), span)).otherwise(0.5)
    vol = F.when(F.col("_ve") > 0, F.try_divide(F.col("_vl"), F.col("_ve"))).otherwise(1.0)
    ranging = width < 0.25
    points = (
        F.when(ranging, F.when(pos < 0.40, 0.45).when(pos > 0.60, 0.2 - 0.20).otherwise(0.2)).otherwise(0.0)
        + F.when(F.col("_l1") > F.col("_l2"), 0.20).otherwise(0.0) + F.when(vol > 1.15, 0.15).when(vol < 0.80, -0.10).otherwise(0.0)
    )
    s = s.withColumns({"score": clip(points, -1.0, 1.0), "_s50": F.when(F.col("_n") >= 50, F.col("_s50")).otherwise(F.col("_s20"))})
    sc = F.col("score")
    phase = F.when(
        ~ranging,
        F.when((F.col("_c") > F.col("_s20")) & (F.col("_s20") > F.col("_s50")), "Markup (Uptrend)")
        .when((F.col("_c") < F.col("_s20")) & (F.col("_s20") < F.col("_s50")), "Markdown (Downtrend)").otherwise("Transition"),
    ).when((sc >= 0.3) & (pos < 0.5), "Accumulation (Phase C/D)").when(sc >= 0.1, "Re-Accumulation").when(sc <= -0.2, "Distribution").otherwise("CONSOLIDATION")
    s = s.withColumn("phase", phase)
    return s.select("symbol", "phase", "score", (F.col("phase").isin(*ACCEPTED_QUICK_PHASES) & (sc >= -0.2)).alias("in_accumulation"))
