"""Forecast calibration, vetoes, sizing and trade plans. Forecasts are rows (symbol, horizon)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.series import Frame, at_last
from tickloom.operators.indicators import add_atr, clip, truthy
from tickloom.operators.joins import nearest
from tickloom.operators.scanner import structural_prior

# Horizon scales, playbook modes, factor weights.
HORIZON_SCALE = {1: 0.25, 5: 0.45, 21: 0.70, 63: 0.90}
MODES = (("Aggressive", 0.35, 1.20, 1.25), ("Balanced", 0.65, 1.70, 1.00), ("Conservative", 1.10, 2.20, 0.70))
MIN_STOP, MAX_STOP, MAX_TARGET, MIN_RR = 0.015, 0.04, 0.06, 1.5
NEUTRAL, BULL, BEAR = "🟡 NEUTRAL", "🟢 BULLISH", "🔴 BEARISH"


def bias_label(ret_pct: Column) -> Column:
    return F.when(ret_pct > 1, BULL).when(ret_pct < -1, BEAR).otherwise(NEUTRAL)


def calibrate(fc: DataFrame) -> DataFrame:
    """Shift forecasts by the structural prior, damp them when the oscillator is exhausted, reset bands and
    confidence. Columns: horizon, current_price, predicted_return (percent), predicted_lower/upper,
    confidence and the context (wyckoff_score, wyckoff_phase, smc_score, qmf_score, qmf_signal, stoch_k/d)."""
    h = F.col("horizon")
    over, under = (F.col("stoch_k") > 85) & (F.col("stoch_d") > 85), (F.col("stoch_k") < 15) & (F.col("stoch_d") < 15)
    scale = None
    for k, v in HORIZON_SCALE.items():
        scale = F.when(h == k, v) if scale is None else scale.when(h == k, v)
    d = fc.withColumn("institutional_prior", structural_prior(F.col("wyckoff_score"), F.col("smc_score"), F.col("qmf_score")))
    prior, raw = F.col("institutional_prior"), F.col("predicted_return") / 100.0
    ret = raw + prior * 0.015 * scale.otherwise(0.5)
    d = d.withColumn("_ret", ret)
    damp = F.when(h <= 5, 0.70).otherwise(0.85)
    d = d.withColumn("_ret", F.when((over & (F.col("_ret") > 0)) | (under & (F.col("_ret") < 0)), F.col("_ret") * damp).otherwise(F.col("_ret")))
    cur = F.col("current_price")
    price = cur * (F.col("_ret") + 1.0)
    band = F.abs(F.col("predicted_upper") - F.col("predicted_lower")) / F.greatest(cur, F.lit(1e-9))
    band = band * F.when(F.upper("wyckoff_phase").contains("RANGE") | (F.abs("smc_score") < 0.12), 1.15).otherwise(1.0) * F.when(over | under, 1.10).otherwise(1.0)
    half = clip(band, 0.01, 0.22) / 2.0
    boost = F.when(F.signum(raw) == F.signum(prior), 0.08).otherwise(-0.08) * F.least(F.abs(prior), F.lit(1.0))
    boost = boost - F.when(over | under, 0.03).otherwise(0.0) - F.when(F.col("qmf_signal") == 0, 0.02).otherwise(0.0)
    known = h.isin(*HORIZON_SCALE) & (cur > 0)
    new = {
        "predicted_price": price, "predicted_return": F.col("_ret") * 100.0, "predicted_lower": price * (1.0 - half), "predicted_upper": price * (half + 1.0),
        "confidence": clip(F.col("confidence") + boost, 0.0, 1.0),
    }
    have = set(d.columns)
    return d.withColumns({k: F.when(known, v).otherwise(F.col(k) if k in have else F.lit(None)) for k, v in new.items()}).drop("_ret")


def auto_veto(day1: DataFrame) -> DataFrame:
    """Contradictions between momentum, flow and the one-day forecast (one row per symbol)."""
    k, dd, q, r = F.col("stoch_k"), F.col("stoch_d"), F.col("qmf_signal"), F.col("predicted_return")
    long_ = (k > 88) & (dd > 85) & (q < 0) & (r > 0)
    short_ = (k < 12) & (dd < 15) & (q > 0) & (r < 0)
    clash = (F.abs("smc_score") < 0.08) & (F.abs("qmf_score") < 0.10) & (F.abs(r) > 1.2)
    d = day1.withColumn("veto_reason", F.when(long_, "OVERBOUGHT_OUTFLOW").when(short_, "OVERSOLD_INFLOW").when(clash, "LOW_CONVICTION_HIGH_FORECAST").otherwise("NONE"))
    active = F.col("veto_reason") != "NONE"
    return d.withColumns({"veto_active": active, "veto_severity": F.when(active, "HIGH").otherwise("LOW")})


def merge_vetoes(rows: DataFrame, flags: dict[str, str]) -> DataFrame:
    """Add further veto sources: column name -> reason text; reasons are joined."""
    extra = F.concat_ws(" | ", F.when(F.col("veto_active"), F.col("veto_reason")), *[F.when(F.col(c), F.lit(t)) for c, t in flags.items()])
    any_flag = F.col("veto_active")
    for c in flags:
        any_flag = any_flag | F.coalesce(F.col(c), F.lit(False))
    return rows.withColumns({"veto_active": any_flag, "veto_reason": F.when(extra == "", "NONE").otherwise(extra), "veto_severity": F.when(any_flag, "HIGH").otherwise("LOW")})


def apply_veto(fc: DataFrame, veto: DataFrame) -> DataFrame:
    d = fc.join(veto.select("symbol", "veto_active"), "symbol", "left")
    hit = F.coalesce("veto_active", F.lit(False)) & F.col("horizon").isin(1, 5)
    return d.withColumns({"confidence": F.when(hit, clip(F.col("confidence") * 0.72, 0.0, 1.0)).otherwise(F.col("confidence")), "bias": F.when(hit, NEUTRAL).otherwise(F.col("bias"))})


def apply_geo_gate(fc: DataFrame) -> DataFrame:
    """Scale confidence and upside by ``gate_action``/``gate_multiplier``; a pause removes upside."""
    act = F.upper(F.trim("gate_action"))
    act = F.when(act.isin("REDUCE_SIZE", "PAUSE_NEW_LONGS"), act).otherwise("NORMAL")
    mul, up, cur = clip(F.col("gate_multiplier"), 0.0, 1.0), F.col("predicted_return") > 0, F.col("current_price")
    pause, reduce = (act == "PAUSE_NEW_LONGS") & up, (act == "REDUCE_SIZE") & up
    soft = F.col("predicted_return") * 0.8
    return fc.withColumns({
        "confidence": F.when(act == "NORMAL", F.col("confidence")).otherwise(clip(F.col("confidence") * (mul * 0.35 + 0.65), 0.0, 1.0)),
        "predicted_price": F.when(pause, cur).when(reduce & (cur > 0), cur * (soft / 100.0 + 1.0)).otherwise(F.col("predicted_price")),
        "bias": F.when(pause, NEUTRAL).otherwise(F.col("bias")), "predicted_return": F.when(pause, 0.0).when(reduce, soft).otherwise(F.col("predicted_return")),
        "gate_action": act,
    })


def kelly_cap(rows: DataFrame) -> DataFrame:
    """Half-Kelly risk cap from confidence, forecast size and ATR percent."""
    conf = clip(F.coalesce("confidence", F.lit(0.5)), 0.05, 0.95)
    rr = clip(F.abs("predicted_return") / F.greatest("atr_pct", F.lit(0.25)), 0.3, 3.0)
    return rows.withColumn("kelly_cap", clip((conf - (F.lit(1.0) - conf) / rr) * 0.5, 0.003, 0.025))


def risk_budget(rows: DataFrame, ai_weight: float = 1.0) -> DataFrame:
    """Risk percent and core/tactical split from confidence, conviction, veto, gate and Kelly cap."""
    conf = clip((F.col("confidence") - 0.5) * ai_weight + 0.5, 0.0, 1.0)
    conv = clip(F.col("institutional_prior") * 0.4 + F.col("qmf_score") * 0.25 + F.col("smc_score") * 0.2 + F.col("wyckoff_score") * 0.15, -1.0, 1.0)
    d = rows.withColumn("inst_conviction", conv)
    c = F.col("inst_conviction")
    mul = (c * 0.55 + 1.0) * F.when(F.col("veto_active"), 0.55).otherwise(1.0)
    risk = clip((conf * 0.018 + 0.006) * mul, 0.003, 0.025) * clip(F.col("gate_multiplier"), 0.0, 1.0)
    risk = F.when(F.col("kelly_cap").isNotNull(), F.least(risk, F.greatest("kelly_cap", F.lit(0.003)))).otherwise(risk)
    accum = truthy(F.upper("wyckoff_phase").rlike("PHASE B|PHASE C|PHASE D|ACCUM")) & (c > 0)
    core = F.when(accum, clip(c * 25 + 55, 40.0, 80.0)).otherwise(clip(c * 20 + 35, 20.0, 65.0)).cast("int")
    return d.withColumns({"risk_pct": clip(risk, 0.003, 0.025), "core_alloc": core, "tactical_alloc": F.lit(100) - core})


def simple_split(rows: DataFrame) -> DataFrame:
    """70/30 core split in accumulation phases or with more than 15 % expected upside."""
    strong = truthy(F.upper("wyckoff_phase").rlike("PHASE B|PHASE C|PHASE D")) | (F.col("upside_63d") > 15)
    core = F.when(strong, 70).otherwise(30)
    return rows.withColumns({"core_alloc": core, "tactical_alloc": F.lit(100) - core})


def entry_playbook(rows: DataFrame) -> DataFrame:
    """Three entry modes per symbol, scaled by ATR. The modes are an array literal, exploded."""
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(z).alias("zone"), F.lit(s).alias("sl"), F.lit(k).alias("size")) for m, z, s, k in MODES])
    d = rows.withColumn("_m", F.explode(modes))
    p, atr = F.col("live_price"), F.coalesce(F.when(F.col("atr") > 0, F.col("atr")), F.col("live_price") * 0.02)
    risk = F.col("risk_pct") * 100.0 * F.col("_m.size") * F.when(F.col("veto_active"), 0.70).otherwise(1.0) * (F.col("confidence") * 0.5 + 0.75)
    return d.select(
        "symbol", F.col("_m.mode").alias("mode"), (p - F.col("_m.zone") * atr).alias("zone_low"), (p + F.col("_m.zone") * atr * 0.35).alias("zone_high"),
        (p - F.col("_m.sl") * atr).alias("stop_loss"), clip(risk, 0.20, 4.00).alias("risk_per_trade_pct"),
        F.when(F.col("up_1m") + F.col("up_3m") >= 0, "LONG").otherwise("DEFENSIVE").alias("bias"))


def signal_matrix(rows: DataFrame) -> DataFrame:
    """Weighted mean of the available factor scores (0-10) with a label and conviction."""
    whole = lambda c: F.when(c.isNotNull(), F.least(F.lit(10), F.greatest(F.lit(0), c.cast("int"))))
    smc, mtf, conf = F.col("smc_score"), F.col("confluence_score"), F.col("elliott_confidence")
    ten = F.floor(conf / 10).cast("int")
    wave = F.when(conf.isNull(), None).when(F.col("elliott_bias").contains("Bullish"), ten).when(F.col("elliott_bias").contains("Bearish"), F.lit(10) - ten).otherwise(5)
    fund = F.when((F.col("data_coverage") >= 40) & (F.upper("fundamental_grade") != "N/A"), (F.col("total_score") / 10).cast("int"))
    factors = [
        (20, F.when(F.col("smc_signal") != 0, whole((smc + 1) * 5)).otherwise(5)), (15, F.lit(5)), (20, whole((mtf + 9) / 18 * 10)),
        (15, whole(wave)), (15, fund), (10, whole((smc * 0.5 + 0.5) * 10)),
    ]
    d = rows.withColumns({f"_f{i}": s for i, (_, s) in enumerate(factors)})
    cols = [(w, F.col(f"_f{i}")) for i, (w, _) in enumerate(factors)]
    weight = sum((F.when(c.isNotNull(), w).otherwise(0) for w, c in cols), F.lit(0))
    total = sum((F.coalesce(c / 10 * w, F.lit(0.0)) for w, c in cols), F.lit(0.0))
    high = sum((F.when(c / 10 >= 0.7, 1).otherwise(0) for _, c in cols), F.lit(0))
    count = sum((F.when(c.isNotNull(), 1).otherwise(0) for _, c in cols), F.lit(0))
    d = d.withColumns({"composite": total / weight * 100, "_h": high, "_c": count})
    s = F.col("composite")
    return d.withColumns({
        "composite_label": F.when(s >= 70, "STRONG BUY").when(s >= 55, "BUY").when(s <= 30, "STRONG SELL").when(s <= 45, "SELL").otherwise("NEUTRAL"),
        "conviction": F.when(F.col("_h") >= F.col("_c") * 0.6, "HIGH").when(F.col("_h") >= F.col("_c") * 0.4, "MEDIUM").otherwise("LOW"),
    }).drop("_h", "_c", *[f"_f{i}" for i in range(len(factors))])


def readiness(rows: DataFrame) -> DataFrame:
    """Execution readiness from distance to entry, confidence, structure score and pattern; two targets."""
    d = rows.withColumn("_d", F.try_divide(F.abs(F.col("current_price") - F.col("entry")), F.col("entry")))
    base = F.when(F.col("entry").isNull(), "DISABLED").when(F.col("_d") < 0.005, "READY").when(F.col("_d") < 0.015, "ALMOST").otherwise("WAITING")
    trig = (base == "READY") & ((F.col("confidence") > 0.7) | (F.abs("smc_score") > 0.4))
    pyramid = F.col("entry").isNotNull() & F.col("pattern").isin("BULL FLAG", "BEAR PENNANT")
    return d.withColumns({
        "ready_status": F.when(trig, "TRIGGER").when(pyramid, "PYRAMID").otherwise(base), "tp1": F.col("entry") + (F.col("target") - F.col("entry")) * 0.5, "tp2": F.col("target"),
        "plan_rr": F.try_divide(F.abs(F.col("target") - F.col("entry")), F.nullif(F.abs(F.col("entry") - F.col("stop")), F.lit(0.0))),
    }).drop("_d")


def allocation_mode(crash_level: Column, regime: Column) -> Column:
    return F.when(crash_level >= 2, "DEFENSIVE").when(regime == "BULL", "OFFENSIVE").otherwise("NEUTRAL")


def intraday_plan(bars: DataFrame, zones: DataFrame, valid: DataFrame, side: str = "long") -> DataFrame:
    """Bounded hourly plan: nearest zone entry, stop within 1.5-4 %, target up to 6 %, break-even after 70 %
    of the way, validity check. ``zones`` has (symbol, zone_no, top, bottom); ``valid`` the feed check."""
    long = side == "long"

    def fn(d: DataFrame, f: Frame) -> DataFrame:
        d = add_atr(d, f, 14, 14, "_a")
        ext = (lambda n: F.max("high").over(f.rows(-n, -1))) if long else (lambda n: F.min("low").over(f.rows(-n, -1)))
        return d.withColumns({"_e4": ext(4), "_e20": ext(20)})

    d = at_last(bars, fn, 24).select("symbol", F.col("close").alias("current"), F.coalesce(F.when(F.col("_a") > 0, F.col("_a")), F.col("close") * 0.01).alias("atr_h"), "_e4", "_e20")
    anchor = "top" if long else "bottom"
    d = nearest(d, zones.where((F.col("bottom") > 0) & (F.col("bottom") <= F.col("top"))), "current", anchor, max_distance_pct=0.03, side=side)
    cur, atr, sgn = F.col("current"), F.col("atr_h"), 1.0 if long else -1.0
    d = d.withColumn("entry", F.coalesce(anchor, cur * (0.995 if long else 1.005)))
    e = F.col("entry")
    raw = F.coalesce(F.col("bottom" if long else "top") - atr * (0.2 * sgn), e - atr * (1.5 * sgn))
    lo, hi = (e * (1 - MAX_STOP), e * (1 - MIN_STOP)) if long else (e * (1 + MIN_STOP), e * (1 + MAX_STOP))
    d = d.withColumn("stop", F.greatest(F.least(raw, hi), lo))
    risk = (e - F.col("stop")) * sgn
    pick, bound = (F.greatest, F.least) if long else (F.least, F.greatest)
    d = d.withColumn("target", bound(pick("_e20", cur + atr * (2.0 * sgn), e + risk * (MIN_RR * sgn)), e * (1.0 + MAX_TARGET * sgn)))
    d = d.withColumn("break_even_trigger", e + (F.col("target") - e) * 0.70)
    reached = cur >= F.col("break_even_trigger") if long else cur <= F.col("break_even_trigger")
    d = d.withColumn("stop", F.when(reached, pick("stop", "entry")).otherwise(F.col("stop")))
    phase0 = pick("current", "_e4")
    d = d.withColumn("phase0", F.when(F.abs(phase0 - cur) / cur <= 0.03, phase0)).join(valid.select("symbol", "ok", F.col("reason").alias("_why")), "symbol", "left")
    r, w = F.abs(e - F.col("stop")), F.abs(F.col("target") - e)
    ordered = (F.col("stop") < e) & (e < F.col("target")) if long else (F.col("target") < e) & (e < F.col("stop"))
    reason = (
        F.when(~F.coalesce("ok", F.lit(False)), F.coalesce("_why", F.lit("H1 data unavailable"))).when(F.col("stop") == e, "Break-even protected")
        .when(~ordered, f"{side.capitalize()} plan ordering invalid").when(~(r / e).between(MIN_STOP - 1e-9, MAX_STOP + 1e-9), "Intraday stop outside 1.5%-4.0%")
        .when(w / F.nullif(r, F.lit(0.0)) < MIN_RR - 1e-9, "Risk:reward below 1.5").otherwise("OK"))
    return d.select("symbol", reason.isin("OK", "Break-even protected").alias("actionable"), reason.alias("reason"), "current", "phase0", "entry", "stop", "target", "atr_h", "break_even_trigger")
