"""Universe scan: tiers, institutional score, grades, ranking, entry candidates and alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.series import at_last, tail
from tickloom.operators.clean import lookup
from tickloom.operators.indicators import clip, truthy
from tickloom.operators.joins import band_exists
from tickloom.operators.profile import profile_levels, volume_profile
from tickloom.operators.smc import of_kind
from tickloom.operators.wyckoff import quick_phase

# Rating texts, base allocations (percent, stop multiple), status ranks.
STATUS_RANK = {"READY": 0, "NEAR": 1, "WATCH": 2, "WAIT": 3}
STATUS_BONUS = {"READY": 0.12, "NEAR": 0.08, "WATCH": 0.03}
MID_RATINGS = ("⭐⭐⭐ Strong Buy", "⭐⭐ Watch", "⭐ Neutral", "⚠️ Avoid")
SHORT_RATINGS = {
    "STRONG BUY": "⭐⭐⭐ Strong Buy (Sóng ngắn)", "BUY": "⭐⭐ Buy (Sóng ngắn)", "WATCH": "Watch (Đang tích lũy)", "AVOID": "Avoid (Giảm mạnh)",
}
SHORT_NEUTRAL = "Neutral (Trung lập)"
SHORT_ORDER = {SHORT_RATINGS["STRONG BUY"]: 0, SHORT_RATINGS["BUY"]: 1, SHORT_RATINGS["WATCH"]: 2, SHORT_NEUTRAL: 3, SHORT_RATINGS["AVOID"]: 4}
BASE_PCT = {
    MID_RATINGS[0]: 35.0, MID_RATINGS[1]: 15.0, MID_RATINGS[2]: 5.0, MID_RATINGS[3]: 0.0, SHORT_RATINGS["STRONG BUY"]: 25.0,
    SHORT_RATINGS["BUY"]: 15.0, SHORT_RATINGS["WATCH"]: 8.0, SHORT_NEUTRAL: 0.0, SHORT_RATINGS["AVOID"]: 0.0,
}
STOP_MULT = {MID_RATINGS[0]: 1.5, MID_RATINGS[1]: 1.2, SHORT_RATINGS["STRONG BUY"]: 1.5, SHORT_RATINGS["BUY"]: 1.2}
COMPOSITE_WEIGHTS = {"fund_norm": 0.30, "wy_smc_norm": 0.25, "mtf_norm": 0.20, "elliott_norm": 0.15, "flow_norm": 0.10}
TIPS = (
    "Ít Grade A: giảm tần suất vào lệnh mới, ưu tiên bảo toàn vốn.",
    "Grade C chiếm cao: thị trường nhiễu/phân phối, chỉ giữ setup mạnh.",
    "Nhiều mã bị veto: tránh FOMO, chờ xác nhận thêm 1 phiên.",
    "Điều kiện dữ liệu ổn định; tập trung Top Grade A, quản trị rủi ro theo SL.",
    "Không có dữ liệu hợp lệ hôm nay; ưu tiên đứng ngoài và kiểm tra nguồn feed.",
)
from tickloom.session import materialize


@dataclass(frozen=True)
class ScanSettings:
    min_rs: float = -1.25
    min_pass: int = 20
    tier1_top: int = 90
    prefilter_top: int = 60
    final_top: int = 60
    cap_1m: float = 45.0
    cap_3m: float = 80.0
    conf_buy: float = 0.08
    conf_strong: float = 0.25
    conf_buy_tw: float = 0.03
    conf_strong_tw: float = 0.12


def tier1(price_action: DataFrame, bars: DataFrame) -> DataFrame:
    """Price-action rows of symbols with at least 50 bars."""
    long_enough = bars.where(F.col("bar_no") == F.col("n_bars") - 1).where(F.col("n_bars") >= 50).select("symbol", "market", F.col("close").alias("last_close"))
    return price_action.select("symbol", "rs_score", "structure", "volume_status").join(long_enough, "symbol")


def tier_filter(rows: DataFrame, cfg: ScanSettings = ScanSettings()) -> DataFrame:
    """Relative-strength filter; when too few pass, the strongest are taken instead."""
    enough = rows.agg(F.count_if(F.col("rs_score") >= cfg.min_rs)).scalar() >= cfg.min_pass
    return rows.where(~enough | (F.col("rs_score") >= cfg.min_rs)).orderBy(F.desc("rs_score"), "symbol").limit(cfg.tier1_top)


def prefilter(rows: DataFrame, phases: DataFrame, cfg: ScanSettings = ScanSettings()) -> DataFrame:
    """Blend relative strength with the quick phase and keep the best."""
    p = F.lower("quick_phase")
    base = F.when(F.col("in_accumulation"), 0.18).otherwise(0.0)
    boost = (
        F.when(p.contains("markup"), F.greatest(base, F.lit(0.10))).when(p.contains("transition"), F.greatest(base, F.lit(0.05)))
        .when(p.contains("markdown"), F.least(base, F.lit(-0.18))).otherwise(base)
    )
    d = rows.join(phases.select("symbol", F.col("phase").alias("quick_phase"), F.col("score").alias("quick_score"), "in_accumulation"), "symbol")
    d = d.withColumn("prefilter_score", F.col("rs_score") * 0.55 + F.col("quick_score") * 0.45 + boost)
    return d.orderBy(F.desc("prefilter_score"), "symbol").limit(cfg.prefilter_top)


def stoch_state(k: Column, d: Column) -> Column:
    return F.when((k > 85) & (d > 85), "OVERBOUGHT").when((k < 15) & (d < 15), "OVERSOLD").otherwise("NEUTRAL")


def structural_prior(wyckoff: Column, smc: Column, qmf: Column) -> Column:
    return clip(wyckoff * 0.45 + smc * 0.35 + qmf * 0.20, -1.0, 1.0)


def institutional_score(rows: DataFrame, cfg: ScanSettings = ScanSettings()) -> DataFrame:
    """Volatility-capped forecasts, prior, confidence, blended score, contradiction veto, recommendation."""
    vol = F.when(F.col("daily_vol") > 0, F.col("daily_vol")).otherwise(0.02)
    d = rows.withColumns({
        "pred_cap_1m": clip(vol * 21 ** 0.5 * 100 * 4.0, 10.0, cfg.cap_1m), "pred_cap_3m": clip(vol * 63 ** 0.5 * 100 * 4.5, 20.0, cfg.cap_3m),
        "stoch_state": stoch_state(F.col("stoch_k"), F.col("stoch_d")),
        "institutional_prior": structural_prior(F.col("wyckoff_score"), F.col("smc_score"), F.col("qmf_score")),
    })
    capped = lambda c, cap: F.greatest(F.least(F.col(c), F.col(cap)), -F.col(cap))
    d = d.withColumns({
        "pred_21d_ret": capped("pred_21d_ret_raw", "pred_cap_1m"), "pred_63d_ret": capped("pred_63d_ret_raw", "pred_cap_3m"),
        "confidence_boosted": clip(F.col("ai_confidence") + F.col("institutional_prior") * 0.10, 0.0, 1.0),
    })
    blend = clip(
        F.col("pred_21d_ret") / 15.0 * 0.30 + F.col("pred_63d_ret") / 20.0 * 0.35 + F.col("confidence_boosted") * 0.20 + F.col("institutional_prior") * 0.15, -1.0, 1.0)
    hot = (F.col("stoch_state") == "OVERBOUGHT") & (F.col("qmf_signal") < 0) & (F.col("pred_21d_ret") > 0)
    cold = (F.col("stoch_state") == "OVERSOLD") & (F.col("qmf_signal") > 0) & (F.col("pred_21d_ret") < 0)
    d = d.withColumns({"_clash": F.when(hot, "Overbought + outflow contradiction").when(cold, "Oversold + inflow contradiction"), "_blend": blend})
    tw = F.col("market") == "TW"
    buy, strong = F.when(tw, cfg.conf_buy_tw).otherwise(cfg.conf_buy), F.when(tw, cfg.conf_strong_tw).otherwise(cfg.conf_strong)
    d = d.withColumn("institutional_score", F.when(F.col("_clash").isNotNull(), F.col("_blend") * 0.65).otherwise(F.col("_blend")))
    s, c = F.col("institutional_score"), F.col("confidence_boosted")
    low = c < buy
    return d.withColumns({
        "recommendation": F.when(low, "WATCH").when((s >= 0.45) & F.col("_clash").isNull() & (c >= strong), "STRONG BUY")
        .when(s >= 0.20, "BUY").when(s <= -0.25, "AVOID").otherwise("WATCH"),
        "veto": low | F.col("_clash").isNotNull(), "veto_reason": F.coalesce("_clash", F.when(low, "Low confidence gate"), F.lit("")),
    }).drop("_clash", "_blend")


def entry_grade() -> Column:
    """A / B / C from the columns of a scan row."""
    col = F.col
    tw, rec, stoch, status = F.upper("market") == "TW", F.upper("recommendation"), F.upper("stoch_state"), F.upper("smc_entry_status")
    a_conf, b_conf = F.when(tw, 0.12).otherwise(0.20), F.when(tw, 0.03).otherwise(0.08)
    buys, any_rec = rec.isin("STRONG BUY", "BUY"), rec.isin("STRONG BUY", "BUY", "WATCH")
    flow, calm, s, c = col("qmf_signal") >= 0, stoch != "OVERBOUGHT", col("institutional_score"), col("confidence_boosted")
    a = buys & (c >= a_conf) & flow & calm & (
        ((status == "READY") & (col("smc_entry_score") >= 6) & (s >= 0.25) & (col("wyckoff_score") >= -0.05)) | ((s >= 0.35) & (col("wyckoff_score") >= 0.0)))
    b = any_rec & (c >= b_conf) & flow & (
        (status.isin("READY", "NEAR") & (col("smc_entry_score") >= 5) & (s >= 0.08) & calm) | (s >= 0.12))
    return F.when(col("veto"), "C").when(a, "A").when(b, "B").otherwise("C")


def legacy_grade(explicit: Column | None = None) -> Column:
    """Grade of rows written before grades existed; an explicit A/B/C is kept."""
    s, c, flow = F.col("institutional_score"), F.col("confidence_boosted"), F.col("qmf_signal") >= 0
    g = F.when(F.col("veto"), "C").when(F.upper("recommendation").isin("STRONG BUY", "BUY") & (s >= 0.35) & (c >= 0.20) & flow, "A").when(
        (s >= 0.12) & (c >= 0.08) & flow, "B").otherwise("C")
    return g if explicit is None else F.when(F.upper(F.trim(explicit)).isin("A", "B", "C"), F.upper(F.trim(explicit))).otherwise(g)


def legacy_grade_strict() -> Column:
    """The stricter table backfill: A also needs a sound structure and no overbought oscillator."""
    s, c, rec = F.col("institutional_score"), F.col("confidence_boosted"), F.upper("recommendation")
    ok = ~F.col("veto") & (F.col("qmf_signal") >= 0)
    a = ok & rec.isin("STRONG BUY", "BUY") & (s >= 0.35) & (c >= 0.20) & (F.col("wyckoff_score") >= 0.0) & (F.upper("stoch_state") != "OVERBOUGHT")
    b = ok & rec.isin("STRONG BUY", "BUY", "WATCH") & (s >= 0.12) & (c >= 0.08)
    return F.when(a, "A").when(b, "B").otherwise("C")


def rank_value() -> Column:
    bonus = lookup(F.upper("smc_entry_status"), STATUS_BONUS, 0.0)
    return F.coalesce("institutional_score", F.lit(-999.0)) + bonus + clip(F.coalesce(F.col("smc_entry_score"), F.lit(0)).cast("double"), 0.0, 8.0) * 0.01


def final_rank(rows: DataFrame, n: int = 60) -> DataFrame:
    return rows.withColumn("rank_value", rank_value()).orderBy(F.desc("rank_value"), "symbol").limit(n)


def market_tops(rows: DataFrame, n: int, markets: tuple[str, ...] = ("VN", "TW")) -> DataFrame:
    """Top n of each market by score; partitions are limited before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("market").orderBy(F.desc("institutional_score"), "symbol"))
    return rows.where(F.col("market").isin(*markets)).withColumn("market_rank", rank).where(F.col("market_rank") <= n)


def preset(rows: DataFrame, name: str) -> DataFrame:
    """Scanner presets. The runner preset falls back to looser limits only when nothing passes the strict ones."""
    s, wy, q = F.col("institutional_score"), F.col("wyckoff_score"), F.col("qmf_score")
    if name == "Institutional Balanced":
        return rows.where(F.col("recommendation").isin("STRONG BUY", "BUY") | (s >= 0.08) | ((q >= 0.05) & (wy >= 0.05)))
    if name != "Parabolic Runner (1-3M)":
        return rows
    here, p1, p3, c = F.col("market").isin("VN", "TW"), F.col("pred_21d_ret"), F.col("pred_63d_ret"), F.col("confidence_boosted")
    strict = here & (p1 >= 8.0) & (p3 >= 15.0) & (s >= 0.08) & (wy >= -0.05) & (q >= -0.25) & (c >= 0.06)
    loose = here & (p1 >= 4.0) & (s >= 0.03) & (c >= 0.03)
    hits = rows.agg(F.count_if(strict)).scalar()
    return rows.where(F.when(hits > 0, strict).otherwise(loose))


def composite_rating(rows: DataFrame) -> DataFrame:
    """Weighted 0-100 score of the five normalised parts (0.5 where a part is missing) and its rating."""
    score = sum((F.coalesce(F.col(c), F.lit(0.5)) * w for c, w in COMPOSITE_WEIGHTS.items()), F.lit(0.0)) * 100
    d = rows.withColumn("composite_score", score)
    s = F.col("composite_score")
    return d.withColumn("mid_rating", F.when(s >= 72, MID_RATINGS[0]).when(s >= 60, MID_RATINGS[1]).when(s >= 45, MID_RATINGS[2]).otherwise(MID_RATINGS[3]))


def normalized_parts(fund: Column, coverage: Column, grade: Column, wyckoff: Column, smc: Column, mtf: Column) -> dict[str, Column]:
    return {
        "fund_norm": F.when((coverage < 40) | (grade == "N/A"), 0.5).otherwise(fund / 100.0),
        "wy_smc_norm": clip((wyckoff * 0.6 + smc * 0.4 + 1.0) / 2.0, 0.0, 1.0), "mtf_norm": clip((mtf + 9.0) / 18.0, 0.0, 1.0),
    }


def short_rating(recommendation: Column) -> Column:
    return lookup(recommendation, SHORT_RATINGS, SHORT_NEUTRAL)


def ranks(rows: DataFrame) -> DataFrame:
    """Global, per-market and short-term ranks of a scan table, from one ordering of it.

    Rows are sorted over ranges of (score, symbol), so equal scores are split by symbol. A rank is a row's place among those of its
    group in its range, and the group's sizes in the ranges before; short-term ranks add the groups before. Only a row per range and
    group meets in a task."""
    best_first = [F.desc("composite_score"), F.col("symbol")]
    d = rows.withColumn("_so", lookup(F.col("short_rating"), SHORT_ORDER, 3))
    d = d.repartitionByRange(*best_first).sortWithinPartitions(*best_first).withColumn("_at", F.monotonically_increasing_id())
    d = materialize(d, "ranked")  # the places are written down, so that all that follows reads the same ones
    part = F.shiftright("_at", 33)  # the range; the rest of the number is the place in it
    sizes = materialize(d.groupBy(part.alias("_part"), "market", "_so").agg(F.count(F.lit(1)).alias("_n")), "range_sizes")
    d = d.withColumn("_part", part)

    def placed(d: DataFrame, name: str, group: list[str]) -> DataFrame:
        earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        before = sizes.groupBy(*group, "_part").agg(F.sum("_n").alias("_n")).select(*group, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
        here = F.row_number().over(Window.partitionBy("_part", *group).orderBy("_at")) if group else F.col("_at") - F.shiftleft("_part", 33) + 1
        on = before.withColumnsRenamed({c: f"_{c}" for c in group} | {"_part": "_of"})
        same = F.col("_part") == F.col("_of")
        for c in group:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return d.withColumn("_here", here).join(on, same).withColumn(name, (F.col("_here") + F.col("_before")).cast("long")).drop("_here", "_before", "_of", *[f"_{c}" for c in group])

    d = placed(placed(placed(d, "rank", []), "market_rank", ["market"]), "_in_short", ["_so"])
    classes = Window.orderBy("_so").rowsBetween(Window.unboundedPreceding, -1)
    better = sizes.groupBy("_so").agg(F.sum("_n").alias("_n")).select("_so", F.coalesce(F.sum("_n").over(classes), F.lit(0)).alias("_better"))  # five rows
    d = d.join(better, "_so").withColumn("short_rank", (F.col("_in_short") + F.col("_better")).cast("long"))
    return d.drop("_so", "_at", "_part", "_in_short", "_better")


def position_size(rows: DataFrame, portfolio: float = 1_000_000_000.0, twd_rate: float = 800.0) -> DataFrame:
    """Allocation from ratings, volatility and ATR (columns mid_rating, short_rating, annual_vol_pct, atr_pct,
    last_close, market)."""
    base = lambda c: lookup(F.col(c), BASE_PCT, 0.0)
    d = rows.withColumns({"_mid": base("mid_rating"), "_short": base("short_rating")})
    mid = F.col("_mid") >= F.col("_short")
    pct, mult = F.greatest("_mid", "_short"), lookup(F.when(mid, F.col("mid_rating")).otherwise(F.col("short_rating")), STOP_MULT, 1.0)
    v, none, tw = F.col("annual_vol_pct"), pct == 0, F.col("market") == "TW"
    alloc = F.when(none, 0.0).otherwise(F.least(pct * F.when(v > 80, 0.5).when(v > 60, 0.7).otherwise(1.0), F.when(mid, 40.0).otherwise(25.0)))
    d = d.withColumns({
        "_alloc": alloc, "risk_level": F.when(none, "Avoid").when(v > 80, "High").when(v > 60, "Medium").otherwise("Low"),
        "sizing_basis": F.when(none, "Avoid").when(mid, "Mid-term").otherwise("Short-term"),
        "stop_loss_pct": clip(F.bround(F.col("atr_pct") * mult * 1.5, 2), 3.0, 15.0),
    })
    money = F.lit(portfolio) * (F.col("_alloc") / 100.0)
    unit = F.when(tw, F.col("last_close") * twd_rate).otherwise(F.col("last_close"))
    lot = F.when(tw, 1).otherwise(100)
    shares = F.when(F.col("last_close") > 0, F.floor(F.floor(F.try_divide(money, unit)) / lot) * lot).otherwise(0)
    return d.withColumns({
        "allocation_pct": F.bround("_alloc", 1), "amount_million": F.bround(money / 1_000_000, 1), "shares": shares.cast("long"),
    }).drop("_mid", "_short", "_alloc")


def entry_stop_target(rows: DataFrame) -> DataFrame:
    """Entry, stop, target and reward:risk with fallbacks and clamps."""
    g = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    lo, hi, stop, tgt = g("smc_entry_low"), g("smc_entry_high"), g("smc_entry_stop"), g("smc_entry_target")
    zone = F.upper("smc_entry_status").isin("READY", "NEAR") & (lo > 0) & (hi > lo) & (stop > 0) & (tgt > hi)
    d = rows.withColumn("_e", F.when(g("last_close") > 0, g("last_close")).otherwise(F.greatest(g("ai_target_1d"), F.lit(0.01))))
    e = F.col("_e")
    t0 = F.when(g("wyckoff_target") > 0, g("wyckoff_target")).otherwise(e * (g("pred_63d_ret") / 100.0 + 1.0))
    d = d.withColumn("_t", F.when(t0 > 0, t0).otherwise(e))
    conf = g("confidence_boosted")
    pct = F.when(conf >= 0.25, 0.05).when(conf < 0.15, 0.07).otherwise(0.06)
    pct = F.when(F.coalesce("qmf_signal", F.lit(0)) < 0, F.least(pct + 0.01, F.lit(0.09))).otherwise(pct)
    raw = F.when((g("wyckoff_rr") > 0) & (F.col("_t") > e), e - F.try_divide(F.col("_t") - e, g("wyckoff_rr"))).otherwise(e * (1.0 - pct))
    floor_ = F.greatest(raw, F.lit(0.01))
    d = d.withColumn("_s", F.when(floor_ >= e, e * 0.95).otherwise(floor_))
    d = d.withColumn("_t", F.when(F.col("_t") <= e, e * (F.greatest(g("pred_63d_ret"), F.lit(5.0)) / 100.0 + 1.0)).otherwise(F.col("_t")))
    zone_rr = F.when(g("smc_entry_rr") > 0, g("smc_entry_rr")).otherwise((tgt - hi) / F.greatest(hi - stop, F.lit(1e-9)))
    return d.withColumns({
        "entry": F.when(zone, (lo + hi) / 2.0).otherwise(e), "stop_loss": F.when(zone, stop).otherwise(F.col("_s")),
        "target": F.when(zone, tgt).otherwise(F.col("_t")),
        "reward_risk": F.when(zone, zone_rr).otherwise((F.col("_t") - e) / F.greatest(e - F.col("_s"), F.lit(1e-9))),
    }).drop("_e", "_t", "_s")


def trade_plan(rows: DataFrame) -> DataFrame:
    """Simple plan from the bias: stop, goal, reward:risk and phases."""
    p, bias = F.col("last_close"), F.col("ai_bias")
    goal = F.when(F.col("wyckoff_target") > 0, F.greatest("ai_target", "wyckoff_target")).otherwise(F.col("ai_target"))
    stop = F.when(bias == "Bullish", p * 0.96).when(bias == "Bearish", p * 1.04).otherwise(p * 0.95)
    rr = F.when((bias == "Bullish") & (p > stop), F.try_divide(goal - p, p - stop)).when((bias == "Bearish") & (stop > p), F.try_divide(p - goal, stop - p)).otherwise(0.0)
    r2 = lambda c: F.bround(c, 2)
    return rows.withColumns({
        "plan_stop": r2(stop), "plan_goal": r2(goal), "plan_rr": r2(rr), "phase_0": r2(p), "phase_1": r2(F.when(bias == "Bullish", p * 1.02).otherwise(p * 0.98)), "phase_2": r2(goal),
    })


def buy_alerts(rows: DataFrame, n: int = 10) -> DataFrame:
    """High-quality zone alerts, best first."""
    status = F.upper("smc_entry_status")
    ok = (
        status.isin("READY", "NEAR") & ~F.coalesce("veto", F.lit(False)) & F.upper("market").isin("VN", "TW") & (F.col("smc_entry_score") >= 6)
        & (F.col("smc_entry_rr") >= 1.4) & ~((status == "NEAR") & (F.col("smc_entry_distance_pct") > 1.5)) & (F.col("qmf_signal") >= 0)
        & (F.upper("stoch_state") != "OVERBOUGHT") & (F.col("institutional_score") >= 0.05)
    )
    return rows.where(ok).orderBy(lookup(status, STATUS_RANK, 9), F.desc("smc_entry_score"), F.desc("institutional_score"), "smc_entry_distance_pct", "symbol").limit(n)


def alert_key() -> Column:
    money = lambda c: F.format_string("%.2f", F.bround(F.coalesce(F.col(c), F.lit(0.0)), 2))
    return F.concat_ws("|", F.upper("market"), F.upper("symbol"), F.upper("smc_entry_status"), F.upper("smc_entry_type"), F.concat_ws("-", money("smc_entry_low"), money("smc_entry_high")))


def consensus(rows: DataFrame) -> DataFrame:
    """Final grade and action of grade-A rows from the Elliott tag and fundamental grade."""
    tag = F.col("elliott_tag")
    action = F.when(tag == "CAUTION_WAVE5", "WATCH_PULLBACK").when(tag == "STRATEGIC_ONLY", "WATCH_CONFIRM").when(tag.isin("NO_DATA", "ERROR"), "WATCH_RISK").otherwise("BUY")
    return rows.withColumns({
        "entry_grade_final": F.when(tag.isin("CAUTION_WAVE5", "STRATEGIC_ONLY"), "B").otherwise("A"),
        "consensus_action": F.when(F.col("fundamental_grade").isin("D", "F"), "REDUCE_RISK").otherwise(action),
    })


def hidden_gems(rows: DataFrame, market: str = "TW", n: int = 5) -> DataFrame:
    """Under-the-radar rows of a market; a watch list by confidence when there is none."""
    base = (F.upper("market") == market) & F.col("entry_quality_grade").isin("A", "B") & ~F.col("veto") & (F.upper("stoch_state") != "OVERBOUGHT") & (F.col("qmf_signal") >= 0)
    s = F.col("institutional_score")
    gem = base & s.between(0.12, 0.85) & (F.col("confidence_boosted") >= 0.03) & (F.col("pred_63d_ret") >= 12.0)
    hits = rows.agg(F.count_if(gem)).scalar()
    d = rows.where(base).withColumn("_gem", hits > 0).where(~F.col("_gem") | gem)
    first = F.when(F.col("_gem"), F.col("pred_63d_ret")).otherwise(F.col("confidence_boosted"))
    return d.withColumn("pick_kind", F.when(F.col("_gem"), "GEM").otherwise("WATCH")).orderBy(first.desc(), s.desc(), "symbol").limit(n).drop("_gem")


def report_tips(rows: DataFrame) -> DataFrame:
    """Up to three report tips from grade, data and veto shares (one row)."""
    core = (F.coalesce("last_close", F.lit(0.0)) <= 0) | (F.coalesce("institutional_score", F.lit(0.0)) == 0.0)
    d = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("entry_quality_grade") == "A").alias("a"), F.count_if(F.col("entry_quality_grade") == "C").alias("c"),
        F.count_if(core).alias("gaps"), F.count_if(F.coalesce("veto", F.lit(False))).alias("vetoed"))
    n = F.col("n")
    tips = F.array_compact(F.array(
        F.when(F.col("a") <= 2, TIPS[0]), F.when(F.col("c") / F.greatest(n, F.lit(1)) >= 0.50, TIPS[1]),
        F.when(F.col("gaps") > 0, F.concat(F.lit("Có "), F.col("gaps").cast("string"), F.lit(" mã thiếu dữ liệu lõi; cần kiểm tra cache/API trước giờ mở cửa."))),
        F.when(F.col("vetoed") >= F.greatest(F.lit(3), F.floor(n * 0.25)), TIPS[2]),
    ))
    return d.select("n", F.when(n == 0, F.array(F.lit(TIPS[4]))).when(F.size(tips) == 0, F.array(F.lit(TIPS[3]))).otherwise(F.slice(tips, 1, 3)).alias("tips"))


def grade_counts(rows: DataFrame) -> DataFrame:
    """Counts by market and grade with subtotals."""
    return rows.rollup("market", "entry_quality_grade").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("veto")).alias("vetoed"), F.count_if(F.col("recommendation").isin("STRONG BUY", "BUY")).alias("buys"))


def sector_strength(rows: DataFrame, n: int = 20) -> DataFrame:
    return rows.groupBy("sector").agg(F.avg("rs_score").alias("avg_rs"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("avg_rs"), "sector").limit(n)


def price_text(price: Column, symbol: Column, market: Column) -> Column:
    s, m, num = F.upper(symbol), F.upper(market), F.format_number(price, 2)
    tw = s.endswith(".TW") | s.endswith(".TWO") | m.isin("TW", "TAIWAN")
    vn = s.endswith(".VN") | m.isin("VN", "VIETNAM", "VN_STOCK")
    return F.when(tw, F.concat(num, F.lit(" NTD"))).when(vn, F.concat(num, F.lit(" VND"))).otherwise(F.concat(F.lit("$"), num))


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def pick_line(rank: Column) -> Column:
    return F.format_string("%d. <b>%s</b> | %s | inst=%.3f | 1M=%+.1f%% | 3M=%+.1f%%", rank.cast("int"), html_escape(F.col("symbol")), "recommendation", "institutional_score", "pred_21d_ret", "pred_63d_ret")


def zone_text() -> Column:
    status, lo, hi = F.upper("smc_entry_status"), F.col("smc_entry_low"), F.col("smc_entry_high")
    full = F.format_string("SMC:%s %s %.2f-%.2f (%d/8, %.1f%%)", status, F.col("smc_entry_type"), lo, hi, F.col("smc_entry_score").cast("int"), F.col("smc_entry_distance_pct"))
    part = F.format_string("SMC:%s %s (%d/8)", status, F.col("smc_entry_type"), F.col("smc_entry_score").cast("int"))
    return F.when(~status.isin("READY", "NEAR", "WATCH"), "SMC:NONE").when((lo > 0) & (hi > lo), full).otherwise(part)


# ---- entry candidates from structure zones -----------------------------------------------------------


def zone_context(state: DataFrame, bars: DataFrame, wyckoff: DataFrame) -> DataFrame:
    """Structure state joined with swing/fib levels, profile levels, the Wyckoff phase and strict ATR:
    one row per symbol, so every join is between dimension-sized tables."""
    from tickloom.operators.indicators import add_atr

    swing = tail(bars, 120).groupBy("symbol").agg(F.max("high").alias("_sh"), F.min("low").alias("_sl"))
    vp = volume_profile(bars).select("symbol", F.array("poc", "vah", "val").alias("vp_levels"))
    fast = profile_levels(bars).select("symbol", F.col("levels").alias("fast_levels"))
    atr = at_last(bars, lambda d, f: add_atr(d, f, 14, 14, "_a"), 16).select("symbol", F.coalesce(F.when(F.col("_a") > 0, F.col("_a")), F.col("close") * 0.02).alias("atr_radar"))
    d = state.join(swing, "symbol").join(vp, "symbol", "left").join(fast, "symbol", "left").join(atr, "symbol").join(wyckoff.select("symbol", F.upper("phase").alias("_phase")), "symbol", "left")
    fib = lambda *rs: F.when(F.col("_sh") > F.col("_sl"), F.array(*[F.col("_sh") - (F.col("_sh") - F.col("_sl")) * r for r in rs])).otherwise(F.array().cast("array<double>"))
    words = lambda *ws: truthy(F.col("_phase").rlike("|".join(ws)))
    empty = F.array().cast("array<double>")
    return d.withColumns({
        "fib_3": fib(0.382, 0.5, 0.618), "fib_4": fib(0.236, 0.382, 0.5, 0.618), "vp_levels": F.coalesce("vp_levels", empty), "fast_levels": F.coalesce("fast_levels", empty),
        "wyckoff_ok": words("PHASE B", "PHASE C", "PHASE D", "ACCUMULATION", "MARKUP"),
    }).drop("_sh", "_sl", "_phase")


def _zone_rows(ctx: DataFrame) -> DataFrame:
    d = ctx.withColumn("_z", F.explode("zones"))
    return d.withColumns({"kind": F.col("_z.kind"), "direction": F.col("_z.direction"), "top": F.col("_z.top"), "bottom": F.col("_z.bottom"), "weight": F.col("_z.weight"), "born": F.col("_z.bar_no"), "seq": F.col("_z.seq")}).drop("_z")


def _gap_to(price: Column, top: Column, bottom: Column) -> Column:
    return F.when(price > top, (price - top) / price).when(price < bottom, (bottom - price) / price).otherwise(0.0)


def _points(rules: list[tuple[Column, str]]) -> tuple[Column, Column]:
    score = sum((F.when(c, 1).otherwise(0) for c, _ in rules), F.lit(0))
    return score, F.concat_ws(",", *[F.when(c, F.lit(t)) for c, t in rules])


def scan_entry(ctx: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Best bullish zone per symbol within 18 % of the price: nine-factor score, stop, target, status."""
    d = _zone_rows(ctx).where((F.col("direction") == "Bullish") & (F.col("bottom") > 0) & (F.col("top") > F.col("bottom")))
    d = d.join(targets.select("symbol", "target_price"), "symbol", "left") if targets is not None else d.withColumn("target_price", F.lit(0.0))
    p, top, bottom = F.col("current_price"), F.col("top"), F.col("bottom")
    width = top - bottom
    d = d.where((p > 0) & (F.abs((top + bottom) / 2.0 - p) / p <= 0.18)).withColumn("_d", _gap_to(p, top, bottom))
    near = lambda levels: band_exists(F.col(levels), bottom, top, width)
    score, factors = _points([
        (F.lit(True), "ZONE"), (F.col("weight") >= 0.35, "ZONE_QUALITY"), (F.col("stoch_status") != "OVERBOUGHT", "STOCH_OK"), (F.bround("stoch_k", 1) <= 35, "OVERSOLD"),
        (near("fast_levels"), "VOL_NODE"), (near("fib_3"), "FIB"), (F.col("wyckoff_ok"), "WYCKOFF"), (F.col("smc_sweep_bull") | F.col("smc_idm_bull"), "LIQ_SWEEP"), (F.col("smc_signal") >= 0, "SMC_SIGNAL")])
    stop = F.greatest(F.lit(0.01), bottom - F.greatest(width * 0.35, p * 0.015))
    d = d.withColumns({"_score": score, "_factors": factors, "_stop": stop}).withColumn("_risk", F.greatest(top - F.col("_stop"), p * 0.01))
    d = d.withColumn("_target", F.greatest(top + F.col("_risk") * 2.0, F.coalesce("target_price", F.lit(0.0)), p * 1.05))
    inside = p.between(bottom, top)
    d = d.withColumns({
        "_rr": (F.col("_target") - top) / F.col("_risk"),
        "_status": F.when(inside & (F.col("_score") >= 5), "READY").when((F.col("_d") <= 0.02) & (F.col("_score") >= 4), "NEAR").when(F.col("_score") >= 4, "WATCH").otherwise("WAIT"),
    })
    out = F.struct(
        F.col("_status").alias("smc_entry_status"), F.col("kind").alias("smc_entry_type"), bottom.alias("smc_entry_low"), top.alias("smc_entry_high"), F.col("_stop").alias("smc_entry_stop"),
        F.col("_target").alias("smc_entry_target"), F.col("_rr").alias("smc_entry_rr"), F.least("_score", F.lit(8)).alias("smc_entry_score"), (F.col("_d") * 100.0).alias("smc_entry_distance_pct"), F.col("_factors").alias("smc_entry_factors"))
    order = F.struct(lookup(F.col("_status"), STATUS_RANK, 9), -F.least("_score", F.lit(8)), F.col("_d"), -F.col("_rr"), F.col("kind"), F.col("seq"))
    best = d.groupBy("symbol").agg(F.min_by(out, order).alias("_b")).select("symbol", "_b.*")
    return ctx.select("symbol").join(best, "symbol", "left").fillna({"smc_entry_status": "NONE", "smc_entry_type": "", "smc_entry_score": 0, "smc_entry_factors": ""}).fillna(
        0.0, [c for c in best.columns if c.startswith("smc_entry_") and c.split("_")[-1] in ("low", "high", "stop", "target", "rr", "pct")])


def execution_gate(rows: DataFrame) -> DataFrame:
    """Daily / H4 / H1 / trigger booleans from (daily_bias, health, available, actionable, smc flags)."""
    health, bias = F.upper(F.coalesce("health", F.lit(""))), F.upper(F.coalesce("daily_bias", F.lit("")))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    d = rows.withColumns({
        "daily_bullish": bias.contains("BULLISH"), "h4_bullish": health.contains("STRONG BUY") | health.contains("BULL FLAG") | health.contains("BULLISH"),
        "h1_actionable": yes("available") & yes("actionable"),
        "bullish_trigger": (F.col("smc_signal") > 0) & (yes("stoch_crossover") | yes("smc_bos_bull") | yes("smc_sweep_bull") | yes("smc_idm_bull")),
    })
    d = d.withColumn("mtf_confirmed", F.col("daily_bullish") & F.col("h4_bullish") & ~health.contains("REBOUND"))
    return d.withColumn("buy_triggered", F.col("mtf_confirmed") & F.col("h1_actionable") & F.col("bullish_trigger"))


def entry_radar(ctx: DataFrame, gate: DataFrame | None = None) -> DataFrame:
    """Ranked fresh tactical slices of the bullish zones with bounded width, age, fill and risk."""
    d = _zone_rows(ctx).where((F.col("direction") == "Bullish") & (F.col("bottom") > 0) & (F.col("bottom") < F.col("top")))
    flags = ("buy_triggered", "mtf_confirmed", "h1_actionable")
    d = d.join(gate.select("symbol", *flags), "symbol", "left") if gate is not None else d.withColumns({f: F.lit(False) for f in flags})
    p, atr, top = F.col("current_price"), F.col("atr_radar"), F.col("top")
    d = d.withColumns({
        "entry_low": F.greatest("bottom", top - F.least(p * 0.03, atr * 2.0)), "age_bars": F.greatest(F.lit(0), F.col("n_bars") - 1 - F.col("born")),
        "filled_pct": F.when(F.col("kind") == "FVG", F.lit(1.0) - F.col("weight")).otherwise(0.0),
    })
    low = F.col("entry_low")
    width = top - low
    d = d.where((p > 0) & (F.col("age_bars") <= 40) & (F.col("filled_pct") < 0.85)).withColumn("_d", _gap_to(p, top, low)).where(F.col("_d") <= 0.18)
    near = lambda levels: band_exists(F.col(levels), low, top, width)
    score, factors = _points([
        (F.lit(True), "ZONE"), (F.col("stoch_status") != "OVERBOUGHT", "STOCH_OK"), (F.bround("stoch_k", 1) <= 35, "OVERSOLD"), (near("vp_levels"), "VOL_PROFILE"), (near("fib_3"), "FIB"),
        (F.col("wyckoff_ok"), "WYCKOFF"), (F.col("smc_sweep_bull") | F.col("smc_idm_bull"), "LIQ_SWEEP"), (F.col("smc_signal") > 0, "SMC_SIGNAL")])
    d = d.withColumns({"_score": score, "factors": factors, "stop": F.greatest(F.lit(0.01), low - F.greatest(width * 0.20, atr * 0.35, p * 0.0075))})
    risk = top - F.col("stop")
    d = d.where((risk > 0) & (risk / top <= 0.065))
    inside, yes = p.between(low, top), lambda c: F.coalesce(F.col(c), F.lit(False))
    touch, s = inside | (F.col("_d") <= 0.005), F.col("_score")
    status = (
        F.when(touch & (s >= 5) & yes("buy_triggered"), "BUY_TRIGGERED").when(touch & (s >= 5) & yes("mtf_confirmed") & yes("h1_actionable"), "SETUP_READY")
        .when(inside & (s >= 4), "ZONE_TOUCH").when((F.col("_d") <= 0.02) & (s >= 4), "NEAR_ZONE").when(s >= 4, "WATCH").otherwise("WAIT"))
    order = {k: i for i, k in enumerate(("BUY_TRIGGERED", "SETUP_READY", "ZONE_TOUCH", "NEAR_ZONE", "WATCH", "WAIT"))}
    d = d.withColumns({"status": status, "score": F.least("_score", F.lit(8)), "target": top + risk * 2.0, "distance_pct": F.col("_d") * 100.0, "width_atr": width / atr})
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(lookup(F.col("status"), order, 9), F.desc("score"), "distance_pct", "age_bars", "kind", "seq"))
    return d.select("symbol", rank.alias("zone_rank"), "status", "kind", "entry_low", top.alias("entry_high"), F.col("bottom").alias("source_low"), "stop", "target", "score", "distance_pct", inside.alias("inside"), "age_bars", "filled_pct", "width_atr", "factors")


def smart_entries(ctx: DataFrame, n: int = 8) -> DataFrame:
    """Six-factor table of all zones within 20 % of the price, best first."""
    d = _zone_rows(ctx)
    p, top, bottom, bull = F.col("current_price"), F.col("top"), F.col("bottom"), F.col("direction") == "Bullish"
    dist = F.when(p > 0, F.abs((top + bottom) / 2 - p) / p).otherwise(1.0)
    margin = F.greatest((top - bottom) * 0.5, p * 0.01)
    near = lambda levels: band_exists(F.col(levels), bottom, top, margin)
    grab = F.when(bull, F.col("smc_idm_bull") | F.col("smc_sweep_bull")).otherwise(F.col("smc_idm_bear") | F.col("smc_sweep_bear"))
    score, factors = _points([
        (F.lit(True), "ZONE"), (F.when(bull, F.col("stoch_status") != "OVERBOUGHT").otherwise(F.col("stoch_status") != "OVERSOLD"), "STOCH"),
        (near("vp_levels"), "VOL"), (near("fib_4"), "FIB"), (bull == F.col("wyckoff_ok"), "WYK"), (grab, "IDM")])
    d = d.withColumns({"score": score, "factors": factors, "proximity": F.bround(dist * 100, 1), "_dist": dist}).where(F.col("_dist") <= 0.20)
    s, side = F.col("score"), F.when(bull, "BUY").otherwise("SELL")
    d = d.withColumn("action", F.when(s >= 4, F.concat(F.lit("STRONG "), side)).when(s >= 3, side).when(s >= 2, "WATCH").otherwise("SKIP"))
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("score"), "proximity", "kind", "direction", "seq"))
    return d.withColumn("_rank", rank).where(F.col("_rank") <= n).select("symbol", F.col("_rank").alias("zone_rank"), "kind", "direction", "top", "bottom", "score", "factors", "proximity", "action")


def universe_scan(bars: DataFrame, bench: DataFrame, forecasts: DataFrame, structure: DataFrame, wyckoff: DataFrame, cfg: ScanSettings = ScanSettings()) -> DataFrame:
    """The whole scan: tier-1 price action, prefilter, deep scores for the survivors, entry candidates,
    grade and rank. ``forecasts`` has (symbol, pred_21d_ret_raw, pred_63d_ret_raw, ai_confidence);
    ``structure`` and ``wyckoff`` are the snapshots of those operators. No partial results."""
    from tickloom.operators.context import price_action
    from tickloom.operators.flow import quant_money_flow
    from tickloom.operators.indicators import volatility

    # cut where several branches go on: a few rows, and the bars of these few symbols that deep scores reach back to
    survivors = materialize(prefilter(tier_filter(tier1(price_action(bars, bench), bars), cfg), quick_phase(bars), cfg), "survivors")
    deep = materialize(bars.where(F.col("n_bars") >= 80).join(survivors.select("symbol"), "symbol", "left_semi"), "deep_bars")
    structure, wyckoff = (materialize(t.join(survivors.select("symbol"), "symbol", "left_semi"), n) for t, n in ((structure, "deep_structure"), (wyckoff, "deep_phases")))
    last = F.col("bar_no") == F.col("n_bars") - 1
    qmf = quant_money_flow(tail(deep, 60)).where(last).select("symbol", "qmf_score", "qmf_signal")
    vol = volatility(tail(deep, 60)).where(last).select("symbol", F.col("ret_std").alias("daily_vol"))
    d = survivors.join(qmf, "symbol").join(vol, "symbol").join(forecasts, "symbol", "left").fillna({"pred_21d_ret_raw": 0.0, "pred_63d_ret_raw": 0.0, "ai_confidence": 0.0})
    d = d.join(structure.select("symbol", "smc_score", "smc_structure", "stoch_k", "stoch_d"), "symbol").join(
        wyckoff.select("symbol", F.col("phase").alias("wyckoff_phase"), F.col("score").alias("wyckoff_score"), F.col("target").alias("wyckoff_target"), F.col("rr").alias("wyckoff_rr")), "symbol")
    d = institutional_score(d, cfg).join(scan_entry(zone_context(structure, deep, wyckoff)), "symbol", "left")
    return final_rank(d.withColumn("entry_quality_grade", entry_grade()), cfg.final_top)
