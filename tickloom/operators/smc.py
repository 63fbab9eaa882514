"""Price-structure zones, breaks, sweeps, retest entries and their composite signal.

Every step is relational: swings and gaps are block windows, "first bar that breaks the level" is a
minimum per segment, "was the zone entered later" is a suffix extreme read at one row. Retest bars are
claimed in ``retests``. Only the first prices of equal levels are found one after the other, among distinct prices.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import SmcSettings
from tickloom.functions.series import Frame, index_bars, is_last, per_block, running, running_from_end
from tickloom.operators import retests
from tickloom.operators.clean import missing, neutral
from tickloom.operators.indicators import add_atr, add_stochastic, clip, truthy
from tickloom.session import materialize

SWING = 3
ZONE = ["symbol", "direction", "top", "bottom", "bar_no", "ts"]


def keep_newest(zones: DataFrame, n: int, order: str) -> DataFrame:
    """Newest ``n`` zones per symbol and direction; limited per partition before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("symbol", "direction").orderBy(F.desc(order)))
    return zones.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def add_swings(d: DataFrame, f: Frame) -> DataFrame:
    inner = (F.col("bar_no") >= SWING) & (F.col("bar_no") < F.col("n_bars") - SWING)
    around = f.rows(-SWING, SWING)
    high = (F.col("high") == F.max("high").over(around)) & (F.col("high") > f.lag("high")) & (F.col("high") > f.lead("high"))
    low = (F.col("low") == F.min("low").over(around)) & (F.col("low") < f.lag("low")) & (F.col("low") < f.lead("low"))
    return d.withColumns({"swing_high": inner & truthy(high), "swing_low": inner & truthy(low)})


def swings(bars: DataFrame) -> DataFrame:
    return per_block(bars, add_swings, lookback=SWING, lookahead=SWING)


def order_blocks(bars: DataFrame, cfg: SmcSettings = SmcSettings(), keep: int | None = None) -> DataFrame:
    """Last opposite candle within three bars of an impulse of 1.5 ATR, when no bar up to the impulse has
    traded back into it. ``keep`` newest per side (all of them with 0)."""
    d = per_block(bars.where(F.col("n_bars") >= 20), lambda d, f: add_impulse(d, f, cfg), lookback=16)
    return _order_blocks(d, cfg, keep)


def add_impulse(d: DataFrame, f: Frame, cfg: SmcSettings) -> DataFrame:
    d = add_atr(d, f)
    d = d.withColumn("_move", F.col("close") - f.lag("close"))
    back = {}
    for k in range(1, cfg.ob_lookback + 1):
        back[f"_c{k}"] = f.lag(F.struct("open", "high", "low", "close", "bar_no", "ts"), k)
        back[f"_lo{k}"] = F.min("low").over(f.rows(-(k - 1), 0))
        back[f"_hi{k}"] = F.max("high").over(f.rows(-(k - 1), 0))
    return d.withColumns(back)


def _order_blocks(d: DataFrame, cfg: SmcSettings, keep: int | None = None) -> DataFrame:
    d = d.where(F.col("n_bars") >= 20).where((F.col("bar_no") >= 5) & (F.col("bar_no") <= F.col("n_bars") - 2))
    limit = F.col("atr") * cfg.impulse_multiplier

    def side(direction: str, move: Column, opposite: Callable[[Column], Column], entered: Callable[[int, Column], Column]) -> DataFrame:
        pick = None
        for k in range(1, cfg.ob_lookback + 1):
            c = F.col(f"_c{k}")
            value = F.struct(c["high"].alias("top"), c["low"].alias("bottom"), c["bar_no"].alias("bar_no"), c["ts"].alias("ts"), entered(k, c).alias("mitigated"))
            pick = F.when(opposite(c), value) if pick is None else pick.when(opposite(c), value)
        return d.where(move >= limit).select(
            "symbol", F.lit(direction).alias("direction"), pick.alias("_z"), F.col("bar_no").alias("impulse_no"),
            F.least(F.coalesce(F.try_divide(move, limit), F.lit(1.0)), F.lit(1.0)).alias("strength"),
        ).where(F.col("_z").isNotNull()).select("symbol", "direction", "_z.*", "strength", "impulse_no")

    bull = side("Bullish", F.col("_move"), lambda c: c["close"] < c["open"], lambda k, c: F.col(f"_lo{k}") <= c["high"])
    bear = side("Bearish", -F.col("_move"), lambda c: c["close"] > c["open"], lambda k, c: F.col(f"_hi{k}") >= c["low"])
    zones = bull.unionByName(bear).where(~F.col("mitigated")).drop("mitigated")
    keep = cfg.ob_max_zones if keep is None else keep
    return keep_newest(zones, keep, "impulse_no") if keep else zones


def later_extremes(bars: DataFrame) -> DataFrame:
    """Lowest low, highest high, highest and lowest close over all bars after each bar."""
    d = running_from_end(bars, {"_ll": ("min", "low"), "_hh": ("max", "high"), "_hc": ("max", "close"), "_lc": ("min", "close")})
    out = {"later_low": "_ll", "later_high": "_hh", "later_close_max": "_hc", "later_close_min": "_lc"}
    return per_block(d, lambda d, f: d.withColumns({k: f.lead(v) for k, v in out.items()}), lookahead=1).drop(*out.values())


def fair_value_gaps(bars: DataFrame, cfg: SmcSettings = SmcSettings(), keep: int | None = None) -> DataFrame:
    """Three-bar gaps of at least 0.2 % of price with the share that later bars have filled; the newest
    under 90 % filled per side (every gap with ``keep=0``). ``born_no`` is the third bar."""
    return _gaps(per_block(later_extremes(bars.where(F.col("n_bars") >= 5)), add_gap_lags, lookback=2), cfg, keep)


def add_gap_lags(d: DataFrame, f: Frame) -> DataFrame:
    return d.withColumns({"_h2": f.lag("high", 2), "_l2": f.lag("low", 2), "_ts1": f.lag("ts")})


def _gaps(d: DataFrame, cfg: SmcSettings, keep: int | None = None) -> DataFrame:
    d = d.where(F.col("n_bars") >= 5)
    up = F.col("low") > F.col("_h2")
    top, bottom = F.when(up, F.col("low")).otherwise(F.col("_l2")), F.when(up, F.col("_h2")).otherwise(F.col("high"))
    gaps = d.where(truthy(up) | truthy(F.col("high") < F.col("_l2"))).withColumns({"top": top, "bottom": bottom})
    gaps = gaps.where(F.try_divide(F.col("top") - F.col("bottom"), F.col("close")) >= cfg.fvg_min_size_pct)
    depth = F.when(up, F.col("top") - F.col("later_low")).otherwise(F.col("later_high") - F.col("bottom"))
    filled = clip(F.coalesce(F.try_divide(depth, F.col("top") - F.col("bottom")), F.lit(0.0)), 0.0, 1.0)
    zones = gaps.select(
        "symbol", F.when(up, "Bullish").otherwise("Bearish").alias("direction"), "top", "bottom",
        (F.col("bar_no") - 1).alias("bar_no"), F.col("_ts1").alias("ts"), filled.alias("filled_pct"), F.col("bar_no").alias("born_no"),
    )
    keep = cfg.fvg_max_zones if keep is None else keep
    return keep_newest(zones.where(F.col("filled_pct") < cfg.fvg_fill_threshold), keep, "born_no") if keep else zones


def _first_prices(tol: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Distinct swing prices come sorted by (symbol, direction, first bar); those that no earlier kept price has within ``tol`` are kept.
    Kept prices lie that far apart, so what is held is bounded by the range of prices, not by the number of swings."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, kept = None, []
        for pdf in batches:
            keep = []
            for symbol, side, price in zip(pdf["symbol"], pdf["direction"], pdf["price"].tolist()):
                if (symbol, side) != group:
                    group, kept = (symbol, side), []
                lo, hi = bisect_left(kept, price / (1 + tol) * (1 - 1e-9)), bisect_right(kept, price / (1 - tol) * (1 + 1e-9))
                fresh = not any(abs(price - s) / s <= tol for s in kept[lo:hi])
                if fresh:
                    insort(kept, price)
                keep.append(fresh)
            yield pdf[keep]

    return scan


def equal_levels(points: DataFrame, tol: float) -> DataFrame:
    """First-come clusters of swing prices (symbol, direction, bar_no, price): the first free swing takes all later free ones within
    ``tol`` of its price. (symbol, direction, level, touches, bar_no, first_no) of clusters of two or more.

    A swing belongs to the first cluster near it, so the clusters' first prices settle all. They are found among distinct prices, one
    short row each; every swing then looks up the few first prices in its own narrow price cell."""
    prices = points.groupBy("symbol", "direction", "price").agg(F.min("bar_no").alias("first_no"))
    firsts = prices.repartition("symbol", "direction").sortWithinPartitions("symbol", "direction", "first_no").mapInPandas(_first_prices(tol), prices.schema)
    cell = lambda c: F.floor(F.log(c) / math.log1p(tol)).cast("long")
    p = F.col("price")
    firsts = firsts.select("symbol", "direction", p.alias("_p"), "first_no", F.explode(F.sequence(cell(p * (1 - tol) * (1 - 1e-9)), cell(p * (1 + tol) * (1 + 1e-9)))).alias("_cell"))
    near = (F.abs(p - F.col("_p")) / F.col("_p") <= tol) & (F.col("first_no") <= F.col("bar_no"))
    d = points.withColumn("_cell", cell(p)).join(firsts, ["symbol", "direction", "_cell"]).where(near)
    d = d.groupBy("symbol", "direction", "bar_no", "price").agg(F.min("first_no").alias("first_no"))
    return d.groupBy("symbol", "direction", "first_no").agg(F.avg("price").alias("level"), F.count(F.lit(1)).cast("int").alias("touches"), F.max("bar_no").alias("bar_no")).where("touches >= 2")


def liquidity_pools(bars: DataFrame, cfg: SmcSettings = SmcSettings(), keep: int | None = None) -> DataFrame:
    """Clusters of at least two equal swing highs (Buy-side) or lows (Sell-side) that no later close has
    crossed, with a flag when the newest bar pierces the level and closes back."""
    s = per_block(later_extremes(bars.where(F.col("n_bars") >= 20)), add_swings, lookback=SWING, lookahead=SWING)
    return _pools(s, cfg, keep)


def _pools(s: DataFrame, cfg: SmcSettings, keep: int | None = None) -> DataFrame:
    s = s.where(F.col("n_bars") >= 20)
    pick = lambda flag, side, price: s.where(flag).select("symbol", F.lit(side).alias("direction"), "bar_no", F.col(price).alias("price"))
    points = pick(F.col("swing_high"), "Buy-side", "high").unionByName(pick(F.col("swing_low"), "Sell-side", "low"))
    pools = equal_levels(points.where("price > 0"), cfg.liq_tolerance_pct / 100.0)
    later = s.select("symbol", "bar_no", "ts", "later_close_max", "later_close_min")
    newest = s.where(is_last()).select("symbol", F.col("high").alias("_h"), F.col("low").alias("_l"), F.col("close").alias("_c"), (F.col("n_bars") - 1).alias("_end"))
    d = pools.join(later, ["symbol", "bar_no"]).join(newest, "symbol")
    buy, lv = F.col("direction") == "Buy-side", F.col("level")
    swept = F.when(buy, F.col("later_close_max") > lv).otherwise(F.col("later_close_min") < lv)
    event = F.when(buy, (F.col("_h") > lv) & (lv > F.col("_c"))).otherwise(
        (F.col("bar_no") < F.col("_end")) & (F.col("_l") < lv) & (lv < F.col("_c")))
    d = d.withColumn("is_sweep_event", event).where(~truthy(swept))
    d = d.select("symbol", "direction", "level", "touches", "bar_no", "ts", "is_sweep_event", "first_no")
    keep = cfg.liq_max_pools if keep is None else keep
    return keep_newest(d, keep, "first_no") if keep else d


def add_levels(d: DataFrame, f: Frame, mode: str) -> DataFrame:
    """Swing levels as the break logic sees them: at the swing bar (reference) or three bars later
    (causal), and lagged by one bar more for inducement and sweeps (from the fifth bar on)."""
    shift = SWING if mode == "causal" else 0
    flag = (lambda c: F.coalesce(f.lag(c, shift), F.lit(False))) if shift else F.col
    price = (lambda c: f.lag(c, shift)) if shift else F.col
    late = lambda c: F.coalesce(f.lag(c, 1 + shift), F.lit(False)) & (F.col("bar_no") >= 5)
    return d.withColumns({
        "_sh": F.when(flag("swing_high"), price("high")), "_sl": F.when(flag("swing_low"), price("low")),
        "_mh": F.when(late("swing_high"), f.lag("high", 1 + shift)), "_ml": F.when(late("swing_low"), f.lag("low", 1 + shift)),
    })


def market_structure(bars: DataFrame, mode: str = "reference", cut: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """Structure breaks (continuation / change of character), inducement and sweep flags, structure label.

    ``mode="reference"`` gates inducement by the last break of the whole series; ``"causal"`` by the last
    break up to the bar and confirms swings three bars late. ``cut`` keeps the tables that several steps read."""
    d = per_block(bars, lambda d, f: add_levels(add_swings(d, f), f, mode), lookback=2 * SWING + 2, lookahead=SWING)
    return _structure(d, mode, cut)


def _structure(d: DataFrame, mode: str, cut: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    names = ("_sh", "_sl", "_mh", "_ml")
    d = cut(running(d, {**{f"seg{c}": ("count", c) for c in names}, **{f"lvl{c}": ("last", c) for c in names}}), "structure_levels")
    close, low, high = F.col("close"), F.col("low"), F.col("high")
    no = F.lit(False)
    tests = [
        ("bull", "seg_sh", close > F.col("lvl_sh"), no), ("bear", "seg_sl", close < F.col("lvl_sl"), no),
        ("grab_bull", "seg_ml", low < F.col("lvl_ml"), close > F.col("lvl_ml")), ("grab_bear", "seg_mh", high > F.col("lvl_mh"), close < F.col("lvl_mh")),
    ]
    cases = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(seg).alias("seg"), truthy(hit).alias("hit"), truthy(extra).alias("inside")) for k, seg, hit, extra in tests])
    hits = d.where(F.col("bar_no") >= 1).select("symbol", "bar_no", "ts", F.explode(F.filter(cases, lambda x: x["hit"])).alias("_x"))
    first = hits.groupBy("symbol", "_x.kind", "_x.seg").agg(F.min_by(F.struct("bar_no", "ts", "_x.inside"), "bar_no").alias("_e"))
    events = cut(first.select("symbol", "kind", "_e.*"), "structure_events")
    breaks, grabs = events.where(F.col("kind").isin("bull", "bear")), events.where(F.col("kind").startswith("grab"))
    numbered = index_bars(breaks.select("symbol", "ts", "kind", F.col("bar_no").alias("pos")))
    turns = per_block(numbered, lambda b, f: b.withColumn("prev", f.lag("kind")), lookback=1)
    bull, bear, prev = F.col("kind") == "bull", F.col("kind") == "bear", F.col("prev")
    turns = turns.select("symbol", F.col("pos").alias("bar_no"), "kind", *[c.alias(n) for n, c in {
        "smc_bos_bull": bull & truthy(prev.isNull() | (prev == "bull")), "smc_bos_bear": bear & truthy(prev.isNull() | (prev == "bear")),
        "smc_choch": truthy(prev.isNotNull() & (prev != F.col("kind")))}.items()])
    grabs = grabs.groupBy("symbol", "bar_no").agg(
        *[F.max(F.when(F.col("kind") == f"grab_{k}", F.lit(True))).alias(f"_grab_{k}") for k in ("bull", "bear")],
        *[F.max(F.when(F.col("kind") == f"grab_{k}", F.col("inside"))).alias(f"_in_{k}") for k in ("bull", "bear")])
    d = d.join(turns, ["symbol", "bar_no"], "left").join(grabs, ["symbol", "bar_no"], "left")
    if mode == "causal":
        d = running(d, {"_dir": ("last", "kind")})
    else:
        final = breaks.groupBy("symbol").agg(F.max_by("kind", "bar_no").alias("_dir"))
        d = d.join(final, "symbol", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    idm_bull, idm_bear = yes("_grab_bull") & truthy(F.col("_dir") == "bull"), yes("_grab_bear") & truthy(F.col("_dir") == "bear")
    d = d.withColumns({
        "smc_bos_bull": yes("smc_bos_bull"), "smc_bos_bear": yes("smc_bos_bear"), "smc_choch": yes("smc_choch"),
        "smc_idm_bull": idm_bull, "smc_idm_bear": idm_bear,
        "smc_sweep_bull": (idm_bull & yes("_in_bull")) | truthy((F.col("bar_no") >= 5) & (low < F.col("lvl_ml")) & (close > F.col("lvl_ml"))),
        "smc_sweep_bear": (idm_bear & yes("_in_bear")) | truthy((F.col("bar_no") >= 5) & (high > F.col("lvl_mh")) & (close < F.col("lvl_mh"))),
    })

    def label(d: DataFrame, f: Frame) -> DataFrame:
        d = d.withColumns({"_nb": F.sum(F.col("smc_bos_bull").cast("int")).over(f.back(20)), "_ns": F.sum(F.col("smc_bos_bear").cast("int")).over(f.back(20))})
        return d.withColumn("smc_structure", F.when(F.col("_nb") > F.col("_ns"), "Bullish").when(F.col("_ns") > F.col("_nb"), "Bearish").otherwise("Ranging"))

    tmp = [c for c in d.columns if c.startswith(("seg_", "lvl_")) or c in ("_sh", "_sl", "_mh", "_ml", "_grab_bull", "_grab_bear", "_in_bull", "_in_bear", "_dir")]
    return per_block(d, label, lookback=20).drop("kind", "_nb", "_ns", *tmp)


def zone_arrays(obs: DataFrame, fvgs: DataFrame, pools: DataFrame) -> DataFrame:
    """One row per symbol with its few kept zones as arrays."""
    item = F.struct("kind", "direction", "top", "bottom", "weight", "bar_no", "ts", "seq")
    z = obs.select("symbol", F.lit("OB").alias("kind"), "direction", "top", "bottom", F.col("strength").alias("weight"), "bar_no", "ts", F.col("impulse_no").alias("seq"))
    z = z.unionByName(fvgs.select("symbol", F.lit("FVG").alias("kind"), "direction", "top", "bottom", (F.lit(1.0) - F.col("filled_pct")).alias("weight"), "bar_no", "ts", F.col("born_no").alias("seq")))
    zones = z.groupBy("symbol").agg(F.array_sort(F.collect_list(item)).alias("zones"))
    levels = pools.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("direction", "level", "touches", "is_sweep_event", "bar_no"))).alias("pools"))
    return zones.join(levels, "symbol", "full")


def of_kind(kind: str, direction: str) -> Column:
    return F.filter(F.coalesce("zones", F.array().cast("array<struct<kind:string,direction:string,top:double,bottom:double,weight:double,bar_no:bigint,ts:timestamp_ntz,seq:bigint>>")),
                    lambda z: (z["kind"] == kind) & (z["direction"] == direction))


def inside(zones: Column) -> Column:
    return F.exists(zones, lambda z: F.col("close").between(z["bottom"], z["top"]))


def weight_inside(zones: Column) -> Column:
    return F.aggregate(zones, F.lit(0.0), lambda a, z: a + F.when(F.col("close").between(z["bottom"], z["top"]), z["weight"]).otherwise(0.0))


def add_membership(d: DataFrame) -> DataFrame:
    """In-zone flags from the attached zone arrays."""
    return d.withColumns({f"smc_in_{side}_{kind}": inside(of_kind(kind.upper(), f"{side.capitalize()}ish")) for side in ("bull", "bear") for kind in ("ob", "fvg")})


def nearest_pools(bars: DataFrame, pools: DataFrame) -> DataFrame:
    """Distance of the newest close to the nearest pool of each side (1.0 without one)."""
    last = bars.where(is_last()).select("symbol", F.col("close").alias("_c"))
    d = last.join(pools, "symbol", "left")
    gap = F.try_divide(F.abs(F.col("level") - F.col("_c")), F.col("_c"))
    near = lambda side: F.min(F.when(F.col("direction") == side, gap))
    return d.groupBy("symbol").agg(
        F.coalesce(near("Buy-side"), F.lit(1.0)).alias("smc_near_buy_liq"), F.coalesce(near("Sell-side"), F.lit(1.0)).alias("smc_near_sell_liq"))


def smc_score(structured: DataFrame, arrays: DataFrame) -> DataFrame:
    """Zone, break, inducement and sweep contributions per bar, averaged over five bars, in [-1, 1].
    ``arrays`` has one row per symbol with at most a handful of zones."""
    d = structured.join(arrays, "symbol", "left")
    base = (
        weight_inside(of_kind("OB", "Bullish")) * 0.30 - weight_inside(of_kind("OB", "Bearish")) * 0.30
        + weight_inside(of_kind("FVG", "Bullish")) * 0.20 - weight_inside(of_kind("FVG", "Bearish")) * 0.20
    )
    sign = lambda c: F.when(F.col(f"{c}_bull"), 1.0).otherwise(0.0) - F.when(F.col(f"{c}_bear"), 1.0).otherwise(0.0)
    d = d.withColumn("_s", base + sign("smc_bos") * 0.20)
    d = d.withColumn("_s", F.when(F.col("smc_choch"), F.col("_s") * -0.5).otherwise(F.col("_s")) + sign("smc_idm") * 0.25 + sign("smc_sweep") * 0.35)
    d = add_membership(d)
    return per_block(d, lambda d, f: d.withColumn("smc_score", clip(f.mean("_s", 5, 1), -1.0, 1.0)), lookback=5).drop("_s")


def retest_entries(bars: DataFrame, obs: DataFrame, cfg: SmcSettings = SmcSettings(), block: int | None = None) -> DataFrame:
    """Bars that come back to a bullish gap or block and hold it: zone, retest number, quality 0-10,
    grade, factors and the tactical flag."""
    return _retests(per_block(bars.where(F.col("n_bars") >= 30), lambda d, f: add_retest_inputs(add_gap_lags(d, f), f), lookback=22), obs, cfg, block)


def add_retest_inputs(d: DataFrame, f: Frame) -> DataFrame:
    d = add_stochastic(d, f)
    return d.withColumns({"_vm": f.mean("volume", 20, 1), "_r10": F.coalesce(f.pct_change("close", 10), F.lit(0.0))})


def _retests(d: DataFrame, obs: DataFrame, cfg: SmcSettings, block: int | None = None) -> DataFrame:
    d = d.where(F.col("n_bars") >= 30)
    rng = F.greatest(F.col("high") - F.col("low"), F.lit(1e-9))
    gap = (F.col("low") > F.col("_h2")) & ((F.col("low") - F.col("_h2")) / F.greatest("close", F.lit(1e-9)) >= cfg.fvg_min_size_pct)
    bull_close = F.col("close") >= F.col("open")
    reject = F.least("open", "close") - F.col("low") >= rng * 0.30
    d = d.withColumns({
        "eligible": F.col("stoch_status") != "OVERBOUGHT", "confirmed": bull_close | reject,
        "gap_top": F.when(gap, F.col("low")), "gap_bottom": F.when(gap, F.col("_h2")),
    })
    born = lambda c: F.col(c).cast("long").alias("born")
    gaps = d.where(F.col("gap_top").isNotNull()).select("symbol", born("bar_no"), F.col("gap_top").alias("top"), F.col("gap_bottom").alias("bottom"))
    blocks = obs.where(F.col("direction") == "Bullish").select("symbol", F.col("impulse_no").cast("long").alias("turn"), born("bar_no"), "top", "bottom")
    found = retests.first_two_zones(d.where("eligible").select("symbol", "bar_no", "n_bars", "low", "high", "close", "confirmed"), gaps, blocks, block)
    d = retests.claims(found, block).join(d, ["symbol", "bar_no"])
    c, k, top, bottom = F.col("close"), F.col("stoch_k"), F.col("zone_top"), F.col("zone_bottom")
    price = F.greatest(c, F.lit(1e-9))
    above = F.greatest(c - top, F.lit(0.0)) / price
    rules = [
        (F.col("retest_no") == 1, 2, "FIRST_RETEST"), (F.col("retest_no") == 2, 1, "SECOND_RETEST"), (F.col("retest_no") > 2, -1, "LATE_RETEST"),
        (c >= top, 2, "RECLAIM_TOP"), ((c < top) & (c >= (top + bottom) / 2.0), 1, "MID_RECLAIM"), (bull_close, 2, "BULL_CLOSE"),
        ((c - F.col("low")) / rng >= 0.55, 1, "STRONG_CLOSE"), (reject, 1, "WICK_REJECT"), (k <= 40, 2, "STOCH_LOW"), ((k > 40) & (k <= 70), 1, "STOCH_OK"),
        (F.col("volume") >= F.greatest("_vm", F.lit(1.0)) * 0.80, 1, "VOL_OK"), ((top - bottom) / price >= 0.005, 1, "WIDE_FVG"),
        (above <= 0.03, 1, "NEAR_ZONE"), (above > 0.08, -2, "CHASE"), (k >= 75, -1, "STOCH_HIGH"),
        (F.col("_r10") >= 0.30, -2, "HOT_RUN"), ((F.col("_r10") >= 0.20) & (F.col("_r10") < 0.30), -1, "RUN_EXTENDED"),
    ]
    points = sum((F.when(cond, p).otherwise(0) for cond, p, _ in rules), F.lit(0))
    d = d.withColumn("quality", F.greatest(F.lit(0), F.least(points, F.lit(10))))
    tactical = (F.col("quality") >= 7) & (F.col("retest_no") <= 2) & (above <= 0.04) & (k <= 72) & (F.col("_r10") < 0.25)
    return d.select(
        "symbol", "bar_no", "ts", "close", "zone_type", "zone_top", "zone_bottom", "retest_no", "quality",
        F.when(F.col("quality") >= 7, "BEST").when(F.col("quality") >= 5, "GOOD").otherwise("RAW").alias("grade"),
        F.concat_ws(",", *[F.when(cond, name) for cond, _, name in rules]).alias("factors"), tactical.cast("int").alias("tactical"),
    )


def entry_history(entries: DataFrame, n: int = 60) -> DataFrame:
    """Entries to show: the tactical ones if a symbol has any, else those of quality 7+, else all; newest n."""
    has = entries.groupBy("symbol").agg(F.max("tactical").alias("_t"), F.max((F.col("quality") >= 7).cast("int")).alias("_q"))
    d = entries.join(has, "symbol").where(
        F.when(F.col("_t") == 1, F.col("tactical") == 1).when(F.col("_q") == 1, F.col("quality") >= 7).otherwise(F.lit(True)))
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("bar_no")))
    return d.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank", "_t", "_q")


def smc_features(bars: DataFrame, cfg: SmcSettings = SmcSettings(), mode: str = "reference") -> DataFrame:
    """Everything the structure steps read, from one pass over the blocks."""

    def fn(d: DataFrame, f: Frame) -> DataFrame:
        d = add_retest_inputs(add_gap_lags(add_impulse(d, f, cfg), f), f)
        return add_levels(add_swings(d, f), f, mode)

    return per_block(later_extremes(bars), fn, lookback=26, lookahead=SWING)


def smc_signals(
    bars: DataFrame, cfg: SmcSettings = SmcSettings(), mode: str = "reference", cut: Callable[[DataFrame, str], DataFrame] = materialize
) -> DataFrame:
    """All structure columns and the final signal. ``cut`` keeps the feature and zone tables, which several
    branches read, in the shared folder."""
    if missing(bars, ["open", "high", "low", "close"]):
        return neutral(bars, {"smc_signal": 0, "smc_reason": "MISSING_DATA"})
    feats = cut(smc_features(bars, cfg, mode), "smc_features")
    arrays = cut(zone_arrays(_order_blocks(feats, cfg), _gaps(feats, cfg), _pools(feats, cfg)), "smc_zones")
    obs = arrays.select("symbol", F.explode("zones").alias("z")).where(F.col("z.kind") == "OB").select("symbol", "z.direction", "z.top", "z.bottom", "z.bar_no", F.col("z.seq").alias("impulse_no"))
    entries = _retests(feats, obs, cfg).select("symbol", "bar_no", F.lit(1).alias("smc_entry_signal"), F.col("zone_type").alias("smc_entry_type"),
        F.col("zone_top").alias("smc_entry_zone_top"), F.col("zone_bottom").alias("smc_entry_zone_bottom"), F.col("quality").alias("smc_entry_quality"),
        F.col("grade").alias("smc_entry_grade"), F.col("factors").alias("smc_entry_factors"), F.col("retest_no").alias("smc_entry_retest_no"), F.col("tactical").alias("smc_entry_tactical_signal"))
    keep = [*bars.columns, "_sh", "_sl", "_mh", "_ml", *[c for c in feats.columns if c.startswith(("stoch_", "swing_"))]]
    d = smc_score(_structure(feats.select(*keep), mode, cut), arrays)
    d = d.join(entries, ["symbol", "bar_no"], "left").fillna(
        {"smc_entry_signal": 0, "smc_entry_quality": 0, "smc_entry_retest_no": 0, "smc_entry_tactical_signal": 0, "smc_entry_type": "", "smc_entry_grade": "", "smc_entry_factors": ""})
    s, st, t = F.col("smc_score"), F.col("smc_structure"), cfg.score_threshold
    not_ob, not_os = F.col("stoch_status") != "OVERBOUGHT", F.col("stoch_status") != "OVERSOLD"
    swept = lambda side: is_last() & F.exists(F.coalesce("pools", F.array().cast("array<struct<direction:string,level:double,touches:int,is_sweep_event:boolean,bar_no:bigint>>")), lambda p: p["is_sweep_event"] & (p["direction"] == side))
    buy = F.when(F.col("smc_in_bull_ob") & (st == "Bullish") & (s >= t) & not_ob, "BULL_OB").when(
        F.col("smc_bos_bull") & (s >= 0) & not_ob, "BOS_BULL").when((F.col("smc_entry_signal") == 1) & (st != "Bearish"), F.concat(F.lit("BULL_"), "smc_entry_type", F.lit("_RETEST")))
    code = F.when(F.col("smc_in_bear_ob") & (st == "Bearish") & (s <= -t) & not_os, "BEAR_OB").when(buy.isNotNull(), buy).when(F.col("smc_bos_bear") & (s <= 0) & not_os, "BOS_BEAR")
    d = d.withColumn("_code", F.when(F.col("smc_choch"), "CHOCH").otherwise(code))
    quiet = F.col("_code").isNull() | (F.col("_code") == "CHOCH")
    d = d.withColumn("_code", F.when(quiet & F.col("smc_idm_bull"), "IDM_BULL").when(quiet & F.col("smc_idm_bear"), "IDM_BEAR").otherwise(F.col("_code")))
    d = d.withColumn("smc_reason", F.when(F.col("n_bars") < 30, "INSUFFICIENT_DATA").when(swept("Sell-side"), "LIQ_SWEEP_BULL").when(swept("Buy-side"), "LIQ_SWEEP_BEAR").otherwise(F.coalesce("_code", F.lit(""))))
    r = F.col("smc_reason")
    bulls = r.isin("BULL_OB", "BOS_BULL", "BULL_FVG_RETEST", "BULL_OB_RETEST", "IDM_BULL", "LIQ_SWEEP_BULL")
    bears = r.isin("BEAR_OB", "BOS_BEAR", "IDM_BEAR", "LIQ_SWEEP_BEAR")
    return d.withColumn("smc_signal", F.when(bulls, 1).when(bears, -1).otherwise(0)).drop("_code")


def smc_state(signals: DataFrame) -> DataFrame:
    """Newest row of the signals with its zone arrays, as one nested snapshot per symbol."""
    d = signals.where(is_last())
    return d.select(
        "symbol", "ts", F.col("close").alias("current_price"), F.bround("smc_score", 3).alias("smc_score"), "smc_signal", "smc_reason", "smc_structure",
        "smc_bos_bull", "smc_sweep_bull", "smc_sweep_bear", "smc_idm_bull", "smc_idm_bear", F.col("stoch_k"), F.col("stoch_d"), "stoch_status", "stoch_crossover", "stoch_crossunder", "zones", "pools",
        "smc_in_bull_ob", "smc_in_bear_ob", "smc_in_bull_fvg", "smc_in_bear_fvg", "n_bars",
    )


def entry_confirmation(state: DataFrame) -> DataFrame:
    """Zone by oscillator table: BUY / SELL / CAUTION / WAIT for every kept zone."""
    d = state.select("symbol", "stoch_k", "stoch_status", "stoch_crossover", "stoch_crossunder", F.explode("zones").alias("z"))
    bull, status = F.col("z.direction") == "Bullish", F.col("stoch_status")
    blocked = F.when(bull, status == "OVERBOUGHT").otherwise(status == "OVERSOLD")
    go = F.when(bull, (status == "OVERSOLD") | F.col("stoch_crossover")).otherwise((status == "OVERBOUGHT") | F.col("stoch_crossunder"))
    return d.select(
        "symbol", F.col("z.kind").alias("zone_type"), F.col("z.direction").alias("direction"), F.col("z.top").alias("top"), F.col("z.bottom").alias("bottom"),
        F.round("stoch_k", 1).alias("stoch_k"), (~blocked).alias("stoch_confirmed"),
        F.when(blocked, "WAIT").when(go, F.when(bull, "BUY").otherwise("SELL")).otherwise("CAUTION").alias("action"),
    )


def demand_zones(state: DataFrame, per_type: int = 3) -> DataFrame:
    """Bullish zones under the price, the nearest few of each type."""
    d = state.select("symbol", "current_price", F.explode("zones").alias("z")).where((F.col("z.direction") == "Bullish") & (F.col("z.top") < F.col("current_price")))
    d = d.select("symbol", "current_price", F.col("z.kind").alias("zone_type"), F.col("z.top").alias("top"), F.col("z.bottom").alias("bottom"), F.col("z.seq").alias("seq"))
    d = d.withColumn("distance_pct", F.try_divide(F.col("current_price") - F.col("top"), F.col("current_price")) * 100)
    rank = F.row_number().over(Window.partitionBy("symbol", "zone_type").orderBy("distance_pct", "seq"))
    return d.withColumn("_rank", rank).where(F.col("_rank") <= per_type).drop("_rank", "seq")


def open_gaps(state: DataFrame, n: int = 6) -> DataFrame:
    """Unfilled gaps of both sides by distance of their middle from the price."""
    d = state.select("symbol", "current_price", F.explode("zones").alias("z")).where(F.col("z.kind") == "FVG")
    mid = (F.col("z.top") + F.col("z.bottom")) / 2
    d = d.select("symbol", F.col("z.direction").alias("direction"), F.col("z.top").alias("top"), F.col("z.bottom").alias("bottom"), F.col("z.seq").alias("seq"),
                 (F.try_divide(F.abs(mid - F.col("current_price")), F.col("current_price")) * 100).alias("distance_pct"))
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy("distance_pct", "seq"))
    return d.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank", "seq")
