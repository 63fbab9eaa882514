"""Zigzag pivots and impulse-wave reading of weekly bars."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.series import BLOCK

# Rule texts and projection ratios.
RULES = ("Rule 1: Wave 2 retraced > 100% of Wave 1", "Rule 2: Wave 3 is shortest (invalid)", "Rule 3: Wave 4 overlaps Wave 1 territory")
RATIOS = {
    "2": (("W3 target (1.272×)", 1.272), ("W3 target (1.618×) ★", 1.618), ("W3 target (2.000×)", 2.0), ("W3 target (2.618×)", 2.618)),
    "3": (("W3 completion (1.272×)", 1.272), ("W3 completion (1.618×) ★", 1.618), ("W3 extension (2.0×)", 2.0)),
}


def _next_turn(high: np.ndarray, low: np.ndarray, start: int, ref: float, threshold: float) -> tuple[int, str] | None:
    """The first bar from ``start`` on that is above or below the reference price by the threshold, and on which side."""
    up, down, step = ref * (1 + threshold), ref * (1 - threshold), 64
    while start < len(high):
        hit = (high[start : start + step] > up) | (low[start : start + step] < down)
        if hit.any():
            i = start + int(hit.argmax())
            return i, "H" if high[i] > up else "L"
        start, step = start + step, 2 * step
    return None


def _summary(threshold: float) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """What a block of bars does to any reference price that comes in. It acts first where a new highest high or lowest low of the
    block passes the threshold, and what follows depends on that bar and side alone: so a row holds these bars in order, and for each
    the reference, side and number of turns that the block is left with."""

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_no")
        high, low, pos = pdf["high"].to_numpy(dtype=float), pdf["low"].to_numpy(dtype=float), pdf["bar_no"].to_numpy()
        begins = len(pos) > 0 and pos[0] == 0
        start = 1 if begins else 0
        left: dict[tuple[int, str], tuple[float, str, int]] = {}

        def leave(i: int, side: str) -> tuple[float, str, int]:
            trail = []
            while (i, side) not in left:
                trail.append((i, side))
                ref = high[i] if side == "H" else low[i]
                turn = _next_turn(high, low, i + 1, ref, threshold)
                if turn is None:
                    left[i, side] = (float(ref), side, 0)
                    break
                i, side = turn
            for node in reversed(trail):
                if node not in left:
                    ref, kind, turns = left[i, side]
                    left[node] = (ref, kind, turns + (side != node[1]))
                i, side = node
            return left[i, side]

        rows = []
        top = np.fmax.accumulate(high[start:]) if len(high) > start else high[:0]
        floor = np.fmin.accumulate(low[start:]) if len(low) > start else low[:0]
        for side, record in (("H", top), ("L", floor)):
            fresh = np.flatnonzero(np.concatenate([[True], np.diff(record) != 0]) & ~np.isnan(record)) if len(record) else []
            rows += [(start + int(k), side, float(record[k]), *leave(start + int(k), side)) for k in fresh]
        rows.sort(key=lambda r: (r[0], r[1]))
        at, side, price, ref, kind, turns = zip(*rows) if rows else ((),) * 6
        first = float(high[0]) if begins else None
        return pd.DataFrame([(*key, first, list(at), list(side), list(price), list(ref), list(kind), list(turns))], columns=["symbol", "_blk", "first", "at", "side", "price", "ref", "kind", "turns"])

    return block


_SUMMARY = "symbol string, _blk int, first double, at array<int>, side array<string>, price array<double>, ref array<double>, kind array<string>, turns array<int>"
_ENTRY = "symbol string, _blk int, ref_in double, kind_in string, no_in long, closes boolean"


def _entries(threshold: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Block summaries come sorted by (symbol, block); each block in which something turns gets the state it begins with, and
    whether its last swing ends there or goes on in a later block."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, ref, kind, no, waiting = None, 0.0, None, 0, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.symbol != symbol:
                    if waiting:
                        out.append((*waiting, True))
                    symbol, kind, no, waiting = r.symbol, None, 0, None
                if r.first is not None and r.first == r.first:
                    ref = r.first
                up, down = ref * (1 + threshold), ref * (1 - threshold)
                for side, price, next_ref, next_kind, turns in zip(r.side, r.price, r.ref, r.kind, r.turns):
                    if price > up if side == "H" else price < down:
                        if waiting:
                            out.append((*waiting, side != kind))
                        waiting = (r.symbol, r._1, ref, kind, no)
                        no += (side != kind) + turns
                        ref, kind = next_ref, next_kind
                        break
            yield pd.DataFrame(out, columns=["symbol", "_blk", "ref_in", "kind_in", "no_in", "closes"])
        if waiting:
            yield pd.DataFrame([(*waiting, True)], columns=["symbol", "_blk", "ref_in", "kind_in", "no_in", "closes"])

    return scan


def _replay(threshold: float) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """The pivots of one block from the state it begins with."""

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_no")
        high, low, pos, ts = (pdf[c].to_numpy() for c in ("high", "low", "bar_no", "ts"))
        ref, kind, no = pdf["ref_in"].iloc[0], pdf["kind_in"].iloc[0], int(pdf["no_in"].iloc[0])
        i, out = 0 if pos[0] else 1, []
        while (turn := _next_turn(high, low, i, ref, threshold)) is not None:
            i, side = turn
            if side != kind:
                kind, no = side, no + 1
                out.append(None)
            ref = high[i] if side == "H" else low[i]
            if not out:
                out.append(None)
            out[-1] = (key[0], no, int(pos[i]), ts[i], float(ref), side)
            i += 1
        if not pdf["closes"].iloc[0]:
            out.pop()
        return pd.DataFrame(out, columns=["symbol", "pivot_no", "bar_no", "ts", "price", "kind"])

    return block


def zigzag(bars: DataFrame, threshold: float = 0.08, last: int = 14, block: int | None = None) -> DataFrame:
    """Alternating swing pivots of at least ``threshold``; the newest ``last`` per symbol.

    Blocks of bars are summed up and, once the state before each is known, replayed in parallel; what goes through one task per symbol is
    one short row per block."""
    blk = F.floor(F.col("bar_no") / (block or BLOCK)).cast("int")
    feed = bars.where(F.col("n_bars") >= 10).select("symbol", "bar_no", "ts", "high", "low", blk.alias("_blk"))
    sums = feed.select("symbol", "_blk", "bar_no", "high", "low").groupBy("symbol", "_blk").applyInPandas(_summary(threshold), _SUMMARY)
    entries = sums.repartition("symbol").sortWithinPartitions("symbol", "_blk").mapInPandas(_entries(threshold), _ENTRY)
    schema = "symbol string, pivot_no long, bar_no long, ts timestamp_ntz, price double, kind string"
    pivots = feed.join(entries, ["symbol", "_blk"]).groupBy("symbol", "_blk").applyInPandas(_replay(threshold), schema)
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("pivot_no")))
    return pivots.withColumn("_rank", rank).where(F.col("_rank") <= last).drop("_rank")


def impulse(pivots: DataFrame) -> DataFrame:
    """Best six-pivot window per symbol (first of the best) with its rule violations. At most 14 pivots per
    symbol come in, so the windows here are tiny."""
    w = Window.partitionBy("symbol").orderBy("pivot_no")
    ends = pivots.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_pivots"), F.min_by("price", "pivot_no").alias("_first"), F.max_by("price", "pivot_no").alias("_last"))
    d = pivots.withColumns({**{f"p{i}": F.lead("price", i).over(w) for i in range(6)}, **{f"i{i}": F.lead("bar_no", i).over(w) for i in range(6)}})
    d = d.join(ends, "symbol").withColumn("uptrend", F.col("_last") > F.col("_first"))
    d = d.where(F.col("p5").isNotNull() & (F.col("kind") == F.when(F.col("uptrend"), "L").otherwise("H")))
    p = [F.col(f"p{i}") for i in range(6)]
    w1, w3, w5 = F.abs(p[1] - p[0]), F.abs(p[3] - p[2]), F.abs(p[5] - p[4])
    broken = (
        (p[1] > p[0]) & (F.try_divide(p[1] - p[2], p[1] - p[0]) > 1.0), w3 == F.least(w1, w3, w5), p[4] < p[1],
    )
    d = d.withColumn("violations", F.array_compact(F.array(*[F.when(c, t) for c, t in zip(broken, RULES)])))
    keep = F.struct(*[f"p{i}" for i in range(6)], *[f"i{i}" for i in range(6)], "violations")
    best = d.groupBy("symbol").agg(F.max_by(keep, F.struct(-F.size("violations"), -F.col("pivot_no"))).alias("_b")).select("symbol", "_b.*")
    base = ends.select("symbol", "n_pivots", (F.col("_last") > F.col("_first")).alias("uptrend"))
    return base.join(best, "symbol", "left")


def wave_targets(waves: DataFrame) -> DataFrame:
    """Projection, invalidation, entry zone and level map for ``current_wave`` from the prices p0..p5."""
    p = [F.col(f"p{i}") for i in range(6)]
    wave, w1, w3, full = F.col("current_wave"), p[1] - p[0], p[3] - p[2], p[5] - p[0]
    r2 = lambda c: F.bround(c, 2)
    pair = lambda items: F.map_from_arrays(F.array(*[F.lit(k) for k, _ in items]), F.array(*[r2(v) for _, v in items]))
    five = [("ABC target (0.382 retr.) ★", p[5] - full * 0.382), ("ABC target (0.500 retr.)", p[5] - full * 0.5), ("ABC target (0.618 retr.)", p[5] - full * 0.618), ("Wave 4 territory", p[4])]
    four = [("W5 min (0.382× W3)", p[4] + w3 * 0.382), ("W5 target (= W1) ★", p[4] + w1), ("W5 target (0.618× W3)", p[4] + w3 * 0.618), ("W5 extended (1.0× W3)", p[4] + w3)]
    third = lambda k: pair([(name, p[2] + w1 * r) for name, r in RATIOS[k]])
    return waves.withColumns({
        "target_price": r2(F.when(wave.isin("2", "3"), p[2] + w1 * 1.618).when(wave == "4", p[4] + F.greatest(w1, w3 * 0.618)).when(wave == "5", five[0][1]).otherwise(0.0)),
        "target_label": F.when(wave == "2", "Wave 3 target (Fib 1.618× Wave 1)").when(wave == "3", "Wave 3 completion (Fib 1.618× Wave 1)")
        .when(wave == "4", "Wave 5 target (≈ Wave 1 or 0.618× Wave 3)").when(wave == "5", "ABC Correction target (Fib 0.382 retracement)").otherwise(""),
        "invalidation": r2(F.when(wave == "2", p[0]).when(wave.isin("3", "4"), p[2]).when(wave == "5", p[5]).otherwise(0.0)),
        "entry_zone_low": F.when(wave == "4", r2(p[4] * 0.99)).when(wave == "5", r2(five[2][1])).otherwise(0.0),
        "entry_zone_high": F.when(wave == "4", r2(four[0][1])).when(wave == "5", r2(five[0][1])).otherwise(0.0),
        "fib_levels": F.when(wave == "2", third("2")).when(wave == "3", third("3")).when(wave == "4", pair(four)).when(wave == "5", pair(five)),
    })


def wave_duration(waves: DataFrame) -> DataFrame:
    """Bars the current wave may still take, from the bar numbers i0..i5 and ``n_bars``."""
    i, wave, end = [F.col(f"i{k}") for k in range(6)], F.col("current_wave"), F.col("n_bars") - 1
    at_least = lambda c: F.greatest(F.lit(1), F.floor(c))
    left = lambda expected, since: F.greatest(F.lit(0), expected - (end - since))
    return waves.withColumn(
        "bars_remaining",
        F.when(wave == "5", left(i[2] - i[0], i[4])).when(wave == "4", left(at_least((i[2] - i[1]) * 0.7), i[3]))
        .when(wave == "3", left(at_least((i[2] - i[0]) * 1.618), i[2])).otherwise(0).cast("long"),
    )


def elliott_state(weekly: DataFrame, threshold: float = 0.08) -> DataFrame:
    """Wave, bias, targets, duration and confidence per symbol from weekly bars (20 at least)."""
    size = weekly.groupBy("symbol").agg(F.max("n_bars").alias("n_bars"))
    d = size.join(impulse(zigzag(weekly, threshold)), "symbol", "left")
    few = (F.col("n_bars") < 20) | (F.coalesce("n_pivots", F.lit(0)) < 4)
    found = F.col("p5").isNotNull() & ~few
    wave = F.when(few, "Unknown").when(found, "5").when(F.col("n_pivots") % 2 == 0, "B").otherwise("C")
    up = F.col("uptrend")
    d = d.withColumns({
        "current_wave": wave, "pattern": F.when(few, "Unknown").when(found, "Impulse (5-wave)").otherwise("Correction ABC"),
        "bias": F.when(few, "Neutral").when(found == up, "Bullish").otherwise("Bearish"), "n_violations": F.when(found, F.size("violations")).otherwise(0),
        "wave_degree": F.when(F.col("n_bars") > 100, "Primary").when((F.col("n_bars") > 50) | ~found, "Intermediate").otherwise("Minor"),
    })
    conf = F.greatest(F.lit(10), F.least(F.lit(90), F.lit(72) - F.col("n_violations") * 20))
    d = d.withColumn("confidence", F.when(F.col("n_bars") < 20, 0).when(few, 10).when(found, conf).otherwise(30))
    return wave_duration(wave_targets(d)).drop("p0", "p1", "p2", "p3", "p4", "p5", "i0", "i1", "i2", "i3", "i4", "i5")


def elliott_score(state: DataFrame, prices: DataFrame) -> DataFrame:
    """0..1 score from bias, upside to target and confidence; ``prices`` has (symbol, close)."""
    d = state.join(prices.select("symbol", "close"), "symbol")
    upside = F.when((F.col("target_price") > 0) & (F.col("close") > 0), F.try_divide(F.col("target_price") - F.col("close"), F.col("close")) * 100).otherwise(0.0)
    conf = F.col("confidence") / 100
    d = d.withColumn("upside_pct", upside)
    return d.select(
        "symbol", "current_wave", "confidence", "upside_pct",
        F.when((F.col("bias") == "Bullish") & (F.col("upside_pct") > 0), F.least(F.col("upside_pct") / 50, F.lit(1.0)) * conf * 0.5 + 0.5)
        .when(F.col("bias") == "Bearish", F.greatest(F.lit(0.0), F.lit(0.5) - conf * 0.3)).otherwise(0.5).alias("elliott_score"),
    )


def strategic_tag(wave: Column, confidence: Column) -> Column:
    return F.when((wave == "5") & (confidence >= 60), "CAUTION_WAVE5").when((confidence >= 60) & (confidence < 75), "STRATEGIC_ONLY").otherwise("OK")


def wave_tier(n_violations: Column, confidence: Column) -> Column:
    return F.when(n_violations > 0, "INVALID").when(confidence >= 75, "ACTIONABLE").when(confidence >= 60, "STRATEGIC").otherwise("WEAK")
