"""Which bars come back to which zone, without a walk over a symbol's bars.

Zones are offered in order, gaps as they arise and then blocks. A bar goes to the first zone that fits, unless that zone took the bar
before, and zones never close. So a claim needs two things only: the first two zones that fit a bar, and whether its neighbour took
the first one.

* **The first two zones.** Prices are cut into narrow cells. In a cell a gap can matter only while fewer than two earlier gaps cover its
  part of the cell, or fewer than two have the same top in it. Lists of such gaps are pruned per stretch of bars, then together, and
  stay short; each block of bars receives those of the cells it touches and compares them in array operations. That two gaps are the
  earliest of all that fit, later ones included, makes the time order of zones and bars come out by itself.
* **The neighbour.** Between neighbours whose first zone is the same the answer turns round; it stays if the first zone was the
  neighbour's second; else it starts anew. So it is a parity of running counts, which fold block by block like all running values.

Bars have low <= close <= high. A symbol of any length spreads over as many tasks as it has blocks and cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.series import BLOCK, UP, Frame, per_block, running

#: Width of a price cell as a difference of logarithms, and bars whose gaps are pruned together at first.
CELL, STRETCH = 0.02, 65_536
#: Zones that a block of bars is compared with at a time.
AT_ONCE = 256

_ZONE = ["born", "top", "bottom"]


def cell(price: Column) -> Column:
    return F.floor(F.log(F.greatest(price, F.lit(1e-300))) / CELL).cast("int")


class Cover:
    """The intervals that a cell has seen in order; says of each whether fewer than two earlier ones cover it."""

    def __init__(self) -> None:
        self.lo, self.hi, self.n = np.empty(16), np.empty(16), 0
        self.whole = 0
        self.tops: dict[float, int] = {}

    def wanted(self, lo: float, hi: float) -> bool:
        if self.whole >= 2 or int(((self.lo[: self.n] <= lo) & (self.hi[: self.n] >= hi)).sum()) >= 2:
            return False
        if self.n == len(self.lo):
            self.lo, self.hi = np.resize(self.lo, 2 * self.n), np.resize(self.hi, 2 * self.n)
        self.lo[self.n], self.hi[self.n] = lo, hi
        self.n += 1
        self.whole += lo == -np.inf and hi == np.inf
        return True

    def new_top(self, top: float) -> bool:
        seen = self.tops[top] = self.tops.get(top, 0) + 1
        return seen <= 2


def _pruned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by (symbol, cell, stretch, born); gaps that no bar can have among its first two in the cell go."""
    at, cover = None, Cover()
    for pdf in batches:
        keep = np.zeros(len(pdf), dtype=bool)
        for k, (symbol, c, part, top, bottom, first, last) in enumerate(zip(*(pdf[x].tolist() for x in ("symbol", "cell", "stretch", "top", "bottom", "first_cell", "last_cell")))):
            if (symbol, c, part) != at:
                at, cover = (symbol, c, part), Cover()
            inside = last == c
            a = cover.wanted(-np.inf if first < c else bottom, top if inside else np.inf)
            keep[k] = (inside and cover.new_top(top)) or a
        yield pdf[keep]


def cell_zones(gaps: DataFrame) -> DataFrame:
    """(symbol, cell, born, top, bottom): for each price cell the gaps that can be among the first two to fit a bar there."""
    g = gaps.withColumns({"first_cell": cell(F.col("bottom")), "last_cell": cell(F.col("top"))})
    g = g.withColumn("cell", F.explode(F.sequence("first_cell", "last_cell"))).withColumn("stretch", F.floor(F.col("born") / STRETCH).cast("int"))
    g = g.select("symbol", "cell", "stretch", *_ZONE, "first_cell", "last_cell")

    def prune(d: DataFrame, *keys: str) -> DataFrame:
        return d.repartition(*keys).sortWithinPartitions(*keys, "born").mapInPandas(_pruned, d.schema)

    g = prune(g, "symbol", "cell", "stretch").withColumn("stretch", F.lit(0))
    return prune(g, "symbol", "cell").select("symbol", "cell", *_ZONE)


def _first_two(key: tuple, bars: pd.DataFrame, zones: pd.DataFrame) -> pd.DataFrame:
    """Per bar of one block the first two zones that fit, in their order; bars that none fits are left out."""
    columns = ["symbol", "bar_no", "n_bars", *[f"{c}{k}" for k in (1, 2) for c in ("zone", "top", "bottom")]]
    zones = zones.drop_duplicates(["kind", "turn", "born"]).sort_values(["kind", "turn", "born"], kind="stable")
    low, close, high, pos = (bars[c].to_numpy() for c in ("low", "close", "high", "bar_no"))
    most, strict = np.minimum(high, close), ~bars["confirmed"].to_numpy(dtype=bool)
    born, top, bottom = (zones[c].to_numpy() for c in _ZONE)
    found = np.full((len(bars), 2), -1)
    count = np.zeros(len(bars), dtype=np.int64)
    open_ = np.arange(len(bars))
    for lo in range(0, len(zones), AT_ONCE):
        z = slice(lo, lo + AT_ONCE)
        fits = (born[z] < pos[open_, None]) & (top[z] >= low[open_, None]) & (bottom[z] <= most[open_, None]) & ((top[z] <= close[open_, None]) | ~strict[open_, None])
        for _ in range(2):
            some = fits.any(axis=1) & (count[open_] < 2)
            rows, first = open_[some], fits[some].argmax(axis=1)
            found[rows, count[rows]] = lo + first
            count[rows] += 1
            fits[np.flatnonzero(some), first] = False
        open_ = open_[count[open_] < 2]
        if not len(open_):
            break
    at = np.flatnonzero(count)
    out = {"symbol": bars["symbol"].to_numpy()[at], "bar_no": pos[at], "n_bars": bars["n_bars"].to_numpy()[at]}
    name = np.where(zones["kind"].to_numpy() == 0, 2 * born, 2 * zones["turn"].to_numpy() + 1) if len(zones) else np.empty(0, dtype=np.int64)
    for k in (0, 1):
        hit = found[at, k]
        have = hit >= 0
        for c, values in (("zone", name), ("top", top), ("bottom", bottom)):
            v = pd.Series(values[np.where(have, hit, 0)] if len(values) else [], dtype="Int64" if c == "zone" else float)
            out[f"{c}{k + 1}"] = v.mask(~have) if c == "zone" else v.where(have)
    return pd.DataFrame(out, columns=columns)


def first_two_zones(bars: DataFrame, gaps: DataFrame, blocks: DataFrame, block: int | None = None) -> DataFrame:
    """Per bar (symbol, bar_no, n_bars, low, high, close, confirmed) the first two zones that fit: zone1, top1, bottom1, zone2, ... A zone's number is twice
    its gap's bar, or twice its block's ``turn`` plus one. ``gaps`` has symbol, born, top and bottom; ``blocks``, few per symbol, turn too."""
    block = block or BLOCK
    b = bars.where("low is not null and high is not null and close is not null").withColumn("_blk", F.floor(F.col("bar_no") / block).cast("int"))
    reach = b.groupBy("symbol", "_blk").agg(F.min("low").alias("lo"), F.max("close").alias("hi"), F.max("bar_no").alias("until"))
    cells = reach.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.greatest("hi", "lo")))))
    near = (F.col("born") < F.col("until")) & (F.col("top") >= F.col("lo")) & (F.col("bottom") <= F.col("hi"))
    none = F.lit(0).cast("long")
    zones = cells.join(cell_zones(gaps), ["symbol", "cell"]).where(near).select("symbol", "_blk", F.lit(0).alias("kind"), none.alias("turn"), *_ZONE).unionByName(
        reach.join(blocks, "symbol").where(near).select("symbol", "_blk", F.lit(1).alias("kind"), "turn", *_ZONE))
    rows = b.select("symbol", "_blk", "bar_no", "n_bars", "low", "high", "close", "confirmed")
    schema = "symbol string, bar_no long, n_bars long, " + ", ".join(f"zone{k} long, top{k} double, bottom{k} double" for k in (1, 2))
    zones = zones.withColumnsRenamed({"symbol": "_of", "_blk": "_in"})
    return rows.groupBy("symbol", "_blk").cogroup(zones.groupBy("_of", "_in")).applyInPandas(_first_two, schema)


def claims(found: DataFrame, block: int | None = None) -> DataFrame:
    """(symbol, bar_no, zone_type, zone_top, zone_bottom, retest_no) from the first two zones of each bar."""
    block = block or BLOCK
    home = F.floor(F.col("bar_no") / block).cast("int")

    def chained(d: DataFrame, f: Frame) -> DataFrame:
        """Turns so far in the block, and their number at its last fresh start (null before it)."""
        first, before = F.col("zone1"), F.col("_before")
        next_to = F.coalesce(before["bar_no"] == F.col("bar_no") - 1, F.lit(False))
        turns, same = next_to & (before["zone1"] == first), next_to & F.coalesce(before["zone2"] == first, F.lit(False))
        own = F.col("_blk") == home  # the row that was copied from the block before counts there
        d = d.withColumn("_before", f.lag(F.struct("bar_no", "zone1", "zone2")))
        d = d.withColumns({"_turn": F.when(own & turns, 1), "_anew": own & ~turns & ~same}).drop("_before")
        d = d.withColumn("_turns", F.count("_turn").over(f.w.rowsBetween(UP, 0)))
        return d.withColumn("_base", F.last(F.when(F.col("_anew"), F.col("_turns")), True).over(f.w.rowsBetween(UP, 0)))

    d = per_block(found, chained, lookback=1, block=block).withColumn("_in", home)
    ends = d.groupBy("symbol", "_in").agg(F.max("_turns").alias("_all"), F.max("_base").alias("_last"))
    earlier = Window.partitionBy("symbol").orderBy("_in").rowsBetween(UP, -1)
    ends = ends.withColumn("_up", F.coalesce(F.sum("_all").over(earlier), F.lit(0)))
    ends = ends.select("symbol", "_in", "_up", F.last(F.col("_up") + F.col("_last"), True).over(earlier).alias("_old"))
    d = d.join(ends, ["symbol", "_in"])
    # without a fresh start in the block, the last one of an earlier block counts
    since = F.when(F.col("_base").isNotNull(), F.col("_turns") - F.col("_base")).otherwise(F.col("_up") + F.col("_turns") - F.col("_old"))
    takes = since % 2 == 0
    d = d.select("symbol", "bar_no", *[F.when(takes, F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(c) for c in ("zone", "top", "bottom")]).where("zone is not null")
    d = running(d.withColumn("_zone", F.struct("symbol", "zone")), {"retest_no": ("count", F.lit(1))}, block, key="_zone")
    return d.select("symbol", "bar_no", F.when(F.col("zone") % 2 == 0, "FVG").otherwise("OB").alias("zone_type"), F.col("top").alias("zone_top"),
                    F.col("bottom").alias("zone_bottom"), F.col("retest_no").cast("int").alias("retest_no"))
