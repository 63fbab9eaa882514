"""Ordered-series computation that never needs a whole symbol in one task.

A bar table is numbered once (``index_bars``): ``bar_no`` is the 0-based position of a bar in its
symbol, ``n_bars`` the length of that symbol. From then on

* "the last n bars" is a plain filter on the two columns (``tail``), with no window and no shuffle;
* rolling work runs on fixed-size blocks of a symbol (``per_block``): every block also receives the
  few rows before (after) it that its frames reach, so a symbol holding a third of the table spreads
  over as many tasks as it has blocks;
* unbounded running values (``running``) are computed inside blocks and completed with the carried
  value of the earlier blocks, one row per block.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = 2048
#: Smoothing above which an exponential mean is summed term by term.
DIRECT_ALPHA = 0.3
UP, DOWN = Window.unboundedPreceding, Window.unboundedFollowing


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def index_bars(
    df: DataFrame, key: str = "symbol", ts: str = "ts", chunk: str = "quarter", then: tuple[str, ...] = (), unique: bool = False
) -> DataFrame:
    """Add ``bar_no`` and ``n_bars``. Rows are counted per (key, calendar chunk) first, so the only
    per-key window runs over one row per chunk. ``then`` lists further columns that order equal times; rows that
    are equal in these as well are ordered by a hash of all their values, so that numbers do not change between runs.
    ``unique`` says that a key has no time twice, which spares the hash."""
    hashed = [] if unique else [F.xxhash64(*[f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()])]
    chunked = df.withColumn("_chunk", F.date_trunc(chunk, F.col(ts)).cast("timestamp_ntz"))
    over_chunks = Window.partitionBy(key).orderBy("_chunk")
    counts = (
        chunked.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(over_chunks.rowsBetween(UP, -1)), F.lit(0)))
        .withColumn("n_bars", F.sum("_n").over(Window.partitionBy(key)))
        .drop("_n")
    )
    in_chunk = Window.partitionBy(key, "_chunk").orderBy(ts, *then, *hashed)
    return (
        chunked.join(counts, [key, "_chunk"])
        .withColumn("bar_no", F.col("_before") + F.row_number().over(in_chunk) - 1)
        .drop("_chunk", "_before")
    )


def tail(df: DataFrame, n: int) -> DataFrame:
    """Last ``n`` bars of every symbol."""
    return df.where(F.col("bar_no") >= F.col("n_bars") - n)


def is_last() -> Column:
    return F.col("bar_no") == F.col("n_bars") - 1


@dataclass(frozen=True)
class Frame:
    """Window builders for one block of one symbol, ordered by bar."""

    key: str
    block: int

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(self.key, "_blk").orderBy("bar_no")

    def back(self, n: int) -> WindowSpec:
        return self.w.rowsBetween(-(n - 1), 0)

    def rows(self, a: int, b: int) -> WindowSpec:
        return self.w.rowsBetween(a, b)

    def lag(self, c: Column | str, n: int = 1) -> Column:
        return F.lag(col(c), n).over(self.w)

    def lead(self, c: Column | str, n: int = 1) -> Column:
        return F.lead(col(c), n).over(self.w)

    def _guard(self, c: Column, n: int, mp: int | None, value: Column) -> Column:
        mp = n if mp is None else mp
        if mp <= 0:
            return value
        return F.when(F.count(c).over(self.back(n)) >= mp, value)

    def mean(self, c: Column | str, n: int, mp: int | None = None) -> Column:
        c = col(c)
        return self._guard(c, n, mp, F.avg(c).over(self.back(n)))

    def std(self, c: Column | str, n: int, mp: int | None = None) -> Column:
        c = col(c)
        return self._guard(c, n, mp, F.stddev_samp(c).over(self.back(n)))

    def sum(self, c: Column | str, n: int, mp: int | None = None) -> Column:
        c = col(c)
        return self._guard(c, n, mp, F.sum(c).over(self.back(n)))

    def min(self, c: Column | str, n: int, mp: int | None = None) -> Column:
        c = col(c)
        return self._guard(c, n, mp, F.min(c).over(self.back(n)))

    def max(self, c: Column | str, n: int, mp: int | None = None) -> Column:
        c = col(c)
        return self._guard(c, n, mp, F.max(c).over(self.back(n)))

    def pct_change(self, c: Column | str, n: int = 1) -> Column:
        c = col(c)
        return F.try_divide(c, self.lag(c, n)) - 1

    def ewm(self, c: Column | str, alpha: float, mp: int = 0, adjust: bool = True) -> Column:
        """Exponentially weighted mean as a ratio of running sums, anchored at the block centre so the
        weights stay inside the double range. Rows older than ``ewm_reach`` weigh less than one ulp."""
        c = col(c)
        if alpha > DIRECT_ALPHA:
            return self._short_ewm(c, alpha, mp, adjust)
        k = -math.log(1 - alpha)
        pos = F.col("bar_no") - F.col("_blk") * self.block - self.block // 2
        wt = F.exp(F.lit(k) * pos)
        run = self.w.rowsBetween(UP, 0)
        if adjust:
            value = F.sum(c * wt).over(run) / F.sum(F.when(c.isNotNull(), wt)).over(run)
        else:
            share = F.when(F.col("bar_no") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
            value = F.sum(c * wt * share).over(run) / wt
        return F.when(F.count(c).over(run) >= mp, value) if mp > 0 else value

    def _short_ewm(self, c: Column, alpha: float, mp: int, adjust: bool) -> Column:
        """The same mean for fast decay: the few bars that weigh anything are summed one by one, since weights
        anchored at a block's centre would leave the double range."""
        terms = [(F.lag(c, j).over(self.w) if j else c, (1 - alpha) ** j, F.col("bar_no") - j) for j in range(ewm_reach(alpha) + 1)]
        if adjust:
            num = sum((F.coalesce(x * w, F.lit(0.0)) for x, w, _ in terms[1:]), F.coalesce(c, F.lit(0.0)))
            den = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w, _ in terms[1:]), F.when(c.isNotNull(), 1.0).otherwise(0.0))
            value = F.try_divide(num, den)
        else:
            share = lambda at: F.when(at == 0, 1.0).otherwise(alpha)
            parts = [F.coalesce(x * w * share(at), F.lit(0.0)) for x, w, at in terms]
            value = F.when(F.count(c).over(self.w.rowsBetween(UP, 0)) > 0, sum(parts[1:], parts[0]))
        return F.when(F.count(c).over(self.w.rowsBetween(UP, 0)) >= mp, value) if mp > 0 else value


def ewm_reach(alpha: float) -> int:
    """Bars after which an exponential weight falls under double precision."""
    return math.ceil(37.5 / -math.log(1 - alpha)) if alpha < 1 else 0


def per_block(
    df: DataFrame,
    fn: Callable[[DataFrame, Frame], DataFrame],
    lookback: int = 0,
    lookahead: int = 0,
    block: int | None = None,
    key: str = "symbol",
) -> DataFrame:
    """Run ``fn(df, frame)`` on blocks of bars. ``lookback``/``lookahead`` are the total reach of the
    frames used in ``fn``; rows copied into a block for reach are dropped again afterwards."""
    block = block or BLOCK
    bn, last = F.col("bar_no"), F.col("n_bars") - 1
    home = F.floor(bn / block).cast("int")
    if lookback or lookahead:
        lo = F.floor(F.greatest(bn - lookahead, F.lit(0)) / block).cast("int")
        hi = F.floor(F.least(bn + lookback, last) / block).cast("int")
        df = df.withColumn("_blk", F.explode(F.sequence(lo, hi)))
    else:
        df = df.withColumn("_blk", home)
    return fn(df, Frame(key, block)).where(F.col("_blk") == home).drop("_blk")


_AGG = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
_JOIN = {
    "sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b),
    "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "min": F.least,
    "max": F.greatest,
    "last": lambda a, b: F.coalesce(b, a),
}


def running(
    df: DataFrame, specs: dict[str, tuple[str, Column | str]], block: int | None = None, key: str = "symbol"
) -> DataFrame:
    """Running sum / count / min / max / last-non-null from the first bar of the symbol to the current
    one. Each block folds its own rows; a one-row-per-block table carries the earlier blocks."""
    block = block or BLOCK
    base = df.withColumn("_blk", F.floor(F.col("bar_no") / block).cast("int"))
    for name, (_, c) in specs.items():
        base = base.withColumn(f"_in_{name}", col(c))
    run = Window.partitionBy(key, "_blk").orderBy("bar_no").rowsBetween(UP, 0)
    before = Window.partitionBy(key).orderBy("_blk").rowsBetween(UP, -1)
    aggs, carries, local = [], [], {}
    for name, (op, _) in specs.items():
        x = F.col(f"_in_{name}")
        if op == "last":
            aggs.append(F.max_by(x, F.when(x.isNotNull(), F.col("bar_no"))).alias(f"_tot_{name}"))
            carries.append(F.last(f"_tot_{name}", True).over(before).alias(f"_carry_{name}"))
            local[name] = F.last(x, True).over(run)
        else:
            outer = F.sum if op == "count" else _AGG[op]
            aggs.append(_AGG[op](x).alias(f"_tot_{name}"))
            carries.append(outer(f"_tot_{name}").over(before).alias(f"_carry_{name}"))
            local[name] = _AGG[op](x).over(run)
    carry = base.groupBy(key, "_blk").agg(*aggs).select(key, "_blk", *carries)
    out = base.withColumns({f"_loc_{n}": c for n, c in local.items()}).join(carry, [key, "_blk"])
    out = out.withColumns(
        {n: _JOIN[op](F.col(f"_carry_{n}"), F.col(f"_loc_{n}")) for n, (op, _) in specs.items()}
    )
    return out.drop("_blk", *[f"{p}_{n}" for n in specs for p in ("_in", "_loc", "_carry")])


def running_from_end(
    df: DataFrame, specs: dict[str, tuple[str, Column | str]], block: int | None = None, key: str = "symbol"
) -> DataFrame:
    """``running`` taken from the last bar backwards (suffix minima, back fill, later-break factors)."""
    flipped = df.withColumn("_fwd", F.col("bar_no")).withColumn("bar_no", F.col("n_bars") - 1 - F.col("bar_no"))
    return running(flipped, specs, block, key).withColumn("bar_no", F.col("_fwd")).drop("_fwd")


def exact_median(df: DataFrame, c: Column | str, key: str = "symbol", name: str = "median") -> DataFrame:
    """Exact median of the positive values of ``c`` per key without collecting a key: a logarithmic
    histogram finds the bucket of the middle ranks, then only that bucket's distinct values are ranked."""
    v = df.select(key, col(c).alias("_v")).where(F.col("_v") > 0)
    v = v.withColumn("_b", F.floor(F.log2("_v") * 32))
    by_bucket = Window.partitionBy(key).orderBy("_b")
    hist = (
        v.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(by_bucket.rowsBetween(UP, 0)))
        .withColumn("_all", F.sum("_n").over(Window.partitionBy(key)))
        .withColumn("_from", F.col("_upto") - F.col("_n"))
    )
    lo, hi = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    middle = hist.where((F.col("_from") <= hi) & (F.col("_upto") > lo)).select(key, "_b", "_from", "_all")
    values = v.join(middle, [key, "_b"]).groupBy(key, "_b", "_from", "_all", "_v").agg(F.count(F.lit(1)).alias("_k"))
    in_bucket = Window.partitionBy(key, "_b").orderBy("_v").rowsBetween(UP, 0)
    values = values.withColumn("_end", F.col("_from") + F.sum("_k").over(in_bucket)).withColumn("_start", F.col("_end") - F.col("_k"))
    holds = lambda r: (F.col("_start") <= r) & (r < F.col("_end"))
    return values.groupBy(key).agg(
        ((F.max(F.when(holds(lo), F.col("_v"))) + F.max(F.when(holds(hi), F.col("_v")))) / 2).alias(name)
    )


def exact_percentile(df: DataFrame, c: Column | str, share: float, buckets: int = 4096) -> float | None:
    """The interpolated percentile of all non-null values, as one number. Values are counted in equal steps of their range, and only the
    step that holds the wanted rank is looked at again: a few passes over the table, ``buckets`` counters each, whatever is in it."""
    v = df.select(col(c).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    n, least, most = v.agg(F.count("_v"), F.min("_v"), F.max("_v")).first()
    if not n:
        return None

    def at(rank: int) -> float:
        lo, hi = least, most
        while lo < hi:
            step = F.least(F.floor((F.col("_v") - lo) / (hi - lo) * buckets), F.lit(buckets - 1))
            counts = v.where(F.col("_v").between(lo, hi)).groupBy(step.alias("_s")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect()
            for r in sorted(counts, key=lambda r: r["_s"]):
                if rank < r.n:
                    lo, hi = r.lo, r.hi
                    break
                rank -= r.n
        return lo

    place = share * (n - 1)
    low = at(math.floor(place))
    return low if place == math.floor(place) else low + (at(math.ceil(place)) - low) * (place - math.floor(place))


def at_last(
    df: DataFrame, fn: Callable[[DataFrame, Frame], DataFrame], reach: int, block: int | None = None, key: str = "symbol"
) -> DataFrame:
    """``fn`` evaluated on the newest bar of every symbol only. Rows older than ``reach`` cannot matter
    and are filtered out before the shuffle, which bounds every window partition."""
    block = block or BLOCK
    d = tail(df, reach + 1).withColumn("_blk", F.floor((F.col("n_bars") - 1) / block).cast("int"))
    return fn(d, Frame(key, block)).where(is_last()).drop("_blk")


def recent(df: DataFrame, n: int, *columns: str, key: str = "symbol", name: str = "r") -> DataFrame:
    """The last ``n`` bars of every symbol as one array, oldest first (``n`` bounds it)."""
    item = F.struct("bar_no", *columns)
    return tail(df, n).groupBy(key).agg(F.array_sort(F.collect_list(item)).alias(name))
