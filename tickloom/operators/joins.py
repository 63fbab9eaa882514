"""As-of, nearest, range and priority joins expressed on equi-keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame, right: DataFrame, columns: list[str], key: str = "symbol", ts: str = "ts", chunk: str = "quarter",
    back_fill: bool = False,
) -> DataFrame:
    """Newest right row at or before each left row, per key. Both sides are stacked and the last right values carried
    forward inside calendar chunks; one row per chunk carries what earlier chunks end with. Rows are shuffled once, and nothing
    is numbered or compared pairwise. ``back_fill`` also gives the rows before the first match its values (look-ahead)."""
    from tickloom.operators.indicators import fill

    payload = F.struct(*columns)
    stacked = left.withColumns({"_side": F.lit(1), "_r": F.lit(None).cast(right.select(payload.alias("x")).schema["x"].dataType)}).unionByName(
        right.select(key, ts, F.lit(0).alias("_side"), payload.alias("_r")), allowMissingColumns=True
    ).withColumn("_chunk", F.date_trunc(chunk, F.col(ts)).cast("timestamp_ntz"))
    upto = Window.partitionBy(key, "_chunk").orderBy(ts, "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    newest = F.max_by("_r", F.when(F.col("_side") == 0, F.struct(ts, "_r")))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = stacked.groupBy(key, "_chunk").agg(newest.alias("_end")).select(
        F.col(key).alias("_of"), F.col("_chunk").alias("_in"), F.last("_end", True).over(before).alias("_carry"))
    d = stacked.withColumn("_m", F.last("_r", True).over(upto)).where(F.col("_side") == 1)
    d = d.join(carry, F.col(key).eqNullSafe(F.col("_of")) & F.col("_chunk").eqNullSafe(F.col("_in"))).select(*left.columns, F.coalesce("_m", "_carry").alias("_m"))
    d = d.select(*[c for c in left.columns if c not in columns], *[F.col(f"_m.{c}").alias(c) for c in columns])
    return fill(d, columns, back=True) if back_fill else d


def asof_calendar(left: DataFrame, right: DataFrame, columns: list[str], ts: str = "ts") -> DataFrame:
    """As-of join to a table that has no instrument key: the match is found once per distinct time of
    the left side and attached by equality."""
    times = left.select(ts).distinct().withColumn("_all", F.lit("all"))
    matched = asof_join(times, right.select(ts, *columns).withColumn("_all", F.lit("all")), columns, key="_all", ts=ts)
    return left.join(matched.drop("_all"), ts, "left")


def with_benchmark(bars: DataFrame, bench: DataFrame, name: str = "index_close") -> DataFrame:
    """Inner join to the benchmark by time, with the price ratio."""
    b = bench.select("ts", F.col("close").alias(name))
    return bars.join(b, "ts").withColumn("rel_strength", F.try_divide(F.col("close"), F.col(name)))


def prefer_new(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Left join that takes the new value of each column where there is one."""
    n = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    d = old.join(n, keys, "left")
    have = set(old.columns)
    return d.withColumns(
        {c: F.coalesce(F.col(f"_new_{c}"), F.col(c) if c in have else F.lit(0.0)) for c in columns}
    ).drop(*[f"_new_{c}" for c in columns])


def merge_flow(bars: DataFrame, flow: DataFrame, fx: float = 1.0) -> DataFrame:
    """Attach foreign/block flow to bars and value the net in millions of local currency."""
    cols = ["foreign_buy", "foreign_sell", "block_volume"]
    d = prefer_new(bars, flow, ["symbol", "ts"], cols)
    net = (F.coalesce("foreign_buy", F.lit(0.0)) - F.coalesce("foreign_sell", F.lit(0.0))) * F.coalesce("close", F.lit(0.0))
    return d.withColumn("foreign_net_value", F.round(net * fx / 1_000_000, 3))


def by_source_priority(sources: list[DataFrame], key: str = "symbol") -> DataFrame:
    """Fallback chain: each key takes all its rows from the first source that has any."""
    tagged = None
    for rank, src in enumerate(sources):
        t = src.withColumn("src_rank", F.lit(rank))
        tagged = t if tagged is None else tagged.unionByName(t, allowMissingColumns=True)
    best = tagged.groupBy(key).agg(F.min("src_rank").alias("src_rank"))
    return tagged.join(best, [key, "src_rank"])


def nearest(
    points: DataFrame, zones: DataFrame, price: str, level: str, key: str = "symbol", tie: str = "zone_no",
    max_distance_pct: float | None = None, side: str | None = None,
) -> DataFrame:
    """Per point row (one per key) the closest zone, optionally on one side and within a distance.
    Zones are few per key; the pick is an aggregate, so nothing is sorted."""
    d = points.join(zones, key)
    dist = F.try_divide(F.abs(F.col(level) - F.col(price)), F.col(price))
    ok = F.lit(True)
    if max_distance_pct is not None:
        ok = ok & (dist <= max_distance_pct)
    if side == "long":
        ok = ok & (F.col(level) < F.col(price))
    elif side == "short":
        ok = ok & (F.col(level) > F.col(price))
    zone_cols = [c for c in zones.columns if c != key]
    pick = d.where(ok).groupBy(key).agg(F.min_by(F.struct(*zone_cols, dist.alias("distance")), F.struct(dist, F.col(tie))).alias("_z"))
    return points.join(pick.select(key, "_z.*"), key, "left")


def band_exists(levels: Column, bottom: Column, top: Column, width: Column) -> Column:
    """True when any level lies in [bottom - width, top + width]."""
    return F.exists(levels, lambda x: x.between(bottom - width, top + width))


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Union-and-dedupe: the newest row of each key, as a partial aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def keep_first(rows: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


#: Symbols in a tile's side: a task holds the sums of one pair of tiles at a time, whatever the number of symbols.
TILE = 256


def _tile_products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of products of each pair of tiles over the days of the task. Rows come sorted by pair of tiles; each is one day's symbols and
    values of both. What leaves a task is one row per pair of symbols that have a day in common."""
    pair, names, total = None, ({}, {}), {}

    def out() -> pd.DataFrame:
        a, b = (np.array(list(n), dtype=object) for n in names)
        n = total["n"][: len(a), : len(b)] if total else np.zeros((0, 0))
        i, j = np.nonzero(n)
        if pair is not None and pair[0] == pair[1] and len(i):
            keep = np.array([x <= y for x, y in zip(a[i], b[j])])
            i, j = i[keep], j[keep]
        return pd.DataFrame({"a": a[i] if len(i) else [], "b": b[j] if len(i) else [], **{k: total[k][i, j] if len(i) else [] for k in ("n", "sx", "sy", "sxx", "syy", "sxy")}})

    for pdf in batches:
        if not len(pdf):
            continue
        key = list(zip(pdf["ta"].tolist(), pdf["tb"].tolist()))
        cuts = [0, *[k for k in range(1, len(key)) if key[k] != key[k - 1]], len(key)]
        for lo, hi in zip(cuts, cuts[1:]):
            if key[lo] != pair:
                if total:
                    yield out()
                pair, names, total = key[lo], ({}, {}), {}
            days = pdf.iloc[lo:hi]
            sides = []
            for k, (who, what) in enumerate((("names_a", "values_a"), ("names_b", "values_b"))):
                at = [[names[k].setdefault(s, len(names[k])) for s in day] for day in days[who]]
                x, m = np.zeros((hi - lo, len(names[k]))), np.zeros((hi - lo, len(names[k])))
                for d, (cols, values) in enumerate(zip(at, days[what])):
                    x[d, cols], m[d, cols] = values, 1.0
                sides.append((x, m))
            (x, mx), (y, my) = sides
            parts = {"n": mx.T @ my, "sx": x.T @ my, "sy": mx.T @ y, "sxx": (x * x).T @ my, "syy": mx.T @ (y * y), "sxy": x.T @ y}
            for c, v in parts.items():
                old = total.get(c, np.zeros((0, 0)))
                total[c] = np.pad(old, ((0, v.shape[0] - old.shape[0]), (0, v.shape[1] - old.shape[1]))) + v
    if total:
        yield out()


def pairwise(returns: DataFrame, value: str = "ret", tile: int = TILE, least: float | None = None, min_days: int = 1) -> DataFrame:
    """Correlation and sample covariance of every pair of symbols over their common days.

    Symbols are cut into tiles, and a task adds up one pair of tiles over its days by matrix products, so its memory is that of a tile
    squared, however many symbols there are; no row per (day, pair) is ever made. Partial sums meet per pair. Values are shifted by their
    overall mean, so the sums lose no digits. ``least`` keeps pairs of at least that absolute correlation (and symbols with themselves), ``min_days`` those with as many common days, which
    bounds the output where all pairs are not wanted."""
    mean = returns.agg(F.avg(value)).scalar()
    rows = returns.where(F.col(value).isNotNull()).select("ts", "symbol", (F.col(value) - mean).alias("x"))
    symbols = rows.select("symbol").distinct()
    tiles = max(1, -(-symbols.count() // tile))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("symbol"), F.lit(tiles)).cast("int"))
    days = rows.groupBy("ts", "tile").agg(F.collect_list("symbol").alias("names"), F.collect_list("x").alias("values"))
    # a day's tile goes to all tiles that it meets, the smaller number first
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    sent = days.withColumn("other", other).select("ts", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), F.col("tile"), "names", "values")
    side = lambda c, t: F.max(F.when(F.col("tile") == F.col(t), F.col(c)))
    both = sent.groupBy("ts", "ta", "tb").agg(*[side(c, t).alias(f"{c}_{t[1]}") for t in ("ta", "tb") for c in ("names", "values")]).where("names_a is not null and names_b is not null")
    span = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (400 * 86_400))  # days of one pair of tiles spread over tasks as well
    sums = both.repartition("ta", "tb", span).sortWithinPartitions("ta", "tb").drop("ts").mapInPandas(
        _tile_products, "a string, b string, n double, sx double, sy double, sxx double, syy double, sxy double")
    low = F.col("a") <= F.col("b")  # tiles are by hash, so a pair may come either way round
    flip = {"a": "b", "b": "a", "sx": "sy", "sy": "sx", "sxx": "syy", "syy": "sxx"}
    sums = sums.select(*[F.when(low, F.col(c)).otherwise(F.col(flip.get(c, c))).alias(c) for c in ("a", "b", "n", "sx", "sy", "sxx", "syy", "sxy")])
    s = sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.col("n")
    var = lambda c: F.greatest(F.col(f"s{c}{c}") - F.col(f"s{c}") * F.col(f"s{c}") / n, F.lit(0.0))
    co = F.col("sxy") - F.col("sx") * F.col("sy") / n
    out = s.select(
        "a", "b", F.try_divide(co, F.sqrt(var("x") * var("y"))).alias("corr"), F.when(n > 1, co / (n - 1)).alias("cov"), n.cast("long").alias("days"))
    out = out.where(F.col("days") >= min_days) if min_days > 1 else out
    return out.where((F.abs("corr") >= least) | (F.col("a") == F.col("b"))) if least is not None else out
