"""Volume profiles: histogram, point of control and value area."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.config import ProfileSettings
from tickloom.functions.series import Frame, per_block, tail


def bin_no(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Index of the equal-width bin of [lo, hi] that holds x; edges are lo + k * step and belong upwards."""
    step = (hi - lo) / bins
    k = F.floor(F.try_divide(x - lo, step))
    k = F.when(lo + (k + 1) * step <= x, k + 1).when(lo + k * step > x, k - 1).otherwise(k)
    return F.greatest(F.lit(0), F.least(k, F.lit(bins - 1))).cast("int")


def value_area(volumes: Column, share: float, bins: int) -> Column:
    """Grow outwards from the fullest bin (first on ties; the lower neighbour on ties) until ``share`` of
    the volume is inside. Returns struct(poc, lo, hi)."""
    at = lambda i: F.when((i >= 0) & (i < bins), F.get(volumes, i)).otherwise(0.0)
    target = F.aggregate(volumes, F.lit(0.0), lambda a, x: a + x) * share
    poc = (F.array_position(volumes, F.array_max(volumes)) - 1).cast("int")

    def grow(s: Column, _: Column) -> Column:
        down, up = at(s["lo"] - 1), at(s["hi"] + 1)
        go_down = (down >= up) & (s["lo"] > 0)
        go_up = ~go_down & (s["hi"] < bins - 1)
        done = (s["vol"] >= target) | (~go_down & ~go_up)
        return F.struct(
            s["poc"].alias("poc"),
            F.when(~done & go_down, s["lo"] - 1).otherwise(s["lo"]).cast("int").alias("lo"),
            F.when(~done & go_up, s["hi"] + 1).otherwise(s["hi"]).cast("int").alias("hi"),
            F.when(done, s["vol"]).when(go_down, s["vol"] + down).otherwise(s["vol"] + up).alias("vol"),
        )

    start = F.struct(poc.alias("poc"), poc.alias("lo"), poc.alias("hi"), F.get(volumes, poc).alias("vol"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(bins)), start, grow)


def _binned(bars: DataFrame, lookback: int, bins: int) -> DataFrame:
    recent = tail(bars, lookback)
    span = recent.groupBy("symbol").agg(F.min("low").alias("lo"), F.max("high").alias("hi"), F.count(F.lit(1)).alias("n"))
    d = recent.join(span.where(F.col("hi") > F.col("lo")), "symbol")
    return d.withColumn("bin", bin_no(F.col("close"), F.col("lo"), F.col("hi"), bins)).groupBy("symbol", "lo", "hi", "n", "bin").agg(
        F.sum(F.greatest("volume", F.lit(0.0))).alias("vol")
    )


def volume_profile(bars: DataFrame, cfg: ProfileSettings = ProfileSettings()) -> DataFrame:
    """POC, value area and histogram of the recent bars of each symbol (5 bars at least)."""
    n = cfg.num_bins
    d = _binned(bars, cfg.lookback, n).where(F.col("n") >= 5).groupBy("symbol", "lo", "hi").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "vol"))).alias("m")
    )
    volumes = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    d = d.withColumn("v", volumes).withColumn("va", value_area(F.col("v"), cfg.value_area_pct, n))
    step = (F.col("hi") - F.col("lo")) / n
    edge = lambda k: F.col("lo") + k * step
    mid = lambda k: (edge(k) + edge(k + 1)) / 2
    return d.select(
        "symbol", mid(F.col("va.poc")).alias("poc"), edge(F.col("va.hi") + 1).alias("vah"), edge(F.col("va.lo")).alias("val"),
        F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total_volume"),
        F.transform("v", lambda x, i: F.struct(
            mid(i).alias("price"), x.alias("volume"), (i == F.col("va.poc")).alias("is_poc"),
            i.between(F.col("va.lo"), F.col("va.hi")).alias("in_va"),
        )).alias("histogram"),
    )


def profile_levels(bars: DataFrame, lookback: int = 80, bins: int = 24, top: int = 3) -> DataFrame:
    """Mid prices of the fullest bins, least full first."""
    d = _binned(bars, lookback, bins).where(F.col("lo") > 0).groupBy("symbol", "lo", "hi").agg(
        F.array_sort(F.collect_list(F.struct("vol", "bin"))).alias("s")
    )
    step = (F.col("hi") - F.col("lo")) / bins
    level = lambda x: ((F.col("lo") + x["bin"] * step) + (F.col("lo") + (x["bin"] + 1) * step)) / 2
    return d.select("symbol", F.transform(F.slice("s", F.greatest(F.size("s") - top + 1, F.lit(1)), top), level).alias("levels"))


def _window_profiles(bins: int, share: float):
    """Vectorised over an Arrow batch of windows: one row per window, ``bins`` growth steps for all of them."""

    @F.pandas_udf("poc_price double, poc_dist double, inside_va int")
    def profile(closes: pd.Series, volumes: pd.Series) -> pd.DataFrame:
        if not len(closes):
            return pd.DataFrame({"poc_price": [], "poc_dist": [], "inside_va": []})
        c, v = np.stack(closes.to_numpy()), np.stack(volumes.to_numpy())
        rows = np.arange(len(c))
        lo, hi = c.min(axis=1), c.max(axis=1)
        step = (hi - lo) / bins
        flat = hi == lo
        safe = np.where(flat, 1.0, step)[:, None]
        k = np.floor((c - lo[:, None]) / safe)
        k = np.where(lo[:, None] + (k + 1) * safe <= c, k + 1, np.where(lo[:, None] + k * safe > c, k - 1, k))
        k = np.clip(k, 0, bins - 1).astype(np.int64)
        vol = np.zeros((len(c), bins + 2))  # one empty bin on either side
        np.add.at(vol, (rows[:, None], k + 1), v)
        poc = vol[:, 1:-1].argmax(axis=1)
        low, high, inside = poc.copy(), poc.copy(), vol[rows, poc + 1]
        target = vol.sum(axis=1) * share
        for _ in range(bins):
            down, up = vol[rows, low], vol[rows, np.minimum(high + 2, bins + 1)]
            go_down = (inside < target) & (down >= up) & (low > 0)
            go_up = (inside < target) & ~go_down & (high < bins - 1)
            inside = inside + np.where(go_down, down, np.where(go_up, up, 0.0))
            low, high = low - go_down, high + go_up
        mid = ((lo + poc * step) + (lo + (poc + 1) * step)) / 2
        last = c[:, -1]
        with np.errstate(divide="ignore", invalid="ignore"):
            dist = np.where(flat, 0.0, (last - mid) / mid)
        held = flat | ((lo + low * step <= last) & (last <= lo + (high + 1) * step))
        return pd.DataFrame({"poc_price": np.where(flat, lo, mid), "poc_dist": dist, "inside_va": held.astype(np.int32)})

    return profile


def rolling_profile(bars: DataFrame, window: int = 20, bins: int = 10, share: float = 0.70) -> DataFrame:
    """Distance to the POC and inside-value-area flag over a moving window; neutral for the first bars.
    Spark frames the windows; the histograms are filled in Arrow batches, as nested array lambdas over
    every row were ten times slower."""

    def fn(d: DataFrame, f: Frame) -> DataFrame:
        return d.withColumns({"_c": F.collect_list("close").over(f.back(window)), "_v": F.collect_list("volume").over(f.back(window))})

    d = per_block(bars, fn, lookback=window)
    full = (F.col("bar_no") >= window) & (F.size("_c") == window) & (F.size("_v") == window)
    blank = F.array_repeat(F.lit(0.0), window)
    part = lambda c: F.when(full, F.col(c)).otherwise(blank)
    d = d.withColumn("_p", _window_profiles(bins, share)(part("_c"), part("_v")))
    return d.withColumns({
        "poc_price": F.when(full, F.col("_p.poc_price")), "poc_dist": F.when(full, F.col("_p.poc_dist")).otherwise(0.0),
        "inside_va": F.when(full, F.col("_p.inside_va")).otherwise(0),
    }).drop("_c", "_v", "_p")
