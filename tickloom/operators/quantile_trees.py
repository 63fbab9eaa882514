"""Boosted trees on the pinball loss, grown for all horizons and quantiles at once from distributed histograms.

Features are cut into a few bins once. A level of the next tree of every model costs one job: tasks apply the trees so far, and add up
gradients and rows per (model, node, feature, bin); running sums over the bins give each split's gain, and only the best split of each
node comes to the driver. A leaf's value is the wanted quantile of its rows' residuals, read from counts in fixed buckets. Models are a
few kilobytes whatever the data. The band is widened or narrowed by what calibration rows, which no tree has seen, show it to miss
(conformalised quantile regression).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import materialize

QUANTILES = (0.1, 0.5, 0.9)
BINS = 32
#: Buckets of residuals: even steps of asinh(residual / FINEST) between the largest ones that clipped targets allow.
BUCKETS, FINEST, LARGEST = 4096, 1e-3, 2.5
_STEP = 2 * math.asinh(LARGEST / FINEST) / BUCKETS


@dataclass
class QuantileModel:
    """Trees of fixed depth for each (horizon, quantile): ``feature`` and ``upto`` (the last bin that goes left) of the inner nodes
    and ``value`` of the leaves, each tree by tree and model by model."""

    features: list[str]
    horizons: tuple[int, ...]
    depth: int
    cuts: np.ndarray
    base: np.ndarray
    feature: list[np.ndarray] = field(default_factory=list)
    upto: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    widen: dict[int, float] = field(default_factory=dict)
    gains: np.ndarray | None = None
    labelled: dict[int, int] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c[np.isfinite(c)], x[:, k], side="left") for k, c in enumerate(self.cuts)]).astype(np.uint8)

    def nodes(self, bins: np.ndarray, feature: np.ndarray, upto: np.ndarray, levels: int) -> np.ndarray:
        """Where each row stands in each model's tree after so many levels, counted from the level's left end."""
        rows, models = np.arange(len(bins))[:, None], np.arange(len(self.base))[None, :]
        at = np.zeros((len(bins), len(self.base)), dtype=np.int64)
        for level in range(levels):
            inner = at + (1 << level) - 1
            f = feature[models, inner]
            at = 2 * at + (bins[rows, np.maximum(f, 0)] > np.where(f < 0, 255, upto[models, inner]))
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        out = np.tile(self.base, (len(bins), 1))
        models = np.arange(len(self.base))[None, :]
        for f, u, v in zip(self.feature, self.upto, self.value):
            out += v[models, self.nodes(bins, f, u, self.depth)]
        return out


def _levels(rows: DataFrame, model: QuantileModel, feature: np.ndarray, upto: np.ndarray, level: int) -> DataFrame:
    """(model, node, feature, bin, g, n) over all rows: negative gradients of the pinball loss and counts."""
    wanted = np.tile(QUANTILES, len(model.horizons))
    width, p = 1 << level, len(model.features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, len(wanted), p, width * BINS))
        for pdf in batches:
            bins, y = _arrays(pdf, p)
            f = model.predict(bins)
            node = model.nodes(bins, feature, upto, level)
            for m, q in enumerate(wanted):
                label = y[:, m // len(QUANTILES)]
                ok = np.isfinite(label)
                g = q - (label[ok] <= f[ok, m])
                for k in range(p):
                    place = node[ok, m] * BINS + bins[ok, k]
                    total[0, m, k] += np.bincount(place, g, width * BINS)
                    total[1, m, k] += np.bincount(place, minlength=width * BINS)
        m, k, place = np.nonzero(total[1])
        yield pd.DataFrame({"model": m, "node": place // BINS, "feature": k, "bin": place % BINS, "g": total[0, m, k, place], "n": total[1, m, k, place]})

    parts = rows.mapInPandas(run, "model int, node int, feature int, bin int, g double, n double")
    return parts.groupBy("model", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))


def _arrays(pdf: pd.DataFrame, p: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(len(pdf), p), np.stack(pdf["y"].to_list()).astype(float) if len(pdf) else np.empty((0, 1))


def best_splits(hist: DataFrame, least: int) -> DataFrame:
    """Per model and node the split with the largest gain that leaves ``least`` rows on both sides."""
    upto = Window.partitionBy("model", "node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("model", "node", "feature")
    d = hist.select("model", "node", "feature", "bin", *[F.sum(c).over(w).alias(f"{c}{s}") for c in ("g", "n") for w, s in ((upto, "_left"), (whole, "_all"))])
    right_g, right_n = F.col("g_all") - F.col("g_left"), F.col("n_all") - F.col("n_left")
    d = d.where((F.col("n_left") >= least) & (right_n >= least))
    gain = F.col("g_left") ** 2 / F.col("n_left") + right_g**2 / right_n - F.col("g_all") ** 2 / F.col("n_all")
    d = d.withColumn("gain", gain)
    first = F.struct("gain", -F.col("feature"), -F.col("bin"))
    return d.groupBy("model", "node").agg(F.max_by(F.struct("feature", "bin", "gain"), first).alias("s")).select("model", "node", "s.*").where("gain > 1e-9")


def _buckets(r: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((np.arcsinh(np.clip(r, -LARGEST, LARGEST) / FINEST)) / _STEP) + BUCKETS // 2, 0, BUCKETS - 1).astype(np.int64)


def _quantile_of(counts: DataFrame, keys: list[str], wanted: Column) -> DataFrame:
    """The bucket in which the wanted share of each key's counts is reached."""
    upto = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    d = counts.groupBy(*keys, "bucket").agg(F.sum("n").alias("n")).withColumns({"_upto": F.sum("n").over(upto), "_all": F.sum("n").over(Window.partitionBy(*keys))})
    return d.where(F.col("_upto") >= wanted * F.col("_all")).groupBy(*keys).agg(F.min("bucket").alias("bucket"))


def _value(bucket: int, at: float = 0.5) -> float:
    """The value in the middle of a bucket, or at another place in it."""
    return FINEST * math.sinh((bucket - BUCKETS // 2 + at) * _STEP)


def _leaf_counts(rows: DataFrame, model: QuantileModel, feature: np.ndarray, upto: np.ndarray, depth: int) -> DataFrame:
    """(model, leaf, bucket, n): residuals of the rows in each leaf."""
    p = len(model.features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(model.base), (1 << depth) * BUCKETS), dtype=np.int64)
        for pdf in batches:
            bins, y = _arrays(pdf, p)
            f, leaf = model.predict(bins), model.nodes(bins, feature, upto, depth)
            for m in range(len(model.base)):
                r = y[:, m // len(QUANTILES)] - f[:, m]
                ok = np.isfinite(r)
                total[m] += np.bincount(leaf[ok, m] * BUCKETS + _buckets(r[ok]), minlength=total.shape[1])
        m, place = np.nonzero(total)
        yield pd.DataFrame({"model": m, "leaf": place // BUCKETS, "bucket": place % BUCKETS, "n": total[m, place]})

    return rows.mapInPandas(run, "model int, leaf int, bucket int, n long")


def train_quantiles(table: DataFrame, features: list[str], horizons: tuple[int, ...], trees: int = 12, depth: int = 3, rate: float = 0.3, min_rows: int = 50, least: int = 20,
                    calibrate: Column | None = None, target: str = "target_{}") -> QuantileModel:
    """Models of ``horizons`` by QUANTILES on all rows of ``table`` that have a label; rows where ``calibrate`` holds (by default a fifth of them, by hash) only
    adjust the width of the band. A horizon with under ``min_rows`` labelled rows has none."""
    calibrate = F.pmod(F.xxhash64("symbol", "bar_no"), F.lit(5)) == 0 if calibrate is None else calibrate
    labels = [target.format(h) for h in horizons]
    counts = table.agg(*[F.count(y).alias(f"n{k}") for k, y in enumerate(labels)]).first()
    labelled = {h: counts[f"n{k}"] for k, h in enumerate(horizons)}
    horizons = tuple(h for h in horizons if labelled[h] >= min_rows)
    model = QuantileModel(list(features), horizons, depth, np.empty((len(features), 0)), np.zeros(len(horizons) * len(QUANTILES)), labelled=labelled)
    model.gains = np.zeros((len(model.base), len(features)))
    if not horizons:
        return model
    shares = [k / BINS for k in range(1, BINS)]
    edges = table.agg(*[F.percentile_approx(c, shares, 1000).alias(f"c{k}") for k, c in enumerate(features)]).first()
    cuts = [sorted(set(edges[f"c{k}"])) for k in range(len(features))]
    model.cuts = np.array([c + [np.inf] * (BINS - 1 - len(c)) for c in cuts])

    x = F.array(*[F.col(c).cast("double") for c in features])
    y = F.array(*[F.col(target.format(h)).cast("double") for h in horizons])

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                b = model.bins(np.stack(pdf["x"].to_list()))
                yield pd.DataFrame({"bins": [r.tobytes() for r in b], "y": pdf["y"], "held": pdf["held"]})

    rows = table.select(x.alias("x"), y.alias("y"), calibrate.alias("held")).mapInPandas(binned, "bins binary, y array<double>, held boolean")
    rows = materialize(rows, "quantile_rows")
    fit, held = rows.where("not held").select("bins", "y"), rows.where("held").select("bins", "y")
    wanted = F.element_at(F.array(*[F.lit(q) for q in QUANTILES]), F.col("model") % len(QUANTILES) + 1)

    none = np.full((len(model.base), max(1, (1 << depth) - 1)), -1)
    for r in _quantile_of(_leaf_counts(fit, model, none, none, 0), ["model", "leaf"], wanted).collect():
        model.base[r.model] = _value(r.bucket)
    for _ in range(trees):
        feature, upto = none.copy(), none.copy()
        for level in range(depth):
            for s in best_splits(_levels(fit, model, feature, upto, level), least).collect():  # a row per node at most
                inner = s.node + (1 << level) - 1
                feature[s.model, inner], upto[s.model, inner] = s.feature, s.bin
                model.gains[s.model, s.feature] += s.gain
        value = np.zeros((len(model.base), 1 << depth))
        for r in _quantile_of(_leaf_counts(fit, model, feature, upto, depth), ["model", "leaf"], wanted).collect():
            value[r.model, r.leaf] = rate * _value(r.bucket)
        model.feature.append(feature)
        model.upto.append(upto)
        model.value.append(value)
    model.widen = _misses(held, model)
    return model


def _misses(held: DataFrame, model: QuantileModel) -> dict[int, float]:
    """By how much each horizon's band must move outwards (inwards: below 0) to hold its share of the calibration rows."""
    share, p = QUANTILES[-1] - QUANTILES[0], len(model.features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(model.horizons), BUCKETS), dtype=np.int64)
        for pdf in batches:
            bins, y = _arrays(pdf, p)
            f = np.sort(model.predict(bins).reshape(len(bins), len(model.horizons), len(QUANTILES)), axis=2)
            miss = np.maximum(f[:, :, 0] - y, y - f[:, :, -1]) if len(bins) else np.empty((0, len(model.horizons)))
            for h in range(len(model.horizons)):
                ok = np.isfinite(miss[:, h])
                total[h] += np.bincount(_buckets(miss[ok, h]), minlength=BUCKETS)
        h, bucket = np.nonzero(total)
        yield pd.DataFrame({"h": h, "bucket": bucket, "n": total[h, bucket]})

    found = _quantile_of(held.mapInPandas(run, "h int, bucket int, n long"), ["h"], F.lit(share)).collect()
    return {h: 0.0 for h in model.horizons} | {model.horizons[r.h]: _value(r.bucket, 1.0) + 1e-12 for r in found}  # no row of the bucket misses by more


def predict_quantiles(table: DataFrame, model: QuantileModel, prefix: str = "q") -> DataFrame:
    """``table`` with ``<prefix>10_<h>``, ``<prefix>50_<h>`` and ``<prefix>90_<h>`` of each horizon, in order, the outer two moved by its calibration."""
    n = len(QUANTILES)

    @F.pandas_udf("array<double>")
    def apply(x: pd.Series) -> pd.Series:
        f = model.predict(model.bins(np.stack(x.to_list()))).reshape(len(x), len(model.horizons), n) if len(x) else np.empty((0, len(model.horizons), n))
        f = np.sort(f, axis=2)
        for k, h in enumerate(model.horizons):
            f[:, k, 0], f[:, k, -1] = np.minimum(f[:, k, 0] - model.widen[h], f[:, k, 1]), np.maximum(f[:, k, -1] + model.widen[h], f[:, k, 1])
        return pd.Series(list(f.reshape(len(x), -1)))

    if not model.horizons:
        return table
    d = table.withColumn("_q", apply(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in model.features])))
    names = {f"{prefix}{round(q * 100)}_{h}": F.col("_q")[k * n + j] for k, h in enumerate(model.horizons) for j, q in enumerate(QUANTILES)}
    return d.withColumns(names).drop("_q")
