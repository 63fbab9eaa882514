"""Walk-forward study: a model refitted at every cut-off of every symbol, in one pass over the bars.

A linear model's normal equations are sums over its rows. A row's label at horizon h is known h bars later, so the row belongs to the
first cut-off from then on, and a cut-off's model needs the sums of its own slot and of all earlier ones. One job adds up the products
per (symbol, horizon, slot); running sums over the few slots of a symbol give every refit, with its own centring, scaling and residual
width, and nothing that was not known at its cut-off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.indicators import clip

#: Products of one task that wait in memory at most before they are sent on.
WAITING = 4000
#: Standard normal quantile of the band's upper end (a tenth of the errors lie above it).
BAND = 1.2815515655446004

_PART = "symbol string, horizon int, slot int, products array<double>"
_MODEL = "symbol string, horizon int, slot int, n_train long, intercept double, weights array<double>, sigma double"


def _products(features: list[str], horizons: tuple[int, ...], every: int):
    """Sums of products of (1, features, label) per symbol, horizon and slot of the task's rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[tuple[str, int, int], np.ndarray] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(*k, v.ravel()) for k, v in waiting.items()], columns=["symbol", "horizon", "slot", "products"])
            waiting.clear()
            return out

        for pdf in batches:
            x = pdf[features].to_numpy(dtype=float)
            names, who = np.unique(pdf["symbol"].to_numpy(dtype=object), return_inverse=True)
            at, first, last = (pdf[c].to_numpy() for c in ("bar_no", "first_cut", "last_cut"))
            for h in horizons:
                y = pdf[f"target_{h}"].to_numpy(dtype=float)
                ok = np.isfinite(y) & (at + h <= last)
                slot = np.maximum(0, -(-(at + h - first) // every))
                rows = np.column_stack([np.ones(len(y)), x, y])[ok]
                key = np.column_stack([who[ok], slot[ok]])
                groups, place = np.unique(key, axis=0, return_inverse=True)
                order = np.argsort(place.ravel(), kind="stable")
                for (sym, s), part in zip(groups.tolist(), np.split(rows[order], np.cumsum(np.bincount(place.ravel()))[:-1])):
                    k = (names[sym], h, s)
                    waiting[k] = waiting.get(k, 0.0) + part.T @ part
                if len(waiting) > WAITING:
                    yield flush()
        yield flush()

    return run


def _added(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([(*key, np.sum(np.stack(pdf["products"].to_list()), axis=0))], columns=["symbol", "horizon", "slot", "products"])


def solve(g: np.ndarray, ridge: float) -> tuple[float, np.ndarray, float]:
    """(intercept, weights, residual deviation) from the products of (1, features, label); the penalty is on standardised features."""
    n = g[0, 0]
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    p = len(cov) - 1
    # what rounding leaves of a constant feature's variance is none
    scale = np.sqrt(np.where(np.diag(cov) > 1e-12 * (1e-300 + np.diag(g)[1:] / n), np.diag(cov), 0.0))[:p]
    used = scale > 0
    w = np.zeros(p)
    if used.any():
        z = cov[:p, :p][np.ix_(used, used)] / np.outer(scale[used], scale[used])
        w[used] = np.linalg.lstsq(z + ridge * np.eye(int(used.sum())), cov[:p, p][used] / scale[used], rcond=None)[0] / scale[used]
    rest = cov[p, p] - 2 * w @ cov[:p, p] + w @ cov[:p, :p] @ w
    return float(mean[p] - w @ mean[:p]), w, float(np.sqrt(max(rest, 0.0)))


def _refits(ridge: float, min_rows: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Running sums over the slots of one symbol and horizon, a model for each."""
        total, out = 0.0, []
        for slot, products in pdf.sort_values("slot")[["slot", "products"]].itertuples(index=False):
            total = total + np.asarray(products)
            g = total.reshape(int(np.sqrt(len(total))), -1)
            if g[0, 0] >= min_rows:
                b, w, s = solve(g, ridge)
                out.append((*key, slot, int(g[0, 0]), b, w, s))
        return pd.DataFrame(out, columns=["symbol", "horizon", "slot", "n_train", "intercept", "weights", "sigma"])

    return run


def refits(table: DataFrame, cuts: DataFrame, features: list[str], horizons: tuple[int, ...], every: int = 21, ridge: float = 0.01, min_rows: int = 50) -> DataFrame:
    """A model per (symbol, cut_no, horizon): n_train, intercept, weights, sigma. ``table`` has the features and ``target_<h>`` of every bar, ``cuts`` the cut-off
    bars of every symbol, ``every`` bars apart."""
    span = cuts.groupBy("symbol").agg(F.min("cut_no").alias("first_cut"), F.max("cut_no").alias("last_cut"))
    rows = table.select("symbol", "bar_no", *features, *[f"target_{h}" for h in horizons]).join(span, "symbol").where("bar_no <= last_cut")
    sums = rows.mapInPandas(_products(features, horizons, every), _PART).groupBy("symbol", "horizon", "slot").applyInPandas(_added, _PART)
    # a slot without rows of its own has the model of the one before it
    slots = span.select("symbol", F.explode(F.sequence(F.lit(0), ((F.col("last_cut") - F.col("first_cut")) / every).cast("int"))).alias("slot"), "first_cut")
    slots = slots.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    empty = F.array_repeat(F.lit(0.0), (len(features) + 2) ** 2)
    sums = slots.join(sums, ["symbol", "horizon", "slot"], "left").select("symbol", "horizon", "slot", F.coalesce("products", empty).alias("products"))
    models = sums.groupBy("symbol", "horizon").applyInPandas(_refits(ridge, min_rows), _MODEL)
    return models.join(span, "symbol").withColumn("cut_no", F.col("first_cut") + F.col("slot") * every).drop("slot", "first_cut", "last_cut")


def walk_forward(table: DataFrame, cuts: DataFrame, features: list[str], horizons: tuple[int, ...] = (1, 5, 21, 63), every: int = 21, ridge: float = 0.01, min_rows: int = 50) -> DataFrame:
    """Forecasts at every cut-off from the model refitted there: symbol, cut_no, horizon, n_train, current_price, price_raw, price_lower and price_upper (a band for
    eight in ten outcomes), and price_cal: the forecast move shrunk by its share in the spread of moves, which is what a model that explains
    little may claim."""
    models = refits(table, cuts, features, horizons, every, ridge, min_rows)
    at = table.join(cuts.select("symbol", F.col("cut_no").alias("bar_no")), ["symbol", "bar_no"]).select("symbol", F.col("bar_no").alias("cut_no"), "close", F.array(*features).alias("_x"))
    d = models.join(at, ["symbol", "cut_no"])
    move = F.col("intercept") + F.aggregate(F.zip_with("weights", "_x", lambda w, x: w * x), F.lit(0.0), lambda a, b: a + b)
    d = d.withColumn("_move", clip(move, -1.0, 1.0))
    share = F.abs("_move") / F.greatest(F.abs("_move") + F.col("sigma"), F.lit(1e-12))
    price = lambda m: F.col("close") * F.exp(clip(m, -1.0, 1.0))
    return d.select("symbol", "cut_no", "horizon", "n_train", F.col("close").alias("current_price"), price(F.col("_move")).alias("price_raw"), price(F.col("_move") - BAND * F.col("sigma")).alias("price_lower"),
                    price(F.col("_move") + BAND * F.col("sigma")).alias("price_upper"), price(F.col("_move") * share).alias("price_cal"))
