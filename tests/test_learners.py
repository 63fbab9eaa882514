"""Walk-forward refits and quantile trees against plain fits, and what they must not know."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import collect, to_bars, walk
from tickloom.operators import ml, quantile_trees, walkforward


@pytest.fixture(scope="module")
def panel(spark):
    bars = to_bars(spark, pd.concat([walk(n, s, f"S{s}") for s, n in ((1, 700), (2, 520), (3, 250))], ignore_index=True))
    table, names = ml.feature_table(bars, horizons=(1, 5, 21))
    return bars, table.withColumn("market", F.lit("US")).cache(), names


def plain_fit(x, y, ridge):
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = np.inf
    z = (x - mean) / scale
    w = np.linalg.lstsq(z.T @ z / len(y) + ridge * np.eye(z.shape[1]), z.T @ (y - y.mean()) / len(y), rcond=None)[0] / scale
    b = y.mean() - w @ mean
    return b, w, (y - b - x @ w).std()


def test_each_refit_equals_a_fit_on_what_was_known(spark, panel):
    bars, table, names = panel
    names = names[:9]
    cuts = ml.walk_forward_cutoffs(bars)
    got = collect(walkforward.walk_forward(table, cuts, names, (1, 5, 21)), "symbol", "horizon", "cut_no")
    t = table.toPandas().sort_values(["symbol", "bar_no"])
    assert set(got.symbol) == {"S1", "S2"} and got.groupby(["symbol", "horizon"]).size().min() >= 8
    for r in got.itertuples():
        g = t[(t.symbol == r.symbol) & (t.bar_no + r.horizon <= r.cut_no)]
        b, w, s = plain_fit(g[names].to_numpy(), g[f"target_{r.horizon}"].to_numpy(), 0.01)
        here = t[(t.symbol == r.symbol) & (t.bar_no == r.cut_no)].iloc[0]
        move = np.clip(b + here[names].to_numpy(dtype=float) @ w, -1, 1)
        assert r.n_train == len(g)
        np.testing.assert_allclose([r.price_raw, r.price_lower, r.price_upper], here.close * np.exp(np.clip([move, move - walkforward.BAND * s, move + walkforward.BAND * s], -1, 1)), rtol=1e-6)


def test_no_look_ahead(spark, panel):
    """Other prices behind a cut-off change none of its forecasts."""
    bars, _, _ = panel
    cut = 520
    other = bars.withColumns({c: F.when((F.col("symbol") == "S1") & (F.col("bar_no") > cut), F.col(c) * 3).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})
    cuts = ml.walk_forward_cutoffs(bars)
    names = ["roc_20", "rsi_14", "ma_15_rel"]
    seen = [collect(walkforward.walk_forward(ml.feature_table(b, horizons=(1, 21))[0], cuts, names, (1, 21)).where(F.col("cut_no") <= cut), "symbol", "horizon", "cut_no") for b in (bars, other)]
    assert len(seen[0]) > 20
    pd.testing.assert_frame_equal(*seen)
    late = [walkforward.walk_forward(ml.feature_table(b, horizons=(1, 21))[0], cuts, names, (1, 21)).where((F.col("cut_no") > cut) & (F.col("symbol") == "S1")).agg(F.sum("price_raw")).first()[0] for b in (bars, other)]
    assert abs(late[0] - late[1]) > 1


def noisy_table(spark, n, seed):
    """Spread and centre depend on the features, so a band of one width for all would miss."""
    rng = np.random.default_rng(seed)
    x = rng.uniform(-1, 1, (n, 3))
    y = 0.2 * np.sign(x[:, 0]) + rng.normal(0, 1, n) * (0.05 + 0.15 * (x[:, 1] > 0))
    pdf = pd.DataFrame({"symbol": "A", "bar_no": np.arange(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "target_1": np.clip(y, -1, 1), "target_9": np.where(np.arange(n) < 20, y, np.nan)})
    return spark.createDataFrame(pdf).withColumn("target_9", F.nanvl("target_9", F.lit(None).cast("double"))).repartition(4)


def test_bands_follow_the_spread(spark):
    model = quantile_trees.train_quantiles(noisy_table(spark, 6000, 1), ["a", "b", "c"], (1, 9), trees=10, depth=2)
    assert model.horizons == (1,) and model.labelled == {1: 6000, 9: 20}
    got = quantile_trees.predict_quantiles(noisy_table(spark, 4000, 2), model).toPandas()
    inside = got.target_1.between(got.q10_1, got.q90_1)
    for part in (got.b > 0.05, got.b < -0.05):
        assert abs(inside[part].mean() - 0.8) < 0.04
    assert abs(inside.mean() - 0.8) < 0.02
    width = got.q90_1 - got.q10_1
    assert width[got.b > 0.05].mean() > 2.5 * width[got.b < -0.05].mean()
    assert abs(got.q50_1[(got.a > 0.05) & (got.b < -0.05)].mean() - 0.2) < 0.03 and (got.q10_1 <= got.q50_1).all() and (got.q50_1 <= got.q90_1).all()
    assert model.gains[1].argmax() == 0 and model.gains[0].sum() > 0


def test_a_split_is_the_best_of_all(spark):
    """The first split of each model against a search over all cuts."""
    df = noisy_table(spark, 1500, 3)
    model = quantile_trees.train_quantiles(df, ["a", "b", "c"], (1,), trees=1, depth=1, calibrate=F.lit(False))
    t = df.toPandas()
    bins, y = model.bins(t[["a", "b", "c"]].to_numpy()), t.target_1.to_numpy()
    for m, q in enumerate(quantile_trees.QUANTILES):
        g, best = q - (y <= model.base[m]), (-1.0, None)
        assert abs(model.base[m] - np.quantile(y, q)) < 0.01
        for k in range(3):
            for cut in range(quantile_trees.BINS):
                left = bins[:, k] <= cut
                if 20 <= left.sum() <= len(y) - 20:
                    gain = g[left].sum() ** 2 / left.sum() + g[~left].sum() ** 2 / (~left).sum() - g.sum() ** 2 / len(y)
                    best = max(best, (gain, (k, cut)), key=lambda b: b[0])
        assert (model.feature[0][m, 0], model.upto[0][m, 0]) == best[1]
        left = bins[:, best[1][0]] <= best[1][1]
        for leaf, part in enumerate((left, ~left)):
            assert abs(model.value[0][m, leaf] / 0.3 - np.quantile(y[part] - model.base[m], q)) < 0.02


def test_tables_without_labels(spark):
    empty = noisy_table(spark, 30, 4)
    model = quantile_trees.train_quantiles(empty, ["a"], (1, 9))
    assert model.horizons == () and quantile_trees.predict_quantiles(empty, model).columns == empty.columns
