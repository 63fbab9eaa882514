"""Feature table, panel forecasts with bands, and the volume-price anomaly forest (Spark MLlib and tasks)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.config import ForecastSettings, VolumePriceSettings
from tickloom.functions.series import Frame, exact_percentile, per_block, tail
from tickloom.operators.clean import finite_or_zero
from tickloom.operators.indicators import MACD_REACH, add_atr, add_macd, add_rsi, clip, nonzero
from tickloom.operators.profile import rolling_profile
from tickloom.operators.quantile_trees import QUANTILES, QuantileModel, predict_quantiles, train_quantiles
from tickloom.operators.seasonality import seasonality
from tickloom.session import materialize

BASE_FEATURES = [
    *[f"lag_ret_{k}" for k in range(1, 6)], "ma_5_rel", "ma_15_rel", "rsi_14", "atr_14_rel", "macd_hist_rel", "roc_5", "roc_20", "volume_ratio",
    "poc_dist", "inside_va", "rel_strength", "seasonality_score", "seasonality_weight",
]
STRUCTURE_FEATURES = [
    "wyckoff_score", "wyckoff_tr_position", "wyckoff_spring", "wyckoff_lps", "effort_vs_result", "weis_wave_ratio", "vsa_sos", "vsa_sow", "vsa_no_supply",
    "smc_score", "smc_in_bull_ob", "smc_in_bear_ob", "smc_in_bull_fvg", "smc_in_bear_fvg", "smc_bos_bull", "smc_bos_bear", "smc_choch", "smc_idm_bull", "smc_idm_bear",
]
ANOMALY_FEATURES = ["volume_ratio", "volume_z", "price_change", "price_volatility", "price_range", "vp_divergence"]


def feature_table(bars: DataFrame, extra: list[DataFrame] | None = None, horizons: tuple[int, ...] = ()) -> tuple[DataFrame, list[str]]:
    """Price, volume, profile and seasonal features per bar, joined with further per-bar tables (their
    feature and ``*_signal`` columns), plus clipped forward targets. Infinities and nulls become 0."""

    def fn(d: DataFrame, f: Frame) -> DataFrame:
        c = F.col("close")
        d = add_macd(add_rsi(add_atr(d, f, name="_atr"), f, name="rsi_14"), f)
        d = d.withColumns({
            **{f"lag_ret_{k}": F.log(F.try_divide(c, f.lag("close", k))) for k in range(1, 6)},
            "ma_5_rel": F.try_divide(c, f.mean("close", 5)), "ma_15_rel": F.try_divide(c, f.mean("close", 15)), "atr_14_rel": F.try_divide(F.col("_atr"), c),
            "macd_hist_rel": F.try_divide(F.col("macd_hist"), c), "roc_5": f.pct_change("close", 5), "roc_20": f.pct_change("close", 20),
            "volume_ratio": F.col("volume") / nonzero(f.mean("volume", 20, 5)),
            **{f"target_{h}": clip(F.log(F.try_divide(f.lead("close", h), c)), -1.0, 1.0) for h in horizons},
        })
        return d.drop("_atr", "macd", "macd_signal", "macd_hist")

    d = per_block(bars, fn, lookback=MACD_REACH + 30, lookahead=max(horizons, default=0))
    d = rolling_profile(d)
    d = seasonality(d if "market" in d.columns else d.withColumn("market", F.lit("US")))
    if "rel_strength" not in d.columns:
        d = d.withColumn("rel_strength", F.lit(1.0))
    names = list(BASE_FEATURES)
    for t in extra or []:
        cols = [c for c in t.columns if c in STRUCTURE_FEATURES or (c.endswith("_signal") and c not in ("ai_signal", "combined_signal"))]
        cols = [c for c in cols if c not in names]
        d = d.join(t.select("symbol", "bar_no", *cols), ["symbol", "bar_no"], "left")
        names += cols
    return d.withColumns({c: finite_or_zero(F.col(c).cast("double")) for c in names}), names


def train(table: DataFrame, features: list[str], cfg: ForecastSettings = ForecastSettings(), trees: int = 12, depth: int = 3, calibrate: Column | None = None) -> QuantileModel:
    """Boosted quantile trees for 10, 50 and 90 % of each horizon's clipped return, on all labelled rows (``train_rows`` keeps the last
    rows of each symbol instead). A horizon with under ``min_rows`` labelled rows has no model."""
    rows = table if cfg.train_rows is None else tail(table, cfg.train_rows)
    return train_quantiles(rows, features, cfg.horizons, trees, depth, min_rows=cfg.min_rows, calibrate=calibrate)


def forecast(table: DataFrame, model: QuantileModel, cfg: ForecastSettings = ForecastSettings()) -> DataFrame:
    """Target, lower and upper price per horizon, bias, confidence and veto of every row of ``table``. A horizon
    without a model has null prices and the status NO_MODEL; without the primary one the row is vetoed."""
    d = predict_quantiles(table, model, "_q")
    for h in cfg.horizons:
        names = {f"ai_target_{h}d": f"_q50_{h}", f"ai_lower_{h}d": f"_q10_{h}", f"ai_upper_{h}d": f"_q90_{h}"}
        if h in model.horizons:
            d = d.withColumns({n: F.col("close") * F.exp(clip(F.col(q), -1.0, 1.0)) for n, q in names.items()} | {f"ai_status_{h}d": F.lit("OK")}).drop(*names.values())
        else:
            d = d.withColumns({n: F.lit(None).cast("double") for n in names} | {f"ai_status_{h}d": F.lit("NO_MODEL")})
    if not cfg.horizons:
        return d.withColumns({"ai_bias": F.lit(0), "ai_signal": F.lit(0), "ai_confidence": F.lit(0.0), "ai_veto": F.lit(True)})
    return forecast_signals(d, cfg, min(cfg.horizons))


def scan_forecasts(forecasts: DataFrame, near: int = 21, far: int = 63) -> DataFrame:
    """What the universe scan reads of forecasts: expected moves in percent and the confidence."""
    move = lambda h: (F.try_divide(F.col(f"ai_target_{h}d"), F.col("close")) - 1) * 100
    return forecasts.select("symbol", move(near).alias(f"pred_{near}d_ret_raw"), move(far).alias(f"pred_{far}d_ret_raw"), "ai_confidence")


def band_coverage(table: DataFrame, model: QuantileModel) -> DataFrame:
    """Per horizon of the model: labelled rows, the share whose outcome lies in the band, the share of clipped outcomes (a band holds all of one
    side's or none) and the mean width of the band."""
    d = predict_quantiles(table, model, "_q")
    each = [F.struct(F.lit(h).alias("horizon"), F.col(f"target_{h}").alias("y"), F.col(f"_q10_{h}").alias("lo"), F.col(f"_q90_{h}").alias("hi")) for h in model.horizons]
    d = d.select(F.explode(F.array(*each)).alias("r")).select("r.*").where("y is not null")
    return d.groupBy("horizon").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col("y").between(F.col("lo"), F.col("hi")).cast("double")).alias("coverage"),
                                      F.avg((F.abs("y") >= 1).cast("double")).alias("at_limit"), F.avg(F.col("hi") - F.col("lo")).alias("width"))


def forecast_signals(d: DataFrame, cfg: ForecastSettings = ForecastSettings(), h: int = 1) -> DataFrame:
    """Bias only when the whole band is on one side, confidence from its width, veto when it is wide. A row without a
    price or a band has no confidence and is vetoed."""
    c, lo, hi = F.col("close"), F.col(f"ai_lower_{h}d"), F.col(f"ai_upper_{h}d")
    conf = clip(F.lit(1.0) - F.try_divide(hi - lo, c) / 0.05, 0.0, 1.0)
    d = d.withColumn("ai_confidence", F.coalesce(conf, F.lit(0.0)))
    veto = F.col("ai_confidence") < cfg.confidence_threshold
    up, down = F.log(F.try_divide(lo, c)) > 0.001, F.log(F.try_divide(hi, c)) < -0.001
    return d.withColumns({"ai_veto": veto, "ai_bias": F.when(veto, 0).when(down, -1).when(up, 1).otherwise(0)}).withColumn("ai_signal", F.col("ai_bias"))


def fit_report(table: DataFrame, model: QuantileModel, features: list[str], h: int = 1) -> DataFrame:
    """R2, MAE and certification of the primary horizon's median, one row per feature with its share of the gains."""
    y, p = F.col(f"target_{h}"), F.col(f"_q50_{h}")
    scored = predict_quantiles(table.where(y.isNotNull()), model, "_q")
    m = scored.agg((F.lit(1.0) - F.try_divide(F.avg((y - p) ** 2), F.var_pop(y))).alias("r2"), F.avg(F.abs(y - p)).alias("mae")).first()
    gains = model.gains[model.horizons.index(h) * len(QUANTILES) + 1]
    weights = gains / max(gains.sum(), 1e-300)
    rows = sorted(zip(features, map(float, weights)), key=lambda x: -x[1])
    spark = table.sparkSession
    return spark.createDataFrame(
        [(i + 1, n, w, m["r2"], m["mae"], bool((m["r2"] or 0.0) > 0)) for i, (n, w) in enumerate(rows)],
        "rank int, feature string, importance double, r2 double, mae double, certified boolean")


def walk_forward_cutoffs(bars: DataFrame, months: int = 12, every: int = 21, start: int = 120, ahead: int = 64) -> DataFrame:
    """Cut-off bars of the walk-forward study: every 21st bar of the last year with room to look ahead."""
    end = bars.groupBy("symbol").agg(F.max("ts").alias("_end"))
    n = F.col("bar_no")
    d = bars.where((F.col("n_bars") >= 260) & (n >= start) & (n < F.col("n_bars") - ahead) & ((n - start) % every == 0))
    return d.join(end, "symbol").where(F.col("ts") >= F.add_months(F.col("_end").cast("date"), -months).cast("timestamp_ntz")).select("symbol", "ts", F.col("bar_no").alias("cut_no"), "close")


def forecast_errors(forecasts: DataFrame, bars: DataFrame) -> DataFrame:
    """Raw and calibrated errors of forecasts (symbol, cut_no, horizon, current_price, price_raw, price_cal)
    against the close ``horizon`` bars later, met by equality on (symbol, bar)."""
    actual = bars.select("symbol", F.col("bar_no").alias("_at"), F.col("close").alias("actual"))
    d = forecasts.withColumn("_at", F.col("cut_no") + F.col("horizon")).join(actual, ["symbol", "_at"])
    a, cur = F.col("actual"), F.col("current_price")
    err = lambda p: F.abs(F.col(p) - a)
    hit = lambda p: (F.signum(F.col(p) - cur) == F.signum(a - cur)).cast("double")
    base = F.greatest(a, F.lit(1e-9))
    return d.withColumns({"mae_raw": err("price_raw"), "mae_cal": err("price_cal"), "mape_raw": err("price_raw") / base, "mape_cal": err("price_cal") / base, "hit_raw": hit("price_raw"), "hit_cal": hit("price_cal")})


def ab_accuracy(errors: DataFrame) -> DataFrame:
    """Mean errors and hit rates per horizon, raw against calibrated."""
    cols = ["mae_raw", "mae_cal", "mape_raw", "mape_cal", "hit_raw", "hit_cal"]
    d = errors.groupBy("horizon").agg(*[F.avg(c).alias(c) for c in cols])
    gain = lambda k: F.coalesce((F.col(f"{k}_raw") - F.col(f"{k}_cal")) / nonzero(F.col(f"{k}_raw")) * 100, F.lit(0.0))
    return d.withColumns({"mae_improve_pct": gain("mae"), "mape_improve_pct": gain("mape")})


def reality_check(forecasts: DataFrame, bars: DataFrame) -> DataFrame:
    """Absolute error, APE, 2 % hit, tolerance gap and direction hit per forecast row (price_raw)."""
    d = forecast_errors(forecasts.withColumn("price_cal", F.col("price_raw")), bars)
    return d.select("symbol", "cut_no", "horizon", F.col("price_raw").alias("pred"), "actual", F.col("mae_raw").alias("abs_err"), F.col("mape_raw").alias("ape"),
                    (F.col("mape_raw") <= 0.02).cast("int").alias("hit_2pct"), ((F.col("mape_raw") - 0.02) * 100.0).alias("tol_gap_pct"), F.col("hit_raw").alias("dir_hit"))


# ---- anomaly forest ----------------------------------------------------------------------------------

_NODE = "tree int, node int, feature int, cut double, lo int, hi int, size int"


def _path_constant(n: float) -> float:
    return 0.0 if n <= 1 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(features: list[str], rows: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    limit = math.ceil(math.log2(max(rows, 2)))

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        no = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("_o", kind="stable").head(rows)
        x, rng, nodes = pdf[features].to_numpy(), np.random.default_rng(no + 42), []
        stack = [(np.arange(len(x)), 0, -1, "")]
        while stack:
            idx, depth, parent, side = stack.pop()
            me = len(nodes)
            nodes.append([no, me, -1, 0.0, -1, -1, len(idx)])
            if parent >= 0:
                nodes[parent][4 if side == "lo" else 5] = me
            if depth >= limit or len(idx) <= 1:
                continue
            part = x[idx]
            low, high = part.min(axis=0), part.max(axis=0)
            usable = np.flatnonzero(high > low)
            if not len(usable):
                continue
            k = int(rng.choice(usable))
            cut = float(rng.uniform(low[k], high[k]))
            nodes[me][2], nodes[me][3] = k, cut
            left = part[:, k] <= cut
            stack += [(idx[left], depth + 1, me, "lo"), (idx[~left], depth + 1, me, "hi")]
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "lo", "hi", "size"])

    return tree


def anomaly_forest(rows: DataFrame, features: list[str] = ANOMALY_FEATURES, cfg: VolumePriceSettings = VolumePriceSettings()) -> DataFrame:
    """Isolation trees as a node table. Every row draws its trees by hash, about 256 rows reach each tree,
    and the trees grow in parallel. Axis cuts do not depend on feature scale, so nothing is standardised."""
    x = rows.select("symbol", "bar_no", *features).na.drop()
    n = x.count()
    want = cfg.trees * cfg.sample_rows * 1.5 / max(n, 1)
    whole, part = int(want), want - int(want)
    unit = lambda seed: F.pmod(F.xxhash64("symbol", "bar_no", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    copies = F.lit(whole) + F.when(unit(1) < part, 1).otherwise(0)
    drawn = x.withColumn("_k", copies).where(F.col("_k") > 0).withColumn("_c", F.explode(F.sequence(F.lit(1), "_k")))
    drawn = drawn.withColumns({"tree": F.pmod(F.xxhash64("symbol", "bar_no", "_c", F.lit(7)), F.lit(cfg.trees)).cast("int"), "_o": F.xxhash64("symbol", "bar_no", "_c", F.lit(11))})
    return drawn.groupBy("tree").applyInPandas(_grow(features, cfg.sample_rows), _NODE)


def anomaly_scores(rows: DataFrame, forest: DataFrame, features: list[str] = ANOMALY_FEATURES, cfg: VolumePriceSettings = VolumePriceSettings()) -> DataFrame:
    """Score each complete row and flag the lowest ``contamination`` share. The node table is at most
    trees x 2 x sample_rows rows whatever the input size, so it is shipped to the tasks."""
    spark = rows.sparkSession
    bound = cfg.trees * 2 * cfg.sample_rows
    nodes = forest.limit(bound + 1).toPandas()
    if len(nodes) > bound:
        raise ValueError("forest is larger than trees x 2 x sample_rows")
    shipped = spark.sparkContext.broadcast([
        {k: g[k].to_numpy() for k in ("feature", "cut", "lo", "hi", "size")} for _, g in nodes.sort_values(["tree", "node"]).groupby("tree")])
    scale = _path_constant(cfg.sample_rows)

    @F.pandas_udf("double")
    def score(x: pd.DataFrame) -> pd.Series:
        m = x.to_numpy()
        at_rows = np.arange(len(m))
        total = np.zeros(len(m))
        for t in shipped.value:
            tail_ = np.array([_path_constant(s) for s in t["size"]])
            node, depth = np.zeros(len(m), dtype=np.int64), np.zeros(len(m))
            live = t["feature"][node] >= 0
            while live.any():
                k = t["feature"][node]
                nxt = np.where(m[at_rows, np.maximum(k, 0)] <= t["cut"][node], t["lo"][node], t["hi"][node])
                node = np.where(live, nxt, node)
                depth += live
                live = t["feature"][node] >= 0
            total += depth + tail_[node]
        return pd.Series(-np.exp2(-total / len(shipped.value) / scale))

    whole = F.lit(True)
    for f in features:
        whole = whole & F.col(f).isNotNull()
    d = rows.withColumn("vp_ml_score", F.when(whole, score(F.struct(*[F.coalesce(F.col(f), F.lit(0.0)).alias(f) for f in features]))))
    d = materialize(d, "scored")  # read by each pass of the selection
    cut = exact_percentile(d, "vp_ml_score", cfg.contamination)
    return d.withColumn("vp_ml_anomaly", F.coalesce(F.col("vp_ml_score") < cut, F.lit(False)))
