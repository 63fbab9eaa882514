"""Rolling and exponentially weighted indicators.

``add_*`` builders run inside one block (see ``per_block``) and can be chained there, so a composite
operator pays for one shuffle; the public functions wrap a single builder with its reach.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.config import StochasticSettings
from tickloom.functions.series import Frame, ewm_reach, per_block, running

WILDER = ewm_reach(1 / 14)
ADX_REACH = 2 * WILDER + 20
MACD_REACH = ewm_reach(2 / 27) + ewm_reach(2 / 10)


def truthy(c: Column) -> Column:
    """Comparisons with null count as false."""
    return F.coalesce(c, F.lit(False))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(hi)), F.lit(lo)))


def nonzero(c: Column) -> Column:
    return F.when(c != 0, c)


def true_range(f: Frame) -> Column:
    prev = f.lag("close")
    return F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
    )


def add_atr(df: DataFrame, f: Frame, period: int = 14, mp: int = 1, name: str = "atr") -> DataFrame:
    df = df.withColumn("_tr", true_range(f))
    return df.withColumn(name, f.mean("_tr", period, mp)).drop("_tr")


def add_rsi(df: DataFrame, f: Frame, period: int = 14, name: str = "rsi") -> DataFrame:
    df = df.withColumn("_d", F.col("close") - f.lag("close"))
    gain = F.when(F.col("_d") > 0, F.col("_d")).otherwise(0.0)
    loss = F.when(F.col("_d") < 0, -F.col("_d")).otherwise(0.0)
    rs = f.ewm(gain, 1 / period, period) / nonzero(f.ewm(loss, 1 / period, period))
    return df.withColumn("_rs", rs).withColumn(
        name, F.coalesce(100 - 100 / (1 + F.col("_rs")), F.lit(50.0))
    ).drop("_d", "_rs")


def add_adx(df: DataFrame, f: Frame, period: int = 14, name: str = "adx") -> DataFrame:
    up = F.col("high") - f.lag("high")
    down = f.lag("low") - F.col("low")
    df = add_atr(df.withColumns({"_up": up, "_down": down}), f, period, 1, "_atr")
    plus = F.when((F.col("_up") > F.col("_down")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0)
    df = df.withColumn("_plus", plus)
    minus = F.when((F.col("_down") > F.col("_plus")) & (F.col("_down") > 0), F.col("_down")).otherwise(0.0)
    df = df.withColumn("_minus", minus)
    atr = nonzero(F.col("_atr"))
    df = df.withColumns({
        "_pdi": 100 * (f.ewm("_plus", 1 / period, period) / atr),
        "_mdi": 100 * (f.ewm("_minus", 1 / period, period) / atr),
    })
    df = df.withColumn("_dx", 100 * (F.abs(F.col("_pdi") - F.col("_mdi")) / nonzero(F.col("_pdi") + F.col("_mdi"))))
    df = df.withColumn(name, F.coalesce(f.ewm("_dx", 1 / period, period), F.lit(0.0)))
    return df.drop("_up", "_down", "_atr", "_plus", "_minus", "_pdi", "_mdi", "_dx")


def add_macd(df: DataFrame, f: Frame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = df.withColumn(
        "macd", f.ewm("close", 2 / (fast + 1), fast) - f.ewm("close", 2 / (slow + 1), slow)
    )
    df = df.withColumn("macd_signal", f.ewm("macd", 2 / (signal + 1), signal))
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def add_stochastic(df: DataFrame, f: Frame, cfg: StochasticSettings = StochasticSettings()) -> DataFrame:
    lo, hi = f.min("low", cfg.k_period, 1), f.max("high", cfg.k_period, 1)
    df = df.withColumns({"_lo": lo, "_hi": hi})
    raw = (F.col("close") - F.col("_lo")) / nonzero(F.col("_hi") - F.col("_lo")) * 100
    df = df.withColumn("_raw", F.coalesce(raw, F.lit(50.0)))
    df = df.withColumn("_k", f.mean("_raw", cfg.slowing, 1))
    df = df.withColumn("_dd", f.mean("_k", cfg.d_period, 1))
    df = df.withColumns({"_pk": f.lag("_k"), "_pd": f.lag("_dd")})
    k, d = F.col("_k"), F.col("_dd")
    over = truthy((k > d) & (F.col("_pk") <= F.col("_pd")))
    under = truthy((k < d) & (F.col("_pk") >= F.col("_pd")))
    buy, sell = over & (k <= cfg.oversold + 10), under & (k >= cfg.overbought - 10)
    return df.withColumns({
        "stoch_k": clip(k, 0.0, 100.0),
        "stoch_d": clip(d, 0.0, 100.0),
        "stoch_status": F.when(k <= cfg.oversold, "OVERSOLD").when(k >= cfg.overbought, "OVERBOUGHT")
        .otherwise("NEUTRAL"),
        "stoch_crossover": over,
        "stoch_crossunder": under,
        "stoch_signal": F.when(sell, -1).when(buy, 1).otherwise(0),
        "stoch_reason": F.when(sell, "STOCH_BEAR").when(buy, "STOCH_BULL").otherwise(""),
    }).drop("_lo", "_hi", "_raw", "_k", "_dd", "_pk", "_pd")


def rolling_rank_pct(f: Frame, c: str, n: int) -> Column:
    """Percent rank of the current value among the last n (ties averaged)."""
    values = F.collect_list(c).over(f.back(n))
    below = F.size(F.filter(values, lambda x: x < F.col(c)))
    equal = F.size(F.filter(values, lambda x: x == F.col(c)))
    return F.when(F.size(values) >= n, (below + (equal + 1) / 2) / n)


# ---- public single-indicator operators -------------------------------------------------------------


def sma(bars: DataFrame, periods: tuple[int, ...] = (5, 10, 15, 20, 50, 200), c: str = "close", mp: int | None = None) -> DataFrame:
    return per_block(
        bars, lambda d, f: d.withColumns({f"sma_{n}": f.mean(c, n, mp) for n in periods}), lookback=max(periods)
    )


def lagged_returns(bars: DataFrame, lags: int = 5) -> DataFrame:
    """diff, pct_change over 1/2/5/10 bars and lagged log returns."""

    def fn(d: DataFrame, f: Frame) -> DataFrame:
        d = d.withColumns({
            "diff_1": F.col("close") - f.lag("close"),
            **{f"ret_{k}": f.pct_change("close", k) for k in (1, 2, 5, 10)},
            "log_ret": F.log(F.try_divide(F.col("close"), f.lag("close"))),
        })
        return d.withColumns({f"log_ret_lag_{k}": f.lag("log_ret", k) for k in range(1, lags + 1)})

    return per_block(bars, fn, lookback=max(11, lags + 1))


def volatility(bars: DataFrame, n: int = 20, mp: int | None = None) -> DataFrame:
    """Sample deviation of daily returns, plain and annualised."""

    def fn(d: DataFrame, f: Frame) -> DataFrame:
        d = d.withColumn("ret_1", f.pct_change("close"))
        d = d.withColumn("ret_std", f.std("ret_1", n, mp))
        return d.withColumn("annual_vol", F.col("ret_std") * math.sqrt(252))

    return per_block(bars, fn, lookback=n + 1)


def rolling_extremes(bars: DataFrame, n: int = 14) -> DataFrame:
    return per_block(
        bars, lambda d, f: d.withColumns({"lowest": f.min("low", n, 1), "highest": f.max("high", n, 1)}), lookback=n
    )


def ema(bars: DataFrame, span: int, c: str = "close", mp: int | None = None, adjust: bool = True, name: str | None = None) -> DataFrame:
    alpha = 2 / (span + 1)
    mp = span if mp is None else mp
    return per_block(
        bars, lambda d, f: d.withColumn(name or f"ema_{span}", f.ewm(c, alpha, mp, adjust)), lookback=ewm_reach(alpha)
    )


def atr(bars: DataFrame, period: int = 14, mp: int = 1) -> DataFrame:
    return per_block(bars, lambda d, f: add_atr(d, f, period, mp), lookback=period + 1)


def atr_variants(bars: DataFrame, period: int = 14) -> DataFrame:
    """Core ATR; strict ATR falling back to 2 % (radar) or 1 % (intraday) of close; ATR as % of close."""

    def fn(d: DataFrame, f: Frame) -> DataFrame:
        d = add_atr(add_atr(d, f, period, 1, "atr"), f, period, period, "_strict")
        c = F.col("close")
        return d.withColumns({
            "atr_radar": F.coalesce(F.col("_strict"), c * 0.02),
            "atr_intraday": F.coalesce(F.col("_strict"), c * 0.01),
            "atr_pct": F.coalesce(F.when(c > 0, F.col("_strict") / c * 100), F.lit(5.0)),
        }).drop("_strict")

    return per_block(bars, fn, lookback=period + 1)


def rsi(bars: DataFrame, period: int = 14) -> DataFrame:
    return per_block(bars, lambda d, f: add_rsi(d, f, period), lookback=ewm_reach(1 / period) + 1)


def rsi_simple(bars: DataFrame, period: int = 14) -> DataFrame:
    """RSI on plain means of gains and losses."""

    def fn(d: DataFrame, f: Frame) -> DataFrame:
        d = d.withColumn("_d", F.col("close") - f.lag("close"))
        gain = F.when(F.col("_d").isNotNull(), F.greatest(F.col("_d"), F.lit(0.0)))
        loss = F.when(F.col("_d").isNotNull(), F.greatest(-F.col("_d"), F.lit(0.0)))
        rs = f.mean(gain, period) / nonzero(f.mean(loss, period))
        return d.withColumn("rsi_simple", 100 - 100 / (1 + rs)).drop("_d")

    return per_block(bars, fn, lookback=period + 1)


def adx(bars: DataFrame, period: int = 14) -> DataFrame:
    return per_block(bars, lambda d, f: add_adx(d, f, period), lookback=2 * ewm_reach(1 / period) + period + 2)


def macd(bars: DataFrame) -> DataFrame:
    return per_block(bars, add_macd, lookback=MACD_REACH)


def stochastic(bars: DataFrame, cfg: StochasticSettings = StochasticSettings()) -> DataFrame:
    return per_block(bars, lambda d, f: add_stochastic(d, f, cfg), lookback=cfg.k_period + cfg.slowing + cfg.d_period)


def spread_rank(bars: DataFrame, n: int = 20) -> DataFrame:
    def fn(d: DataFrame, f: Frame) -> DataFrame:
        d = d.withColumn("spread", F.greatest(F.col("high") - F.col("low"), F.lit(1e-6)))
        return d.withColumn("spread_rank_pct", rolling_rank_pct(f, "spread", n))

    return per_block(bars, fn, lookback=n)


def zscores(bars: DataFrame, n: int = 20, mp: int = 5) -> DataFrame:
    def fn(d: DataFrame, f: Frame) -> DataFrame:
        d = d.withColumn("ret_1", f.pct_change("close"))
        return d.withColumns({
            "volume_z": (F.col("volume") - f.mean("volume", n, mp)) / nonzero(f.std("volume", n, mp)),
            "return_z": F.col("ret_1") / nonzero(f.std("ret_1", n, mp)),
        })

    return per_block(bars, fn, lookback=n + 1)


def money_multiplier() -> Column:
    """Close location in the bar's range, -1..1; 0 for a bar without range."""
    rng = nonzero(F.col("high") - F.col("low"))
    return F.coalesce(((F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))) / rng, F.lit(0.0))


def obv_ad(bars: DataFrame, slope: int = 10) -> DataFrame:
    """Cumulative on-balance volume and accumulation/distribution lines with k-bar slopes."""
    d = per_block(
        bars, lambda d, f: d.withColumn("_dir", F.coalesce(F.signum(F.col("close") - f.lag("close")), F.lit(0.0))), lookback=1
    )
    d = running(d, {
        "obv": ("sum", F.col("_dir") * F.col("volume")),
        "ad_line": ("sum", money_multiplier() * F.col("volume")),
    }).drop("_dir")
    return per_block(d, lambda d, f: d.withColumns({
        "obv_slope": F.coalesce(F.col("obv") - f.lag("obv", slope), F.lit(0.0)),
        "ad_slope": F.coalesce(F.col("ad_line") - f.lag("ad_line", slope), F.lit(0.0)),
    }), lookback=slope)


def add_mfi(df: DataFrame, f: Frame, n: int = 14) -> DataFrame:
    df = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3.0)
    df = df.withColumn("_ptp", f.lag("_tp"))
    flow = F.col("_tp") * F.col("volume")
    df = df.withColumns({
        "_pos": F.when(F.col("_tp") > F.col("_ptp"), flow).otherwise(0.0),
        "_neg": F.when(F.col("_tp") < F.col("_ptp"), flow).otherwise(0.0),
    })
    ratio = f.sum("_pos", n) / nonzero(f.sum("_neg", n))
    df = df.withColumn("_mr", ratio)
    return df.withColumn("mfi", clip(F.coalesce(100 - 100 / (1 + F.col("_mr")), F.lit(50.0)), 0.0, 100.0)).drop(
        "_tp", "_ptp", "_pos", "_neg", "_mr"
    )


def add_cmf(df: DataFrame, f: Frame, n: int = 20) -> DataFrame:
    df = df.withColumn("_mfv", money_multiplier() * F.col("volume"))
    value = f.sum("_mfv", n) / nonzero(f.sum("volume", n))
    return df.withColumn("cmf", clip(F.coalesce(value, F.lit(0.0)), -1.0, 1.0)).drop("_mfv")


def mfi(bars: DataFrame, n: int = 14) -> DataFrame:
    return per_block(bars, lambda d, f: add_mfi(d, f, n), lookback=n + 1)


def cmf(bars: DataFrame, n: int = 20) -> DataFrame:
    return per_block(bars, lambda d, f: add_cmf(d, f, n), lookback=n)


def add_vwap_dev(df: DataFrame, f: Frame, n: int = 20, mp: int = 5) -> DataFrame:
    """Session relative volume (0..10) and deviation from rolling VWAP (+-0.2)."""
    df = df.withColumn("_tpv", (F.col("high") + F.col("low") + F.col("close")) / 3.0 * F.col("volume"))
    vwap = f.sum("_tpv", n, mp) / nonzero(f.sum("volume", n, mp))
    df = df.withColumns({"_vwap": vwap, "_vma": nonzero(f.mean("volume", n, mp))})
    return df.withColumns({
        "session_rel_volume": clip(F.coalesce(F.col("volume") / F.col("_vma"), F.lit(1.0)), 0.0, 10.0),
        "vwap_dev": clip(F.coalesce((F.col("close") - F.col("_vwap")) / F.col("_vwap"), F.lit(0.0)), -0.2, 0.2),
    }).drop("_tpv", "_vwap", "_vma")


def vwap_dev(bars: DataFrame) -> DataFrame:
    return per_block(bars, add_vwap_dev, lookback=20)


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0, squeeze_window: int = 100) -> DataFrame:
    """Band position and a squeeze flag (band width at its lowest quintile's scale: under 0.8 of its mean)."""

    def fn(d: DataFrame, f: Frame) -> DataFrame:
        d = d.withColumns({"bb_mid": f.mean("close", n), "_sd": f.std("close", n)})
        d = d.withColumns({"bb_upper": F.col("bb_mid") + k * F.col("_sd"), "bb_lower": F.col("bb_mid") - k * F.col("_sd")})
        d = d.withColumn("bb_width", F.try_divide(F.col("bb_upper") - F.col("bb_lower"), F.col("bb_mid")))
        return d.withColumns({
            "bb_position": (F.col("close") - F.col("bb_lower")) / nonzero(F.col("bb_upper") - F.col("bb_lower")),
            "bb_squeeze": truthy(F.col("bb_width") < 0.8 * f.mean("bb_width", squeeze_window, n)),
        }).drop("_sd")

    return per_block(bars, fn, lookback=n + squeeze_window)


def price_volume_divergence(bars: DataFrame, k: int = 20) -> DataFrame:
    d = obv_ad(bars)

    def fn(d: DataFrame, f: Frame) -> DataFrame:
        d = d.withColumns({
            "_ot": F.coalesce(F.col("obv") - f.lag("obv", k), F.lit(0.0)),
            "_pt": F.coalesce(F.col("close") - f.lag("close", k), F.lit(0.0)),
        })
        return d.withColumns({
            "obv_bullish_div": (F.col("_ot") > 0) & (F.col("_pt") < 0),
            "obv_bearish_div": (F.col("_ot") < 0) & (F.col("_pt") > 0),
        }).drop("_ot", "_pt")

    return per_block(d, fn, lookback=k)


def drawdown(bars: DataFrame, c: str = "close") -> DataFrame:
    d = running(bars, {"peak": ("max", c)})
    return d.withColumn("drawdown", F.try_divide(F.col(c) - F.col("peak"), F.col("peak")))


def fill(df: DataFrame, columns: list[str], back: bool = False) -> DataFrame:
    """Forward fill; with ``back`` the rows before the first value take it too (look-ahead)."""
    from tickloom.functions.series import running_from_end

    out = running(df, {f"_f_{c}": ("last", c) for c in columns})
    if back:
        out = running_from_end(out, {f"_b_{c}": ("last", f"_f_{c}") for c in columns})
    src = "_b_" if back else "_f_"
    for c in columns:
        out = out.withColumn(c, F.col(f"{src}{c}"))
    return out.drop(*[f"{p}{c}" for c in columns for p in ("_f_", "_b_")])


def crossover(df: DataFrame, a: str, b: str) -> DataFrame:
    def fn(d: DataFrame, f: Frame) -> DataFrame:
        pa, pb = f.lag(a), f.lag(b)
        return d.withColumns({
            "crossover": truthy((F.col(a) > F.col(b)) & (pa <= pb)),
            "crossunder": truthy((F.col(a) < F.col(b)) & (pa >= pb)),
        })

    return per_block(df, fn, lookback=1)


def prior_extremes(bars: DataFrame, n: int = 4) -> DataFrame:
    """Highest high / lowest low of the n bars before the current one."""
    return per_block(bars, lambda d, f: d.withColumns({
        "prior_high": F.max("high").over(f.rows(-n, -1)),
        "prior_low": F.min("low").over(f.rows(-n, -1)),
    }), lookback=n)


def forward_columns(bars: DataFrame, horizons: tuple[int, ...] = (1, 21)) -> DataFrame:
    """Next return and clipped forward log returns (targets: they look ahead by construction)."""

    def fn(d: DataFrame, f: Frame) -> DataFrame:
        return d.withColumns({
            "next_ret": F.try_divide(f.lead("close"), F.col("close")) - 1,
            **{f"target_{h}": clip(F.log(F.try_divide(f.lead("close", h), F.col("close"))), -1.0, 1.0) for h in horizons},
        })

    return per_block(bars, fn, lookahead=max(horizons))
