"""Value at risk, sizing, portfolio weights, orders, entry outcomes and performance measures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import RiskSettings, StudySettings
from tickloom.functions.series import Frame, per_block, running, tail
from tickloom.operators.indicators import add_atr, clip, nonzero, truthy

# Lot sizes and contract multipliers.
LOT_SIZE = {"VN": 100, "US": 1, "COMMODITY": 1, "MACRO": 1}
MULTIPLIER = {"GC=F": 100.0, "SI=F": 5000.0, "CL=F": 1000.0, "NG=F": 10000.0, "HG=F": 25000.0}
YEAR = 252


def value_at_risk(curve: DataFrame, c: str = "close", confidence: float = 0.95, lookback: int = 252) -> DataFrame:
    """Historical VaR and CVaR of the recent curve per symbol; 0 under ten points. ``lookback`` bounds the
    rows and the array of one symbol."""
    recent = tail(curve, lookback)
    step = Window.partitionBy("symbol").orderBy("bar_no")
    r = recent.withColumn("_r", F.try_divide(F.col(c), F.lag(c).over(step)) - 1)
    q = 1 - confidence
    s = r.groupBy("symbol").agg(F.max("n_bars").alias("_n"), F.percentile("_r", q).alias("_v"), F.collect_list("_r").alias("_rs"), F.max_by(c, "bar_no").alias("_last"))
    bad = F.filter("_rs", lambda x: x <= F.col("_v"))
    cvar = F.coalesce(F.try_divide(F.aggregate(bad, F.lit(0.0), lambda a, x: a + x), F.size(bad)), F.col("_v"))
    few = (F.col("_n") < 10) | F.col("_v").isNull()
    zero = lambda x: F.when(few, 0.0).otherwise(F.abs(x))
    return s.select("symbol", zero(F.col("_v")).alias("var_pct"), zero(F.col("_v") * F.col("_last")).alias("var_value"), zero(cvar).alias("cvar_pct"))


def var_gate(bars: DataFrame, max_var_pct: float = 0.03) -> DataFrame:
    """Blocks symbols whose one-day VaR of the return path is too high; 40 bars at least."""
    path = bars.where(F.col("bar_no") >= 1)
    v = value_at_risk(path)
    d = bars.where(F.col("bar_no") == F.col("n_bars") - 1).select("symbol", "n_bars").join(v, "symbol", "left")
    pct = F.when(F.col("n_bars") < 40, 0.0).otherwise(F.coalesce("var_pct", F.lit(0.0)))
    return d.select("symbol", pct.alias("var_pct"), (pct > max_var_pct).alias("blocked"))


def _linkage_order(corr: np.ndarray) -> list[int]:
    """Leaf order of the single-linkage tree over distances between rows of the correlation distance."""
    dist = np.sqrt(np.clip(0.5 * (1 - corr), 0, None))
    n = len(dist)
    far = np.sqrt(((dist[:, None, :] - dist[None, :, :]) ** 2).sum(axis=2))
    i, j = np.triu_indices(n, 1)
    group = {k: (k, [k]) for k in range(n)}
    next_id = n
    for e in np.argsort(far[i, j], kind="stable"):
        a, b = group[int(i[e])], group[int(j[e])]
        if a[0] == b[0]:
            continue
        left, right = sorted((a, b), key=lambda g: g[0])
        merged = (next_id, left[1] + right[1])
        next_id += 1
        for k in merged[1]:
            group[k] = merged
    return group[0][1]


def _parity(pdf: pd.DataFrame) -> pd.DataFrame:
    names = sorted(set(pdf["a"]) | set(pdf["b"]))
    at = {s: k for k, s in enumerate(names)}
    n = len(names)
    corr, cov = np.eye(n), np.zeros((n, n))
    for a, b, r, v in zip(pdf["a"], pdf["b"], pdf["corr"].fillna(0.0), pdf["cov"].fillna(0.0)):
        x, y = at[a], at[b]
        corr[x, y] = corr[y, x] = 1.0 if x == y else r
        cov[x, y] = cov[y, x] = v

    def spread(items: list[int]) -> float:
        part = cov[np.ix_(items, items)]
        w = 1.0 / np.clip(np.diag(part), 1e-8, None)
        w /= w.sum()
        return float(w @ part @ w)

    weight = np.ones(n)
    queue = [_linkage_order(corr)] if n > 1 else []
    while queue:
        items = queue.pop(0)
        if len(items) < 2:
            continue
        one, two = items[: len(items) // 2], items[len(items) // 2:]
        v1, v2 = spread(one), spread(two)
        share = 1 - v1 / (v1 + v2)
        weight[one] *= share
        weight[two] *= 1 - share
        queue += [one, two]
    return pd.DataFrame({"portfolio_id": pdf["portfolio_id"].iloc[0], "symbol": names, "weight": weight})


def hrp_weights(pairs: DataFrame) -> DataFrame:
    """Hierarchical-risk-parity weights per portfolio from its pair table (a, b, corr, cov). The moments
    over all days come from Spark; a task only sees one portfolio's assets-by-assets matrix."""
    return pairs.groupBy("portfolio_id").applyInPandas(_parity, "portfolio_id string, symbol string, weight double")


def risk_budget(rows: DataFrame, risk: str = "risk", total: float = 1.0, by: str = "portfolio_id") -> DataFrame:
    """Share inversely proportional to risk, within each portfolio."""
    inv = rows.withColumn("_i", F.lit(1.0) / F.greatest(F.col(risk), F.lit(1e-6)))
    sums = inv.groupBy(by).agg(F.sum("_i").alias("_t"))
    return inv.join(sums, by).withColumn("budget", F.col("_i") / F.col("_t") * total).drop("_i", "_t")


def volatility_size(rows: DataFrame, cfg: RiskSettings = RiskSettings(), atr_multiplier: float = 2.0) -> DataFrame:
    """Shares risking a fixed share of capital per ATR stop, capped, times the crash multiplier column; none without a price."""
    stop = F.col("atr") * atr_multiplier
    most = F.try_divide(F.col("capital") * cfg.max_position_pct, F.col("entry_price"))
    size = F.least(F.try_divide(F.col("capital") * cfg.risk_per_trade, stop), most) * F.coalesce("crash_multiplier", F.lit(1.0))
    return rows.withColumn("shares", F.when((stop > 0) & (F.col("entry_price") > 0), size).otherwise(0.0))


def kelly_fraction(win_rate: Column, avg_win: Column, avg_loss: Column, cfg: RiskSettings = RiskSettings()) -> Column:
    b = F.try_divide(avg_win, F.abs(avg_loss))
    k = F.try_divide(win_rate * b - (F.lit(1.0) - win_rate), b) * cfg.kelly_fraction
    return F.when((avg_loss <= 0) | (win_rate <= 0), cfg.risk_per_trade).otherwise(F.greatest(F.lit(0.0), F.least(k, F.lit(cfg.max_position_pct))))


def orders(targets: DataFrame, cost: StudySettings = StudySettings()) -> DataFrame:
    """Orders from (symbol, market, weight, price, capital, position): lots, multipliers, difference to the
    position, costs; changes under one lot are dropped."""
    from tickloom.operators.clean import lookup

    lot, mult = lookup(F.col("market"), LOT_SIZE, 1), lookup(F.col("symbol"), MULTIPLIER, 1.0)
    d = targets.where(F.col("price") > 0).withColumns({"_lot": lot, "_mult": mult})
    qty = F.floor(F.col("capital") * F.col("weight") / (F.col("price") * F.col("_mult")) / F.col("_lot")) * F.col("_lot")
    d = d.withColumn("_diff", qty - F.coalesce("position", F.lit(0.0))).where(F.abs("_diff") >= F.col("_lot"))
    value = F.abs("_diff") * F.col("price") * F.col("_mult")
    return d.select(
        "symbol", "market", F.when(F.col("_diff") > 0, "BUY").otherwise("SELL").alias("action"), F.abs("_diff").cast("double").alias("quantity"), "price",
        value.alias("value"), (value * cost.commission_pct).alias("commission"), (value * cost.slippage_pct).alias("slippage"), "capital")


def capital_check(order_rows: DataFrame) -> DataFrame:
    need = F.sum(F.when(F.col("action") == "BUY", F.col("value") + F.col("commission") + F.col("slippage")).otherwise(0.0))
    return order_rows.agg(need.alias("required"), F.max("capital").alias("available")).withColumn("ok", F.col("required") <= F.col("available"))


def entry_outcomes(bars: DataFrame, signal: str = "signal", cfg: StudySettings = StudySettings()) -> DataFrame:
    """What became of every entry signal, each on its own: bought at the next open, left at the first
    trailing stop, take profit or opposite signal within ``horizon`` bars, else at the last bar seen.
    Entries fan out to their next bars and meet them on (symbol, bar), so cost is entries x horizon."""

    def prep(d: DataFrame, f: Frame) -> DataFrame:
        d = add_atr(d, f)
        return d.withColumns({"_a": F.when(F.col("atr") > 0, F.col("atr")).otherwise(F.col("close") * 0.02), "_sig": F.coalesce(f.lag(signal), F.lit(0))})

    d = per_block(bars, prep, lookback=16)
    entry = d.where(F.col("_sig") == 1).select("symbol", F.col("bar_no").alias("entry_no"), F.col("ts").alias("entry_ts"), (F.col("open") * (1 + cfg.slippage_pct)).alias("entry_price"),
                                                (F.col("open") * (1 + cfg.slippage_pct) - F.col("_a") * cfg.atr_multiplier).alias("_init"))
    fan = entry.withColumn("bar_no", F.explode(F.sequence(F.col("entry_no") + 1, F.col("entry_no") + cfg.horizon)))
    path = fan.join(d.select("symbol", "bar_no", "ts", "open", "close", "_a", "_sig"), ["symbol", "bar_no"])
    since = Window.partitionBy("symbol", "entry_no").orderBy("bar_no").rowsBetween(Window.unboundedPreceding, 0)
    path = path.withColumn("_stop", F.greatest("_init", F.max(F.col("close") - F.col("_a") * cfg.atr_multiplier).over(since)))
    reason = (
        F.when(F.col("close") <= F.col("_stop"), "TRAILING_STOP").when(F.try_divide(F.col("close") - F.col("entry_price"), F.col("entry_price")) >= cfg.take_profit, "TAKE_PROFIT")
        .when(F.col("_sig") == -1, "SIGNAL_EXIT"))
    path = path.withColumn("_why", reason)
    price = F.when(F.col("_why") == "SIGNAL_EXIT", F.col("open")).otherwise(F.col("close")) * (1 - cfg.slippage_pct)
    out = F.struct(F.col("bar_no").alias("exit_no"), F.col("ts").alias("exit_ts"), price.alias("exit_price"), F.coalesce("_why", F.lit("END_OF_DATA")).alias("exit_reason"))
    closed = path.groupBy("symbol", "entry_no", "entry_ts", "entry_price").agg(
        F.coalesce(F.min_by(F.when(F.col("_why").isNotNull(), out), F.when(F.col("_why").isNotNull(), F.col("bar_no"))), F.max_by(out, "bar_no")).alias("_o"))
    d = closed.select("symbol", "entry_no", "entry_ts", "entry_price", "_o.*")
    gross = F.try_divide(F.col("exit_price") - F.col("entry_price"), F.col("entry_price"))
    return d.withColumns({"pnl_pct": gross, "pnl_net_pct": F.try_divide(F.col("exit_price") * (1 - cfg.commission_pct) - F.col("entry_price"), F.col("entry_price"))})


def trade_metrics(trades: DataFrame, by: str = "strategy", pnl: str = "pnl") -> DataFrame:
    p = F.col(pnl)
    win, loss = F.when(p > 0, p), F.when(p <= 0, p)
    d = trades.groupBy(by).agg(
        F.count(F.lit(1)).alias("num_trades"), F.sum(p).alias("total_pnl"), (F.count(win) / F.count(F.lit(1))).alias("win_rate"), F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss"), F.coalesce(F.sum(win), F.lit(0.0)).alias("_gp"), F.when(F.count(loss) > 0, F.abs(F.sum(loss))).otherwise(1.0).alias("_gl"),
        F.max(p).alias("best_trade"), F.min(p).alias("worst_trade"), F.avg(p).alias("expectancy"))
    return d.withColumn("profit_factor", F.when(F.col("_gl") > 0, F.try_divide(F.col("_gp"), F.col("_gl")))).drop("_gp", "_gl")


def kelly_from_trades(trades: DataFrame, by: str = "strategy", pnl: str = "pnl", min_trades: int = 20, base: float = 0.10) -> DataFrame:
    m = trade_metrics(trades, by, pnl)
    k = kelly_fraction(F.col("win_rate"), F.col("avg_win"), F.abs("avg_loss"))
    usable = (F.col("num_trades") >= min_trades) & (F.col("avg_win") > 0) & (F.col("avg_loss") < 0)
    return m.select(by, "win_rate", F.when(usable, clip(k, 0.0, base)).otherwise(base).alias("kelly_weight"))


def curve_metrics(curve: DataFrame, c: str = "close", trades_per_year: float = 0.0) -> DataFrame:
    """Sharpe, Sortino (population deviation), drawdown, Calmar and turnover-adjusted Sharpe per symbol."""
    d = per_block(curve, lambda d, f: d.withColumn("_r", f.pct_change(c)), lookback=1)
    d = running(d, {"_peak": ("max", c)})
    dn = F.when(F.col("_r") < 0, F.col("_r"))
    s = d.groupBy("symbol").agg(
        F.avg("_r").alias("_m"), F.stddev_pop("_r").alias("_s"), F.count(dn).alias("_nd"), F.stddev_pop(dn).alias("_sd"), F.min(F.try_divide(F.col(c) - F.col("_peak"), F.col("_peak"))).alias("max_drawdown"),
        F.min_by(c, "bar_no").alias("_first"), F.max_by(c, "bar_no").alias("_last"))
    root = YEAR ** 0.5
    total = F.try_divide(F.col("_last") - F.col("_first"), F.col("_first"))
    sharpe = F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * root).otherwise(0.0)
    return s.select(
        "symbol", total.alias("total_return"), sharpe.alias("sharpe"), F.when((F.col("_nd") > 1) & (F.col("_sd") > 0), F.try_divide(F.col("_m"), F.col("_sd")) * root).otherwise(0.0).alias("sortino"),
        "max_drawdown", F.when(F.col("max_drawdown") != 0, F.abs(F.try_divide(total, F.col("max_drawdown")))).otherwise(0.0).alias("calmar"), (sharpe / (1.0 + trades_per_year)).alias("turnover_adjusted_sharpe"))


def hit_rate(bars: DataFrame, signal: str = "signal") -> DataFrame:
    """Share of active signals whose sign agrees with the next return, in percent."""
    d = per_block(bars, lambda d, f: d.withColumn("_nx", F.try_divide(f.lead("close"), F.col("close")) - 1), lookahead=1)
    s = F.col(signal)
    right = truthy(((s > 0) & (F.col("_nx") > 0)) | ((s < 0) & (F.col("_nx") < 0)))
    return d.where(s != 0).groupBy("symbol").agg((F.avg(right.cast("double")) * 100).alias("hit_rate"), F.count(F.lit(1)).alias("n_active"))


def filter_entries(rows: DataFrame, base: float = 0.10, confidence_weight: bool = True) -> DataFrame:
    """Sentiment veto, model-conflict sizing and confidence scaling of entry signals."""
    sig = F.when((F.col("signal") == 1) & (F.col("sentiment_bias") == -1), 0).otherwise(F.col("signal"))
    d = rows.withColumn("effective_signal", sig)
    clash = (F.col("ai_confidence") > 0.25) & (F.col("effective_signal") != 0) & (F.col("effective_signal") != F.col("ai_bias"))
    scaled = F.col("ai_confidence") * base if confidence_weight else F.lit(base)
    return d.withColumns({"ai_conflict": clash, "weight": F.when(F.col("effective_signal") != 1, 0.0).when(clash, base * 0.2).otherwise(scaled)})


def circuit_breaker(curve: DataFrame, c: str = "close", cfg: RiskSettings = RiskSettings()) -> DataFrame:
    """Halted from a drawdown of 15 % until it has recovered to 5 %: the last of the two crossings decides."""
    d = running(curve, {"_peak": ("max", c)})
    dd = F.try_divide(F.col("_peak") - F.col(c), F.col("_peak"))
    d = d.withColumn("drawdown", dd)
    mark = F.when(F.col("drawdown") >= cfg.max_drawdown_pct, True).when(F.col("drawdown") <= cfg.recovery_threshold, False)
    d = running(d, {"_state": ("last", mark)})
    return d.withColumn("halted", F.coalesce("_state", F.lit(False))).drop("_peak", "_state")


def trailing_stops(entries: DataFrame, k: float = 3.0) -> DataFrame:
    """Ratcheting stop of open entries: rows (symbol, entry_id, bar_no, n_bars, close, atr); an entry lives
    over its own bars, which bounds the window."""
    w = Window.partitionBy("symbol", "entry_id").orderBy("bar_no").rowsBetween(Window.unboundedPreceding, 0)
    d = entries.withColumn("trail_stop", F.max(F.col("close") - F.col("atr") * k).over(w))
    return d.withColumn("triggered", F.col("close") <= F.col("trail_stop"))
