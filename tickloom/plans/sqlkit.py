"""DuckDB text fragments shared by the oracle queries."""

from __future__ import annotations

import math

P = "PARTITION BY symbol ORDER BY bar_no"

_OHLCV = """first(px ORDER BY {seq}) AS open, max(px) AS high, min(px) AS low,
 last(px ORDER BY {seq}) AS close, sum(q) AS volume"""

TRADES = """trades AS (SELECT p_brand AS symbol, date_trunc('day', l_shipdate) AS ts,
 l_extendedprice / l_quantity AS px, l_quantity AS q, l_orderkey AS k1, l_linenumber AS k2, l_extendedprice AS k3
 FROM lineitem JOIN part ON l_partkey = p_partkey)"""

_SEQ = "k1, k2, k3, q"


def numbered(name: str, src: str) -> str:
    return (
        f"{name} AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_no,"
        f" count(*) OVER (PARTITION BY symbol) AS n_bars FROM {src})"
    )


DAILY = ", ".join([
    TRADES,
    f"b0 AS (SELECT symbol, CAST(ts AS TIMESTAMP) AS ts, {_OHLCV.format(seq=_SEQ)}, "
    "CASE CAST(replace(symbol, 'Brand#', '') AS INT) % 3 WHEN 0 THEN 'VN' WHEN 1 THEN 'TW' ELSE 'US' END AS market "
    "FROM trades GROUP BY symbol, ts)",
    numbered("bars", "b0"),
])

BENCH = (
    f"x0 AS (SELECT 'ALL' AS symbol, CAST(ts AS TIMESTAMP) AS ts, {_OHLCV.format(seq=_SEQ)} FROM trades GROUP BY ts), "
    + numbered("bench", "x0")
)

HOURLY = ", ".join([
    "ticks AS (SELECT event_type AS symbol, ts, date_trunc('hour', ts) AS h, value AS px, 1.0::DOUBLE AS q, event_id FROM events)",
    f"h0 AS (SELECT symbol, CAST(h AS TIMESTAMP) AS ts, {_OHLCV.format(seq='ts, event_id')} FROM ticks GROUP BY symbol, h)",
    numbered("hours", "h0"),
])

POSITIONING = ", ".join([
    """p0 AS (SELECT CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS ts,
 CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS open_interest,
 CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS commercial_short,
 CAST(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS commercial_long,
 'ALL' AS symbol FROM orders GROUP BY 1)""",
    numbered("pos", "p0"),
])


def sql(ctes: str | list[str], final: str) -> str:
    if isinstance(ctes, str):
        ctes = [ctes]
    return "WITH " + ",\n".join(ctes) + "\n" + final


def back(n: int) -> str:
    return f"({P} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def rows(a: int, b: int) -> str:
    side = lambda k: "CURRENT ROW" if k == 0 else f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"
    return f"({P} ROWS BETWEEN {side(a)} AND {side(b)})"


RUN = f"({P} ROWS UNBOUNDED PRECEDING)"


def _roll(fn: str, c: str, n: int, mp: int | None) -> str:
    mp = n if mp is None else mp
    v = f"{fn}({c}) OVER {back(n)}"
    return f"(CASE WHEN count({c}) OVER {back(n)} >= {mp} THEN {v} END)" if mp > 0 else f"({v})"


def mean(c: str, n: int, mp: int | None = None) -> str:
    return _roll("avg", c, n, mp)


def std(c: str, n: int, mp: int | None = None) -> str:
    return _roll("stddev_samp", c, n, mp)


def total(c: str, n: int, mp: int | None = None) -> str:
    return _roll("sum", c, n, mp)


def low(c: str, n: int, mp: int | None = None) -> str:
    return _roll("min", c, n, mp)


def high(c: str, n: int, mp: int | None = None) -> str:
    return _roll("max", c, n, mp)


def lag(c: str, n: int = 1) -> str:
    return f"lag({c}, {n}) OVER ({P})"


def lead(c: str, n: int = 1) -> str:
    return f"lead({c}, {n}) OVER ({P})"


def ewm(c: str, alpha: float, mp: int = 0) -> str:
    k = -math.log(1 - alpha)
    wt = f"exp({k!r} * bar_no)"
    v = f"(sum(({c}) * {wt}) OVER {RUN} / sum(CASE WHEN ({c}) IS NOT NULL THEN {wt} END) OVER {RUN})"
    return f"(CASE WHEN count({c}) OVER {RUN} >= {mp} THEN {v} END)" if mp else v


def clip(c: str, lo: float, hi: float) -> str:
    return f"(CASE WHEN ({c}) IS NOT NULL THEN greatest(least(({c}), {float(hi)!r}), {float(lo)!r}) END)"


TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"


def step(name: str, src: str, **cols: str) -> str:
    """A CTE that adds columns to another one."""
    return f"{name} AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in cols.items()) + f" FROM {src})"


def chain(src: str, *layers: dict[str, str], prefix: str = "l") -> tuple[list[str], str]:
    """Successive ``step``s; returns the CTEs and the last name."""
    out = []
    for i, layer in enumerate(layers):
        name = f"{prefix}{i}"
        out.append(step(name, src, **layer))
        src = name
    return out, src


RSI_LAYERS = [
    {"dlt": f"close - {lag('close')}"},
    {
        "ag": ewm("CASE WHEN dlt > 0 THEN dlt ELSE 0 END", 1 / 14, 14),
        "al": ewm("CASE WHEN dlt < 0 THEN -dlt ELSE 0 END", 1 / 14, 14),
    },
    {"rsi": "coalesce(100 - 100 / (1 + ag / nullif(al, 0)), 50)"},
]

ATR_LAYERS = [{"tr": TR}, {"atr": mean("tr", 14, 1)}]

ADX_LAYERS = [
    {"adx_up": f"high - {lag('high')}", "adx_dn": f"{lag('low')} - low", "adx_tr": TR},
    {"adx_p": "CASE WHEN adx_up > adx_dn AND adx_up > 0 THEN adx_up ELSE 0 END", "adx_atr": mean("adx_tr", 14, 1)},
    {"adx_m": "CASE WHEN adx_dn > adx_p AND adx_dn > 0 THEN adx_dn ELSE 0 END"},
    {
        "pdi": f"100 * ({ewm('adx_p', 1 / 14, 14)} / nullif(adx_atr, 0))",
        "mdi": f"100 * ({ewm('adx_m', 1 / 14, 14)} / nullif(adx_atr, 0))",
    },
    {"dx": "100 * (abs(pdi - mdi) / nullif(pdi + mdi, 0))"},
    {"adx": f"coalesce({ewm('dx', 1 / 14, 14)}, 0)"},
]

STOCH_LAYERS = [
    {"st_lo": low("low", 14, 1), "st_hi": high("high", 14, 1)},
    {"st_raw": "coalesce((close - st_lo) / nullif(st_hi - st_lo, 0) * 100, 50)"},
    {"st_k": mean("st_raw", 3, 1)},
    {"st_d": mean("st_k", 3, 1)},
    {"st_pk": lag("st_k"), "st_pd": lag("st_d")},
    {
        "stoch_k": clip("st_k", 0, 100),
        "stoch_d": clip("st_d", 0, 100),
        "stoch_status": "CASE WHEN st_k <= 20 THEN 'OVERSOLD' WHEN st_k >= 80 THEN 'OVERBOUGHT' ELSE 'NEUTRAL' END",
        "stoch_crossover": "coalesce(st_k > st_d AND st_pk <= st_pd, false)",
        "stoch_crossunder": "coalesce(st_k < st_d AND st_pk >= st_pd, false)",
    },
]

MFM = "coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0)"


def fix(c: str, d: int) -> str:
    return f"round(({c}) + {10.0 ** -(d + 3)!r}, {d})"
