"""Market readers and operator chains."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Reader = Callable[[SparkSession, str | None, str | None], DataFrame]
Operator = Callable[[DataFrame], DataFrame]

_READERS: dict[str, Reader] = {}


def register(market: str, reader: Reader) -> None:
    """Bind a market id to a reader ``(spark, start, end) -> bars``."""
    _READERS[market.upper()] = reader


def markets() -> list[str]:
    return sorted(_READERS)


def read(spark: SparkSession, market: str, start: str | None = None, end: str | None = None) -> DataFrame:
    if market.upper() not in _READERS:
        raise KeyError(f"no reader for market {market!r}; known: {markets()}")
    return _READERS[market.upper()](spark, start, end)


def read_all(spark: SparkSession, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of every registered market, stacked."""
    out = None
    for m in markets():
        d = _READERS[m](spark, start, end)
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    if out is None:
        raise KeyError("no market reader is registered")
    return out


def chain(bars: DataFrame, *operators: Operator) -> DataFrame:
    """Apply operators in order; each adds its ``*_signal`` and ``*_reason`` columns."""
    for op in operators:
        bars = bars.transform(op)
    return bars
