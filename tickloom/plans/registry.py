"""Collects (query, oracle) pairs of one module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.plans import sqlkit as q

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, query: Query, oracle: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"duplicate query {name}")
        self.queries[name] = query
        if oracle is not None:
            self.oracles[name] = oracle


def fix(c: Column | str, d: int) -> Column:
    """Round for comparison. The nudge moves exact decimal ties off the rounding edge, where two
    engines may fall on different sides."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + 10.0 ** -(d + 3), d)


KEY = ["symbol", "ts"]


def rounded(df, exact=(), r6=(), r4=(), keys=KEY):
    return df.select(*keys, *exact, *[fix(c, 6).alias(c) for c in r6], *[fix(c, 4).alias(c) for c in r4])


def sel(src: str, exact=(), r6=(), r4=(), keys=KEY, where: str = "") -> str:
    cols = [*keys, *exact] + [f"{q.fix(c, 6)} AS {c}" for c in r6] + [f"{q.fix(c, 4)} AS {c}" for c in r4]
    return f"SELECT {', '.join(cols)} FROM {src} {where}"
