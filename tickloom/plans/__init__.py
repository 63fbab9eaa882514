"""Registered queries and their DuckDB twins, one module per operator family."""

from __future__ import annotations

from importlib import import_module

_MODULES = [
    "indicator_checks", "clean_join_checks", "flow_context_checks", "smc_checks", "wyckoff_elliott_checks", "scanner_checks", "risk_ml_checks", "stream_checks", "source_checks",
]


def load() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in _MODULES:
        mod = import_module(f"tickloom.plans.{name}")
        queries.update(mod.QUERIES)
        oracles.update(mod.ORACLES)
    return queries, oracles
