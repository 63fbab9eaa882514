"""Month-of-year context by asset type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.indicators import clip

# Monthly scores January..December by asset type, and the symbol patterns of each type.
CALENDAR = {
    "GOLD": (0.2, 0.3, 0.1, 0.0, -0.2, -0.1, 0.1, 0.5, 0.6, 0.3, 0.4, 0.2),
    "SILVER": (0.1, 0.3, 0.2, 0.1, -0.3, -0.2, 0.0, 0.4, 0.5, 0.2, 0.3, 0.1),
    "CRUDE_OIL": (-0.1, 0.1, 0.3, 0.4, 0.5, 0.4, 0.3, 0.1, -0.2, -0.3, -0.2, 0.0),
    "VN": (0.6, 0.5, 0.4, 0.2, 0.0, -0.1, -0.2, -0.5, -0.4, 0.1, 0.3, 0.4),
    "TW": (0.3, 0.2, 0.1, -0.1, -0.3, -0.2, 0.1, 0.3, 0.5, 0.4, 0.2, 0.0),
    "US": (0.3, 0.2, 0.1, 0.2, -0.1, -0.1, 0.1, -0.2, -0.4, 0.0, 0.4, 0.5),
    "CRYPTO": (0.4, 0.2, 0.1, 0.3, -0.1, -0.3, 0.2, 0.1, 0.0, 0.4, 0.5, 0.3),
}
TYPE_PATTERNS = (
    ("GOLD", "GC|GOLD|XAU"), ("SILVER", "SI|SILVER|XAG"), ("CRUDE_OIL", "CL|OIL|CRUDE|WTI|BRENT"),
    ("CRYPTO", "BTC|ETH|SOL|BNB|CRYPTO|-USD"),
)
STRONG, ADVERSE = 0.4, -0.3


def asset_type(symbol: Column, market: Column) -> Column:
    s = F.upper(symbol)
    out = None
    for kind, pattern in TYPE_PATTERNS:
        out = F.when(s.rlike(pattern), kind) if out is None else out.when(s.rlike(pattern), kind)
    return out.when((market == "VN") | s.endswith(".VN"), "VN").when((market == "TW") | s.endswith(".TW"), "TW").otherwise("US")


def _by_type(kind: Column, value) -> Column:
    out = None
    for k, scores in CALENDAR.items():
        v = value(scores)
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out


def _next_strong(scores: tuple[float, ...]) -> list[int]:
    """Months until the next strong month, per month (0 when the year has none)."""
    return [next((k for k in range(1, 13) if scores[(m + k) % 12] >= STRONG), 0) for m in range(12)]


def seasonality(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Seasonal score, size weight, adverse flag and distance to the next strong month. The calendars are
    literals picked by CASE, so nothing is joined."""
    month = F.month(ts)
    kind = asset_type(F.col("symbol"), F.col("market"))
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), month)
    d = df.withColumn("asset_type", kind)
    k = F.col("asset_type")
    d = d.withColumn("seasonality_score", _by_type(k, pick)).withColumn("_away", _by_type(k, lambda s: pick(_next_strong(s))))
    s = F.col("seasonality_score")
    return d.withColumns({
        "seasonality_weight": clip(s * 0.5 + 1.0, 0.5, 1.5), "seasonality_adverse": s <= ADVERSE,
        "months_to_strong": F.nullif(F.col("_away"), F.lit(0)),
    }).drop("_away")
