"""Directional bias per timeframe and their agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timeframe_bias(rows: DataFrame, wyckoff_bias: str | None = None) -> DataFrame:
    """Bias from structure and signal. The Wyckoff term is off unless a bias column is named, as its
    source state carries none."""
    s = F.when(F.col("structure") == "Bullish", 1).when(F.col("structure") == "Bearish", -1).otherwise(0) + F.signum(F.coalesce("signal", F.lit(0)).cast("double")).cast("int")
    if wyckoff_bias:
        b = F.col(wyckoff_bias)
        s = s + F.when(b.isin("Bullish", "Markup"), 1).when(b.isin("Bearish", "Markdown"), -1).otherwise(0)
    d = rows.withColumn("bull_score", s)
    v = F.col("bull_score")
    return d.withColumn("bias", F.when(v >= 2, "Bullish").when(v <= -2, "Bearish").when(v == 1, "Lean Bullish").when(v == -1, "Lean Bearish").otherwise("Neutral"))


def confluence(biases: DataFrame) -> DataFrame:
    """Sum of the timeframe scores, number of agreeing timeframes and label per symbol."""
    v = F.col("bull_score")
    d = biases.groupBy("symbol").agg(F.sum(v).alias("confluence_score"), F.greatest(F.count_if(v > 0), F.count_if(v < 0)).alias("alignment"))
    c = F.col("confluence_score")
    return d.withColumns({
        "confluence_label": F.when(c >= 5, "🟢 Strong Bullish").when(c >= 2, "🟢 Lean Bullish").when(c <= -5, "🔴 Strong Bearish").when(c <= -2, "🔴 Lean Bearish").otherwise("⚪ Neutral / Mixed"),
        "agreement": F.when(F.col("alignment") == 3, "ALL").when(F.col("alignment") == 2, "TWO_OF_THREE").otherwise("CONFLICT"),
    })
