"""Headlines to sentiment, asset impact, geopolitical events and an execution gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.clean import lookup
from tickloom.operators.indicators import clip
from tickloom.operators.joins import keep_first

# Keyword weights, headline rules, severity and source tables.
SENTIMENT_WEIGHTS = {
    "bullish": 0.5, "upbeat": 0.4, "growth": 0.3, "higher": 0.3, "record": 0.4, "bearish": -0.5, "fear": -0.4,
    "recession": -0.6, "lower": -0.3, "drop": -0.4, "war": -0.7, "hike": -0.3, "crisis": -0.6, "inflation": -0.2,
}
IMPACT_RULES = (
    ("iran", "High", "Bullish", ("BSR.VN", "OIL", "GAS"), "Oil supply risk"),
    ("hormuz", "Critical", "Bullish", ("BSR.VN", "OIL"), "Global shipping bottleneck"),
    ("war", "Medium", "Mixed", ("GOLD", "USD"), "Safe haven draw"),
    ("fertilizer", "High", "Bullish", ("DPM.VN", "DCM.VN"), "Supply chain disruption"),
    ("supply", "Medium", "Bullish", ("BSR.VN", "DPM.VN"), "Scarcity factor"),
)
EVENT_RULES = (
    (("hormuz", "strait", "shipping", "transit", "tanker", "vessel", "chokepoint", "port closure", "route disruption"), "SHIPPING_DISRUPTION", "HIGH", 0.78),
    (("missile", "drone", "strike", "military", "navy", "airstrike", "conflict", "escalat", "war"), "MILITARY_ESCALATION", "CRITICAL", 0.82),
    (("sanction", "embargo", "restriction", "blacklist", "compliance action"), "SANCTIONS_ENFORCEMENT", "MEDIUM", 0.70),
    (("insurance", "war-risk premium", "premium jumped", "underwriting stress"), "INSURANCE_STRESS", "HIGH", 0.74),
    (("pipeline", "refinery", "terminal", "infrastructure", "outage", "explosion", "sabotage"), "INFRA_ATTACK", "HIGH", 0.76),
    (("ceasefire", "de-escalat", "reopen", "diplomatic talks", "truce", "agreement"), "DIPLOMATIC_DEESCALATION", "MEDIUM", 0.68),
)
REGION_WORDS = ("hormuz", "iran", "gulf", "middle east")
PUBLISHER_GRADES = (
    ("REUTERS", "A"), ("BLOOMBERG", "A"), ("FINANCIAL TIMES", "A"), ("WALL STREET JOURNAL", "A"), ("WSJ", "A"),
    ("CNBC", "B"), ("YAHOO", "B"), ("MARKETWATCH", "B"), ("INVESTING.COM", "C"),
)
CATEGORY_BONUS = {"Geopolitics": 0.07, "Energy": 0.04}
SEVERITY_WEIGHT = {"LOW": 0.25, "MEDIUM": 0.5, "HIGH": 0.8, "CRITICAL": 1.0}
EVENT_WEIGHT = {
    "SHIPPING_DISRUPTION": 1.0, "MILITARY_ESCALATION": 1.0, "SANCTIONS_ENFORCEMENT": 0.7, "DIPLOMATIC_DEESCALATION": -0.8,
    "INSURANCE_STRESS": 0.6, "INFRA_ATTACK": 1.0,
}
SOURCE_WEIGHT = {"A": 1.0, "B": 0.8, "C": 0.6, "D": 0.4}
EVENT_SPELLINGS = {
    "timestamp": "event_ts", "time": "event_ts", "type": "event_type", "sev": "severity", "conf": "confidence",
    "source_grade": "source_quality", "title": "headline",
}
EVENT_DEFAULTS = {"confidence": 0.6, "source_quality": "B", "severity": "MEDIUM", "region": "Hormuz", "headline": "", "event_type": ""}


@dataclass(frozen=True)
class GeoSettings:
    half_life_hours: float = 36.0
    reduce_threshold: float = 0.45
    pause_threshold: float = 0.70
    max_move_pct: float = 6.0
    lookback_hours: int = 72
    stale_minutes: int = 180
    min_events: int = 2


def keyword_score(text: Column) -> Column:
    """Sum of the weights of the keywords contained in the text, clipped to +-1."""
    low = F.lower(text)
    total = sum((F.when(low.contains(w), v).otherwise(0.0) for w, v in SENTIMENT_WEIGHTS.items()), F.lit(0.0))
    return clip(total, -1.0, 1.0)


def newest_per_key(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """Newest ``n`` rows of each key. Spark limits each partition to n rows per key before the shuffle
    (WindowGroupLimit), so a busy key reaches one task with a few rows per map task only."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def headline_sentiment(headlines: DataFrame, key: str = "symbol", order: str = "ts", n: int = 10) -> DataFrame:
    """Mean keyword score of the newest headlines per symbol with a label at +-0.1."""
    d = newest_per_key(headlines, key, order, n).groupBy(key).agg(F.avg(keyword_score(F.col("headline"))).alias("_s"), F.count(F.lit(1)).alias("n_headlines"))
    s = F.col("_s")
    return d.select(key, F.bround(s, 4).alias("score"), F.when(s > 0.1, "BULLISH").when(s < -0.1, "BEARISH").otherwise("NEUTRAL").alias("label"), "n_headlines")


def sentiment_bias(score: Column, threshold: float = 0.2) -> Column:
    return F.when(score >= threshold, 1).when(score <= -threshold, -1).otherwise(0)


def half_even(c: Column, digits: int) -> Column:
    """Half-even on the scaled value, as SQL's ``round_even``: a decimal tie that arithmetic has moved by an ulp is still one
    (``bround`` rounds the shortest decimal of the double, and takes 54.949999999999996 to 54.9)."""
    return F.rint(c * 10.0**digits) / 10.0**digits


def composite_sentiment(df: DataFrame) -> DataFrame:
    """60/30/10 blend of ``news_score``, ``social_score`` and ``fear_greed`` (0-100), with a confidence."""
    news, social = F.col("news_score"), F.col("social_score")
    comp = news * 0.6 + social * 0.3 + (F.col("fear_greed") - 50) / 50 * 0.1
    agree = F.when(news * social > 0, 1.0).otherwise(0.7)
    conf = (F.abs(comp) * 0.5 + 0.5) * agree * 100
    return df.withColumns({
        "composite_score": half_even(comp, 4), "confidence": half_even(F.least(conf, F.lit(99.0)), 1), "sentiment_bias": sentiment_bias(comp),
    })


def first_rule(text: Column, rules: list[tuple[Column, Column]]) -> Column:
    """Value of the first rule whose condition holds (an ordered CASE, no join)."""
    out = None
    for cond, value in rules:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """True when the text holds any of the words: plain substring tests, which stop at the first hit and
    are far cheaper on long texts than a case-insensitive alternation pattern."""
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def matched(rule: Column) -> Column:
    """Keeps the rows with a match. A generator, because a filter on the match would be pushed below the
    lower-casing and repeat it for every word."""
    return F.explode(F.array_compact(F.array(rule)))


def news_impact(headlines: DataFrame) -> DataFrame:
    """Asset impact of each headline by its first matching keyword; one row per affected asset."""
    low = F.col("_low")
    rules = [
        (low.contains(k), F.struct(F.lit(i).alias("impact"), F.lit(d).alias("direction"), F.array(*[F.lit(t) for t in targets]).alias("targets"), F.lit(r).alias("reason")))
        for k, i, d, targets, r in IMPACT_RULES
    ]
    d = headlines.withColumn("_low", F.lower("headline")).select("*", matched(first_rule(low, rules)).alias("_m"))
    return d.select(*headlines.columns, "_m.impact", "_m.direction", "_m.reason", F.explode("_m.targets").alias("asset"))


def publisher_grade(name: Column) -> Column:
    up = F.upper(name)
    graded = first_rule(up, [(up.contains(k), F.lit(g)) for k, g in PUBLISHER_GRADES])
    return F.when(F.coalesce(name, F.lit("")) == "", "C").otherwise(F.coalesce(graded, F.lit("B")))


def headline_events(headlines: DataFrame) -> DataFrame:
    """Headlines that match an event rule, as events (type, severity, confidence, grade, region)."""
    low = F.col("_low")
    rules = [
        (contains_any(low, words), F.struct(F.lit(t).alias("event_type"), F.lit(s).alias("severity"), F.lit(c).alias("base")))
        for words, t, s, c in EVENT_RULES
    ]
    d = headlines.withColumns({"headline": F.trim("headline"), "_low": F.lower("headline"), "source_quality": publisher_grade(F.col("publisher"))})
    d = d.where(F.col("headline") != "").select("*", matched(first_rule(low, rules)).alias("_e"))
    conf = F.col("_e.base") + lookup(F.col("category"), CATEGORY_BONUS, 0.0) + lookup(F.col("source_quality"), {"A": 0.06, "D": -0.08}, 0.0)
    return d.withColumns({
        "event_type": F.col("_e.event_type"), "severity": F.col("_e.severity"), "confidence": clip(conf, 0.20, 0.98),
        "region": F.when(contains_any(low, REGION_WORDS), "Hormuz").otherwise("Global"),
    }).drop("_e", "_low")


def normalize_events(raw: DataFrame) -> DataFrame:
    """Canonical event columns from common spellings, with defaults for what is missing."""
    d = raw.withColumnsRenamed({k: v for k, v in EVENT_SPELLINGS.items() if k in raw.columns and v not in raw.columns})
    d = d.withColumns({c: F.lit(v) for c, v in EVENT_DEFAULTS.items() if c not in d.columns})
    tidy = lambda c: F.upper(F.trim(F.col(c).cast("string")))
    return d.withColumns({
        "event_type": tidy("event_type"), "severity": tidy("severity"), "source_quality": tidy("source_quality"),
        "confidence": clip(F.coalesce(F.col("confidence").cast("string").try_cast("double"), F.lit(0.6)), 0.0, 1.0),
        "headline": F.col("headline").cast("string"),
    })


def dedupe_headlines(headlines: DataFrame, order: str) -> DataFrame:
    return keep_first(headlines, ["headline"], order)


def geo_risk(events: DataFrame, now: Column, cfg: GeoSettings = GeoSettings(), keys: tuple[str, ...] = ()) -> DataFrame:
    """Decayed event risk in [0, 1] with support and de-escalation counts, from one aggregate."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("event_ts").cast("timestamp"))) / 3_600_000_000.0
    kind = lookup(F.col("event_type"), EVENT_WEIGHT, 0.25)
    raw = (
        kind * lookup(F.col("severity"), SEVERITY_WEIGHT, 0.5) * lookup(F.col("source_quality"), SOURCE_WEIGHT, 0.7)
        * F.col("confidence") * F.exp(age * (-0.6931471805599453 / max(cfg.half_life_hours, 1.0)))
    )
    d = events.select(*keys, raw.alias("_r"), kind.alias("_k"), "event_ts").groupBy(*keys).agg(
        F.avg("_r").alias("_mean"), F.max("_r").alias("_max"), F.count_if(F.col("_k") > 0).cast("double").alias("support_count"),
        F.count_if(F.col("_k") < 0).cast("double").alias("deescalation_count"), F.count(F.lit(1)).alias("n_events"),
        F.max("event_ts").alias("latest_event_ts"),
    )
    risk = clip(F.col("_mean") + F.col("_max") * 0.35, -1.0, 1.0)
    return d.withColumn("geo_risk_score", F.coalesce(clip((risk + 1.0) / 2.0, 0.0, 1.0), F.lit(0.0))).drop("_mean", "_max")


def causal_map(risk: DataFrame, cfg: GeoSettings = GeoSettings()) -> DataFrame:
    g = F.col("geo_risk_score")
    p = F.lit(1.0) / (F.exp((g - 0.5) * -7.0) + 1.0)
    return risk.withColumns({
        "prob_oil_up_1d": p, "expected_oil_move_1d_pct": (p - 0.5) * 2.0 * cfg.max_move_pct,
        "tail_risk_flag": (g >= cfg.pause_threshold).cast("double"),
    })


def execution_gate(risk: DataFrame, now: Column | None = None, cfg: GeoSettings = GeoSettings()) -> DataFrame:
    """NORMAL / REDUCE_SIZE / PAUSE_NEW_LONGS with a size multiplier; an old or thin feed is defensive."""
    g = F.col("geo_risk_score")
    pause, reduce = g >= cfg.pause_threshold, g >= cfg.reduce_threshold
    stale = F.lit(False)
    if now is not None:
        age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("latest_event_ts").cast("timestamp"))) / 60_000_000.0
        stale = (F.col("n_events") < cfg.min_events) | F.coalesce(age > cfg.stale_minutes, F.lit(True))
    return risk.withColumns({
        "gate_stale": stale,
        "gate_action": F.when(stale, "REDUCE_SIZE").when(pause, "PAUSE_NEW_LONGS").when(reduce, "REDUCE_SIZE").otherwise("NORMAL"),
        "gate_multiplier": F.when(stale, 0.6).when(pause, 0.0).when(reduce, 0.5).otherwise(1.0),
    })
