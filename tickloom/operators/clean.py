"""Cleaning: names, symbols, units, sessions, scale breaks, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.series import exact_median, index_bars, is_last, per_block, running_from_end

PRICES = ("open", "high", "low", "close")
OHLCV = (*PRICES, "volume")

# Accepted spellings, market time zones, units.
COLUMN_SPELLINGS = {"adj close": "close", "adj_close": "close", "date": "ts", "datetime": "ts", "timestamp": "ts"}
SUFFIXES = (".TWO", "_TWO", ".TW", "_TW", ".VN", "_VN", ".US", "_US")
MARKET_ZONE = {"VN": "Asia/Ho_Chi_Minh", "TW": "Asia/Taipei"}
UNIT_CEILING = 1000.0
UNIT_RATIO = 100.0
SCALE_JUMP = 2.0


def missing(df: DataFrame, columns: tuple[str, ...] | list[str]) -> list[str]:
    return [c for c in columns if c not in df.columns]


def neutral(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Neutral result columns for an input that lacks what an operator needs."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def neutral_when_short(df: DataFrame, min_bars: int, values: dict[str, object]) -> DataFrame:
    """Neutral values on symbols with fewer than ``min_bars`` bars."""
    return df.withColumns(
        {k: F.when(F.col("n_bars") < min_bars, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()}
    )


def normalize_columns(df: DataFrame) -> DataFrame:
    """Lower-case canonical names. A table without all of OHLCV and a time is an error."""
    by_name: dict[str, str] = {}
    for c in df.columns:
        low = c.strip().lower()
        target = COLUMN_SPELLINGS.get(low, low.replace(" ", "_"))
        if target not in by_name or low == target:
            by_name[target] = c
    out = df.select(*[F.col(f"`{src}`").alias(dst) for dst, src in by_name.items()])
    if missing(out, [*OHLCV, "ts"]):
        raise ValueError(f"no column for {', '.join(missing(out, [*OHLCV, 'ts']))}")
    return out.withColumn("ts", F.to_timestamp_ntz(F.col("ts").cast("string"))).withColumns(
        {c: F.col(c).cast("double") for c in OHLCV}
    )


def clean_symbol(c: Column) -> Column:
    for suffix in SUFFIXES:
        c = F.replace(c, F.lit(suffix), F.lit(""))
    return F.upper(F.translate(c, ".=-", "___"))


def vendor_ticker(symbol: Column, market: Column) -> Column:
    return (
        F.when(market == "VN", F.concat(clean_symbol(symbol), F.lit(".VN")))
        .when(market == "TW", F.when(symbol.endswith(".TWO"), symbol).otherwise(F.concat(clean_symbol(symbol), F.lit(".TW"))))
        .otherwise(symbol)
    )


def infer_market(symbol: Column) -> Column:
    s = F.upper(symbol)
    return (
        F.when(s.endswith(".VN"), "VN")
        .when(s.endswith(".TW") | s.endswith(".TWO") | s.rlike(r"^\d+$"), "TW")
        .otherwise("US")
    )


def is_cash_equity(symbol: Column, market: Column) -> Column:
    s, m = F.upper(symbol), F.upper(market)
    return s.endswith(".VN") | s.endswith(".TW") | s.endswith(".TWO") | m.isin("VN", "VIETNAM", "VN_STOCK", "TW", "TAIWAN")


def safe_number(c: Column, default: float | None = 0.0) -> Column:
    """Numeric value of a string; anything else, NaN and infinities give the default."""
    x = c.try_cast("double")
    ok = ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.when(ok, x), F.lit(default).cast("double"))


def finite_or_zero(c: Column) -> Column:
    return F.coalesce(F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c), F.lit(0.0))


def normalize_price(price: Column, exempt: Column | None = None) -> Column:
    """One price in full units: values under the ceiling were quoted in thousands."""
    scaled = F.when((price > 0) & (price < UNIT_CEILING), price * 1000.0).otherwise(price)
    return scaled if exempt is None else F.when(exempt, price).otherwise(scaled)


def normalize_units(bars: DataFrame, exempt: Column | None = None) -> DataFrame:
    """Bring each symbol's mixed thousand/unit quotes to units, judged against its median close."""
    med = exact_median(bars, "close", name="_med")
    limit = F.when(F.col("_med") < UNIT_CEILING, F.lit(UNIT_CEILING)).otherwise(
        F.least(F.lit(UNIT_CEILING), F.col("_med") / UNIT_RATIO)
    )
    hit = F.coalesce((F.col("close") > 0) & (F.col("close") < limit), F.lit(False))
    if exempt is not None:
        hit = hit & ~exempt
    out = bars.join(med, "symbol", "left").withColumn("_hit", hit)
    return out.withColumns({c: F.when(F.col("_hit"), F.col(c) * 1000.0).otherwise(F.col(c)) for c in PRICES}).drop(
        "_med", "_hit"
    )


def canonical_sessions(rows: DataFrame, order: str = "ingest_seq", drop_untraded: bool = True) -> DataFrame:
    """One bar per (symbol, session day): traded rows first, then the fullest, then the newest.
    ``max_by`` keeps it a partial aggregation, so a day with many copies is combined before the shuffle."""
    traded = F.coalesce(F.col("volume") > 0, F.lit(False)).cast("int")
    quality = sum((F.col(c).isNotNull().cast("int") for c in OHLCV), F.lit(0))
    rest = [c for c in rows.columns if c not in ("symbol", "ts", order)]
    best = rows.where(F.col("ts").isNotNull()).groupBy(
        "symbol", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("session")
    ).agg(F.max_by(F.struct(*rest), F.struct(traded, quality, F.col(order))).alias("_r"))
    out = best.select("symbol", F.col("session").alias("ts"), "_r.*")
    return out.where(F.col("volume") > 0) if drop_untraded else out


def scale_is_consistent(bars: DataFrame) -> DataFrame:
    """Per symbol: every close is within 100x of the previous one and there is at least one pair."""
    d = per_block(bars, lambda d, f: d.withColumn("_r", F.col("close") / F.nullif(f.lag("close"), F.lit(0.0))), lookback=1)
    inside = F.col("_r").between(0.01, 100.0)
    return d.groupBy("symbol").agg(
        (F.coalesce(F.bool_and(inside), F.lit(False)) & (F.count("_r") > 0)).alias("consistent")
    )


def repair_scale_breaks(bars: DataFrame) -> DataFrame:
    """Undo up to two unit jumps per symbol by scaling the rows before each; with more jumps, or when a
    jump stays, keep only the rows from the last jump on."""

    def ratios(d: DataFrame, f) -> DataFrame:
        d = d.withColumn("_ratio", F.col("close") / F.nullif(f.lag("close"), F.lit(0.0)))
        jump = (F.abs(F.log("_ratio")) >= SCALE_JUMP) & ((F.col("_ratio") > 100) | (F.col("_ratio") < 0.005))
        return d.withColumn("_lr", F.when(jump, F.log("_ratio")))

    d = per_block(bars, ratios, lookback=1)
    d = running_from_end(d, {"_suffix": ("sum", F.coalesce(F.col("_lr"), F.lit(0.0)))})
    d = d.withColumn("_later", F.exp(F.col("_suffix") - F.coalesce(F.col("_lr"), F.lit(0.0))))
    d = d.withColumns({f"_{c}": F.when(F.col("_later") == 1.0, F.col(c)).otherwise(F.col(c) * F.col("_later")) for c in PRICES})
    d = per_block(
        d, lambda d, f: d.withColumn("_left", F.abs(F.log(F.col("_close") / F.nullif(f.lag("_close"), F.lit(0.0))))), lookback=1
    )
    state = d.groupBy("symbol").agg(
        F.count("_lr").alias("_breaks"),
        F.max(F.when(F.col("_lr").isNotNull(), F.col("bar_no"))).alias("_last"),
        F.max("_left").alias("_worst"),
    )
    d = d.join(state, "symbol")
    cut = (F.col("_breaks") > 2) | ((F.col("_breaks") > 0) & (F.col("_worst") > SCALE_JUMP))
    d = d.where(~cut | (F.col("bar_no") >= F.col("_last")))
    d = d.withColumns({c: F.when(cut | (F.col("_breaks") == 0), F.col(c)).otherwise(F.col(f"_{c}")) for c in PRICES})
    return d.drop("_ratio", "_lr", "_suffix", "_later", "_left", "_breaks", "_last", "_worst", *[f"_{c}" for c in PRICES])


def floor_minutes(ts: Column, minutes: int) -> Column:
    secs = F.unix_timestamp(ts.cast("timestamp"))
    return F.timestamp_seconds(secs - secs % (minutes * 60)).cast("timestamp_ntz")


def confirmed_candles(bars: DataFrame, now: Column, minutes: int, order: str = "ingest_seq") -> DataFrame:
    """Closed bars only. A symbol whose series has no time of day and no repeated day is a daily
    series handed in by mistake and is dropped whole. Of repeated bars the last by ``order`` (if there is such a
    column), then by value, is kept."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    kinds = bars.groupBy("symbol", day.alias("_day")).agg(
        F.count(F.lit(1)).alias("_n"), F.bool_or(F.col("ts") != day).alias("_timed")
    ).groupBy("symbol").agg((F.bool_or("_timed") | (F.max("_n") > 1)).alias("_intraday"))
    rest = [c for c in bars.columns if c not in ("symbol", "ts")]
    return (
        bars.join(kinds.where("_intraday").select("symbol"), "symbol", "left_semi")
        .where(F.col("ts") < floor_minutes(now, minutes))
        .groupBy("symbol", "ts").agg(F.max_by(F.struct(*rest), F.struct(*([order] if order in rest else []), *rest)).alias("_r")).select("symbol", "ts", "_r.*")
    )


def validate_intraday(bars: DataFrame, now: Column) -> DataFrame:
    """(ok, reason) per symbol for an hourly feed, first failing rule wins."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")

    def fn(d: DataFrame, f) -> DataFrame:
        prev = f.lag("close")
        return d.withColumns({"_ratio": F.col("close") / F.nullif(prev, F.lit(0.0)), "_day": day, "_same": f.lag(day) == day})

    d = per_block(bars, fn, lookback=1)
    s = d.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.count("_ratio").alias("pairs"),
        F.coalesce(F.bool_and(F.col("_ratio").between(0.01, 100.0)), F.lit(False)).alias("same_unit"),
        F.bool_or(F.col("ts") != F.col("_day")).alias("timed"), F.coalesce(F.bool_or("_same"), F.lit(False)).alias("repeated"),
        F.bool_or(F.col("close").isNull() | (F.col("close") <= 0)).alias("bad_price"),
        F.max(F.abs(F.col("_ratio") - 1)).alias("jump"), F.max("ts").alias("latest"),
    )
    reason = (
        F.when(F.col("n") < 14, "Need at least 14 H1 bars")
        .when(~F.col("same_unit") | (F.col("pairs") == 0), "Mixed price units")
        .when(~(F.col("timed") & F.col("repeated")), "Daily fallback is not an intraday feed")
        .when(F.col("bad_price"), "Invalid H1 prices")
        .when(F.col("jump") > 0.15, "Implausible H1 price jump")
        .when(now - F.col("latest") > F.expr("INTERVAL 4 DAYS"), "H1 data is stale")
        .otherwise("OK")
    )
    return s.select("symbol", (reason == "OK").alias("ok"), reason.alias("reason"))


def previous_weekday(d: Column) -> Column:
    back = F.when(F.weekday(d) == 5, 1).when(F.weekday(d) == 6, 2).otherwise(0)
    return F.date_sub(d, back)


def expected_session(now_utc: Column, market: str = "VN", settle: tuple[int, int] | None = (15, 15)) -> Column:
    """Newest session a daily series should contain at ``now_utc``. With ``settle`` a weekday's bar
    counts only after that local time."""
    local = F.from_utc_timestamp(now_utc, MARKET_ZONE[market])
    day = local.cast("date")
    if settle:
        early = (F.weekday(day) < 5) & (F.hour(local) * 60 + F.minute(local) < settle[0] * 60 + settle[1])
        day = F.when(early, F.date_sub(day, 1)).otherwise(day)
    return previous_weekday(day)


def fresh_symbols(bars: DataFrame, expected: Column) -> DataFrame:
    """Rows of symbols whose newest session reaches the expected one."""
    newest = bars.where(is_last()).where(F.col("ts").cast("date") >= expected).select("symbol")
    return bars.join(newest, "symbol", "left_semi")


def market_open(now_utc: Column, scope: str = "VN_TW") -> Column:
    local = F.from_utc_timestamp(now_utc, MARKET_ZONE["TW"])
    minutes = F.hour(local) * 60 + F.minute(local)
    tw = minutes.between(9 * 60, 13 * 60 + 45)
    vn = (minutes - 60).between(9 * 60, 15 * 60)
    rule = {"TW": tw, "VN": vn}.get(scope.upper(), tw | vn)
    return (F.weekday(local) < 5) & rule


def point_in_time(bars: DataFrame, reference: Column) -> tuple[DataFrame, DataFrame]:
    """(history up to and including the reference day, outcome rows from it on)."""
    day = F.date_trunc("day", reference).cast("timestamp_ntz")
    return bars.where(F.col("ts") < day + F.expr("INTERVAL 1 DAY")), bars.where(F.col("ts") >= day + F.expr("INTERVAL 1 DAY"))


def first_existing(df: DataFrame, candidates: list[str], default: object = None) -> Column:
    """The first of several possible column names that the table has, chosen at plan time."""
    for c in candidates:
        if c in df.columns:
            return F.col(c)
    return F.lit(default)


def to_percent(c: Column) -> Column:
    return F.when(F.abs(c) < 1, c * 100).otherwise(c)


def universe(listing: DataFrame, exchanges: tuple[str, ...] = ("HOSE", "HNX")) -> DataFrame:
    return listing.where(F.col("exchange").isin(*exchanges)).select("symbol").distinct()


def lookup(c: Column, table: dict[str, float], default: float) -> Column:
    """Category to number with a default."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[c], F.lit(default))


def search_instruments(dim: DataFrame, text: str, blacklist: tuple[str, ...] = (), limit: int = 10) -> DataFrame:
    """Ranked instrument search: exact symbols first, markets by priority, the general market only when
    no priority market answers, one row per base symbol there."""
    q = text.strip().lower()
    sym, base = F.lower("symbol"), F.upper(F.split("symbol", r"\.")[0])
    exact = (sym == q) | (F.lower(base) == q)
    loose = sym.startswith(q) if len(q) <= 3 else (
        sym.contains(q) | F.lower("name").contains(q) | F.lower("sector").contains(q)
    )
    priority = F.when(F.col("market") == "COMMODITY", 0).when(F.col("market") == "TW", 1).when(
        F.col("market") == "VN", 2).when(F.col("market") == "US", 3).otherwise(99)
    hits = dim.where(exact | loose).where(~F.upper("symbol").isin(*blacklist) if blacklist else F.lit(True))
    hits = hits.withColumns({"_exact": F.when(exact, 0).otherwise(1), "_prio": priority, "base": base})
    from_priority = hits.where(F.col("market") != "US").agg(F.count(F.lit(1))).scalar()
    hits = hits.where((F.col("market") != "US") | (from_priority == 0))
    return hits.orderBy("_exact", "_prio", "symbol").limit(limit).drop("_exact", "_prio")
