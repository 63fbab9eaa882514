"""Landed tables: bars, instruments, fundamentals, positioning, flow, listings and reports.

Each reader takes a path and returns a DataFrame with an explicit schema; each writer is one write job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators import clean, joins
from tickloom.operators.context import positioning_columns
from tickloom.functions.series import index_bars
from tickloom.session import materialize

BAR_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampNTZType()),
    *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")], T.StructField("market", T.StringType()),
])
# Field names of stored fundamentals and column headers of positioning files.
FUNDAMENTAL_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("market", T.StringType()), T.StructField("updated", T.TimestampNTZType()),
    *[T.StructField(c, T.DoubleType()) for c in ("roe", "debt_to_equity", "eps_growth", "pe_ratio", "fcf_yield", "revenue_growth", "profit_margin")],
])
METRICS = [f.name for f in FUNDAMENTAL_SCHEMA.fields[3:]]
COT_COLUMNS = {
    "Open_Interest_All": "open_interest", "Comm_Positions_Long_All": "commercial_long", "Comm_Positions_Short_All": "commercial_short",
    "NonComm_Positions_Long_All": "noncomm_long", "NonComm_Positions_Short_All": "noncomm_short",
}


# ---- bars --------------------------------------------------------------------------------------------


def read_bars(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, market: str | None = None, min_rows: int = 0) -> DataFrame:
    """Bars with the range and market filters pushed to the scan; ``min_rows`` drops short symbols."""
    d = spark.read.schema(BAR_SCHEMA).parquet(path)
    if market:
        d = d.where(F.col("market") == market)
    if start:
        d = d.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        d = d.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    if min_rows:
        d = d.join(d.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows).select("symbol"), "symbol", "left_semi")
    return d


def merge_bars(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing and new rows, the newest ingest winning per session, cleaned and repaired."""
    stacked = existing.withColumn("ingest_seq", F.lit(0)).unionByName(new.withColumn("ingest_seq", F.lit(1)), allowMissingColumns=True)
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    last = joins.keep_last(stacked.withColumn("ts", day), ["symbol", "ts"], "ingest_seq")
    sessions = clean.canonical_sessions(clean.normalize_units(last))
    return clean.repair_scale_breaks(index_bars(sessions)).drop("bar_no", "n_bars")


def write_bars(bars: DataFrame, path: str) -> None:
    """Replace only the market partitions present in ``bars``; rows are clustered by symbol and time."""
    keep = [f.name for f in BAR_SCHEMA.fields]
    (bars.select(*keep).repartition("market", "symbol").sortWithinPartitions("market", "symbol", "ts").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("market").parquet(path))


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BAR_SCHEMA).option("header", True).csv(path)


def read_bars_first(spark: SparkSession, path: str, csv: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars from the parquet store, and from CSV files for the symbols that the store does not have at all; a symbol comes from one
    source, also where the other has more days. The range is taken afterwards, so it does not change the source."""
    stored, spare = spark.read.schema(BAR_SCHEMA).parquet(path), read_bars_csv(spark, csv)
    missing = spare.join(stored.select("symbol").distinct(), "symbol", "left_anti")
    d = stored.withColumn("source", F.lit("parquet")).unionByName(missing.withColumn("source", F.lit("csv")))
    if start:
        d = d.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return d.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz")) if end else d


def asset_bundles(instruments: DataFrame, bars: DataFrame, fundamentals: DataFrame, start: str, end: str, page: str = "year") -> DataFrame:
    """Every instrument with its fundamentals (null without) and its bars from ``start`` to ``end`` as nested rows: one row per symbol and
    calendar ``page``, numbered from 1, which bounds the arrays. A symbol without bars in the range has one page without bars."""
    ts = F.col("ts")
    b = bars.where((ts >= F.lit(start).cast("timestamp_ntz")) & (ts <= F.lit(end).cast("timestamp_ntz")))
    item = F.struct("ts", "open", "high", "low", "close", "volume")
    pages = b.groupBy("symbol", F.date_trunc(page, ts).cast("timestamp_ntz").alias("page_start")).agg(F.array_sort(F.collect_list(item)).alias("bars"))
    order = Window.partitionBy("symbol").orderBy("page_start")
    pages = pages.withColumns({"page": F.row_number().over(order), "pages": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    info = instruments.select("symbol", F.struct(*instruments.columns).alias("info")).join(fundamentals.select("symbol", F.struct(*fundamentals.columns).alias("fundamentals")), "symbol", "left")
    d = info.join(pages, "symbol", "left")
    return d.withColumns({"page": F.coalesce("page", F.lit(1)), "pages": F.coalesce("pages", F.lit(1)), "bars": F.coalesce("bars", F.array().cast(pages.schema["bars"].dataType))})


def bar_stats(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# ---- instruments and fundamentals --------------------------------------------------------------------


def fresh(rows: DataFrame, now: Column, max_age_hours: int, column: str = "updated") -> DataFrame:
    return rows.where(F.col(column) >= now - F.make_dt_interval(hours=F.lit(max_age_hours)))


def write_fundamentals(rows: DataFrame, path: str) -> None:
    """JSON rows; those without a single metric are not written."""
    rows.where(F.coalesce(*METRICS).isNotNull()).write.mode("append").json(path)


def read_fundamentals(spark: SparkSession, path: str, now: Column, max_age_hours: int = 168) -> DataFrame:
    d = fresh(spark.read.schema(FUNDAMENTAL_SCHEMA).json(path), now, max_age_hours)
    return joins.keep_last(d, ["symbol", "market"], "updated")


# ---- positioning, flow, listings ---------------------------------------------------------------------


def short_date(c: Column) -> Column:
    """Date of a yyMMdd text; years 69-99 belong to the last century."""
    century = F.when(F.substring(c, 1, 2).cast("int") >= 69, "19").otherwise("20")
    return F.to_date(F.concat(century, c), "yyyyMMdd")


def read_positioning_csv(spark: SparkSession, path: str, contract: str) -> DataFrame:
    """Weekly positioning of one contract from yearly CSV files, with derived columns."""
    raw = spark.read.option("header", True).csv(path)
    d = raw.where(F.trim("CFTC_Contract_Market_Code") == contract).select(
        F.lit(contract).alias("symbol"), short_date(F.trim("As_of_Date_In_Form_YYMMDD")).cast("timestamp_ntz").alias("ts"),
        *[F.trim(src).try_cast("double").alias(dst) for src, dst in COT_COLUMNS.items()])
    return positioning_columns(index_bars(d, chunk="year"))


def apply_flow(bars: DataFrame, saved: DataFrame, new: DataFrame, fx: float = 1.0) -> DataFrame:
    """Persisted flow rows and today's, newest per day, joined to the bars that exist."""
    rows = saved.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
    return joins.merge_flow(bars, joins.keep_last(rows, ["symbol", "ts"], "_o").drop("_o"), fx)


def build_panel(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """Training panel: every symbol's bars on the benchmark's days with relative strength."""
    return joins.with_benchmark(bars, bench, "index_close")


def extract_listing(pages: DataFrame, pattern: str, suffix: Column, text: str = "html") -> DataFrame:
    """Instrument rows found in listing pages by a two-group pattern, the last page winning per symbol."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("code"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("name"))
    d = pages.select("page_id", F.posexplode(pairs).alias("_i", "_p")).select("page_id", "_i", "_p.code", F.trim("_p.name").alias("name"))
    d = d.withColumn("symbol", F.concat("code", suffix))
    return joins.keep_last(d.withColumn("_o", F.struct("page_id", "_i")).drop("_i"), ["symbol"], "_o").drop("_o", "page_id")


def coverage(universe: DataFrame, bars: DataFrame, min_rows: int = 1) -> DataFrame:
    """ok / empty / failed share of a universe: no rows at all means failed, too few means empty."""
    have = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    d = universe.select("symbol").distinct().join(have, "symbol", "left")
    status = F.when(F.col("_n").isNull(), "failed").when(F.col("_n") < min_rows, "empty").otherwise("ok")
    counts = d.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
    total = d.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("pct", F.round(F.col("n") / total * 100, 2))


# ---- scan results and reports --------------------------------------------------------------------------


def write_scan(rows: DataFrame, path: str, scan_date: str, scope: str) -> None:
    """JSON rows (NaN as null) and one metadata row."""
    tidy = rows.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in rows.schema.fields if isinstance(f.dataType, T.DoubleType)})
    tidy.write.mode("overwrite").json(f"{path}/results")
    meta = rows.agg(F.count(F.lit(1)).alias("total_candidates"), F.max("institutional_score").alias("best_score")).withColumns(
        {"scan_date": F.lit(scan_date), "market_scope": F.lit(scope)})
    meta.write.mode("overwrite").json(f"{path}/meta")


def read_scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/results")


def snapshot(rows: DataFrame, picks: int = 10) -> DataFrame:
    """One JSON document: counts and the best picks of each grade (a bounded array)."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("entry_quality_grade").orderBy(F.desc("institutional_score"), "symbol"))
    top = rows.withColumn("_r", rank).where(F.col("_r") <= picks)
    item = F.struct(F.col("_r").alias("rank"), "symbol", "market", "institutional_score")
    per = lambda g: F.array_sort(F.collect_list(F.when(F.col("entry_quality_grade") == g, item)))
    lists = top.agg(per("A").alias("top_a"), per("C").alias("grade_c_watchout"))
    n = lambda g: rows.agg(F.count_if(F.col("entry_quality_grade") == g)).scalar()
    total = rows.agg(F.count(F.lit(1))).scalar()
    return lists.select(F.to_json(F.struct(
        total.alias("total_candidates"), F.struct(n("A").alias("grade_a"), n("B").alias("grade_b"), n("C").alias("grade_c")).alias("counts"), "top_a", "grade_c_watchout")).alias("snapshot"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def report_tables(rows: DataFrame, n: int = 20) -> dict[str, DataFrame]:
    """The report's tables: top picks, short-term picks, per-market rankings, sizing, all, metadata."""
    meta = rows.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("mid_rating").contains("Strong Buy")).alias("mid_strong"), F.count_if(F.col("short_rating").contains("Strong Buy")).alias("short_strong"))
    sizing = ["symbol", "market", "sector", "last_close", "mid_rating", "short_rating", "composite_score", "annual_vol_pct", "risk_level", "allocation_pct", "amount_million", "shares", "stop_loss_pct"]
    return {
        "top_picks": rows.where(F.col("rank") <= n), "short_term_picks": rows.orderBy("short_rank"), "vn_ranking": rows.where(F.col("market") == "VN").orderBy("market_rank"),
        "tw_ranking": rows.where(F.col("market") == "TW").orderBy("market_rank"), "position_sizing": rows.select(*sizing).orderBy(F.desc_nulls_last("allocation_pct"), "symbol"),
        "all_stocks": rows, "scan_info": meta,
    }


def write_report(rows: DataFrame, path: str, n: int = 20) -> None:
    """One CSV folder per table; the ranked rows are computed once and read back for each."""
    rows = materialize(rows, "report_rows")
    for name, df in report_tables(rows, n).items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def newest_ratings(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Ratings of every symbol from the file that landed last."""
    d = spark.read.schema(schema).json(path).withColumns({"_t": F.col("_metadata.file_modification_time"), "_f": F.col("_metadata.file_name")})
    rest = [c for c in d.columns if c not in ("symbol", "_t", "_f")]
    return d.groupBy("symbol").agg(F.max_by(F.struct(*rest), F.struct("_t", "_f")).alias("_r")).select("symbol", "_r.*")
