"""Bars that are merged in place: versioned parts by market and year, of which a merge rewrites only those that it touches.

A part is a folder that is never changed once a manifest names it. Merging batch n reads the touched parts of manifest n - 1, writes their
new versions under the batch's own folder, and then writes manifest n, a small table of (market, bucket, batch). Readers take the newest
manifest, so they see all of a merge or nothing of it; a batch that runs again after a failure starts from the same manifest and replaces
its own folder. Rows are spread over files by ranges of symbol and time, so a part's size does not matter, nor does that of a symbol.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.joins import keep_last
from tickloom.sources.store import BAR_SCHEMA

#: Rows of one file, about.
FILE_ROWS = 2_000_000
#: Markets times buckets that a manifest may list.
MOST_PARTS = 100_000

_MANIFEST = "market string, bucket string, batch long"


class BarStore:
    def __init__(self, spark: SparkSession, path: str, bucket: str = "yyyy") -> None:
        self.spark, self.path, self.bucket = spark, path.rstrip("/"), bucket
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def batches(self) -> list[int]:
        """Numbers of the finished merges; a manifest counts once its write has succeeded."""
        if not self._fs.exists(self._at("manifest")):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._at("manifest"))]
        return sorted(int(n.removeprefix("v=")) for n in found if n.startswith("v=") and self._fs.exists(self._at(f"manifest/{n}/_SUCCESS")))

    def manifest(self, batch: int | None = None) -> list:
        """(market, bucket, batch) of the parts as of a batch, by default the newest."""
        done = [b for b in self.batches() if batch is None or b <= batch]
        if not done:
            return []
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/v={done[-1]}").limit(MOST_PARTS + 1).collect()
        if len(rows) > MOST_PARTS:
            raise ValueError(f"more than {MOST_PARTS} parts; use longer buckets")
        return rows

    def _load(self, parts: list) -> DataFrame:
        folders = [f"{self.path}/data/batch={p.batch}/market={p.market}/bucket={p.bucket}" for p in parts]
        if not folders:
            return self.spark.createDataFrame([], BAR_SCHEMA)
        d = self.spark.read.option("basePath", f"{self.path}/data").schema(BAR_SCHEMA).parquet(*folders)
        return d.select(*[f.name for f in BAR_SCHEMA.fields])

    def read(self, start: str | None = None, end: str | None = None, markets: list[str] | None = None, batch: int | None = None) -> DataFrame:
        """Bars from ``start`` to ``end``, as of a batch; parts of other markets and years are not opened."""
        edge = lambda t: self.spark.range(1).select(F.date_format(F.lit(t).cast("timestamp_ntz"), self.bucket)).first()[0] if t else None
        lo, hi = edge(start), edge(end)
        parts = [p for p in self.manifest(batch) if (markets is None or p.market in markets) and (lo is None or p.bucket >= lo) and (hi is None or p.bucket <= hi)]
        d = self._load(parts)
        if start:
            d = d.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
        return d.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz")) if end else d

    def merge(self, new: DataFrame, batch: int) -> list:
        """Adds ``new`` bars, which win over existing ones of the same symbol and time (of several, the one with the highest ``ingest_seq`` if there is such a
        column). Batches count up; returns the new manifest. A batch without bars changes nothing but the manifest's number."""
        later = [b for b in self.batches() if b > batch]
        if later:
            raise ValueError(f"batch {later[-1]} is merged already")
        rows = new.withColumn("bucket", F.date_format("ts", self.bucket))
        touched = {(r.market, r.bucket) for r in rows.select("market", "bucket").distinct().limit(MOST_PARTS + 1).collect()}
        if len(touched) > MOST_PARTS:
            raise ValueError(f"more than {MOST_PARTS} parts in one batch; use longer buckets")
        base = self.manifest(batch - 1)
        columns = [f.name for f in BAR_SCHEMA.fields]
        order = F.col("ingest_seq").cast("long") if "ingest_seq" in new.columns else F.lit(0).cast("long")
        old = self._load([p for p in base if (p.market, p.bucket) in touched]).withColumn("_order", F.lit(-(1 << 62)).cast("long"))
        merged = keep_last(old.unionByName(rows.withColumn("_order", order).select(*columns, "_order")), ["market", "symbol", "ts"], "_order").select(*columns)
        merged = merged.withColumn("bucket", F.date_format("ts", self.bucket))
        merged = merged.repartitionByRange("market", "bucket", "symbol", "ts").sortWithinPartitions("market", "bucket", "symbol", "ts")
        if touched:
            merged.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy("market", "bucket").parquet(f"{self.path}/data/batch={batch}")
        parts = [(p.market, p.bucket, p.batch) for p in base if (p.market, p.bucket) not in touched] + [(m, b, batch) for m, b in touched]
        self.spark.createDataFrame(sorted(parts), _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={batch}")
        return self.manifest(batch)

    def drop_before(self, batch: int) -> None:
        """Removes manifests before ``batch`` and the parts that no later one names."""
        for n in self.batches():
            if n < batch:
                self._fs.delete(self._at(f"manifest/v={n}"), True)
        keep = {p.batch for n in self.batches() for p in self.manifest(n)}
        for status in self._fs.listStatus(self._at("data")):
            n = int(status.getPath().getName().removeprefix("batch="))
            if n < batch and n not in keep:
                self._fs.delete(status.getPath(), True)
