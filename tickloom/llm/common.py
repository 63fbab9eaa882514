"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as white space inside texts: the six ASCII characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Elements of a merged array that one record carries; rows that Python code gets at a time.
CHUNK, ROWS = 4096, 512


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


class Carried:
    """A broadcast value that travels with the code of its classes, as task functions do: executors need no copy of this package."""

    def __init__(self, sc: SparkContext, value: Any) -> None:
        self._held = sc.broadcast(cloudpickle.dumps(value))

    @property
    def value(self) -> Any:
        if isinstance(self._held.value, bytes):  # once in a worker, whose tasks share the broadcast
            self._held._value = pickle.loads(self._held.value)
        return self._held.value


def release() -> None:
    """Gives memory that a task has freed back to the machine: workers stay, and wait idle beside stages that need no Python."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's batches, a bounded number of rows at a time; memory is given back at the end."""
    try:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                yield whole.slice(at, ROWS)
    finally:
        release()


def with_arrow_column(df: DataFrame, name: str, kind: T.DataType, source: str, make: Callable[[], Callable[[list], pa.Array]]) -> DataFrame:
    """``df`` with column ``name`` (replaced if it is there) computed from ``source`` in Arrow batches.

    ``make`` runs once per task and gives the function from a batch's values to the new array. Where that has an attribute
    ``forget``, it is called at the end of the task, to drop what was remembered from batch to batch.
    """
    if source not in df.columns:
        raise ValueError(f"no column {source}")
    schema = T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = None
        try:
            for batch in slices(batches):  # whole batches as Python objects would take much memory
                compute = compute or make()
                keep = [n for n in batch.schema.names if n != name]
                values = compute(batch.column(source).to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), values], names=[*keep, name])
        finally:
            getattr(compute, "forget", lambda: None)()
            release()

    return df.mapInArrow(run, schema)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once per row: as a generator's output they are not copied into what uses them."""
    row = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")
    rest = [c for c in df.columns if c not in columns]
    return df.select("*", row).select(*rest, *[F.col(f"_once.{n}").alias(n) for n in columns])


def array_chunks(total: np.ndarray) -> pa.RecordBatch:
    """A task's array as records (chunk, part), without parts that are all zero; parts of small numbers take a byte for each."""
    parts = {k: total[k * CHUNK : (k + 1) * CHUNK] for k in range(-(-len(total) // CHUNK))}
    parts = {k: x.astype(np.uint8) if x.max() < 256 else x for k, x in parts.items() if x.any()}
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], names=["chunk", "part"])


def merged_array(chunks: DataFrame, add: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int, dtype: type) -> np.ndarray:
    """Adds up an array that every task sends in chunks. Its size is fixed, so the result may go to the driver and to all tasks."""
    if size % CHUNK:
        raise ValueError(f"{size} is no multiple of {CHUNK}")
    out, whole = np.zeros(size, dtype), CHUNK

    def wide(part: bytes) -> np.ndarray:
        return np.frombuffer(part, np.uint8 if len(part) == whole else dtype).astype(dtype)

    for k, part in chunks.rdd.map(lambda r: (r[0], r[1])).combineByKey(wide, lambda a, b: add(a, wide(b)), add, 64).collect():
        out[k * CHUNK : k * CHUNK + len(part)] = part
    return out


def most_frequent(df: DataFrame, count: str, size: int, parts: int = 4096) -> DataFrame:
    """The rows with the largest counts, at most ``size``: all above a threshold that a histogram over the counts' magnitudes
    gives, so that neither the driver nor a task sees more than these rows. Of the magnitude that no longer fits in whole, rows are
    taken by a hash of their values, so many counts that are equal, or nearly so, do not leave it out."""
    step = F.floor(F.log2(count) * 16)
    hist = df.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 16 x 63 rows
    cut, total = None, 0
    for r in sorted(hist, key=lambda r: -r.step):
        if total + r.n > size:
            cut = r.step
            break
        total += r.n
    if cut is None:
        return df
    place = F.pmod(F.xxhash64(*df.columns), F.lit(parts))
    upto = 0
    for r in sorted(df.where(step == cut).groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()):
        if total + r.n > size:
            break
        total, upto = total + r.n, r.place + 1
    return df.where((step > cut) | ((step == cut) & (place < upto)))
