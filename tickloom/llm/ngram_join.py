"""Exact n-gram Jaccard self-join of documents by rare-first prefix filtering, and the groups that its links form.

1. Documents with equal shingle sets are one class; everything after works on classes, so copies are never paired.
2. A count sketch over all documents (a fixed number of counters) orders shingles from rare to frequent. The order only has
   to be the same everywhere to be exact; that it is rare-first keeps the buckets small.
3. A class goes to the buckets of its prefix: two sets that are similar enough share a shingle there. A bucket row is used
   only where the rest of both sets still allows the overlap (positional filter), sizes must be near (length filter), and
   counts per hash range bound the overlap from above (suffix filter).
4. Pairs of neighbours inside the buckets are verified first, each once, and joined to groups. Then only pairs of different
   groups are left to compare, all of them: a bucket that is one group already costs nothing, however large it is.
5. Links become groups by alternating star contraction.

Defined cases: null, empty or blank texts have an empty set, no class, and are linked with nothing (their component is their
own id); with fewer than ``n`` words the whole sequence is the one shingle; repeated rows are copies of each other; ids may be
null (a component's id is its smallest known one) or repeat; empty tables give empty tables; other columns are not looked at.
Shingles and classes are told apart by 64- and 96-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from tickloom.llm.common import array_chunks, merged_array, slices
from tickloom.session import materialize

#: Counters of the frequency sketch, as a power of two.
SKETCH_BITS = 21
#: Bits of the filter that tells which classes have to be read again.
BLOOM_BITS = 26
#: Hash ranges of the suffix filter.
RANGES = 128
#: A bucket is dealt out to one more task for every so many rows that the sketch expects.
BUCKET_ROWS = 4000
#: Distances at which rows of a bucket are paired at first.
NEAR = (1, 2, 3, 5, 8)
#: Bytes of text that are hashed at a time, and classes that a task remembers to have sent.
SLICE, SENT = 1 << 20, 1_000_000

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_TABLE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP, _MIX_A, _MIX_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: np.uint64 = _STEP) -> np.ndarray:
    return np.cumprod(np.full(max(n, 1), base, dtype=np.uint64))


def _word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lower-cased, white space by its six characters) and the index of the text it is in."""
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    buf = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    buf = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
    inside = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    lengths = ends - starts
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(lengths.sum()) - np.repeat(firsts, lengths)
    words = np.add.reduceat(_TABLE[buf[inside]] * _powers(int(lengths.max()))[place], firsts)
    return _mix(words + lengths.astype(np.uint64)), np.searchsorted(np.cumsum(sizes), starts, side="right")


def shingle_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts one after another, and how many each text has."""
    values, counts = [], []
    at = 0
    while at < len(texts):
        raw, size = [], 0
        while at < len(texts) and (not raw or size < SLICE):
            raw.append((texts[at] or "").encode())
            size, at = size + len(raw[-1]), at + 1
        words, owner = _word_hashes(raw)
        per = np.bincount(owner, minlength=len(raw))
        scale = _powers(n + 1, _MIX_B)
        grams, whose = np.empty(0, np.uint64), np.empty(0, np.int64)
        if len(words) >= n:
            full = np.flatnonzero(owner[: len(words) - n + 1] == owner[n - 1 :])
            grams, whose = sum((words[full + k] * scale[k] for k in range(1, n)), words[full] * scale[0]), owner[full]
        short = np.flatnonzero((per > 0) & (per < n))
        if len(short):
            begin = np.concatenate(([0], np.cumsum(per)))[short]
            own = [np.add.reduce(words[b : b + per[d]] * scale[: per[d]]) + np.uint64(n - per[d]) for b, d in zip(begin, short)]
            grams, whose = np.concatenate((grams, np.array(own, np.uint64))), np.concatenate((whose, short))
        grams = _mix(grams)
        order = np.lexsort((grams, whose))
        grams, whose = grams[order], whose[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (whose[1:] != whose[:-1])
        values.append(grams[new])
        counts.append(np.bincount(whose[new], minlength=len(raw)))
    return (np.concatenate(values), np.concatenate(counts)) if values else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _sets(texts: list, n: int) -> Iterator[np.ndarray]:
    values, counts = shingle_sets(texts, n)
    ends = np.cumsum(counts)
    return (values[e - c : e] for c, e in zip(counts, ends))


def _key(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=12).digest() if len(shingles) else None


def least(size: int, percent: int) -> int:
    """The overlap that a set of this size needs with any similar one."""
    return (size * percent + 99) // 100


def frequencies(docs: DataFrame, n: int, text: str = "text", bits: int = SKETCH_BITS) -> np.ndarray:
    """Counters of how many documents have a shingle, by the shingle's top bits, over all documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in slices(batches):
            values, _ = shingle_sets(batch.column(0).to_pylist(), n)
            total += np.bincount((values >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        if total.any():
            yield array_chunks(np.minimum(total, 0xFFFFFFFF).astype(np.uint32))

    wide = lambda a, b: np.minimum(a.astype(np.uint64) + b, 0xFFFFFFFF).astype(np.uint32)
    return merged_array(docs.select(text).mapInArrow(run, "chunk int, part binary"), wide, 1 << bits, np.uint32)


def with_class(docs: DataFrame, n: int, text: str = "text", ranges: bool = False) -> DataFrame:
    """Adds ``_key`` (the class; null: empty set), ``_n`` (shingles) and, if asked for, ``_ranges`` (shingles per hash range)."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_key", T.BinaryType()), T.StructField("_n", T.IntegerType())])
    schema = T.StructType([*schema.fields, T.StructField("_ranges", T.ArrayType(T.IntegerType()))]) if ranges else schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = list(_sets(batch.column(text).to_pylist(), n))
            more = [pa.array(map(_key, sets), pa.binary()), pa.array(map(len, sets), pa.int32())]
            if ranges:
                shift = np.uint64(64 - RANGES.bit_length() + 1)
                more.append(pa.array([np.bincount((s >> shift).astype(np.int64), minlength=RANGES).tolist() for s in sets], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema=pa.schema([*batch.schema, ("_key", pa.binary()), ("_n", pa.int32()), *([("_ranges", pa.list_(pa.int32()))] if ranges else [])]))

    return docs.mapInArrow(run, schema)


def prefixes(docs: DataFrame, n: int, percent: int, counts: np.ndarray, text: str = "text") -> DataFrame:
    """Bucket rows (shingle, deal, key, n, at): the shingles in a class's prefix and their places in its rare-first order.

    A task sends a class once. ``deal`` is 0, or spreads a bucket that is expected to be large over 1, 2, ...
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    bits = int(np.log2(len(counts)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for s in _sets(batch.column(0).to_pylist(), n):
                key = _key(s)
                if key is None or key in sent:
                    continue
                if len(sent) >= SENT:
                    sent.clear()
                sent.add(key)
                often = shared.value[(s >> np.uint64(64 - bits)).astype(np.int64)]
                size = len(s) - least(len(s), percent) + 1
                first = np.lexsort((s, often))[:size]
                hot = often[first].astype(np.int64) // BUCKET_ROWS
                deal = np.where(hot > 0, 1 + int.from_bytes(key[:4], "little") % (hot + 1), 0)
                for to, x in zip(out, (s[first].view(np.int64), deal, None, None, np.arange(size, dtype=np.int32))):
                    if x is not None:
                        to.append(x)
                out[2].append(np.full(size, key, dtype=object))
                out[3].append(np.full(size, len(s), np.int32))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) if k != 2 else pa.array(np.concatenate(x), pa.binary()) for k, x in enumerate(out)], names=["shingle", "deal", "key", "n", "at"])

    return docs.select(text).mapInArrow(run, "shingle long, deal long, key binary, n int, at int")


def _needed(percent: int):
    """The overlap that makes sets of sizes a.n and b.n similar, as a column."""
    return F.ceil((F.col("a.n") + F.col("b.n")) * F.lit(percent) / F.lit(100.0 + percent) - F.lit(1e-9))


def _possible(percent: int):
    """Length and positional filters of a bucket's rows a and b. A similar pair passes at its first common shingle."""
    small, large = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    return (small * 100 >= large * percent) & (F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) >= _needed(percent))


def _suffix(percent: int):
    both = F.aggregate(F.zip_with("a.ranges", "b.ranges", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return both >= _needed(percent)


def neighbours(buckets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of classes that stand close to each other in a bucket, ordered by place, size and class: a number of pairs
    in proportion to the rows. The least edited copies come first, and are paired with all."""
    w = W.Window.partitionBy("shingle", "deal").orderBy("at", "n", "key")
    one = F.struct("key", "n", "at")
    near = F.array(F.first(one).over(w), *[F.lag(one, k).over(w) for k in NEAR])
    d = buckets.withColumn("near", near).withColumn("b", F.explode(F.array_distinct(F.array_compact("near")))).select(one.alias("a"), "b").where("a.key <> b.key")
    return d.where(_possible(percent)).select(F.least("a.key", "b.key").alias("x"), F.greatest("a.key", "b.key").alias("y")).distinct()


def crossing(buckets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """All pairs of classes in a bucket that no group joins yet and that the length and positional filters let pass."""
    d = buckets.join(groups, "key", "left").withColumn("group", F.coalesce("group", "key"))
    mixed = d.groupBy("shingle").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("shingle")
    d = materialize(d.join(mixed, "shingle", "left_semi").select("shingle", "key", "n", "at", "group"), "crossing")
    on = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.key") < F.col("b.key")) & (F.col("a.group") != F.col("b.group"))
    pairs = d.alias("a").join(d.alias("b"), on & _possible(percent))
    return pairs.select(F.col("a.key").alias("x"), F.col("b.key").alias("y")).distinct()


def near_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that the suffix filter lets pass."""
    c = classes.select(F.struct("n", "ranges").alias("c"), "key")
    d = pairs.join(c.withColumnsRenamed({"key": "x", "c": "a"}), "x").join(c.withColumnsRenamed({"key": "y", "c": "b"}), "y")
    return d.where(_suffix(percent)).select("x", "y")


def verify(docs: DataFrame, pairs: DataFrame, n: int, percent: int, text: str = "text") -> DataFrame:
    """The pairs whose whole sets are similar. The texts of their classes are read again; a filter of fixed size leaves
    most others out before anything is shuffled."""
    spark = docs.sparkSession
    keys = pairs.select(F.explode(F.array("x", "y")).alias("key")).distinct()
    words = 1 << (BLOOM_BITS - 6)

    def place(key: bytes) -> tuple[int, ...]:
        return tuple(int.from_bytes(key[i : i + 4], "little") % (1 << BLOOM_BITS) for i in (0, 4, 8))

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(words, np.uint64)
        for batch in batches:
            for key in batch.column(0).to_pylist():
                for p in place(key):
                    bits[p >> 6] |= np.uint64(1 << (p & 63))
        if bits.any():
            yield array_chunks(bits)

    bits = spark.sparkContext.broadcast(merged_array(keys.mapInArrow(fill, "chunk int, part binary"), np.bitwise_or, words, np.uint64))

    def again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in slices(batches):
            out = []
            for s in _sets(batch.column(0).to_pylist(), n):
                key = _key(s)
                if key is None or key in sent or not all(int(bits.value[p >> 6]) >> (p & 63) & 1 for p in place(key)):
                    continue
                if len(sent) >= SENT:
                    sent.clear()
                sent.add(key)
                out.append((key, s.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out)], names=["key", "set"])

    sets = docs.select(text).mapInArrow(again, "key binary, set binary").join(keys, "key", "left_semi")
    sets = materialize(sets.groupBy("key").agg(F.first("set").alias("set")), "sets")
    both = pairs.join(sets.withColumnsRenamed({"key": "x", "set": "a"}), "x").join(sets.withColumnsRenamed({"key": "y", "set": "b"}), "y")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["x", "y"]).filter(pa.array(keep))

    return both.select("x", "y", "a", "b").mapInArrow(compare, "x binary, y binary")


def components(edges: DataFrame) -> DataFrame:
    """(key, group) of all ends of the edges (x, y): the smallest key that is reachable.

    Large-star and small-star steps in turn: a key's larger neighbours, then all others, are tied to its smallest one,
    until every edge leads to the smallest key of its component.
    """

    def tied(e: DataFrame, name: str) -> tuple[DataFrame, tuple]:
        e = materialize(e.distinct(), name)
        return e, tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())

    e, state = tied(edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x <> y"), "edges")
    while True:
        both = e.union(e.select("y", "x").toDF("x", "y"))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("m").alias("x"), "y")
        large = materialize(large.where("x <> y").distinct(), "large_star")
        low = large.groupBy("y").agg(F.min("x").alias("m"))
        small = large.join(low, "y")
        small = small.select(F.col("m").alias("x"), "y").union(small.where("x <> m").select(F.col("m").alias("x"), F.col("x").alias("y")))
        e, now = tied(small, "small_star")
        if now == state:
            return e.select(F.col("y").alias("key"), F.col("x").alias("group")).union(e.select("x", "x").distinct().toDF("key", "group"))
        state = now


def class_groups(docs: DataFrame, n: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, groups): one row per document (doc_id, key, n_shingles), and the class groups (key, group) that links form;
    a class without links is in no row of groups."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    members = materialize(with_class(rows, n, ranges=True).select("doc_id", F.col("_key").alias("key"), F.col("_n").alias("n"), F.col("_ranges").alias("ranges")), "members")
    buckets = prefixes(rows, n, percent, frequencies(rows, n)).repartition("shingle", "deal").dropDuplicates(["shingle", "deal", "key"])
    # a row whose neighbours by size are too small or too large has no partner in its bucket
    by_size = W.Window.partitionBy("shingle", "deal").orderBy("n")
    near = (F.lag("n").over(by_size) * 100 >= F.col("n") * percent) | (F.col("n") * 100 >= F.lead("n").over(by_size) * percent)
    buckets = buckets.withColumn("near", F.coalesce(near, F.lit(False)) | (F.col("deal") > 0)).where("near").drop("near")
    buckets = materialize(buckets, "buckets")
    classes = members.join(buckets.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("n").alias("n"), F.first("ranges").alias("ranges"))
    classes = materialize(classes, "classes")

    first = materialize(near_pairs(neighbours(buckets, percent), classes, percent), "pairs")
    links = materialize(verify(rows, first, n, percent), "links")
    groups = components(links)
    rest = materialize(near_pairs(crossing(buckets, groups, percent), classes, percent), "pairs")
    links = links.union(verify(rows, rest, n, percent))
    return members.drop("ranges"), components(links)


def _grouped(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Per class: its group, and the smallest id of all documents in the group with the class that has it."""
    classes = members.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"))
    classes = classes.join(groups, "key", "left").withColumn("group", F.coalesce("group", "key"))
    best = classes.groupBy("group").agg(F.min_by(F.struct("rep", "key"), F.struct(F.col("rep").isNull(), "rep", "key")).alias("best"))
    return classes.join(best, "group").select("key", "group", F.col("best.rep").alias("best_id"), F.col("best.key").alias("best_key"))


def link(docs: DataFrame, n: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id that links reach)."""
    members, groups = class_groups(docs, n, percent, doc_id, text)
    per_class = _grouped(members, groups).select("key", "best_id")
    d = members.join(per_class, "key", "left")
    return d.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("best_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id. Documents without words all stay."""
    members, groups = class_groups(docs, n, percent, doc_id, text)
    chosen = _grouped(members, groups).where("key = best_key").select(F.col("key").alias("_chosen"), F.col("best_id").alias("_id"))
    name = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    d = with_class(docs.toDF(*name.values()), n, name[text])
    d = d.join(chosen, F.col("_key").eqNullSafe(F.col("_chosen")) & F.col(name[doc_id]).eqNullSafe(F.col("_id")), "left")
    # rows that repeat an id with the same set are copies of each other
    nth = F.row_number().over(W.Window.partitionBy("_key", name[doc_id]).orderBy(name[text]))
    copies = d.where("_chosen is not null").withColumn("_nth", nth).where("_nth = 1").select(*name.values())
    return copies.unionByName(d.where("_key is null").select(*name.values())).toDF(*docs.columns)
