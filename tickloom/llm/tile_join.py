"""Near-duplicate vectors by exact cosine self-join over quantised tiles.

1. Equal vectors are one class with a weight, so copies are never paired. Ids of copies stay in lists of bounded length.
2. Classes go to the cell of the nearest of a few pivot vectors, and cells that hold many are dealt out over groups of a bounded
   number of rows. Every group meets every other once: a class stays in its own group and visits the half of the others that
   follow it in a circle. It leaves out cells whose radius shows by the triangle inequality that no member can be near enough.
3. In a task, each unit vector u is s*q + e with whole numbers q of one byte, a scale s and a known error norm |e|. Products of
   tiles of q are whole numbers, exact in single precision, and u*v lies within |e_u| + |e_v| + |e_u||e_v| of s_u*s_v*(q_u*q_v).
   Pairs whose upper bound is below the threshold go, pairs whose lower bound reaches it are links, and only the pairs between
   are computed again in double precision.
4. A task sends its classes' link counts and a spanning forest of its links, never the pairs. Forests join to components by
   star contraction; a class's name starts with its smallest id, so a component's smallest name gives its id.

Groups bound a task's memory; the tile products of data without clusters grow with the square of the number of distinct vectors,
which the pivots cannot help (nothing exact can, for vectors that are spread evenly).

Defined cases: vectors that are null, empty, all zero or hold a null or non-finite component link with nothing and are their own
component; vectors of unlike lengths are not compared; repeated rows are vectors like others, copies of each other; a null id
is no component's id unless no member has one; empty tables give empty tables; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from tickloom.llm.ngram_join import components
from tickloom.session import materialize

#: Most pivots for vectors of one length; they and a few figures for each cell go to every task.
PIVOTS = 256
#: Rows and bytes of double precision that a group holds about, at most.
GROUP_ROWS, GROUP_BYTES = 65_536, 32 << 20
#: Groups that one task lets visit its own group, and ids that one list of copies has at most.
VISITING, LISTED = 64, 4096
#: Rows of a tile of residents and of visitors.
TILE = 1024
#: Kinds of vectors (lengths by cells) of which figures go to the driver, at most.
KINDS = 100_000
#: What rounding in double precision may add to a product of unit vectors or an angle.
SLACK, TURN = 1e-9, 1e-6

_SIGN = -(1 << 63)


def usable(embedding: str) -> Column:
    """True where a vector has a direction."""
    x = F.col(embedding)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _name(low: Column, key: Column) -> Column:
    """A class's name: sorts by its smallest id (null last), then tells classes apart."""
    as_hex = lambda c: F.lpad(F.hex(c), 16, "0")
    id_ = F.coalesce(as_hex(low.bitwiseXOR(F.lit(_SIGN))), F.lit("0" * 16))
    return F.concat(F.when(low.isNull(), "1").otherwise("0"), id_, as_hex(F.xxhash64(key)))


def _id(name: Column) -> Column:
    """The id that a name starts with."""
    return F.when(F.substring(name, 1, 1) == "0", F.conv(F.substring(name, 2, 16), 16, -10).cast("long").bitwiseXOR(F.lit(_SIGN)))


def units(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision, whatever their size."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whole numbers of one byte, scales, error norms) of unit vectors; the norms are rounded up."""
    s = np.abs(u).max(axis=1) / 127
    q = np.rint(u / s[:, None])
    e = u - q * s[:, None]
    return q.astype(np.int8), s, np.sqrt((e * e).sum(axis=1)) * (1 + 1e-12) + 1e-15


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows of single precision that hold whole numbers of one byte: exact, as up to 1024 terms stay below 2**24."""
    if a.shape[1] <= 1024:
        return a @ b.T
    parts = range(0, a.shape[1], 1024)
    return sum((a[:, k : k + 1024] @ b[:, k : k + 1024].T).astype(np.float64) for k in parts)


class Group:
    """The residents of a group, in order of their scales, with what they have seen so far."""

    def __init__(self, raw: np.ndarray, weights: np.ndarray, threshold: float) -> None:
        u = units(raw)
        q, s, e = quantised(u)
        self.t, self.order = threshold, np.argsort(s, kind="stable")
        by = self.order
        self.u, self.q, self.s, self.e, self.weights = u[by], q[by].astype(np.float32), s[by], e[by], weights[by]
        self.links = np.zeros(len(by), dtype=np.int64)
        self.root = np.arange(len(by))
        self.computed = 0

    def _find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def near(self, u: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(visitor, resident) places of all links to visitors ``u``, tile by tile."""
        q, s, e = quantised(u)
        q = q.astype(np.float32)
        for lo in range(0, len(self.s), TILE):
            r = slice(lo, lo + TILE)
            high, low, worst = self.s[r].max(), self.s[r].min(), self.e[r].max()
            least = self.t - SLACK - e - worst - e * worst
            least /= s * np.where(least > 0, high, low)
            least -= np.abs(least) * 1e-6 + 1e-3  # what single precision may take from the limit
            v, w = np.nonzero(_product(q, self.q[r]) >= least[:, None].astype(np.float32))
            if not len(v):
                continue
            w = w + lo
            about = np.einsum("ij,ij->i", q[v], self.q[w], dtype=np.float64) * s[v] * self.s[w]
            bound = e[v] + self.e[w] + e[v] * self.e[w] + SLACK
            link = about - bound >= self.t
            for part in np.array_split(open_ := np.flatnonzero(~link & (about + bound >= self.t)), max(1, len(open_) // TILE)):
                link[part] = np.einsum("ij,ij->i", u[v[part]], self.u[w[part]]) >= self.t
            self.computed += len(open_)
            yield v[link], w[link]

    def meet(self, u: np.ndarray, weights: np.ndarray, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Lets visitors in: (links, a linked resident or -1) of each. ``own``: they are this group's, from this place on."""
        links, one = np.zeros(len(u), dtype=np.int64), np.full(len(u), -1)
        for v, w in self.near(u):
            if own is not None:
                other = v + own != w
                v, w = v[other], w[other]
            links += np.bincount(v, self.weights[w], len(u)).astype(np.int64)
            if own is None:
                self.links += np.bincount(w, weights[v], len(self.s)).astype(np.int64)
            at, first = np.unique(v, return_index=True)
            new = one[at] < 0
            one[at[new]] = w[first[new]]
            ends = np.unique(one[v] * len(self.s) + w)
            for a, b in zip((ends // len(self.s)).tolist(), (ends % len(self.s)).tolist()):
                a, b = self._find(a), self._find(b)
                self.root[max(a, b)] = min(a, b)
            if own is not None:
                for a, b in zip((at + own).tolist(), one[at].tolist()):
                    a, b = self._find(a), self._find(b)
                    self.root[max(a, b)] = min(a, b)
        return links, one


def classes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(copies, classes) of the usable vectors: lists of ids of equal vectors (key, ids, n), of a bounded length each, and one row
    per distinct vector (name, key, dim, weight), key being its bytes in the table's precision."""
    double = isinstance(vectors.schema[embedding].dataType.elementType, T.DoubleType)
    kind = np.dtype("<f8" if double else "<f4")
    rows = vectors.where(usable(embedding)).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>" if double else "array<float>").alias("x"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x")
            flat = x.flatten().to_numpy(zero_copy_only=False).astype(kind) + kind.type(0)  # no negative zeros
            raw, at = flat.tobytes(), np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))]) * kind.itemsize
            keys = pa.array([raw[a:z] for a, z in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), keys], names=["vec_id", "key"])

    keyed = rows.mapInArrow(pack, "vec_id long, key binary")
    chunk = F.expr(f"monotonically_increasing_id() div {LISTED}")
    copies = keyed.withColumn("chunk", chunk).groupBy("key", "chunk").agg(
        F.collect_list(F.struct("vec_id")).alias("ids"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("low"))
    copies = materialize(copies.drop("chunk"), "vector_copies")
    distinct = copies.groupBy("key").agg(F.sum("n").alias("weight"), F.min("low").alias("low"))
    distinct = distinct.select(_name(F.col("low"), F.col("key")).alias("name"), "key", (F.octet_length("key") / kind.itemsize).cast("int").alias("dim"), "weight")
    return copies.drop("low"), materialize(distinct, "vector_classes")


def _bounded(df: DataFrame, what: str) -> list:
    rows = df.limit(KINDS + 1).collect()
    if len(rows) > KINDS:
        raise ValueError(f"more than {KINDS} {what}")
    return rows


def links(distinct: DataFrame, threshold: float, kind: np.dtype, group_rows: int | None = None) -> DataFrame:
    """(name, links, other): parts of each class's links, summed by their weights, and the forest (other: a class of the same component)."""
    limit, spark = math.acos(min(1.0, threshold)) + TURN, distinct.sparkSession
    cores = spark.sparkContext.defaultParallelism
    sizes = {r.dim: r.n for r in _bounded(distinct.groupBy("dim").agg(F.count(F.lit(1)).alias("n")), "lengths of vectors")}
    rows_of = {d: group_rows or min(GROUP_ROWS, max(TILE // 16, GROUP_BYTES // (8 * d)), max(TILE, -(-n // (2 * cores)))) for d, n in sizes.items()}
    nth = F.row_number().over(W.Window.partitionBy("dim").orderBy(F.xxhash64("key"), "key"))
    pivots: dict[int, np.ndarray] = {}
    for r in _bounded(distinct.select("dim", "key", nth.alias("nth")).where(F.col("nth") <= PIVOTS), "pivots"):
        if r.nth <= max(1, sizes[r.dim] // rows_of[r.dim]):
            pivots[r.dim] = np.vstack([pivots.get(r.dim, np.empty((0, r.dim))), units(np.frombuffer(r.key, kind)[None, :])])

    def matrix(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places, angles to the pivots) of the rows of each vector length."""
        dims = b.column("dim").to_numpy()
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            x = np.frombuffer(b"".join(b.column("key").take(pa.array(at)).to_pylist()), kind).reshape(len(at), d)
            yield d, at, np.arccos(np.clip(units(x) @ pivots[d].T, -1, 1))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], tuple[int, float]] = {}
        for b in batches:
            for d, _, angles in matrix(b):
                home = angles.argmin(axis=1)
                for c in np.unique(home).tolist():
                    n, radius = seen.get((d, c), (0, 0.0))
                    seen[d, c] = n + int((home == c).sum()), max(radius, float(angles[home == c, c].max()))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.int32()),
                                          pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.float64())], names=["dim", "cell", "n", "radius"])

    found = distinct.select("dim", "key").mapInArrow(cells, "dim int, cell int, n long, radius double")
    found = _bounded(found.groupBy("dim", "cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")), "cells")
    plan: dict[int, dict[str, np.ndarray]] = {}
    first = 0
    for d in sorted(sizes):
        own = sorted((r.cell, r.n, r.radius) for r in found if r.dim == d)
        pieces = np.zeros(len(pivots[d]), dtype=np.int64)
        radius = np.full(len(pivots[d]), -np.inf)
        for c, n, rad in own:
            pieces[c], radius[c] = -(-n // rows_of[d]), rad
        plan[d] = {"pieces": pieces, "radius": radius, "start": np.concatenate([[0], np.cumsum(pieces)]), "first": first}
        first += int(pieces.sum())
    stripes = {d: max(1, int(p["pieces"].sum()) // VISITING) for d, p in plan.items()}
    most = max(stripes.values(), default=1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows for the tasks: each class as a resident of its group, and as a visitor where a link is possible."""
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                for d, at, angles in matrix(b):
                    p, total = plan[d], int(plan[d]["pieces"].sum())
                    home = angles.argmin(axis=1)
                    mixed = np.array([int(x[17:25], 16) for x in b.column("name").take(pa.array(at)).to_pylist()], dtype=np.int64)
                    group = p["start"][home] + mixed % p["pieces"][home]
                    to = np.repeat(np.arange(len(p["pieces"])), p["pieces"])  # the cell of each group
                    ahead = (np.arange(total)[None, :] - group[:, None]) % total
                    half = (ahead > 0) & ((2 * ahead < total) | ((2 * ahead == total) & (group[:, None] < total // 2)))
                    v, g = np.nonzero(half & (angles <= p["radius"][None, :] + limit)[:, to])
                    r = np.repeat(np.arange(len(at)), stripes[d])
                    tasks = np.concatenate([(p["first"] + group[r]) * most + np.tile(np.arange(stripes[d]), len(at)), (p["first"] + g) * most + group[v] % stripes[d]])
                    rows, visits = pa.array(at[np.concatenate([r, v])]), np.concatenate([np.zeros(len(r), bool), np.ones(len(v), bool)])
                    for k in range(0, len(rows), 4096):
                        part = slice(k, k + 4096)
                        yield pa.RecordBatch.from_arrays([pa.array(tasks[part]), pa.array(visits[part]), *(b.column(c).take(rows[part]) for c in ("name", "key", "dim", "weight"))],
                                                         names=["task", "visits", "name", "key", "dim", "weight"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Residents come before visitors, task by task; visitors are not kept."""
        task = group = None
        names: list[str] = []
        waiting: list[pa.RecordBatch] = []

        def out(who: list[str], counts: np.ndarray, other: list[str | None]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(who, pa.string()), pa.array(counts, pa.int64()), pa.array(other, pa.string())], names=["name", "links", "other"])

        def vectors(b: pa.RecordBatch) -> np.ndarray:
            return np.frombuffer(b"".join(b.column("key").to_pylist()), kind).reshape(b.num_rows, -1)

        def settle() -> None:
            """All residents are there: they meet each other, if this is their first stripe."""
            nonlocal group, names
            rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            group = Group(vectors(rows), rows.column("weight").to_numpy(), threshold)
            names = rows.column("name").take(pa.array(group.order)).to_pylist()
            waiting.clear()
            if task % most == 0:
                for k in range(0, len(names), TILE):
                    counts, _ = group.meet(group.u[k : k + TILE], group.weights[k : k + TILE], own=k)
                    group.links[k : k + TILE] += counts

        def close() -> Iterator[pa.RecordBatch]:
            if waiting:
                settle()
            if group is not None:
                at = np.flatnonzero(group.links)
                yield out([names[k] for k in at.tolist()], group.links[at], [names[group._find(k)] for k in at.tolist()])

        for b in batches:
            tasks, visits = b.column("task").to_numpy(), b.column("visits").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(tasks) != 0) | (np.diff(visits.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                part = b.slice(lo, hi - lo)
                if tasks[lo] != task:
                    yield from close()
                    task, group = int(tasks[lo]), None
                if not visits[lo]:
                    waiting.append(part)
                    continue
                if waiting:
                    settle()
                for k in range(0, part.num_rows, TILE):
                    some = part.slice(k, TILE)
                    counts, one = group.meet(units(vectors(some)), some.column("weight").to_numpy())
                    at = np.flatnonzero(counts)
                    who = some.column("name").take(pa.array(at)).to_pylist()
                    yield out(who, counts[at], [names[k] for k in one[at].tolist()])
        yield from close()

    dealt = distinct.mapInArrow(deal, "task long, visits boolean, name string, key binary, dim int, weight long")
    dealt = dealt.repartition(max(1, min(first * most, 16 * cores)), "task").sortWithinPartitions("task", "visits")
    return dealt.mapInArrow(compare, "name string, links long, other string")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding", group_rows: int | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors of at least that cosine), component_id (the smallest id that links reach), kept
    (it is its component's first). ``group_rows`` sets the size of groups, which changes no result."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    kind = np.dtype("<f8" if isinstance(vectors.schema[embedding].dataType.elementType, T.DoubleType) else "<f4")
    copies, distinct = classes(vectors, vec_id, embedding)
    found = materialize(links(distinct, threshold, kind, group_rows), "vector_links")
    counts = found.groupBy("name").agg(F.sum("links").alias("links"))
    joined = components(found.where("name <> other").select(F.col("name").alias("x"), F.col("other").alias("y")))
    per_class = distinct.join(counts, "name", "left")
    per_class = per_class.join(joined.withColumnRenamed("key", "member"), F.col("name") == F.col("member"), "left").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), _id(F.coalesce("group", "name")).alias("component_id"))
    linked = copies.join(per_class, "key").select(F.explode("ids").alias("i"), "n_links", "component_id").select("i.vec_id", "n_links", "component_id")
    alone = vectors.where(~usable(embedding)).select(F.col(vec_id).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(vec_id).cast("long").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT vec_id, x FROM v WHERE len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT v.vec_id, (SELECT count(*) FROM e WHERE e.x = v.vec_id) AS n_links, min(r.y) AS component_id, v.vec_id = min(r.y) AS kept
FROM v JOIN r ON v.vec_id = r.x GROUP BY v.vec_id
"""
