"""Trie of the shared beginnings of conversations, from balanced parentheses of sorted shards.

1. A turn is a digest of role and text with its length in bytes; a conversation is the sequence of its digests. Equal
   conversations become one class; their ids are packed into pieces, sorted, and hashed piece by piece.
2. Classes are sorted over range partitions, so each shard of a bounded number of turns holds a stretch of the trie in depth-first
   order. Common beginnings of neighbours give the shard's balanced parentheses. The minima of blocks of its excess, and of pairs
   of blocks upwards, find where each node closes. Between a node and its close, ranks of "()" are its leaves, and differences of
   cumulative arrays its conversations, bytes and distinct bytes.
3. Only nodes on a shard's left and right spine (the paths of its first and last class) can go on in another shard. Shards that
   meet correct for what both have counted; spine nodes are added up by the chained digest of their path.

Defined cases: turns without a conversation id belong to none; null role or text is empty; turns are ordered by turn number (null
first), and equal ones by digest, so that repeated rows and ties are repeated turns in a fixed order; empty tables give an empty
trie; texts of any length are digested where they are read; further columns are not looked at. A conversation is one row of 24
bytes a turn. Turns and paths are told apart by 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tickloom.llm.periodic import CRC32
from tickloom.session import materialize

#: Turns that a shard holds about, and excess values in a block.
SHARD_TURNS, BLOCK = 200_000, 64
#: Ids that one packed piece of a class holds.
PACKED = 4096
#: Copies of the spine table that nodes under hot spine nodes are spread over.
SALT = 16
#: Turns that a rebuilt conversation takes from another at most.
MOST_HEAD = 8
DIGEST = 16

_TURNS = "array<struct<digest:binary,bytes:bigint>>"


def sequences(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, turns): one row per conversation with the digests and bytes of its turns in order."""
    r, t = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary"), 256), 1, 2 * DIGEST))
    rows = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("id"), F.struct(F.col(turn).isNotNull().alias("known"), F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(t).cast("long").alias("bytes")).alias("t"))
    listed = F.array_sort(F.collect_list("t"))
    return rows.groupBy("id").agg(listed.alias("turns")).select("id", F.transform("turns", lambda x: F.struct(x["digest"].alias("digest"), x["bytes"].alias("bytes"))).cast(_TURNS).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Conversations whose first turns, up to eight by their id's checksum, are those of the conversation that begins their group of five."""
    h = (F.crc32(F.col("id").cast("string").cast("binary")) % 9).cast("int")
    heads = convs.where("id % 5 = 0").select(F.col("id").alias("base"), F.slice("turns", 1, MOST_HEAD).alias("head"))
    d = convs.withColumn("base", F.expr("id - id % 5")).join(heads, "base", "left")
    head = F.coalesce("head", F.array().cast(_TURNS))
    own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return d.select("id", F.concat(F.slice(head, F.lit(1), h), own).alias("turns"))


def _hashed_ids(members: DataFrame) -> DataFrame:
    """(key, low, n, ends): per key its smallest id, number of ids, and the SHA-256 of its ids in order."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids = b.column("key").to_pylist(), b.column("id").to_pylist()
            cuts = [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]]
            at = [k for a, z in zip([0, *cuts], [*cuts, len(keys)]) for k in range(a, z, PACKED)]
            parts = [ids[a:z] for a, z in zip(at, [*at[1:], len(keys)])] if keys else []
            yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in at if keys], pa.string()), pa.array([p[0] for p in parts], pa.int64()), pa.array([len(p) for p in parts], pa.int64()),
                                              pa.array([",".join(map(str, p)) for p in parts], pa.string())], names=["key", "low", "n", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": [key], "low": [low], "n": [n], "ends": [state.hexdigest()]})

        done: list[tuple] = []
        for b in batches:
            for k, first, count, ids in zip(*(b.column(c).to_pylist() for c in ("key", "low", "n", "ids"))):
                if k != key:
                    if state is not None:
                        done.append((key, low, n, state.hexdigest()))
                    key, low, n, state = k, first, 0, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
                n += count
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["key", "low", "n", "ends"])
            done = []
        if state is not None:
            yield row()

    packed = members.repartitionByRange(F.col("key"), F.col("id")).sortWithinPartitions("key", "id").mapInArrow(pack, "key string, low long, n long, ids string")
    return packed.repartition("key").sortWithinPartitions("key", "low").mapInArrow(digest, "key string, low long, n long, ends string")


def find_close(excess: np.ndarray, opens: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Where each open parenthesis closes: the next place whose excess is one less. Blocks that stay above it are passed over by
    their minima, and pairs of them by theirs."""
    high = np.iinfo(np.int64).max
    grid = np.concatenate([excess, np.full(-len(excess) % block, high)]).reshape(-1, block)
    mins = [grid.min(axis=1)]
    while len(mins[-1]) > 1:
        level = mins[-1] if len(mins[-1]) % 2 == 0 else np.append(mins[-1], high)
        mins[-1] = level
        mins.append(level.reshape(-1, 2).min(axis=1))
    out = np.empty(len(opens), dtype=np.int64)
    column = np.arange(block)
    for lo in range(0, len(opens), 1 << 16):
        at = opens[lo : lo + (1 << 16)] + 1
        target = excess[at - 1] - 1
        idx = at // block
        hit = (grid[idx] <= target[:, None]) & (column >= (at % block)[:, None])
        found = hit.any(axis=1)
        close = idx * block + hit.argmax(axis=1)
        far = np.flatnonzero(~found)
        if len(far):
            want, node, level = target[far], idx[far] + 1, np.full(len(far), -1)
            for k, m in enumerate(mins):  # up: a right half is looked at, a left half is its parent's matter
                searching = level < 0
                look = searching & ((node % 2 == 1) | (len(m) == 1))
                got = np.zeros(len(far), bool)
                got[look] = m[node[look]] <= want[look]
                level[got] = k
                node = np.where(searching & ~got, np.where(look, node + 1, node) // 2, node)
            for k in range(len(mins) - 1, 0, -1):  # down: the left half, if it goes low enough
                here = level >= k
                left = 2 * node[here]
                node[here] = np.where(mins[k - 1][left] <= want[here], left, left + 1)
            close[far] = node * block + (grid[node] <= want[:, None]).argmax(axis=1)
        out[lo : lo + len(at)] = close
    return out


def _least(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Minima of values[start:stop], by a table of minima of stretches of powers of two."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    k = np.frexp((stop - start).astype(float))[1] - 1
    out = np.empty(len(start), dtype=values.dtype)
    for p in np.unique(k).tolist():
        at = k == p
        out[at] = np.minimum(table[p][start[at]], table[p][stop[at] - (1 << p)])
    return out


def _common(digests: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each sequence with the one before it (0 for the first)."""
    sizes = np.diff(offsets)
    both = np.minimum(sizes[1:], sizes[:-1])
    starts = np.concatenate([[0], np.cumsum(both)])
    t = np.arange(starts[-1]) - np.repeat(starts[:-1], both)
    a, b = np.repeat(offsets[:-2], both) + t, np.repeat(offsets[1:-1], both) + t
    differs = np.flatnonzero((digests[a] != digests[b]).any(axis=1))
    row = np.repeat(np.arange(len(both)), both)[differs]
    out = both.copy()
    np.minimum.at(out, row, t[differs])
    return np.concatenate([[0], out]).astype(np.int64)


def chained(path: np.ndarray) -> list[bytes]:
    """The names of the nodes on a path, from the root: each digest is chained to the one above it."""
    names = [bytes(DIGEST)]
    for d in path:
        names.append(hashlib.blake2b(names[-1] + d.tobytes(), digest_size=DIGEST).digest())
    return names


_OUT = "kind int, name binary, parent_name binary, parent long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved long, ends string, shard long, path binary, sizes binary"
_ARROW = pa.schema([("kind", pa.int32()), ("name", pa.binary()), ("parent_name", pa.binary()), *((c, pa.int64()) for c in ("parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved")),
                    ("ends", pa.string()), ("shard", pa.int64()), ("path", pa.binary()), ("sizes", pa.binary())])
#: Kinds of rows: nodes that are complete, parts of spine nodes, and the ends of a range partition.
DONE, SPINE, FIRST, LAST = range(4)


def _rows(n: int, **columns: list | np.ndarray | pa.Array) -> pa.RecordBatch:
    arrays = [columns[f.name] if f.name in columns else None for f in _ARROW]
    return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if x is None else pa.array(x, f.type) if not isinstance(x, pa.Array) else x for f, x in zip(_ARROW, arrays)], schema=_ARROW)


def meeting(before: tuple[np.ndarray, np.ndarray], after: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """What two neighbouring shards have both counted, from the last path (digests, bytes) of one and the first path of the next: the nodes
    on their common beginning, their bytes, and a leaf if the one path ends where the other goes on."""
    (a, size), (b, _) = before, after
    n = min(len(a), len(b))
    differs = np.flatnonzero((a[:n] != b[:n]).any(axis=1))
    common = int(differs[0]) if len(differs) else n
    names = chained(a[:common])
    own = np.concatenate([[0], size[:common]])
    return _rows(common + 1, kind=np.full(common + 1, SPINE), name=names, parent_name=[None, *names[:-1]], depth=np.arange(common + 1), n_convs=np.zeros(common + 1, int),
                 n_children=-(np.arange(common + 1) < common).astype(int), n_leaves=np.full(common + 1, -1 if len(a) == common else 0), saved=np.cumsum(own[::-1])[::-1])


def shard(digests: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, low: np.ndarray, weights: np.ndarray, ends: pa.Array) -> Iterator[pa.RecordBatch]:
    """The nodes of a shard of sorted, distinct sequences: complete ones, and parts of those on its two spines."""
    length, common = np.diff(offsets), _common(digests, offsets)
    new = length - common
    n = len(length)
    # parentheses: each sequence closes down to what it shares with the one before, then opens the rest
    counts = np.empty(2 * n + 2, dtype=np.int64)
    counts[0], counts[1:-1:2], counts[2:-1:2], counts[-1] = 1, np.concatenate([[0], length[:-1] - common[1:]]), new, length[-1] + 1
    bits = np.repeat(np.tile([1, -1], n + 1), counts)
    excess = np.cumsum(bits)
    opens = np.flatnonzero(bits == 1)
    close = find_close(excess, opens)
    depth = excess[opens] - 1
    nodes = len(opens)
    stop = np.cumsum(bits == 1)[close]
    pairs = np.cumsum((bits[:-1] == 1) & (bits[1:] == -1))
    leaves = pairs[close - 1] - np.where(opens > 0, pairs[opens - 1], 0)

    last = np.cumsum(new)  # the node that each sequence ends in, in depth-first order (the root is 0)
    first_seq, stop_seq = np.searchsorted(last, np.arange(nodes)), np.searchsorted(last, stop)
    upto = np.concatenate([[0], np.cumsum(weights)])
    convs = upto[stop_seq] - upto[first_seq]
    least = _least(low, first_seq, stop_seq)

    own = np.zeros(nodes, dtype=np.int64)
    turn = np.arange(nodes - 1) - np.repeat(np.cumsum(new) - new, new) + np.repeat(offsets[:-1] + common, new)
    own[1:] = sizes[turn]
    total = np.concatenate([[0], np.cumsum((convs - 1) * own)])
    saved = total[stop] - total[:nodes]

    parent, path = np.empty(nodes, dtype=np.int64), np.zeros(int(length.max()) + 1, dtype=np.int64)
    parent[0], at = -1, 1
    for k, c in zip(common.tolist(), new.tolist()):
        if c:
            parent[at : at + c] = np.arange(at - 1, at - 1 + c)
            parent[at] = path[k]
            path[k + 1 : k + 1 + c] = np.arange(at, at + c)
            at += c
    children = np.bincount(parent[1:], minlength=nodes)
    end_of = np.full(nodes, -1)
    end_of[last] = np.arange(n)
    ended = ends.take(pa.array(end_of, mask=end_of < 0))

    names: dict[int, bytes] = {}
    right = path[: length[-1] + 1].tolist()
    names.update(zip(range(int(length[0]) + 1), chained(digests[: length[0]])))
    names.update(zip(right, chained(digests[offsets[-2] :])))
    spine = np.zeros(nodes, bool)
    spine[list(names)] = True
    for kind, at in ((DONE, np.flatnonzero(~spine)), (SPINE, np.flatnonzero(spine))):
        above = parent[at]
        known = (above >= 0) & ~spine[above]
        yield _rows(len(at), kind=np.full(len(at), kind), name=[names.get(k) for k in at.tolist()] if kind == SPINE else None, parent_name=[None if ok else names.get(k) for k, ok in zip(above.tolist(), known)],
                    parent=pa.array(least[above], mask=~known), conv_id=least[at], depth=depth[at], n_convs=convs[at], n_children=children[at], n_leaves=leaves[at], saved=saved[at], ends=ended.take(pa.array(at)))


def _paths(batches: Iterator[pa.RecordBatch], shard_turns: int) -> Iterator[pa.RecordBatch]:
    """The shards of one range partition, and its first and last path."""
    part = TaskContext.get().partitionId()
    before = None

    def ends(kind: int, path: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return _rows(1, kind=[kind], shard=[part], path=[path[0].tobytes()], sizes=[path[1].astype(np.int64).tobytes()])

    for whole in batches:
        upto = np.concatenate([[0], np.cumsum(whole.column("path").value_lengths().to_numpy(zero_copy_only=False))])
        at = 0
        while at < whole.num_rows:
            stop = max(at + 1, int(np.searchsorted(upto, upto[at] + shard_turns, side="right")) - 1)
            b = whole.slice(at, stop - at)
            at = stop
            offsets = np.concatenate([[0], np.cumsum(b.column("path").value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            digests = np.frombuffer(b"".join(b.column("path").flatten().to_pylist()), np.uint64).reshape(-1, DIGEST // 8)
            sizes = b.column("sizes").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            left, right = (digests[: offsets[1]], sizes[: offsets[1]]), (digests[offsets[-2] :], sizes[offsets[-2] :])
            yield ends(FIRST, left) if before is None else meeting(before, left)
            yield from shard(digests, sizes, offsets, b.column("low").to_numpy(), b.column("n").to_numpy(), b.column("ends"))
            before = right
    if before is not None:
        yield ends(LAST, before)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def path(row: dict, name: str) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(row[f"{name}_path"], np.uint64).reshape(-1, DIGEST // 8), np.frombuffer(row[f"{name}_sizes"], np.int64)

    for b in batches:
        for row in b.to_pylist():
            yield meeting(path(row, "before"), path(row, "after"))


def trie(convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of (id, turns): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over
    the subtree, bytes that members after the first repeat), ends_sha256 (of the ids of those that end here)."""
    key = F.sha2(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "").cast("binary"), 256)
    rows = materialize(convs.select("id", "turns", key.alias("key")), "conversations")
    distinct = rows.groupBy("key").agg(F.first("turns").alias("turns")).join(_hashed_ids(rows.select("key", "id")), "key")
    ordered = distinct.select(F.transform("turns", lambda t: t["digest"]).alias("path"), F.transform("turns", lambda t: t["bytes"]).alias("sizes"), "low", "n", "ends")
    ordered = ordered.repartitionByRange("path").sortWithinPartitions("path")
    parts = materialize(ordered.mapInArrow(lambda it: _paths(it, shard_turns), _OUT), "trie_parts")

    side = lambda kind, name: parts.where(F.col("kind") == kind).select("shard", F.col("path").alias(f"{name}_path"), F.col("sizes").alias(f"{name}_sizes"))
    edges = side(FIRST, "after").join(side(LAST, "last"), "shard")  # one row per range partition
    in_order = W.Window.orderBy("shard")
    edges = edges.select("after_path", "after_sizes", F.lag("last_path").over(in_order).alias("before_path"), F.lag("last_sizes").over(in_order).alias("before_sizes")).where("before_path is not null")
    spine = parts.where(F.col("kind") == SPINE).unionByName(edges.mapInArrow(_meetings, _OUT))
    spine = spine.groupBy("name").agg(F.max("parent_name").alias("parent_name"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
                                      *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")], F.max("ends").alias("ends"))
    spine = materialize(spine, "trie_spine")

    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    salted = spine.select(F.col("name").alias("parent_name"), F.col("conv_id").alias("parent"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    below = spine.select("parent_name", *columns).unionByName(parts.where((F.col("kind") == DONE) & F.col("parent").isNull()).select("parent_name", *columns))
    below = below.withColumn("salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALT)).cast("int")).join(salted, ["parent_name", "salt"], "left").select("parent", *columns)
    done = parts.where((F.col("kind") == DONE) & F.col("parent").isNotNull()).select("parent", *columns)
    return done.unionByName(below).select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


ORACLE = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, @CRC@ % 9 AS h, conv_id - conv_id % 5 AS base FROM t),
b AS (SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.base WHERE pos < h
      UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos >= h),
s AS (SELECT c.conv_id, coalesce(list({'role': role, 'text': text} ORDER BY part, pos) FILTER (role IS NOT NULL), []) AS turns FROM c LEFT JOIN b USING (conv_id) GROUP BY c.conv_id),
p AS (SELECT conv_id, len(turns) AS size, turns, unnest(range(0, len(turns) + 1)) AS depth FROM s),
n AS (SELECT depth, turns[1:depth] AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(strlen(any_value(turns[depth].text)), 0) AS bytes,
             string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth) AS ends FROM p GROUP BY depth, turns[1:depth]),
k AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (prefix)),
u AS (SELECT prefix, (n_convs - 1) * bytes AS saved, n_children = 0 AS leaf, unnest(range(0, depth + 1)) AS up FROM m),
a AS (SELECT prefix[1:up] AS prefix, sum(saved) AS saved_tokens, count(*) FILTER (leaf) AS n_leaves FROM u GROUP BY ALL)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, a.n_leaves, a.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN a ON m.prefix = a.prefix LEFT JOIN n q ON m.depth > 0 AND q.prefix = m.prefix[1:m.depth - 1]
""".replace("@CRC@", CRC32.format("conv_id::VARCHAR"))
