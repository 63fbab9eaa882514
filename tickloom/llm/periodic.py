"""Periodic runs of words: stretches that one short passage fills by being repeated at least three times.

A text's words go one by one into a suffix automaton. Its suffix links form a tree whose root paths are held as a link-cut
forest: the states on one preferred path have their last occurrence at the same word. The path of an appended word's state
crosses a few such segments; in each, the deepest state gives the longest suffix that last ended at an earlier word, and where
that word lies within the suffix's length, the two occurrences overlap: a square, which comparing words to both sides extends
to its run. Then the whole path takes the new word as its last occurrence.

Only stretches in which every eight words in a row stand elsewhere in the same text go into the automaton. That loses nothing:
a run of 24 words or more, and three periods or more, is longer than a period and eight words twice over, so each of its eight
words in a row stands a period away in it again, and the run lies in one such stretch.

Defined cases: null, empty and blank texts have no words and no runs, and collapse to an empty text; a null id takes part in no
rewriting by id; repeated rows are treated alike, one by one; empty tables give empty tables; further columns stay, whatever
their names, except those that the results replace. A text is handled whole, in memory that grows with its longest repetitive
stretch (some 500 bytes a word).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tickloom.llm.common import ROWS

#: A run has at least so many words and so many periods.
LEAST, TIMES = 24, 3
#: Words in a row that must be repeated in a text; at most a third of LEAST.
GRAM = 8

Run = tuple[int, int, int]
Change = Callable[[int | None, list[bytes]], list[bytes]]


class LastEnds:
    """Suffix automaton of a growing sequence, with the last end of every state kept on the paths of a link-cut forest.

    State 0 stands for none and 1 for the empty word. Each preferred path is a splay tree ordered by depth, and all states on it
    have the same last end, which its splay root holds.
    """

    def __init__(self) -> None:
        self.follow: list[dict[int, int]] = [{}, {}]
        self.link, self.len, self.end = [0, 0], [0, 0], [-1, -1]
        self.left, self.right, self.up = [0, 0], [0, 0], [0, 0]
        self.last, self.n = 1, 0

    def _state(self, length: int, link: int, follow: dict[int, int], end: int) -> int:
        """A state that is a path by itself, hanging from its link's path."""
        self.follow.append(follow)
        self.len.append(length)
        self.link.append(link)
        self.end.append(end)
        self.left.append(0)
        self.right.append(0)
        self.up.append(link)
        return len(self.len) - 1

    def _splay(self, x: int) -> None:
        """Makes ``x`` the root of its path's splay tree."""
        left, right, up = self.left, self.right, self.up
        path = [x]
        p = up[x]
        while p and (left[p] == path[-1] or right[p] == path[-1]):
            path.append(p)
            p = up[p]
        if len(path) == 1:
            return
        self.end[x] = self.end[path[-1]]
        at = 1
        while at < len(path):
            p = path[at]
            if at + 1 < len(path):
                g = path[at + 1]
                self._rotate(p if (left[g] == p) == (left[p] == x) else x)
            self._rotate(x)
            at += 2

    def _rotate(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        p = up[x]
        g = up[p]
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner:
            up[inner] = p
        up[p], up[x] = x, g
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def _hang(self, x: int, link: int) -> None:
        """Cuts ``x`` from its link and hangs it, with what is below it, from another state."""
        self._splay(x)
        above = self.left[x]
        if above:
            self.left[x], self.up[above], self.end[above] = 0, self.up[x], self.end[x]
        self.up[x] = self.link[x] = link

    def append(self, word: int) -> list[tuple[int, int]]:
        """(last end, length) of the path segments of the new word's suffixes, longest first; then they all end here."""
        follow, link, length = self.follow, self.link, self.len
        p, new = self.last, self._state(length[self.last] + 1, 0, {}, -1)
        while p and word not in follow[p]:
            follow[p][word] = new
            p = link[p]
        if not p:
            to = 1
        else:
            to = follow[p][word]
            if length[to] != length[p] + 1:
                self._splay(to)
                copy = self._state(length[p] + 1, link[to], dict(follow[to]), self.end[to])
                self._hang(to, copy)
                old, to = to, copy
                while p and follow[p].get(word) == old:
                    follow[p][word] = copy
                    p = link[p]
        link[new] = self.up[new] = to
        self.last = new
        return self._recolour(new)

    def _recolour(self, x: int) -> list[tuple[int, int]]:
        right, up, end = self.right, self.up, self.end
        segments, below = [], 0
        while x:
            self._splay(x)
            if end[x] >= 0:
                segments.append((end[x], self.len[x]))
            if right[x]:
                end[right[x]] = end[x]
            right[x] = below
            if below:
                up[below] = x
            below, x = x, up[x]
        end[below] = self.n
        self.n += 1
        return segments


def runs(words: list[int], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All (start, length, period) of a sequence: stretches of at least ``least`` words and ``times`` of their smallest period
    that no neighbour extends, by start and period."""
    ends, found, upto = LastEnds(), {}, {}
    n = len(words)
    for i, word in enumerate(words):
        for end, size in ends.append(word):
            period = i - end
            if size < period or size + period < max(least, times * period) or i <= upto.get(period, -1):
                continue
            first, last = i - size - period + 1, i
            while first and words[first - 1] == words[first - 1 + period]:
                first -= 1
            while last + 1 < n and words[last + 1] == words[last + 1 - period]:
                last += 1
            upto[period] = last
            at = (first, last)
            found[at] = min(period, found.get(at, period))
    return sorted((first, last - first + 1, period) for (first, last), period in found.items())


def repetitive(words: np.ndarray, texts: np.ndarray, gram: int = GRAM) -> list[tuple[int, int]]:
    """(start, end) of the stretches in which every ``gram`` words in a row stand twice or more in the same text. ``texts`` has
    the number of each word's text. Words in a row are compared by 64-bit hashes; equal ones by chance only make a stretch longer."""
    n = len(words) - gram + 1
    if n <= 0:
        return []
    mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    key = texts[:n].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    for k in range(gram):
        key = key * np.uint64(0xD6E8FEB86659FD93) + (mixed[k : k + n] ^ (mixed[k : k + n] >> np.uint64(32)))
    inside = texts[:n] == texts[gram - 1 :]
    order = np.argsort(key, kind="stable")
    order = order[inside[order]]
    same = key[order[1:]] == key[order[:-1]]
    repeated = np.zeros(n + 2, dtype=np.int8)
    repeated[order[1:][same] + 1] = 1
    repeated[order[:-1][same] + 1] = 1
    # a text's first stretch does not go on from the one before it
    step = np.diff(repeated)
    starts, stops = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return list(zip(starts.tolist(), (stops + gram - 1).tolist()))


def _texts(values: list[list[bytes]], least: int, times: int, gram: int) -> list[list[Run]]:
    """The runs of each text of a batch."""
    known: dict[bytes, int] = {}
    sizes = np.array([len(words) for words in values], dtype=np.int64)
    flat = np.fromiter((known.setdefault(w, len(known)) for words in values for w in words), dtype=np.int64, count=int(sizes.sum()))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out: list[list[Run]] = [[] for _ in values]
    for start, stop in repetitive(flat, np.repeat(np.arange(len(values)), sizes), gram):
        if stop - start >= least:
            text = int(np.searchsorted(offsets, start, side="right")) - 1
            shift = start - int(offsets[text])
            out[text] += [(first + shift, size, period) for first, size, period in runs(flat[start:stop].tolist(), least, times)]
    return out


def collapse(words: list[bytes], found: list[Run]) -> bytes:
    """The words that stay, joined by spaces: of each run only the first period, unless another run takes it too."""
    if found:
        gone = np.zeros(len(words) + 1, dtype=np.int64)
        for start, size, period in found:
            gone[start + period] += 1
            gone[start + size] -= 1
        words = [w for w, k in zip(words, np.cumsum(gone).tolist()) if not k]
    return b" ".join(words)


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with every tenth text, by its id's checksum, ending in repetitions of a passage: the contract's test bed."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES, change: Change | None = None) -> DataFrame:
    """``docs`` with n_words, runs (start, length and period, by start and period), best (of the greatest length over period;
    ties: smallest start, then period; null without a run) and collapsed (the words left when each run keeps its first period).

    ``change`` may replace a text's words by others before they are looked at, by id.
    """
    if least < 3 * GRAM or times < 3:
        raise ValueError(f"runs have at least {3 * GRAM} words and 3 periods")
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    added = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("best", run), T.StructField("collapsed", T.StringType())]
    names = {f.name for f in added}
    schema = T.StructType([f for f in docs.schema.fields if f.name not in names] + added)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
        as_dict = lambda r: dict(zip(("start", "length", "period"), r))
        for whole in batches:
            keep = [n for n in whole.schema.names if n not in names]
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                values = [(x or b"").split() for x in batch.column(text).cast(pa.binary()).to_pylist()]
                if change:
                    values = [change(key, words) for key, words in zip(batch.column(doc_id).to_pylist(), values)]
                found = _texts(values, least, times, GRAM)
                best = [max(rs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if rs else None for rs in found]
                columns = [
                    pa.array([len(words) for words in values], pa.int64()),
                    pa.array([[as_dict(r) for r in rs] for rs in found], pa.list_(struct)),
                    pa.array([as_dict(r) if r else None for r in best], struct),
                    pa.array([collapse(words, rs) for words, rs in zip(values, found)], pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *columns], names=[*keep, *(f.name for f in added)])

    return docs.mapInArrow(find, schema)


#: DuckDB: the unsigned CRC-32 of the text in {}, bit by bit.
CRC32 = (
    "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({}, ''), "
    "lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
    "lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"
)

ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS raw, @CRC@ AS h FROM documents),
f AS (SELECT *, len(raw) AS n, CASE WHEN h % 10 = 0 AND len(raw) > 0 THEN (h // 10) % len(raw) END AS a, h // 10 AS g FROM d),
c AS (SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN raw ELSE list_transform(range(0, n), lambda i: raw[CASE WHEN i < a THEN i
             ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) END AS words FROM f),
w AS (SELECT rid, n, unnest(words) AS word, unnest(range(0, n)) AS i FROM c),
p AS (SELECT x.rid, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
g AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM p),
s AS (SELECT rid, q, min(i) AS s, max(i) + q AS e FROM g GROUP BY rid, q, island HAVING max(i) + q - min(i) + 1 >= greatest(24, 3 * q)),
r AS (SELECT rid, s AS start, e - s + 1 AS length, min(q) AS period FROM s GROUP BY rid, s, e),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT w.rid, string_agg(word, ' ' ORDER BY w.i) AS collapsed FROM w ANTI JOIN gone ON w.rid = gone.rid AND w.i = gone.i GROUP BY w.rid),
b AS (SELECT *, row_number() OVER (PARTITION BY r.rid ORDER BY length::DOUBLE / period DESC, start, period) AS rank FROM r),
t AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY rid)
SELECT c.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period,
       (1000 * b.length // b.period)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM c LEFT JOIN t ON c.rid = t.rid LEFT JOIN kept ON c.rid = kept.rid LEFT JOIN b ON c.rid = b.rid AND b.rank = 1
""".replace("@CRC@", CRC32.format("coalesce(doc_id, 1)::VARCHAR"))
