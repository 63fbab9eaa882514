"""Language-model scores by a log-bilinear neural model over word classes.

A word's probability is that of its class after the two classes before it, times the word's share of its class. Classes are
the most frequent words by themselves, groups of words with a common ending, all other words, and the end of the text. The
class model is log-bilinear (the next class is scored by the product of its vector with a linear prediction from the vectors
before it), trained in numpy by noise-contrastive estimation in full passes over all the corpus's class trigrams; batched matrix products over
all pairs of classes then give its normalised log-probabilities. Shares are smoothed counts over the whole training corpus.

What is gathered: every training document's word counts (shuffled by word) and its class trigrams (added up in an array of
fixed size). Counts of frequent words (a table of bounded size) are joined inside the tasks that read the texts; the other
words are shuffled with their frequencies and joined to the counts.

Defined cases: null and empty texts consist of their end; ids that are null count as the empty string when folds are dealt;
repeated rows are learnt from and scored each; without training documents classes are equally likely; an empty table gives an
empty table. The row number that ties the parts of a row together needs an input that reads the same again, such as files.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Carried, array_chunks, merged_array, most_frequent
from tickloom.session import materialize

#: Classes: the end, frequent words, endings, and one for the rest.
CLASSES, FREQUENT = 96, 47
#: Bytes of an ending; words joined inside the reading tasks, and their longest length; words whose class a task remembers.
ENDING, HOT, HOT_BYTES, REMEMBERED = 3, 100_000, 32, 500_000
#: Counts of words that a task holds before it adds them up and passes them on, if most are of different words; bytes of text cut at once.
HELD, SLICE = 1_000_000, 4_000_000
_MARKS = b".,;:!?\"'()!*#$%&<>|"


def ending(word: bytes) -> bytes:
    return word.rstrip(_MARKS)[-ENDING:]


class Classes:
    """Class of a word: its own, its ending's, or the last one."""

    def __init__(self, words: list[bytes], endings: list[bytes]) -> None:
        self.own = {w: 1 + i for i, w in enumerate(words)}
        self.by_ending = {e: 1 + FREQUENT + i for i, e in enumerate(endings)}
        self._seen: dict[bytes, int] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_seen": {}}

    def of(self, word: bytes) -> int:
        if (c := self._seen.get(word)) is None:
            c = self.own.get(word) or self.by_ending.get(ending(word), CLASSES - 1)
            if len(self._seen) >= REMEMBERED:
                self._seen.clear()
            self._seen[word] = c
        return c


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive texts of about ``SLICE`` bytes together."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // SLICE
    ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)] if len(texts) else []
    for lo, hi in zip([0, *ends], ends):
        yield texts.slice(lo, hi - lo)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A-Z in lower case, cut at the six white-space characters: distinct words, the number of each word of the texts in turn,
    words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, n = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves an empty string there
    sizes = np.bincount(np.repeat(np.arange(len(n)), n)[full], minlength=len(n))
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return coded.dictionary.cast(pa.binary()), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes


def trigrams_of(kinds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers of the class trigrams of texts, one after another: two ends before each text, its words, its end."""
    starts = np.cumsum(sizes + 3) - (sizes + 3)
    path, third = np.zeros(int(sizes.sum()) + 3 * len(sizes), np.int64), np.ones(int(sizes.sum()) + 3 * len(sizes), bool)
    path[np.arange(len(kinds)) + np.repeat(3 * np.arange(len(sizes)) + 2, sizes)] = kinds
    third[starts] = third[starts + 1] = False
    at = np.flatnonzero(third)
    return (path[at - 2] * CLASSES + path[at - 1]) * CLASSES + path[at]


class LogBilinear:
    """Scores of a class after two others: (before1 P1 + before2 P2) . target + bias."""

    def __init__(self, size: int = 24, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.rng, k = rng, CLASSES
        self.source, self.target = rng.normal(0, 0.1, (k, size)), rng.normal(0, 0.1, (k, size))
        self.place = np.stack([np.eye(size) * 0.5] * 2) + rng.normal(0, 0.02, (2, size, size))
        self.bias = np.full(k, -math.log(k))

    def fit(self, trigrams: np.ndarray, steps: int = 700, noise: int = 48, rate: float = 0.1) -> LogBilinear:
        """Noise-contrastive estimation: tell the corpus's classes from ``noise`` times as many classes drawn by frequency, after
        contexts of the corpus. Every step is a pass over all trigrams by their counts, with the expected noise: matrix products
        over all pairs of classes, whatever the size of the corpus."""
        n = trigrams.reshape(CLASSES**2, CLASSES).astype(float)
        total = n.sum()
        if not total:
            return self
        n /= total
        unigram = n.sum(axis=0) * total + 0.5
        unigram /= unigram.sum()
        self.bias = np.log(unigram)
        drawn, log_noise = n.sum(axis=1, keepdims=True) * (noise * unigram), np.log(noise * unigram)
        both = n + drawn
        squares = [np.full_like(x, 1e-6) for x in (self.source, self.target, self.place, self.bias)]
        for _ in range(steps):
            q = ((self.source @ self.place[0])[:, None] + self.source @ self.place[1]).reshape(CLASSES**2, -1)
            logit = np.clip(q @ self.target.T + (self.bias - log_noise), -30, 30)
            up = n - both / (1 + np.exp(-logit))  # n (1 - p) - drawn p
            dq = (up @ self.target).reshape(CLASSES, CLASSES, -1)
            first, second = dq.sum(axis=1), dq.sum(axis=0)
            grads = [first @ self.place[0].T + second @ self.place[1].T, up.T @ q, np.stack((self.source.T @ first, self.source.T @ second)), up.sum(axis=0)]
            for x, g, s in zip((self.source, self.target, self.place, self.bias), grads, squares):
                s += g * g
                x += rate * g / np.sqrt(s)
        return self

    def table(self) -> np.ndarray:
        """log10 P(class | two classes before), for all pairs, by batches of matrix products."""
        out = np.empty((CLASSES, CLASSES, CLASSES), np.float32)
        behind = self.source @ self.place[1]
        for a in range(CLASSES):
            s = (self.source[a] @ self.place[0] + behind) @ self.target.T + self.bias
            s -= s.max(axis=1, keepdims=True)
            out[a] = (s - np.log(np.exp(s).sum(axis=1, keepdims=True))) / math.log(10)
        return out


def word_counts(docs: DataFrame, text: str, most: int = HELD) -> DataFrame:
    """(word, c) over all texts; tasks add up before anything is shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n = 0

        def added() -> pa.Table:
            t = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")])
            return t.select(["word", "c_sum"]).rename_columns(["word", "c"])

        for batch in batches:
            for texts in slices(batch.column(0)):
                words, at, _ = words_of(texts)
                held.append(pa.table({"word": words, "c": np.bincount(at, minlength=len(words))}))
                n += len(words)
                if n >= most:
                    held = [added()]
                    n = held[0].num_rows
                    if n > most // 2:
                        yield from held[0].to_batches()
                        held, n = [], 0
        if n:
            yield from added().to_batches()

    return docs.select(text).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _per_word(counts: DataFrame, key, kind: str) -> DataFrame:
    """Sums of c, and words, by a function of the word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, n = Counter(), Counter()
        for batch in batches:
            for w, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k = key(w)
                c[k] += x
                n[k] += 1
        if c:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)), pa.array(list(c.values()), pa.int64()), pa.array([n[k] for k in c], pa.int64())], names=["k", "c", "n"])

    return counts.select("word", "c").mapInArrow(run, f"k {kind}, c long, n long").groupBy("k").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def score(docs: DataFrame, held: Column, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from rows where ``held`` is false."""
    sc = docs.sparkSession.sparkContext
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), held.alias("held"), F.col(text).alias("text"))
    train = d.where(~F.col("held"))
    counts = materialize(word_counts(train, "text"), "word_counts")
    ends = train.count()
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = total + ends, distinct + (ends > 0)

    top = most_frequent(counts.where(F.octet_length("word") <= HOT_BYTES), "c", max(hot, FREQUENT)).collect()
    top.sort(key=lambda r: (-r.c, bytes(r.word)))
    words = [bytes(r.word) for r in top[:FREQUENT]]
    own = set(words)
    endings = [bytes(r.k) for r in _per_word(counts, lambda w: b" " if w in own else ending(w), "binary").where(F.col("k") != b" ")
               .orderBy(F.desc("c"), "k").limit(CLASSES - FREQUENT - 2).collect()]
    classes = Carried(sc, Classes(words, endings))
    sums, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in _per_word(counts, lambda w: classes.value.of(w), "long").collect():
        sums[r.k], kinds[r.k] = r.c, r.n

    def kinds_of(words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(classes.value.of, words), np.int64, len(words))

    def trigrams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for texts in slices(batch.column(0)):
                words, at, sizes = words_of(texts)
                np.add.at(seen, trigrams_of(kinds_of(words.to_pylist())[at], sizes), 1)
        if seen.any():
            yield array_chunks(seen)

    seen = merged_array(train.select("text").mapInArrow(trigrams, "chunk int, part binary"), np.add, CLASSES**3, np.int64)
    table = sc.broadcast(LogBilinear().fit(seen).table())

    base_of = lambda c: np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    shared = np.where(np.arange(CLASSES) > FREQUENT, sums + 0.5 * (kinds + 1), 0.0)  # 0: the class is one word
    share_of = lambda c, k: math.log10((c + 0.5) / shared[k]) if shared[k] else 0.0
    places = {bytes(r.word): i for i, r in enumerate(top)}
    gains = np.array([(base_of(r.c), share_of(r.c, classes.value.of(bytes(r.word)))) for r in top] + [(0.0, 0.0)])  # at last: none of these
    known = sc.broadcast((places, gains))
    end_base, end_known = float(base_of(ends)), int(ends > 0)
    columns = "row long, doc_id " + docs.schema[doc_id].dataType.simpleString() + ", held boolean, n_tokens long, n_known long, base double, score double, word binary, n long, class int"
    names = [c.split()[0] for c in columns.split(", ")]

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text with what its frequent words and its classes give, and a row for each of its other words."""
        (place, gain), logs = known.value, table.value.reshape(-1)
        for batch in batches:
            lo = 0
            for texts in slices(batch.column(3)):
                words, at, sizes = words_of(texts)
                size, listed, each = len(texts), words.to_pylist(), np.arange(len(texts))
                class_of, place_of = kinds_of(listed), np.fromiter(map(place.get, listed, repeat(len(place))), np.int64, len(listed))
                model = np.bincount(np.repeat(each, sizes + 1), logs[trigrams_of(class_of[at], sizes)], size)
                pairs, m = np.unique(np.repeat(each, sizes) * len(words) + at, return_counts=True)
                owner, w = np.divmod(pairs, max(len(words), 1))
                hit = place_of[w] < len(place)
                total_of = lambda x: np.bincount(owner[hit], x, size)  # noqa: E731, B023
                of_words = gain[place_of[w[hit]]] * m[hit, None]
                values = (sizes + 1, end_known + total_of(m[hit]).astype(np.int64), end_base + total_of(of_words[:, 0]), model + total_of(of_words[:, 1]))
                head = [c.slice(lo, size) for c in batch.columns[:3]]
                kinds_ = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([*head, *[pa.array(x, t) for x, t in zip(values, kinds_)], pa.nulls(size, pa.binary()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int32())], names=names)
                rest = ~hit
                if rest.any():
                    w, n_rest = w[rest], int(rest.sum())
                    none = [pa.nulls(n_rest, t) for t in (batch.column(1).type, pa.bool_(), *kinds_)]
                    yield pa.RecordBatch.from_arrays([head[0].take(pa.array(owner[rest])), *none, words.take(pa.array(w)), pa.array(m[rest], pa.int64()), pa.array(class_of[w], pa.int32())], names=names)
                lo += size

    # rows without a word get a key of their own (no word has a space), so that they are spread as well
    d = d.mapInArrow(spread, columns).withColumn("key", F.coalesce("word", F.concat(F.lit(" "), F.col("row").cast("string")).cast("binary")))
    d = d.join(counts.withColumnRenamed("word", "key"), "key", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sizes = F.element_at(F.array(*[F.lit(float(x)) for x in shared]), F.col("class") + 1)
    rare = F.col("word").isNotNull()
    base = F.when(rare, F.col("n") * F.log10((F.col("c") + 0.5) / F.lit(n + 0.5 * (v + 1)))).otherwise(F.col("base"))
    model = F.when(rare, F.when(sizes > 0, F.col("n") * F.log10((F.col("c") + 0.5) / sizes)).otherwise(0.0)).otherwise(F.col("score"))
    seen_n = F.when(rare, F.when(F.col("c") > 0, F.col("n")).otherwise(0)).otherwise(F.col("n_known"))
    out = d.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum(seen_n).alias("n_known"),
                               F.sum(base).alias("base_score"), F.sum(model).alias("score"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
