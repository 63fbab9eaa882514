"""Token counts without token ids: the pieces of each distinct pre-token are counted once and joined to the documents.

A text is cut where no piece of the vocabulary can cross: before every run of spaces, around line feeds, and between a letter
and a full stop or comma if the vocabulary has no such pair. A text's count is the sum over its pre-tokens of frequency
times pieces. Frequent pre-tokens (a table of bounded size) are joined inside the tasks that read the texts; the others
are shuffled by pre-token with their frequencies, counted once each where they meet, and summed per document.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; texts and pre-tokens may be
of any length; ids may be null; an empty table gives an empty table; columns not asked for are not read.
The row number that ties the parts of a row together needs an input that reads the same again, such as files.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import Carried, most_frequent
from tickloom.session import materialize

#: Pre-tokens joined inside the reading tasks, their longest length in characters, and how many candidates a task proposes.
HOT, HOT_CHARS, PROPOSED = 200_000, 24, 20_000
#: Distinct pre-tokens that a task holds before it forgets the rare ones.
HELD = 1_000_000
SPACE_PIECE = "▁"


class Pieces:
    """Pre-tokens of a text, and the number of pieces of a pre-token, by a BPE model without extra rules for spaces."""

    def __init__(self, model: bytes) -> None:
        self.model = model
        self.load()
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        if any(re.search(f"[^{SPACE_PIECE}]{SPACE_PIECE}|.\n|\n.", p) for p in pieces) or len(self.lib.encode(" a")) < len(self.lib.encode("a")):
            raise ValueError("pieces of this model cross spaces or lines")
        letter = r"(?<=[^\W\d_])"
        cut = not any(re.search(letter + "[.,]", p) for p in pieces)
        self.pattern = (rf" *[^ \n.,]++(?:{letter}(?=[.,])|(?![.,]))|" if cut else "") + r" *[^ \n]+| +|\n"
        self.find = re.compile(self.pattern).findall

    def load(self) -> None:
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        self.line = len(self.lib.encode("\n"))

    def __getstate__(self) -> dict:
        return {"model": self.model, "pattern": self.pattern}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.load()
        self.find = re.compile(self.pattern).findall

    def split(self, text: str) -> list[str]:
        """The model puts a space before the text."""
        return self.find(" " + text.replace(SPACE_PIECE, " ")) if text else []

    def count(self, pre_tokens: list[str]) -> list[int]:
        lead = [p[0] == " " for p in pre_tokens]
        ids = self.lib.encode([p[1:] if s else "\n" + p for p, s in zip(pre_tokens, lead)], num_threads=1)
        # a lone space is one piece, which the library leaves out of an empty text
        return [(len(x) or 1) if s else len(x) - self.line for x, s in zip(ids, lead)]


def frequent(docs: DataFrame, pieces: Pieces, text: str = "text", size: int = HOT) -> list[str]:
    """At most ``size`` short pre-tokens that are frequent in the whole corpus. Each task proposes its most frequent ones;
    which are taken decides about the way of the rest, not about results."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(pieces.split(t))
            if len(seen) > HELD:
                seen = Counter(dict(seen.most_common(HELD // 2)))
        top = [x for x in seen.most_common(PROPOSED) if len(x[0]) <= HOT_CHARS]
        if top:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in top]), pa.array([x[1] for x in top], pa.int64())], names=["token", "n"])

    found = docs.select(text).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return sorted(r.token for r in most_frequent(materialize(found, "proposed"), "n", size).collect())


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", keep: Sequence[str] = ("doc_id",), size: int = HOT) -> DataFrame:
    """One row per row of ``docs``: the kept columns, n_bytes (UTF-8) and n_tokens (long)."""
    with open(model_path, "rb") as f:
        pieces = Pieces(f.read())
    sc = docs.sparkSession.sparkContext
    names = frequent(docs, pieces, text, size)
    hot = sc.broadcast(dict(zip(names, pieces.count(names) if names else [])))
    lib = Carried(sc, pieces)

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*keep).alias("_keep"), F.col(text).alias("_text"))
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in rows.schema.fields[:2]), T.StructField("_bytes", T.LongType()), T.StructField("_token", T.StringType()), T.StructField("_n", T.LongType())])

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text with the tokens of its frequent pre-tokens, and a row for each of the others with its frequency."""
        known, split = hot.value.get, lib.value.split
        for batch in batches:
            n_bytes, sums, owner, token, freq = [], [], [], [], []
            for row, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                total = 0
                for p, n in Counter(split(t or "")).items():
                    if (k := known(p)) is not None:
                        total += n * k
                    else:
                        owner.append(row)
                        token.append(p)
                        freq.append(n)
                n_bytes.append(len((t or "").encode()))
                sums.append(total)
            whole = len(n_bytes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_bytes, pa.int64()), pa.nulls(whole, pa.string()), pa.array(sums, pa.int64())], names=schema.names)
            if owner:
                none = pa.nulls(len(owner), batch.column(1).type)
                yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), none, pa.nulls(len(owner), pa.int64()), pa.array(token), pa.array(freq, pa.int64())], names=schema.names)

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by pre-token: each is counted when it first appears."""
        last, last_n = None, 1
        for batch in batches:
            tokens = batch.column(3).to_pylist()
            new = list(dict.fromkeys(t for t in tokens if t is not None and t != last))
            counted = dict(zip(new, lib.value.count(new) if new else []))
            if last is not None:
                counted[last] = last_n
            out = [n if t is None else n * counted[t] for t, n in zip(tokens, batch.column(4).to_pylist())]
            if tokens and tokens[-1] is not None:
                last, last_n = tokens[-1], counted[tokens[-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.int64())], names=["_row", "_keep", "_bytes", "_n"])

    d = rows.mapInArrow(spread, schema)
    d = d.repartition(F.coalesce("_token", F.col("_row").cast("string"))).sortWithinPartitions("_token")
    d = d.mapInArrow(joined, T.StructType([f for f in schema.fields if f.name != "_token"]))
    d = d.groupBy("_row").agg(F.max(F.when(F.col("_bytes").isNotNull(), F.struct("_bytes", "_keep"))).alias("r"), F.sum("_n").alias("n_tokens"))
    kept = [F.col(f"r._keep.{c}").alias(c) for c in keep if c not in ("n_bytes", "n_tokens")]
    return d.select(*kept, F.col("r._bytes").alias("n_bytes"), "n_tokens")
