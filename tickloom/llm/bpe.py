"""Byte-level BPE by prefix dynamic programming.

For a piece of text, every byte prefix has exactly one token that can stand last in the prefix's encoding: the token that
ends there and is compatible with the last token of the prefix before it. Two tokens are compatible if the merges leave
their concatenation as just these two. A piece's table of last tokens therefore holds the encodings of all its prefixes:
an append extends the table, and an edit recomputes it from the edited byte on.

Defined cases: a null text counts as empty and has no ids; ids that are null decode to empty bytes; repeated rows are encoded
each; an existing column with the name of the result is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tickloom.llm.common import Carried, with_arrow_column

#: Distinct pieces, and token pairs, that a worker remembers before it starts over.
REMEMBERED = 150_000
#: Pieces of more bytes get a whole table from left to right; in shorter ones only the prefixes in question are looked at.
WHOLE_TABLE = 200
#: A pre-token's end depends on this many characters behind it at most.
LOOK_AHEAD = 3


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def latin_pattern(pattern: str) -> re.Pattern:
    """The pattern for texts of Latin-1 characters only, its Unicode classes spelt out: the standard matcher is much faster then."""
    chars = [chr(i) for i in range(256)]

    def members(name: str) -> str:
        return "".join(re.escape(c) for c in chars if regex.match(name, c))

    for name in sorted(set(re.findall(r"\\p\{\w+\}|\\s", pattern))):
        pattern = re.sub(r"\[[^\]]*\]", lambda m: m.group().replace(name, members(name)), pattern).replace(name, f"[{members(name)}]")  # noqa: B023
    return re.compile(pattern.replace(r"\S", f"[^{members(chr(92) + 's')}]"))


def halves(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """For every token of two or more parts, the two that its last merge joins (a token that no merges make has none)."""
    out = {}
    for token, rank in ranks.items():
        if len(token) > 1 and len(pair := merged(token, ranks, 2)) == 2 and pair[0] + pair[1] == token:
            out[rank] = (ranks[pair[0]], ranks[pair[1]])
    return out


def merged(piece: bytes, ranks: dict[bytes, int], stop: int = 1) -> list[bytes]:
    """The plain merges: always the adjacent pair of lowest rank, leftmost first, until ``stop`` parts are left."""
    parts, none = [piece[i : i + 1] for i in range(len(piece))], 1 << 60
    while len(parts) > stop:
        best, at = min((ranks.get(a + b, none), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
        if best == none:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class PrefixEncoder:
    """Encodes pieces and texts by the last tokens of their prefixes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, split: dict[int, tuple[int, int]] | None = None) -> None:
        self.ranks, self.any, self.latin = ranks, regex.compile(pattern), latin_pattern(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.halves = halves(ranks) if split is None else split
        self._fit: dict[tuple[int, int], bool] = {}
        self._last: dict[bytes, int] = {}
        self._known: dict[str, list[int]] = {}

    def _apart(self, a: int, b: int) -> bool:
        """Whether the merges of the bytes of ``a`` and ``b`` never join across their border.

        Goes back in time: of the two tokens at the border, the one that was made last is taken apart, and the pair at the
        border must not have had a merge that came before that. Equal merges go from left to right.
        """
        before, get, bytes_of, parts = 1 << 60, self.ranks.get, self.bytes_of, self.halves
        while True:
            joined = get(bytes_of[a] + bytes_of[b])
            if joined is not None and joined < before:
                return False
            if a in parts and (a > b or b not in parts):
                before, a = a, parts[a][1]
            elif b in parts:
                before, b = b + 1, parts[b][0]
            else:
                return True

    def fits(self, before: int, after: int) -> bool:
        key = (before, after)
        if (ok := self._fit.get(key)) is None:
            if len(self._fit) >= REMEMBERED:
                self._fit.clear()
            ok = self._fit[key] = self._apart(before, after)
        return ok

    def last_token(self, prefix: bytes) -> int:
        """The last token of a prefix; those of shorter prefixes are looked up, or found first, where they are needed."""
        last, get, fit, n = self._last, self.ranks.get, self._fit, len(prefix)
        if (found := last.get(prefix)) is not None:
            return found
        found = get(prefix)
        if found is None or not (n == 1 or found in self.halves):
            for start in range(max(1, n - self.longest), n):
                if (found := get(prefix[start:])) is not None:
                    head = prefix[:start]
                    if (before := last.get(head)) is None:
                        before = self.last_token(head)
                    if (ok := fit.get((before, found))) is None:
                        ok = self.fits(before, found)
                    if ok:
                        break
            else:
                raise ValueError(f"no token ends {prefix!r}")
        if len(last) >= REMEMBERED:
            last.clear()
        last[prefix] = found
        return found

    def last_tokens(self, piece: bytes, known: Iterable[int] = ()) -> list[int]:
        """The last token of every byte prefix; ``known`` are those of a prefix that is already done."""
        last = list(known)
        get, fits, longest = self.ranks.get, self.fits, self.longest
        for end in range(len(last) + 1, len(piece) + 1):
            for start in range(max(0, end - longest), end):
                token = get(piece[start:end])
                if token is not None and (fits(last[start - 1], token) if start else end == 1 or token in self.halves):
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends at byte {end} of {piece!r}")
        return last

    def ids_of(self, last: list[int]) -> list[int]:
        """The encoding that a table of last tokens holds."""
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def forget(self) -> None:
        for known in (self._fit, self._last, self._known):
            known.clear()

    def piece(self, text: str) -> list[int]:
        if (ids := self._known.get(text)) is None:
            raw = text.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                ids = [whole]
            elif len(raw) > WHOLE_TABLE:
                ids = self.ids_of(self.last_tokens(raw))
            else:
                ids = []
                while raw:
                    ids.append(self.last_token(raw))
                    raw = raw[: -len(self.bytes_of[ids[-1]])]
                ids.reverse()
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[text] = ids
        return ids

    def splitter(self, text: str) -> re.Pattern:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any
        return self.latin

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, piece = self._known, self.piece
        for p in self.splitter(text).findall(text):
            out += known.get(p) or piece(p)
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def edit(self, text: str, ids: list[int], at: int, drop: int, put: str) -> tuple[str, list[int]]:
        """The text with ``drop`` characters at ``at`` replaced by ``put``, and its encoding.

        Only the pre-tokens that the edit can touch are encoded again: from the last one that ends well before the edit
        to the first boundary behind it where old and new pre-tokens meet.
        """
        new = text[:at] + put + text[at + drop :]
        shift, starts, begin, head = len(new) - len(text), [], 0, 0
        for m in self.any.finditer(text):
            if m.end() <= at - LOOK_AHEAD:
                begin, head = m.end(), head + len(self.piece(m.group()))
            elif m.start() >= at + drop:
                starts.append(m.start() + shift)
        ends, middle, stop = set(starts), [], len(new)
        for m in self.any.finditer(new, begin):
            if m.start() in ends and m.start() >= at + len(put):
                stop = m.start()
                break
            middle += self.piece(m.group())
        tail = sum(len(self.piece(m.group())) for m in self.any.finditer(new, stop)) if stop < len(new) else 0
        return new, ids[:head] + middle + (ids[len(ids) - tail :] if tail else [])

    def append(self, text: str, ids: list[int], more: str) -> tuple[str, list[int]]:
        return self.edit(text, ids, len(text), 0, more)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids", packed: bool = False) -> DataFrame:
    """Adds the token ids of each whole text: an array of ints, or packed as little-endian unsigned 32-bit integers."""

    # one entry per token of the vocabulary, whatever the input; what a task remembers goes with it
    encoder = Carried(docs.sparkSession.sparkContext, PrefixEncoder(load_ranks(ranks_path), pattern))

    def make():
        enc = encoder.value

        def run(texts: list) -> pa.Array:
            ids = (enc.encode(t) if t else [] for t in texts)
            if packed:
                return pa.array([np.array(x, dtype="<u4").tobytes() for x in ids], pa.binary())
            return pa.array(list(ids), pa.list_(pa.int32()))

        run.forget = enc.forget
        return run

    return with_arrow_column(docs, out, T.BinaryType() if packed else T.ArrayType(T.IntegerType()), text, make)


def decode(docs: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids (an array, or packed) stand for."""

    tables = docs.sparkSession.sparkContext.broadcast({i: b for b, i in load_ranks(ranks_path).items()})

    def make():
        bytes_of = tables.value

        def run(rows: list) -> pa.Array:
            lists = (np.frombuffer(x, "<u4").tolist() if isinstance(x, bytes) else x or () for x in rows)
            return pa.array([b"".join(map(bytes_of.__getitem__, x)) for x in lists], pa.binary())

        return run

    return with_arrow_column(docs, out, T.BinaryType(), ids, make)
