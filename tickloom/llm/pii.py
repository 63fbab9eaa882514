"""Personal data by patterns and by a linear-chain conditional random field over word-shape features.

Patterns give e-mail addresses, IP addresses, card numbers (with their check digit) and international phone numbers. The
random field is trained on the driver from a small labelled table of lines and adds spans that no pattern span touches, such as
national phone numbers and mistyped card numbers. Words that are longer than what the features see (minified data, addresses of
pages, scripts without spaces) are cut into tokens first, so that nothing in them stays unseen. It labels whole lines; training checks that a line of plain words can only
be labelled as such (the margin of its scores exceeds anything that transitions can give), so lines without a digit or an
at sign need no decoding. The others are decoded together by Viterbi in numpy.

Defined cases: null and empty texts have no spans; repeated rows are scanned each; texts may be of any length (every step is
linear in it); an empty table gives an empty table; an existing column with the result's name is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import WORD, Carried, with_arrow_column

KINDS = ["email", "ip", "card", "phone"]
#: Tags: 0 outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))
#: Distinct words whose scores a task remembers, and words that are decoded together.
REMEMBERED, DECODED = 100_000, 200_000

#: Characters of a shape; longer words with a digit are cut into tokens.
SEEN = 24

_WORD = re.compile(WORD)
_NUMBER = r"\+?[0-9](?:[.-]?[0-9]){6,}"
_HEX = r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9a-fA-F]{64}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32})(?![0-9A-Za-z])"
#: Tokens of a long word: UUIDs and digests (look-alikes of the labelled table), bracketed digits, numbers of seven and more digits, ASCII letters with shorter numbers, other letters, marks.
_TOKEN = re.compile(rf"{_HEX}|\([0-9]+\)|{_NUMBER}|(?:(?!{_NUMBER})[A-Za-z0-9])+|(?:(?![A-Za-z0-9])[^\W_])+|(?:(?!\([0-9]|\+[0-9])[\W_])+|.")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = sum(int(d) if k % 2 == 0 else (2 * int(d) - 9 if int(d) > 4 else 2 * int(d)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _emails(text: str) -> Iterable[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", at + 1)


def _ips(text: str) -> Iterable[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans, by kind and start."""
    out = [("email", *s) for s in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *s) for s in _ips(text)]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def words_of(line: str) -> list[re.Match]:
    """What the field labels: words, and the tokens of long ones."""
    out: list[re.Match] = []
    for m in _WORD.finditer(line):
        if m.end() - m.start() > SEEN and _DIGIT.search(line, m.start(), m.end()):
            out += _TOKEN.finditer(line, m.start(), m.end())
        else:
            out.append(m)
    return out


def shape(word: str) -> str:
    """Runs of digits by their length, runs of letters, and all else as it is."""
    s = re.sub(r"[0-9]+", lambda m: "9" + "abcdefghijklmnopqrs"[min(len(m.group()), 19) - 1], word[:60])
    return re.sub(r"[^\W\d_]{3,}", "w", re.sub(r"9[a-s]", lambda m: "<" + str(ord(m.group()[1]) - 96) + ">", s))[:SEEN]


def _coarse(word: str) -> str:
    digits = sum(c in "0123456789" for c in word[:40])
    mark = "@" if "@" in word else "+" if word[0] == "+" else "(" if word[0] == "(" else "-" if "-" in word else "." if "." in word[:-1] else ""
    return mark + str(min(digits, 5) if digits < 8 else 8 if digits < 13 else 13 if digits < 20 else 20) if digits or mark else "plain"


def features(word: str) -> list[str]:
    digits = sum(c in "0123456789" for c in word[:40])
    letters = any(c.isalpha() for c in word[:200])
    bare = word.strip(".,;:!?\"'|*#$%&<>")
    return ["bias", "s:" + shape(bare), "c:" + _coarse(word), f"d:{digits}:{letters}", f"at:{'@' in word[1:]}", f"dots:{min(bare.count('.'), 4)}:{letters}",
            f"dash:{min(bare.count('-'), 4)}:{letters}"]


class Field:
    """Weights of a linear-chain random field: features of a word, coarse classes of its neighbours, pairs of tags."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.near: dict[str, int] = {"": 0, "plain": 1}
        self._seen: dict[str, tuple[np.ndarray, int]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_seen": {}}

    def _ids(self, word: str, grow: bool = False) -> list[int]:
        if grow:
            for f in features(word):
                self.index.setdefault(f, len(self.index))
            self.near.setdefault(_coarse(word), len(self.near))
        return [self.index[f] for f in features(word) if f in self.index]

    def forget(self) -> None:
        self._seen.clear()

    def word(self, word: str) -> tuple[np.ndarray, int]:
        """Scores of the tags by the word itself, and its class as a neighbour."""
        if (known := self._seen.get(word)) is None:
            if len(self._seen) >= REMEMBERED:
                self._seen.clear()
            known = self._seen[word] = (self.own[self._ids(word)].sum(axis=0), self.near.get(_coarse(word), 0))
        return known

    def fit(self, lines: list[tuple[list[str], list[int]]], steps: int = 120, rate: float = 0.15, decay: float = 2e-3) -> Field:
        """Maximum likelihood with weight decay, by gradient steps on all lines at once."""
        ids = [[self._ids(w, True) for w in words] for words, _ in lines]
        size, longest = len(lines), max(len(w) for w, _ in lines)
        mask, gold = np.zeros((size, longest), bool), np.zeros((size, longest), int)
        hot = np.zeros((size, longest, len(self.index)), np.float32)
        prev, nxt = np.zeros((size, longest), int), np.zeros((size, longest), int)
        for i, (words, tags) in enumerate(lines):
            mask[i, : len(words)], gold[i, : len(words)] = True, tags
            classes = [self.near[_coarse(w)] for w in words]
            prev[i, 1 : len(words)], nxt[i, : len(words) - 1] = classes[:-1], classes[1:]
            for t, row in enumerate(ids[i]):
                hot[i, t, row] = 1
        n = len(self.near)
        context = np.concatenate((np.eye(n, dtype=np.float32)[prev], np.eye(n, dtype=np.float32)[nxt]), axis=2)
        x = np.concatenate((hot, context), axis=2) * mask[:, :, None]
        want = np.eye(TAGS, dtype=np.float32)[gold] * mask[:, :, None]
        w, pair = np.zeros((x.shape[2], TAGS)), np.zeros((TAGS, TAGS))
        both = mask[:, 1:] & mask[:, :-1]
        pair_want = np.zeros((TAGS, TAGS))
        np.add.at(pair_want, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        moments = [np.zeros_like(w), np.zeros_like(pair), np.zeros_like(w), np.zeros_like(pair)]
        last = mask.sum(axis=1) - 1
        for step in range(1, steps + 1):
            score = x @ w
            fwd, bwd = np.zeros((size, longest, TAGS)), np.zeros((size, longest, TAGS))
            fwd[:, 0] = score[:, 0]
            for t in range(1, longest):
                fwd[:, t] = np.where(mask[:, t, None], score[:, t] + _log_sum(fwd[:, t - 1, :, None] + pair, 1), fwd[:, t - 1])
            for t in range(longest - 2, -1, -1):
                bwd[:, t] = np.where(mask[:, t + 1, None], _log_sum(pair + (score[:, t + 1] + bwd[:, t + 1])[:, None, :], 2), 0)
            whole = _log_sum(fwd[np.arange(size), last], 1)
            margin = np.exp(fwd + bwd - whole[:, None, None]) * mask[:, :, None]
            joint = np.exp(fwd[:, :-1, :, None] + pair + (score[:, 1:] + bwd[:, 1:])[:, :, None, :] - whole[:, None, None, None])
            grads = [np.einsum("btf,bty->fy", x, want - margin) / size - decay * w, (pair_want - (joint * both[:, :, None, None]).sum(axis=(0, 1))) / size - decay * pair]
            for k, (value, g) in enumerate(zip((w, pair), grads)):
                moments[k] = 0.9 * moments[k] + 0.1 * g
                moments[k + 2] = 0.99 * moments[k + 2] + 0.01 * g * g
                value += rate * (moments[k] / (1 - 0.9**step)) / (np.sqrt(moments[k + 2] / (1 - 0.99**step)) + 1e-8)
        self.own, self.before, self.behind, self.pair = w[: len(self.index)], w[len(self.index) : -n], w[-n:], pair
        return self

    def plain_margin(self) -> float:
        """By how much a plain word between plain words is outside, beyond what pairs of tags can give a run of words: into it,
        out of it, or from each of its words to the next."""
        worst = np.inf
        for word in ("word", "Word,", "WORD.", "mot!!", "é", "|", "###", "-", "a"):
            score = self.word(word)[0]
            for p in (0, 1):
                for q in (0, 1):
                    s = score + self.before[p] + self.behind[q]
                    worst = min(worst, s[0] - s[1:].max())
        gain = np.maximum(self.pair - self.pair[0, 0], 0)
        return worst - max(gain[1:, 1:].max(), gain[0, 1:].max() + gain[1:, 0].max())

    def decode(self, lines: list[list[str]]) -> list[np.ndarray]:
        """The best tags of each line, all lines together, longest first."""
        order = sorted((i for i in range(len(lines)) if lines[i]), key=lambda i: -len(lines[i]))
        sizes = np.array([len(lines[i]) for i in order])
        longest = int(sizes[0]) if len(sizes) else 0
        out: list[np.ndarray] = [np.empty(0, int)] * len(lines)
        if not longest:
            return out
        flat = [self.word(w) for i in order for w in lines[i]]
        own, near = np.array([f[0] for f in flat]), np.array([f[1] for f in flat])
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        head, tail = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
        head[begin], tail[begin + sizes - 1] = True, True
        score = own + self.before[np.where(head, 0, np.roll(near, 1))] + self.behind[np.where(tail, 0, np.roll(near, -1))]
        best, back = score[begin].copy(), np.zeros((len(flat), TAGS), np.int8)
        for t in range(1, longest):
            live = int(np.searchsorted(-sizes, -t, side="left"))  # lines longer than t come first
            step = best[:live, :, None] + self.pair
            back[begin[:live] + t] = step.argmax(axis=1)
            best[:live] = step.max(axis=1) + score[begin[:live] + t]
        tags = np.zeros(len(flat), int)
        now = best.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            live = int(np.searchsorted(-sizes, -t, side="left"))
            at = begin[:live] + t
            tags[at] = now[:live]
            now[:live] = back[at, now[:live]]
        for k, i in enumerate(order):
            out[i] = tags[begin[k] : begin[k] + sizes[k]]
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def labelled_table(rows: int = 400, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The labelled lines that the field is trained on: words of invented syllables around personal data and look-alikes."""
    rng = np.random.default_rng(seed)
    syllables = "an ber che der ent fa go hin in ja kel lo men na on pre qui ra ster ti un ver wo xa yl zu é ñ ü".split()
    pick = lambda options: options[rng.integers(len(options))]
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def word() -> str:
        w = "".join(pick(syllables) for _ in range(rng.integers(1, 4)))
        w = pick([w, w, w, w.capitalize(), w.upper()])
        return w + pick([""] * 8 + [",", ".", "!", "!!", "***", "###", "$$$", "%%%", "&&&"])

    name = lambda: "".join(pick(syllables) for _ in range(2)).encode("ascii", "ignore").decode() or "x"
    host = lambda: pick([f"mail{d(1)}.example.com", f"{name()}.org", f"{name()}.co.uk", f"{name()}-{name()}.net"])
    ip = lambda: ".".join(str(rng.integers(1, 256)) for _ in range(4))
    good = {
        "email": lambda: pick([f"{name()}.{d(2)}@{host()}", f"{name()}@{host()}", f"{name()}_{name()}@{host()}", f"{name()}+{d(1)}@{host()}"]),
        "ip": lambda: ip(),
        "card": lambda: pick([d(16), d(16), f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}"]),
        "phone": lambda: pick([f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"+{d(2)} {d(3)} {d(7)}", f"{d(3)}.{d(3)}.{d(4)}"]),
    }
    other = [
        lambda: str(rng.integers(1900, 2100)), lambda: f"{d(1)}.{d(1)}", lambda: f"{d(2)}.{d(2)}", lambda: f"{d(1)}.{d(1)}.{d(1)}", lambda: d(int(rng.integers(1, 9))), lambda: f"20{d(2)}-0{d(1)}-1{d(1)}",
        lambda: f"{d(2)}:{d(2)}", lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: f"{d(1)},{d(3)}", lambda: f"{d(1)},{d(3)},{d(3)}", lambda: f"#{d(5)}", lambda: f"{d(2)}%", lambda: "@" + name(), lambda: f"{name()}@", lambda: f"${d(2)}.{d(2)}",
        lambda: f'token = "{"".join(pick("0123456789abcdef") for _ in range(40))}"', lambda: f"{name()}{d(2)}", lambda: f"({d(1)})", lambda: f"[{d(2)}]", lambda: f"{d(2)}-{d(2)}", lambda: f"v{d(1)}.{d(2)}.{d(1)}",
        lambda: f"{name()}-{d(3)}", lambda: f"({d(4)})", lambda: f"{d(4)}-{d(4)}", lambda: "".join(pick("0123456789abcdef") for _ in range(8)) + "-" + d(4) + "-4" + d(3) + "-a" + d(3) + "-" + d(12), lambda: d(24), lambda: "-", lambda: "|", lambda: f"+{d(1)}", lambda: f"{d(1)}-{d(1)}-{d(1)}",
    ]
    out = []
    for i in range(rows):
        text, spans = " ".join(word() for _ in range(rng.integers(0, 5))), []
        for _ in range(rng.integers(1, 3) if i % 4 else 0):
            text += " " if text else ""
            if rng.random() < 0.5:
                kind = pick(KINDS)
                value = good[kind]()
                spans.append((kind, len(text), len(text) + len(value)))
                text += value + pick([""] * 5 + [".", ",", "!!", "###"])
            else:
                text += pick(other)() + pick([""] * 5 + [".", ",", "!!"])
            text += "".join(" " + word() for _ in range(rng.integers(0, 4)))
        if text:
            out.append((text, spans))
    return out


def tagged(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[str], list[int]]:
    words, tags = [], []
    for m in _WORD.finditer(text):
        tag = 0
        for kind, start, end in spans:
            if m.start() < end and m.end() > start:
                tag = 1 + 2 * KINDS.index(kind) + (m.start() > start)
        words.append(m.group())
        tags.append(tag)
    return words, tags


def train(table: list[tuple[str, list[tuple[str, int, int]]]]) -> Field:
    field = Field().fit([tagged(text, spans) for text, spans in table])
    if field.plain_margin() <= 0:
        raise ValueError("this table leaves plain words in doubt")
    return field


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_table())


def _spans_of(words: list[re.Match], tags: np.ndarray, at: int) -> Iterable[tuple[str, int, int]]:
    k = 0
    while k < len(words):
        if tags[k] == 0:
            k += 1
            continue
        kind, first = (int(tags[k]) - 1) // 2, k
        k += 1
        while k < len(words) and tags[k] == 2 + 2 * kind:
            k += 1
        start, end = words[first].start(), words[k - 1].end()
        text = words[first].string
        while start < end and not (text[start].isalnum() or text[start] in "+("):
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        if _DIGIT.search(text, start, end) or "@" in text[start:end]:
            yield KINDS[kind], at + start, at + end


def find(texts: list[str | None], field: Field) -> list[list[tuple[str, int, int, bool]]]:
    """Spans (kind, start, end, whether by pattern) of each text, by kind, then start."""
    found = [base_spans(t or "") for t in texts]
    more: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    lines: list[tuple[int, int, list[re.Match]]] = []

    def flush() -> None:
        for (i, at, words), tags in zip(lines, field.decode([[m.group() for m in x[2]] for x in lines])):
            more[i] += _spans_of(words, tags, at)
        lines.clear()

    held = 0
    for i, t in enumerate(texts):
        if not t or not ("@" in t or _DIGIT.search(t)):
            continue
        at = 0
        for line in t.split("\n"):
            if "@" in line or _DIGIT.search(line):
                lines.append((i, at, words_of(line)))
                held += len(lines[-1][2])
                if held > DECODED:
                    flush()
                    held = 0
            at += len(line) + 1
    flush()
    out = []
    for base, extra in zip(found, more):
        spans, taken = [(*s, True) for s in base], sorted((s[1], s[2]) for s in base)
        ends = np.maximum.accumulate([e for _, e in taken]) if taken else []
        for kind, start, end in extra:
            k = int(np.searchsorted([s for s, _ in taken], end)) if taken else 0
            if not k or ends[k - 1] <= start:
                spans.append((kind, start, end, False))
        out.append(sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))
    return out


def detect(docs: DataFrame, field: Field | None = None, text: str = "text", out: str = "spans") -> DataFrame:
    """Adds the spans: kind, start, end (code points, end exclusive) and whether a pattern gave it."""
    model = Carried(docs.sparkSession.sparkContext, field or default_field())
    names = [f.name for f in SPAN.elementType.fields]

    def make():
        kind = pa.list_(pa.struct([(names[0], pa.string()), (names[1], pa.int32()), (names[2], pa.int32()), (names[3], pa.bool_())]))
        def run(texts: list) -> pa.Array:
            return pa.array([[dict(zip(names, s)) for s in spans] for spans in find(texts, model.value)], kind)

        run.forget = model.value.forget
        return run

    return with_arrow_column(docs, out, SPAN, text, make)


def redact(docs: DataFrame, field: Field | None = None, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets (overlapping spans become one), and its length kept true."""
    model = Carried(docs.sparkSession.sparkContext, field or default_field())

    def make():
        def clean(t: str | None, spans: list) -> str | None:
            if not spans:
                return t
            parts, at = [], 0
            for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
                if start >= at:
                    parts += [t[at:start], f"[{kind.upper()}]"]
                at = max(at, end)
            return "".join([*parts, t[at:]])

        def run(texts: list) -> pa.Array:
            return pa.array([clean(t, s) for t, s in zip(texts, find(texts, model.value))], pa.string())

        run.forget = model.value.forget
        return run

    d = with_arrow_column(docs, text, T.StringType(), text, make)
    if n_chars and n_chars in docs.columns:
        d = d.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return d.select(*docs.columns)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order they are in."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
