"""Secret scan: candidate strings, judged by a random forest that removes false positives.

Candidates are long runs of token characters with letters and digits, and values assigned to names with ``password`` and the
like in them. Runs with filler in them, and very long ones, are judged part by part, so that no head hides what is glued to it. The
forest (MLlib) is trained on a small table of labelled findings and sees each candidate's length, how its characters change
class, how much of it dictionary words cover, the path it was found at, and the words next to it.

Defined cases: null and empty texts have no candidates; repeated rows are scanned each; texts may be of any length; a null path
is an empty one; an empty table gives an empty table; columns not asked for are not read. The row number that ties the parts of
a row together needs an input that reads the same again, such as files.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of context on either side, and of a candidate that is judged in one part unless it has filler.
CONTEXT, ONE_PART = 32, 400

_RUN = re.compile(r"[A-Za-z0-9+/=_\-]{16,}")
_ASSIGNED = re.compile(r"(?i)(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]*?(?:password|passwd|pwd|secret|token|api_?key))[A-Za-z0-9_]++[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"']{6,})")
_FILLER = re.compile(r"(.)\1{7,}", re.S)
_NAMED = re.compile(r"(?i)passw|pwd|secret|token|api_?key")
#: Dictionary words, words near secrets, words near look-alikes, and parts of paths with examples.
DICTIONARY = """about account admin address after also and array back base before begin block build cache call change check class client code commit config content count create data database date
 default delete demo document dummy error event example false file first format from function get group handler hash have here host image index info input int key last length level line link list load local
 main manager message method model module name new next node null number object open option order output page part path place point position process project query read request response result return
 root save schema search server service session set size source start state status string style system table test text that the this time true type update user value version view with word work your""".split()
NEAR_SECRET = re.compile(r"(?i)secret|token|passw|pwd|api[_ -]?key|access[_ -]?key|auth|bearer|credential|private")
NEAR_OTHER = re.compile(r"(?i)sha\d*|md5|commit|checksum|digest|hash|uuid|guid|revision|integrity|etag|order|isbn|version|build|id")
EXAMPLE_PATH = re.compile(r"(?i)test|example|sample|doc|mock|fixture|lock|readme|demo")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk_live_", "xoxb-", "eyJ", "AIza", "glpat-")
_PREFIX = re.compile("(?=" + "|".join(map(re.escape, PREFIXES)) + ")")
_CUTS = (_PREFIX, re.compile("="), re.compile("/"), re.compile("[^A-Za-z0-9]"))
_WORDS = re.compile("|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=len, reverse=True)), re.I)
FEATURES = ["length", "log_length", "digits", "upper", "lower", "other", "changes", "entropy", "distinct", "hex", "covered", "longest_run", "prefix", "dashes", "slashes",
            "near_secret", "near_other", "assigned", "quoted", "example_path", "placeholder"]


def candidates(text: str | None) -> list[tuple[int, int]]:
    """Spans in code points, by start; overlapping ones are one."""
    if not text or not (_NAMED.search(text) or re.search("[0-9]", text)):
        return []
    spans = [m.span() for m in _RUN.finditer(text) if re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group())]
    spans += [m.span(1) for m in _ASSIGNED.finditer(text)]
    out: list[tuple[int, int]] = []
    for s in sorted(spans):
        if out and s[0] < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]))
        else:
            out.append(s)
    return out


def parts(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """What of a candidate is judged by itself: what filler leaves of it; of a very long one what known prefixes, equal signs,
    slashes and then other marks leave (encoded data, most of which would be such parts, stays whole). Parts are as long as a run
    or, behind a name, an assigned value has to be, and have letters and digits; a candidate without such parts is judged whole."""
    least = 6 if _NAMED.search(text, max(0, start - CONTEXT), start) else 16

    def cut(spans: list[tuple[int, int]], mark: re.Pattern) -> list[tuple[int, int]]:
        out = []
        for a, b in spans:
            for m in mark.finditer(text, a, b):
                out.append((a, m.start()))
                a = m.end()
            out.append((a, b))
        return [s for s in out if s[0] < s[1]]

    def judged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        return [s for s in spans if s[1] - s[0] >= least and re.search("[0-9]", text[s[0] : s[1]]) and re.search("[A-Za-z]", text[s[0] : s[1]])]

    spans = cut([(start, end)], _FILLER)
    for k, mark in enumerate(_CUTS):
        out = []
        for s in spans:
            some = cut([s], mark) if s[1] - s[0] > ONE_PART else [s]
            encoded = k > 1 and 2 * sum(b - a for a, b in judged(some)) > s[1] - s[0]
            out += [s] if encoded else some
        spans = out
    return judged(spans) or [(start, end)]


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def features(text: str, start: int, end: int, path: str | None, whole: tuple[int, int] | None = None) -> list[float]:
    """Of a part of the candidate ``whole``, or all of it; a part has the surroundings of the candidate and its own inside it."""
    a, b = whole or (start, end)
    s, before, after = text[start:end], text[max(a, start - CONTEXT) : start] + text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    kinds, n = [_kind(c) for c in s], len(s)
    share = [kinds.count(k) / n for k in range(4)]
    count = Counter(s)
    run = max(len(m.group()) for m in re.finditer(r"(.)\1*", s, re.S))
    return [
        float(end - start), math.log(end - start), *share, sum(a != b for a, b in zip(kinds, kinds[1:])) / n, -sum(v / n * math.log2(v / n) for v in count.values()), len(count) / min(n, 64),
        float(re.fullmatch(r"[0-9a-fA-F]+", s) is not None), sum(len(m.group()) for m in _WORDS.finditer(s)) / n, run / n, float(s.startswith(PREFIXES)), s.count("-") / n, s.count("/") / n,
        float(bool(NEAR_SECRET.search(before))), float(bool(NEAR_OTHER.search(before)) or bool(NEAR_OTHER.match(after.lstrip()))), float(bool(re.search(r"[:=]\s*[\"']?$", before))),
        float(before[-1:] in "\"'" and before != ""), float(bool(EXAMPLE_PATH.search(path or ""))), float(bool(re.search(r"(?i)example|your|xxxx|placeholder|changeme|<|\*\*\*|dummy", s))),
    ]


def labelled_findings(rows: int = 800, seed: int = 11) -> list[tuple[str, int, int, str, int]]:
    """The labelled table (text, start, end, path, 1: secret): invented secrets and look-alikes in their usual surroundings."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[rng.integers(len(options))]
    chars = lambda alphabet, n: "".join(pick(alphabet) for _ in range(n))
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    hexa, full = digits + "abcdef", low + low.upper() + digits
    word = lambda: pick(["the", "of", "ber", "entre", "tion", "shed", "que", "lich", "data", "value", "run", "see"])
    camel = lambda: "".join(pick(DICTIONARY).capitalize() for _ in range(rng.integers(3, 6))) + chars(digits, 2)
    upper = lambda f: (lambda: f().upper())
    secret = [
        lambda: f'token = "{{{chars(hexa, 40)}}}"', lambda: f'token = "{{{chars(hexa, 40)}}}"', upper(lambda: f'token = "{{{chars(hexa, 40)}}}"'), lambda: f"api_key: {{{chars(hexa, 32)}}}", lambda: f'secret="{{{chars(full + "+/", 40)}}}"',
        lambda: f"aws_access_key_id = {{AKIA{chars(low.upper() + digits, 16)}}}", lambda: f"{{ghp_{chars(full, 36)}}}", lambda: f"Authorization: Bearer {{eyJ{chars(full + '-_', 60)}}}", lambda: f"{{sk_live_{chars(full, 24)}}}",
        lambda: f'password = "{{{chars(full + "!@", int(rng.integers(9, 16)))}}}"', lambda: f"private key {{{chars(full + '/', 64)}}}", lambda: f"access_key={{{chars(full, 32)}}}", lambda: f"token: {{{chars(full + '-_', 28)}}}",
    ]
    other = [
        lambda: f"commit {{{chars(hexa, 40)}}}", lambda: f"sha256: {{{chars(hexa, 64)}}}", lambda: f"md5 {{{chars(hexa, 32)}}}", lambda: f"integrity sha512-{{{chars(full + '+/', 60)}}}", lambda: f"uuid {{{chars(hexa, 8)}-{chars(hexa, 4)}-4{chars(hexa, 3)}-a{chars(hexa, 3)}-{chars(hexa, 12)}}}",
        lambda: f"{word()} {{{camel()}}}", lambda: f"{{{'/'.join(pick(DICTIONARY) for _ in range(4))}/{chars(digits, 4)}}}", lambda: f'password = "{{{pick(["changeme1", "your_password_1", "xxxxxxxxxx", "example_password1", "<password>", "********"])}}}"',
        lambda: f'token = "{{{pick(["your_token_here_1", "example-token-0000", "xxxxxxxxxxxxxxxx1", "placeholder_token_1"])}}}"', lambda: f"build {{{chars(digits, 8)}-{chars(low, 5)}-{chars(digits, 4)}}}", lambda: f"{{{'-'.join(pick(DICTIONARY) for _ in range(4))}-{chars(digits, 2)}}}",
        lambda: f"order id {{{chars(low.upper(), 3)}-{chars(digits, 14)}}}", lambda: f"{{{'_'.join(pick(DICTIONARY) for _ in range(4))}_{chars(digits, 1)}}}", lambda: f"{{{pick('=-_')*20}{chars(digits, 1)}a}}", lambda: f"password: {{{pick(DICTIONARY)}{pick(DICTIONARY)}}}",
    ]
    out = []
    for i in range(rows):
        text = pick(secret)() if i % 2 else pick(other)()
        start, end = text.index("{"), text.index("}") - 1
        head = " ".join(word() for _ in range(rng.integers(0, 5)))
        text = (head + " " if head else "") + text.replace("{", "", 1).replace("}", "", 1) + pick(["", " ", "###", "!!", "."]) + " " + word()
        shift = len(head) + 1 if head else 0
        path = pick(["src/app.py", "config/prod.env", "src3", "web", "deploy/main.tf"] if i % 2 or rng.random() < 0.7 else ["tests/test_app.py", "docs/example.md", "package.lock"])
        out.append((text, start + shift, end + shift, path, i % 2))
    return out


def train(spark: SparkSession, findings: Sequence[tuple[str, int, int, str, int]], trees: int = 40, depth: int = 8, seed: int = 3) -> RandomForestClassificationModel:
    rows = [(features(t, a, b, p), float(y)) for t, a, b, p, y in findings]
    table = spark.createDataFrame(rows, "x array<double>, label double").coalesce(1).select(array_to_vector("x").alias("features"), "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8).fit(table)


def scan(docs: DataFrame, model: RandomForestClassificationModel | None = None, text: str = "text", path: str = "source", keep: Sequence[str] = ("doc_id",), cut: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: the kept columns, n_candidates (parts count each), n_secrets and findings (start, end, probability), by start.
    Candidates below the probability ``cut`` are false positives."""
    model = model or train(docs.sparkSession, labelled_findings())
    d = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*keep).alias("_keep"), F.col(text).alias("_text"), F.col(path).cast("string").alias("_path"))
    schema = T.StructType([T.StructField("_row", T.LongType()), T.StructField("_keep", d.schema["_keep"].dataType), T.StructField("_start", T.IntegerType()), T.StructField("_end", T.IntegerType()), T.StructField("_x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, start, end, x = [], [], [], []
            for i, (t, p) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                spans = [(p, s) for s in candidates(t) for p in parts(t, *s)]
                for (a, b), s in spans or [((None, None), None)]:
                    at.append(i)
                    start.append(a)
                    end.append(b)
                    x.append([0.0] * len(FEATURES) if a is None else features(t, a, b, p, s))
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=schema.names)

    d = model.transform(d.mapInArrow(run, schema).withColumn("features", array_to_vector("_x")))
    p = vector_to_array("probability")[1]
    found = F.when(F.col("_start").isNotNull() & (p >= cut), F.struct(F.col("_start").alias("start"), F.col("_end").alias("end"), p.alias("probability")))
    d = d.groupBy("_row").agg(F.max("_keep").alias("k"), F.count("_start").alias("n_candidates"), F.array_sort(F.collect_list(found)).alias("findings"))
    own = [F.col(f"k.{c}").alias(c) for c in keep if c not in ("n_candidates", "n_secrets", "findings")]
    return d.select(*own, "n_candidates", F.size("findings").cast("long").alias("n_secrets"), "findings")
