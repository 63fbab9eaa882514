from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import tiktoken
import public_tokenizers as P

from conftest import SF
from tickloom.llm import bpe, pii
from tickloom.llm.queries import BYTE_RANKS

from test_ngram_join import plain as near_groups
from test_quality import plain as measures

pipeline = pytest.importorskip("corpus_pipeline")


def keeps(text: str | None) -> bool:
    n, chars, symbols, lines, dup, repeat = measures(text)
    return not (n < 50 or 100 * repeat > 50 * n or 10 * symbols > n or 2 * dup > lines or chars < 2 * n or chars > 20 * n)


def redacted(text: str) -> str:
    out, at = [], 0
    for kind, start, end, _ in sorted(pii.find([text], pii.default_field())[0], key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mixed(rows: list[tuple]) -> dict:
    """Copies of each document (doc_id, source, size) by one sort over all."""
    total = Counter()
    for _, s, n in rows:
        total[s] += n
    names = sorted(total)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(total.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * total[s]]
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
            open_.remove(s)
    order = []
    for s in names:
        given = 0
        for epoch in (1, 2):
            for key, d, n in sorted((hashlib.md5(f"mix:{d}".encode()).hexdigest(), d, n) for d, t, n in rows if t == s):
                given += n
                order.append((given / target[s], names.index(s), epoch, key, d, n))
    copies, used = Counter(), 0
    for *_, d, n in sorted(order):
        used += n
        if used > 1.5 * sum(total.values()):
            break
        copies[d] += 1
    return copies


def test_stages_against_plain_versions(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    frame, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        columns = frame.columns
        frame = stage(spark, frame, SF).cache()
        assert k == 4 or frame.columns == columns
        seen.append(frame.collect())
    want = {d: r.text for d, r in docs.items() if keeps(r.text)}
    assert {r.doc_id: r.text for r in seen[0]} == want and len(seen[0]) == len(want)
    groups = near_groups(list(want.items()), 5, 80)
    want = {int(d): want[int(d)] for d, _, c in groups if d == c}
    assert {r.doc_id: r.text for r in seen[1]} == want and len(seen[1]) == len(want)
    want = {d: redacted(t) for d, t in want.items()}
    assert {r.doc_id: (r.text, r.n_chars) for r in seen[2]} == {d: (t, len(t)) for d, t in want.items()}
    copies = mixed([(d, docs[d].source, len(re.findall(r"[^\x20\x09-\x0D]+", t))) for d, t in want.items()])
    assert Counter(r.doc_id for r in seen[3]) == copies and all(r.text == want[r.doc_id] for r in seen[3])
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(BYTE_RANKS), special_tokens={})
    assert Counter(r.doc_id for r in seen[4]) == copies
    for r in seen[4]:
        assert r.round_trip and np.frombuffer(r.ids, "<u4").tolist() == lib.encode_ordinary(want[r.doc_id]) and r.n_tokens * 4 == len(r.ids)
    assert sorted((r.doc_id, r.ids_sha256) for r in pipeline.run(spark, SF).collect()) == sorted((r.doc_id, r.ids_sha256) for r in seen[4])


def test_stages_with_odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, "en", "s", 5, 1), (1, words, "en", "s", 5, 1), (None, words + " x y z", None, None, None, 2), (3, None, "en", "s", 0, 3), (4, "", None, "s", 0, 4),
            (5, " ".join(f"v{i}" for i in range(90000)), "en", None, 9, 5), (6, "call (212) 555-0142 " + " ".join(f"u{i}" for i in range(60)), "de", "t", 1, 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int")
    empty = frame.limit(0)
    for k, (_, stage) in enumerate(pipeline.STAGES):
        columns = frame.columns
        frame, empty = stage(spark, frame, SF).cache(), stage(spark, empty, SF).cache()
        assert empty.count() == 0 and (k == 4 or frame.columns == columns == empty.columns)
    got = {r.doc_id for r in frame.collect()}
    assert got <= {1, None, 5, 6} and {5, 6} <= got
