from __future__ import annotations

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF
from tickloom.llm import pii
from tickloom.llm.queries import QUERIES

FIELD = pii.default_field()


def plain(text: str | None) -> list[tuple[str, int, int]]:
    """The patterns as they are stated, by the standard matcher."""
    text, out = text or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m.group())
        if 16 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.findall("[0-9]", m.group())) <= 15]
    return out


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from("a1@.+-( )0259é_\n"), max_size=60))
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_linear_in_hostile_texts():
    for text in ("a" * 200000 + "@", "1" * 200000, "1." * 100000, "+1" * 100000, "@" * 100000, "a@" * 50000, "1 " * 100000):
        assert len(pii.base_spans(text)) < 50000


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    words = ["in", "+1", "(377)", "555-0271", "a@b.example.com", "7086638319846192", "Word.", "1.2.3.4", "2024"]
    for _ in range(30):
        line = [words[i] for i in rng.integers(0, len(words), 4)]
        got = FIELD.decode([["x"] * 9, line, []])[1]

        def score(tags):
            near = [FIELD.word(w)[1] for w in line]
            s = sum(FIELD.word(w)[0][t] for w, t in zip(line, tags)) + sum(FIELD.pair[a, b] for a, b in zip(tags, tags[1:]))
            return s + sum(FIELD.before[near[k - 1] if k else 0][t] + FIELD.behind[near[k + 1] if k + 1 < len(line) else 0][t] for k, t in enumerate(tags))

        best = max(score(t) for t in np.ndindex(*[pii.TAGS] * 4))
        assert abs(score(tuple(got)) - best) < 1e-9


def test_held_out_lines():
    right = [np.array_equal(FIELD.decode([w])[0], t) for w, t in (pii.tagged(*x) for x in pii.labelled_table(300, 99))]
    assert np.mean(right) > 0.95


def test_query_against_the_patterns(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op8_personal_data"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        want = plain(docs[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        spans = r.spans.split(",") if r.spans else []
        assert set(joined.split(",") if joined else []) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])))


def test_cases_and_redaction(spark):
    texts = [None, "", "call (212) 555-0142 now", "x a.b@c.example.com, 1.2.3.4", "é +1 (377) 555-0271.", "in 2024 3 of 4.5", "w " * 60000 + "a@b.co", "call (212) 555-0142 now"]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id int, text string, spans string, n_chars long")
    found = {r.doc_id: r.spans for r in pii.detect(df).collect()}
    assert not found[0] and not found[1] and not found[5] and [s.kind for s in found[2]] == ["phone"] and not found[2][0].base
    clean = {r.doc_id: r for r in pii.redact(df).collect()}
    assert clean[0].text is None and clean[2].text == "call [PHONE] now" == clean[7].text and clean[3].text == "x [EMAIL], [IP]" and clean[4].text == "é [PHONE]."
    assert clean[6].n_chars == len("w " * 60000 + "[EMAIL]") and pii.redact(df).columns == df.columns
    assert pii.detect(df.limit(0)).count() == 0 == pii.redact(df.limit(0)).count()


def test_numbers_in_long_runs_without_spaces(spark):
    phone, card = "212-555-0142", "4111111111111112"
    heads = ['{"id":17,"name":"abcdefghij","street":"klmnopqrst","city":"uvwxyz","key":"', "name,street,city,country,code,remark,colour," * 3, "https://www.example.com/a/long/path/to/some/page?first=abc&second=def&key=",
             "\u79c1\u306e\u96fb\u8a71\u756a\u53f7\u306f" * 9, "a" * 300, "x1y2z3" * 50 + "w"]
    cases = [(head + value + tail, kind, len(head), len(value)) for head in heads for value, kind in ((phone, "phone"), (card, "card")) for tail in ("", '"}', "\u3067\u3059\u3002" * 20)]
    cases += [(heads[0] + "(212)555-0142", "phone", len(heads[0]), 13), (heads[3] + "4111 1111 1111 1112", "card", len(heads[3]), 19)]
    got = pii.find([c[0] for c in cases], FIELD)
    for (text, kind, start, size), spans in zip(cases, got):
        assert (kind, start, start + size, False) in spans, text
        assert all(s[3] or s[1:3] == (start, start + size) for s in spans), text
    df = spark.createDataFrame([(i, c[0], 0) for i, c in enumerate(cases)], "doc_id int, text string, n_chars int")
    for r in pii.redact(df).collect():
        text, kind, start, size = cases[r.doc_id]
        assert r.text == text[:start] + f"[{kind.upper()}]" + text[start + size :]


def test_long_look_alikes_and_tokens():
    for text in ('token="24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', 'token="2d480315a6562b81c25342984c4087344558d00e"', '"id":"12345678-1234-4123-a456-123456789012","at":"2024-01-02T12:30:45"', "build/2024-01-02/v1.22.3/part-00017.parquet", "1" * 24 + "a" * 20):
        assert pii.find([text], FIELD) == [[]], text
    for text in ("a" * 200000 + "1", "1" * 200000, "1." * 100000, "+1" * 100000, "(1" * 100000, "(" * 200000 + "1", "a1-" * 70000):
        assert "".join(m.group() for m in pii.words_of(text)) == text
