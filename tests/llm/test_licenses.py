from __future__ import annotations

import re
import textwrap

from conftest import SF
from tickloom.llm import licenses
from tickloom.llm.queries import ORACLES, QUERIES
from tools.compare import connect, diff


def plain(text: str | None) -> tuple:
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = re.findall(word, low)
    at = {p: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p, _ in licenses.PHRASES}
    places = sorted(x for v in at.values() for x in v)
    labels, best = {label for p, label in licenses.PHRASES if at[p]}, 0.0
    base = sorted(labels)
    for line in low.split("\n"):
        have = set(re.findall(word, line))
        for label, notice in licenses.TEMPLATES:
            t = set(notice.split())
            if len(have & t) >= licenses.needed(len(t), licenses.THRESHOLD):
                labels = labels | {label}
                best = max(best, len(have & t) / len(t))
    return len(words), len(places), places[0] if places else None, places[-1] if places else None, base, sorted(labels), 1.0 if places else best


def test_query_against_sql(spark):
    assert diff(QUERIES["op9_license_scan"](spark, SF), connect(SF).sql(ORACLES["op9_license_scan"])) is None


def test_cases(spark):
    texts = [None, "", " \n ", "CC BY", "cc by cc-by", "a cc\nby b", "All Rights Reserved. all rights reserved", "Licensed under the Apache License, Version 2.0.",
             "Released under the\nMIT License", "x Released under the MIT License y", "general public  license général public license", "ccby cc byx", "é cc by é",
             "word " * 20000 + "cc by " + "and " * 20000 + "\nLicensed under CC BY-NC 4.0.", "all rights", "reserved all rights", "CC BY", "\u0085cc by cc by"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, labels string")
    for r in licenses.scan(df).collect():
        got = (r.n_words, r.n_base, r.first_word, r.last_word, list(r.base_labels), list(r.labels), r.score)
        assert got == plain(texts[r.doc_id]), (texts[r.doc_id] or "")[:60]
    assert licenses.scan(df.limit(0)).count() == 0


def over_lines(text: str) -> dict[str, float]:
    """Containment by label, over all runs of the text's words."""
    words, out = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()), {}
    for label, notice in licenses.TEMPLATES:
        t, n = set(notice.split()), licenses.SPREAD * len(notice.split())
        best = max((len(set(words[i : i + n]) & t) for i in range(len(words))), default=0)
        if best >= licenses.needed(len(t), licenses.THRESHOLD):
            out[label] = max(out.get(label, 0.0), best / len(t))
    return out


def test_wrapped_notices(spark):
    wrap = lambda text, width, mark="": "\n".join(mark + x for x in textwrap.wrap(text, width))
    notices = [notice for _, notice in licenses.TEMPLATES]
    texts = [wrap(n, w, m) for n in notices for w, m in ((12, ""), (30, "# "), (72, " * "))]
    texts += ["Released under the\nMIT License", wrap("This work is licensed under a Creative Commons Attribution 4.0 International License", 40),
              "filler words " * 2000 + "\n" + wrap(notices[12], 70) + "\n" + "filler " * 3000, "released\n" + "x " * 50 + "\nunder the mit license"]
    texts += ["x " * k + "\n" + wrap(notices[1], 25) for k in (200, 230, 255, 256, 257)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in licenses.scan(df, wrapped=True).collect():
        want = over_lines(texts[r.doc_id])
        lines = {m.label for m in r.matches if m.line is not None}
        assert set(r.labels) == set(want) | lines | set(r.base_labels) and (r.n_base or r.score == max(want.values(), default=0.0)), texts[r.doc_id][:80]
        assert r.labels or r.doc_id == len(notices) * 3 + 3
