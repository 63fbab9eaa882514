from __future__ import annotations

import re

import pytest

from conftest import SF
from tickloom.llm import secret_forest as sf
from tickloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model(spark):
    return sf.train(spark, sf.labelled_findings())


def test_held_out_findings(spark, model):
    rows = [(i, t, p, y, a, b) for i, (t, a, b, p, y) in enumerate(sf.labelled_findings(400, 99))]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string, y int, a int, b int")
    got = {r.doc_id: r for r in sf.scan(df, model).collect()}
    right = [bool(got[i].n_secrets) == bool(y) for i, _, _, y, _, _ in rows]
    assert sum(right) >= 0.93 * len(right)


def test_query_finds_the_planted_tokens(spark):
    got = {r.doc_id: r for r in QUERIES["op5_secret_scan"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = [f"{m.start(1)}:{m.end(1)}" for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', d.text or "")]
        assert set(want) <= set(got[d.doc_id].spans.split(",")) and (want or not got[d.doc_id].n_secrets)


def test_cases(spark, model):
    texts = [None, "", "plain words only", "x" * 100000 + "1", "commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "a1" * 60000, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"']
    df = spark.createDataFrame([(i, t, None, 5) for i, t in enumerate(texts)], "doc_id int, text string, source string, n_secrets int")
    got = {r.doc_id: r for r in sf.scan(df, model).collect()}
    assert len(got) == 8 and [got[i].n_candidates for i in range(4)] == [0, 0, 0, 1]
    assert [got[i].n_secrets for i in (4, 5, 7)] == [0, 1, 1] and got[5].findings[0].start == 9
    assert sf.scan(df.limit(0), model).count() == 0


def test_names_with_letters_digits_and_underscores_around():
    for text, value in (('DB_PASSWORD="Xk9fq2Lm"', "Xk9fq2Lm"), ('client_secret: "Xk9fq2Lm7"', "Xk9fq2Lm7"), ("auth_token = 'a8Fk2LmQ91'", "a8Fk2LmQ91"), ('secret_key: "Xk9fq2Lm7"', "Xk9fq2Lm7"),
                        ('dbPassword2="Xk9fq2Lm"', "Xk9fq2Lm"), ('password="Xk9fq2Lm"', "Xk9fq2Lm")):
        assert [text[a:b] for a, b in sf.candidates(text)] == [value]
    assert sf.candidates("tokens of 9 kinds") == [] and len(sf.candidates("token" * 40000 + "1")) == 1 and sf.candidates("token_1 " * 40000) == []


def test_secrets_behind_long_heads(spark, model):
    token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    heads = ["=" * 20, "=" * 400, "-" * 1000, "_" * 500, "x" * 500, "home/data/cache/index/" * 30, "x9" + "=" * 450, "iVBORw0KGgoAAAANSUhEUgAAAAUA" * 20 + "=="]
    texts = [f'token = "{h}{token}"' for h in heads] + [f'token = "{"home/data/" * 50}"', "commit " + "home/data/" * 50 + token]
    df = spark.createDataFrame([(i, t, "src/app.py") for i, t in enumerate(texts)], "doc_id int, text string, source string")
    got = {r.doc_id: [(f.start, f.end) for f in r.findings] for r in sf.scan(df, model).collect()}
    for i, h in enumerate(heads):
        assert (9 + len(h), 9 + len(h) + 40) in got[i], h[:30]
    assert got[8] == got[9] == []
    assert sf.parts('password="' + "=" * 450 + 'Xk9fq2Lm"', 10, 468) == [(460, 468)]
    assert all(sum(b - a for a, b in sf.parts(t, 0, len(t))) <= len(t) for t in texts)


def test_names_find_their_secrets(spark, model):
    texts = ['DB_PASSWORD="Xk9fq2Lm7w"', 'client_secret: "Xk9fq2Lm7w"', "auth_token = 'a8Fk2LmQ91'", 'secret_key: "Xk9fq2Lm7w"']
    df = spark.createDataFrame([(i, t, "src/app.py") for i, t in enumerate(texts)], "doc_id int, text string, source string")
    assert all(r.n_candidates == 1 for r in sf.scan(df, model).collect())
