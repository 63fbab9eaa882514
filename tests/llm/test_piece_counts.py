from __future__ import annotations

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF
from tickloom.llm import piece_counts
from tickloom.llm.queries import PIECE_MODEL, QUERIES

LIB = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
PIECES = piece_counts.Pieces(open(PIECE_MODEL, "rb").read())
TEXT = st.text(alphabet=st.sampled_from("ab the,.;:()\"'_ \n\r\t▁\x00<s>0194éß中\U0001f600"), max_size=40) | st.text(max_size=30)


@settings(max_examples=500, deadline=None)
@given(TEXT)
def test_pre_tokens_sum_to_the_librarys_count(text):
    parts = PIECES.split(text)
    assert sum(PIECES.count(parts) if parts else []) == len(LIB.encode(text))


def test_cases(spark):
    rows = [(1, None, 1), (2, "", 1), (None, "a b", 1), (3, "x" * 50000, 1), (3, "x" * 50000, 1), (4, "   ", 1), (5, "zq wv " * 9000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    for size in (0, 3, 1000):
        got = sorted((r.n_bytes, r.n_tokens) for r in piece_counts.count_tokens(df, PIECE_MODEL, size=size).collect())
        assert got == sorted((len((t or "").encode()), len(LIB.encode(t or ""))) for _, t, _ in rows)
    assert piece_counts.count_tokens(df.limit(0), PIECE_MODEL).count() == 0


def test_query_against_the_library(spark):
    got = {r.doc_id: r for r in QUERIES["op1_token_counts"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        n = len(LIB.encode(d.text or ""))
        assert (got[d.doc_id].n_tokens, got[d.doc_id].n_bytes, got[d.doc_id].over_limit) == (n, len((d.text or "").encode()), n > 4096)
