from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF
from tickloom.llm import bpe
from tickloom.llm.queries import BYTE_RANKS, QUERIES

RANKS = bpe.load_ranks(BYTE_RANKS)
LIB = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENC = bpe.PrefixEncoder(RANKS, P.PATTERN)
TEXT = st.text(alphabet=st.sampled_from("ab e'sltvrdm \n\t019.,!éß中\U0001f600\x00"), max_size=40) | st.text(max_size=30)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_encoding_is_the_librarys(text):
    ids = ENC.encode(text)
    assert ids == LIB.encode_ordinary(text) and ENC.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT, st.integers(0, 40), st.integers(0, 10))
def test_edits_and_appends_are_exact(text, put, at, drop):
    at = min(at, len(text))
    new, ids = ENC.edit(text, ENC.encode(text), at, drop, put)
    assert new == text[:at] + put + text[at + drop :] and ids == LIB.encode_ordinary(new)
    new, ids = ENC.append(text, ENC.encode(text), put)
    assert ids == LIB.encode_ordinary(text + put)


def test_the_fast_matcher_splits_alike():
    for c in map(chr, range(256)):
        for text in (f"a{c}1 x", f" {c}{c}'s", f"{c} \n{c}"):
            assert ENC.latin.findall(text) == ENC.any.findall(text)


def test_tables_of_prefixes_extend():
    word = "unbelievablenessless".encode()
    table = ENC.last_tokens(word)
    for n in range(1, len(word)):
        assert ENC.ids_of(table[:n]) == LIB._encode_single_piece(word[:n])
        assert ENC.last_tokens(word, table[:n]) == table


def test_cases(spark):
    rows = [(1, None, 7), (2, "", 8), (None, "a b", 9), (3, "x" * 30000 + " <|endoftext|>", 1), (3, "x" * 30000 + " <|endoftext|>", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.decode(bpe.encode(df, BYTE_RANKS, P.PATTERN), BYTE_RANKS).collect()
    assert sorted(len(r.ids) for r in got) == sorted(len(LIB.encode_ordinary(t or "")) for _, t, _ in rows)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in got)
    assert bpe.encode(df.limit(0), BYTE_RANKS, P.PATTERN).count() == 0


def test_query_against_the_library(spark):
    got = {r.doc_id: r for r in QUERIES["op4_byte_bpe"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = LIB.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_a_missing_column_is_an_error(spark):
    with pytest.raises(ValueError):
        bpe.encode(spark.range(1), BYTE_RANKS, P.PATTERN)
