"""From documents to encoded training data: five stages, each written and read again by the next.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last give back the columns
of documents. What each does with nulls, empty and very long texts, repeated rows, empty tables and further columns is
stated by its operator.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, mixing, ngram_join, pii, quality
from tickloom.llm.common import documents
from tickloom.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 of the rule ledger rejects go."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("text").alias("text"))
    return quality.apply_policy(quality.ledger(rows), "v1").where("kept").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with similar sets of five-word shingles (0.8 or more), the one with the smallest id stays."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind, and n_chars follows."""
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out, kept or repeated, so that the sources have their shares."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "source", "text")
    mixed = mixing.mix(rows).where("copies > 0")
    return mixed.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text (little-endian unsigned 32-bit), checked by decoding them."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN, packed=True)
    coded = bpe.decode(coded, ranks)
    return coded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE encoding and decoding", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage_{k}")
    return docs


#: Tokenizing and the random field are beyond SQL; tests/llm/test_pipeline.py has the plain version.
ORACLE_SQL = None
