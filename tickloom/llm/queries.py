"""The registered training-data queries and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, iblt, lbl, licenses, mixing, ngram_join, periodic, pii, piece_counts, prefix_trie, quality, secret_forest, tile_join
from tickloom.llm.common import documents, once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    coded = bpe.encode(docs, BYTE_RANKS, public_tokenizers.PATTERN, out="ids", packed=True).drop("text")
    return bpe.decode(coded, BYTE_RANKS, "ids", "decoded").select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES["op4_byte_bpe"] = byte_bpe


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


QUERIES["op2_source_mix"] = source_mix
ORACLES["op2_source_mix"] = mixing.ORACLE


def quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(documents(spark, sf_dir, "doc_id", "text")).drop("text")
    rows = quality.apply_policy(quality.apply_policy(rows, "base", "_base"), "v1", "_v1")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("_base")).alias("base_failed"),
                       (F.col("_base") & F.col("_v1")).alias("kept"), "n_lines", "failures")


QUERIES["op7_quality_ledger"] = quality_ledger
ORACLES["op7_quality_ledger"] = quality.ORACLE


def ngram_join_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(documents(spark, sf_dir, "doc_id", "text"), n=4, percent=85)


QUERIES["op10_ngram_join"] = ngram_join_groups

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
TOKEN_LIMIT = 4096


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = piece_counts.count_tokens(documents(spark, sf_dir, "doc_id", "text"), PIECE_MODEL)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


QUERIES["op1_token_counts"] = token_counts


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir, "doc_id", "text"), wrapped=True)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join("labels", ",").alias("labels"), "score")


QUERIES["op9_license_scan"] = license_scan
ORACLES["op9_license_scan"] = licenses.oracle()


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = iblt.with_next(documents(spark, sf_dir, "doc_id", "text"), "text", "next")
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    d = once(d.select("doc_id", text.alias("text"), "next", edited.alias("edited")), a=iblt.digests(F.col("text")), e=iblt.digests(F.col("edited")), b=iblt.digests(F.col("next")))
    d = d.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "a", "e", "b")
    d = iblt.with_difference(iblt.with_difference(d, "a", "e", "d_edited"), "a", "b", "d_next")
    return d.select("doc_id", "n_chars", "edited_sha256", iblt.fingerprint(F.col("a")).alias("fingerprint"), iblt.fingerprint(F.col("e")).alias("edited_fingerprint"),
                    iblt.likeness("a", "e", "d_edited").alias("near_edited"), iblt.likeness("a", "b", "d_next").alias("near_next"),
                    F.col("d_edited.retries").alias("retries_edited"), F.col("d_next.retries").alias("retries_next"))


QUERIES["op6_fingerprints"] = fingerprints


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(documents(spark, sf_dir, "doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    counts = [of(kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


QUERIES["op8_personal_data"] = personal_data


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.score(documents(spark, sf_dir, "doc_id", "text"), lbl.held_out(F.col("doc_id")))


QUERIES["op3_lm_scores"] = lm_scores


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_forest.scan(documents(spark, sf_dir, "doc_id", "text", "source"))
    spans = F.array_join(F.transform("findings", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_candidates", "n_secrets", spans.alias("spans"), F.array_max(F.transform("findings", lambda s: s["probability"])).alias("probability"))


QUERIES["op5_secret_scan"] = secret_scan


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.detect(documents(spark, sf_dir, "doc_id", "text"), change=periodic.repeated_tail)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES["op13_periodic_runs"] = periodic_runs
ORACLES["op13_periodic_runs"] = periodic.ORACLE


def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tile_join.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), 0.9)


QUERIES["op12_embedding_near_dedup"] = near_vectors
ORACLES["op12_embedding_near_dedup"] = tile_join.ORACLE


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(turns)))


QUERIES["op11_conversation_trie"] = conversation_trie
ORACLES["op11_conversation_trie"] = prefix_trie.ORACLE
