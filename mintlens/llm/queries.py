"""The operators over the driver tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import (byte_bpe, decontamination, language_id, line_dedup, lm_scoring, pii, quality_rules, sharding, simhash_dedup,
               spelling, token_orc, warc, whitening)
from .common import materialize, scratch_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in all documents: five-word shingles, similarity 0.8 or more."""
    leaks = decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), similarity=0.8)
    return leaks.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "first_word", "n_words")


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes, tokens and rows."""
    placed = sharding.assign(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "tokens")


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged by a decision list learned from the quality labels."""
    measured = materialize(quality_rules.measure(table(spark, sf_dir, "documents")), "rules-measured")
    rules = quality_rules.learn(measured, table(spark, sf_dir, "labels"))
    return quality_rules.apply(measured, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@query
def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written as ORC in id order, and described from the files."""
    out = scratch_path(spark, "token-orc")
    token_orc.write(table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"),
                    public_tokenizers.PATTERN, end_id=0, added_tokens=True)
    return token_orc.index(token_orc.read(spark, out, token_orc.SCHEMA.format("bigint")))


@query
def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: 3-word shingles, 2 bits."""
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return found.select("doc_id", "fingerprint", "component_id")


@query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                               public_tokenizers.PATTERN)


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC, normalised and read back; payloads of at least 0 bytes are told apart."""
    return warc.round_trip(spark, table(spark, sf_dir, "pages"), scratch_path(spark, "warc"), min_bytes=0)


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that later windows of three repeat."""
    return line_dedup.remove_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), "text")


ORACLE["op8_line_dedup"] = line_dedup.ORACLE


@query
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a bigram model of six sevenths of them."""
    docs = table(spark, sf_dir, "documents")
    _, scored = lm_scoring.learn_and_score(docs, ~lm_scoring.held_out())
    return scored.select("doc_id", lm_scoring.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four fifths of them."""
    docs = table(spark, sf_dir, "documents")
    net = language_id.train(docs, ~language_id.held_out())
    return language_id.predict(docs, net).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings on the first eight principal components, with unit variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents with its most frequent neighbour one code point away."""
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


@query
def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: fixed patterns and what a conditional random field adds."""
    return pii.find_personal(table(spark, sf_dir, "documents"), pii.train())
