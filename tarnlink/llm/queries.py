"""The corpus queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, exact_dedup, language_id, line_dedup, mixing, ngram_join, packing, pivot_search, suffix_dedup, toxicity
from .common import load


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.line_dedup(load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    return rows.select("doc_id", F.col("n_lines").cast("long"), F.col("n_removed").cast("long"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(load(spark, sf_dir, "documents"))


def op7_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(load(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_documents(load(spark, sf_dir, "documents"))


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = language_id.train(load(spark, sf_dir, "documents"))
    return language_id.identify_pages(load(spark, sf_dir, "pages"), models)


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat_format.preference_pairs(chat_format.last_answer_pairs(load(spark, sf_dir, "conversations")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    loss = lambda c: F.aggregate(F.filter(c, lambda p: p["loss"]), F.lit(0).cast("long"), lambda n, p: n + F.length(p["text"]))
    return pairs.select(
        F.col("pair_id").alias("conv_id"), "n_prompt_turns", digest(F.col("prompt")).alias("prompt_sha256"),
        digest(chat_format.text_of("chosen")).alias("chosen_sha256"), digest(chat_format.text_of("rejected")).alias("rejected_sha256"),
        loss("chosen").alias("chosen_loss_chars"), loss("rejected").alias("rejected_loss_chars"),
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.kept_digest(suffix_dedup.remove_repeats(load(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_exact_dedup, op2_packing, op3_mixing, op4_line_dedup, op5_toxicity, op6_ngram_jaccard, op7_pivot_topk, op8_language_id,
        op9_preference_format, op10_suffix_dedup, pages_language_id,
    )}


def oracle_sql() -> dict[str, str]:
    exact = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
    return {
        "op1_exact_dedup": exact,
        "op2_packing": packing.QUERY_SQL,
        "op3_mixing": mixing.QUERY_SQL,
        "op4_line_dedup": line_dedup.QUERY_SQL,
        "op6_ngram_jaccard": ngram_join.QUERY_SQL,
        "op7_pivot_topk": pivot_search.QUERY_SQL,
        "op9_preference_format": chat_format.QUERY_SQL,
    }
