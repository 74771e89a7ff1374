"""Pair features (F01-F21): window columns over fused candidates, and text comparisons."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity, tokens
from ..functions.names import legal_forms
from .search import cosine

BASE_METHODS = ("bi", "tri", "words", "phonetic")


def retrieval_features(fused: DataFrame, methods: list[str], query: str = "query_id") -> DataFrame:
    """Gaps to the best of the query, how many searches found the candidate, how many candidates."""
    per = Window.partitionBy(query)
    cols = {f"{m}_gap": F.col(f"{m}_score") - F.max(f"{m}_score").over(per) for m in methods}
    cols["rrf_gap"] = F.col("rrf") - F.max("rrf").over(per)
    counted = [m for m in methods if m in BASE_METHODS] or methods
    cols["n_searches"] = sum((F.col(f"{m}_rank").isNotNull().cast("int") for m in counted), F.lit(0))
    cols["n_candidates"] = F.count(F.lit(1)).over(per)
    return fused.withColumns(cols)


def number_jaccard(a: Column | str, b: Column | str) -> Column:
    """over the sets of numbers, null if both are empty."""
    x, y = tokens.numbers(a), tokens.numbers(b)
    return F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0))


def first_number_equal(a: str, b: str) -> Column:
    """null if either has no number."""
    first = lambda c: F.nullif(F.regexp_extract(c, r"\d+", 0), F.lit(""))
    return (first(a) == first(b)).cast("int")


def pair_features(pairs: DataFrame, vectors: tuple[str, str] | None = None) -> DataFrame:
    """F06-F17 of pairs with q_/s_ columns name, core, address. The country is no feature."""
    each = lambda f, c: f(F.col(f"q_{c}"), F.col(f"s_{c}"))
    cols = {
        "name_ratio": each(similarity.ratio_udf, "name"),
        "name_token_set": each(similarity.token_set_udf, "name"),
        "name_token_sort": each(similarity.token_sort_udf, "name"),
        "name_partial": each(similarity.partial_udf, "name"),
        "name_jaro_winkler": each(similarity.jaro_winkler_udf, "name"),
        "core_ratio": each(similarity.ratio_udf, "core"),
        "core_token_set": each(similarity.token_set_udf, "core"),
        "core_exact": (F.col("q_core") == F.col("s_core")).cast("int"),
        "address_ratio": each(similarity.ratio_udf, "address"),
        "address_token_set": each(similarity.token_set_udf, "address"),
        "number_jaccard": number_jaccard("q_address", "s_address"),
        "first_number_equal": first_number_equal("q_address", "s_address"),
        "legal_equal": (legal_forms(F.col("q_name")) == legal_forms(F.col("s_name"))).cast("int"),
        "name_len_diff": F.abs(F.length("q_name") - F.length("s_name")),
        "query_address_empty": (F.col("q_address") == "").cast("int"),
        "s1_address_empty": (F.col("s_address") == "").cast("int"),
    }
    if vectors:
        cols["embedding_cosine"] = cosine(*vectors)
    return pairs.withColumns(cols)


def score_prefix(mode: str, large: bool = False) -> str:
    """column prefix of a pair model by its text mode."""
    return {"both": "ce", "name": "cen", "address": "cea"}[mode] + "g" * large


def score_features(pairs: DataFrame, scores: DataFrame, prefix: str, query: str = "query_id", candidate: str = "s1_id") -> DataFrame:
    """Logit, gap to the query's best, rank among scored pairs; null where a pair was not scored."""
    if f"{prefix}_logit" in pairs.columns:
        raise ValueError(f"two pair models share the prefix {prefix}")
    logit = f"{prefix}_logit"
    rows = pairs.join(scores.select(query, candidate, F.col("logit").alias(logit)), [query, candidate], "left")
    per = Window.partitionBy(query)
    order = per.orderBy(F.col(logit).desc_nulls_last(), "fused_rank")
    return rows.withColumns({f"{prefix}_gap": F.col(logit) - F.max(logit).over(per), f"{prefix}_rank": F.when(F.col(logit).isNotNull(), F.row_number().over(order))})


def config_key(**config) -> str:
    """names a feature cache by everything that made it."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def cached(df: DataFrame, root: str, **config) -> DataFrame:
    """The features of this configuration, written once and read ever after."""
    path = f"{root}/features-{config_key(**config)}"
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.parquet(path)
