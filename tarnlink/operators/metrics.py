"""Evaluation (M20-M24): macro F0.5, pair metrics, recall at k, error groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def macro_f05(predicted: DataFrame, truth: DataFrame, query: str = "query_id", by: DataFrame | None = None) -> DataFrame:
    """One row (f05, entities), or one for each row of by (threshold).

    predicted (query, best_s1), truth (query, s1_id; a row with null query is an entity without records). Over true
    and predicted entities: an entity without records scores 1 if nothing was predicted for it, else 0.
    """
    keys = by.columns if by is not None else []
    n = lambda c: F.sum(c.cast("long"))
    true = truth.where(F.col(query).isNotNull()).select("s1_id", query).distinct()
    sizes = truth.groupBy("s1_id").agg(F.countDistinct(query).alias("t"))
    guess = predicted.withColumnRenamed("best_s1", "s1_id").distinct()
    hit = true.withColumn("hit", F.lit(1))
    per = guess.join(hit, ["s1_id", query], "left").groupBy(*keys, "s1_id").agg(F.count(F.lit(1)).alias("p"), F.count("hit").alias("tp"))
    # only predicted entities are scored one by one; the others count 1 without records and 0 with some
    score = F.when(F.col("t") > 0, 1.25 * F.col("tp") / (0.25 * F.col("t") + F.col("p")))
    found = per.join(sizes, "s1_id", "left").groupBy(*keys)
    found = found.agg(F.sum(score).alias("right"), n(F.col("t") == 0).alias("spoilt"), n(F.col("t").isNull()).alias("unknown"))
    rows = found if by is None else by.join(found, keys, "left")
    whole = sizes.agg(F.count(F.lit(1)).alias("known"), n(F.col("t") == 0).alias("alone"))
    rows = rows.crossJoin(F.broadcast(whole)).fillna(0, ["right", "spoilt", "unknown", "alone"])
    entities = F.col("known") + F.col("unknown")
    return rows.select(*keys, ((F.col("right") + F.col("alone") - F.col("spoilt")) / F.nullif(entities, F.lit(0))).alias("f05"), entities.alias("entities"))


def pair_metrics(best: DataFrame, truth: DataFrame, threshold: float, query: str = "query_id") -> DataFrame:
    """Precision, recall, accepted of decided queries; truth (query, s1_id)."""
    rows = best.join(truth.where(F.col(query).isNotNull()).withColumnRenamed("s1_id", "true_s1"), query, "full")
    ok = F.coalesce(F.col("p") >= threshold, F.lit(False))
    right = ok & F.coalesce(F.col("best_s1") == F.col("true_s1"), F.lit(False))
    n = lambda c: F.sum(c.cast("long"))
    return rows.agg(
        n(ok).alias("accepted"), n(right).alias("correct"), (n(right) / F.nullif(n(ok), F.lit(0))).alias("precision"), (n(right) / F.nullif(F.count("true_s1"), F.lit(0))).alias("recall")
    )


def baseline(fused: DataFrame, query: str = "query_id", candidate: str = "s1_id", queries: DataFrame | None = None) -> DataFrame:
    """The top fused candidate always taken. With queries, those without candidates are decided too, for none."""
    top = fused.where("fused_rank = 1").select(query, F.col(candidate).alias("best_s1"), F.lit(0.0).alias("p"))
    return top if queries is None else queries.select(query).distinct().join(top, query, "left").withColumn("p", F.lit(0.0))


def recall_at(ranked: DataFrame, truth: DataFrame, ks: tuple, query: str = "query_id", candidate: str = "s1_id", rank: str = "rank") -> DataFrame:
    """(k, found, recall) over queries with truth; k = 0 stands for all ranks."""
    rows = truth.where(F.col(query).isNotNull()).select(query, F.col("s1_id").alias(candidate)).join(ranked.select(query, candidate, F.col(rank).alias("_r")), [query, candidate], "left")
    rows = rows.groupBy(query).agg(F.min("_r").alias("r")).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    hit = F.col("r").isNotNull() & ((F.col("k") == 0) | (F.col("r") <= F.col("k")))
    return rows.groupBy("k").agg(F.sum(hit.cast("long")).alias("found"), F.avg(hit.cast("double")).alias("recall"))


def error_groups(best: DataFrame, candidates: DataFrame, truth: DataFrame, threshold: float, query: str = "query_id", candidate: str = "s1_id") -> DataFrame:
    """(query, group): accepted, rejected (right on top but below the threshold), wrong_top, not_retrieved."""
    there = candidates.select(query, F.col(candidate).alias("true_s1")).distinct().withColumn("there", F.lit(True))
    rows = truth.where(F.col(query).isNotNull()).withColumnRenamed("s1_id", "true_s1").join(best, query, "left").join(there, [query, "true_s1"], "left")
    right = F.col("best_s1") == F.col("true_s1")
    group = F.when(F.col("there").isNull(), "not_retrieved").when(right & (F.col("p") >= threshold), "accepted").when(right, "rejected").otherwise("wrong_top")
    return rows.select(query, "true_s1", "best_s1", "p", group.alias("error_group"))
