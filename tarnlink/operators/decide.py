"""Decisions (M16-M19): best candidate, threshold sweep, per-entity expected F0.5."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import macro_f05

THRESHOLDS = tuple(round(0.05 * i, 2) for i in range(1, 16)) + tuple(round(0.80 + 0.01 * i, 2) for i in range(20))


def best_candidates(scored: DataFrame, query: str = "query_id", candidate: str = "s1_id") -> DataFrame:
    """(query, best_s1, p): the likeliest candidate, ties to the lower fused rank, then id."""
    best = F.max(F.struct("p", (-F.col("fused_rank")).alias("r"), F.col(candidate).alias("c"))).alias("b")
    if dict(scored.dtypes)[candidate] == "string":
        order = Window.partitionBy(query).orderBy(F.desc("p"), "fused_rank", candidate)
        return scored.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(query, F.col(candidate).alias("best_s1"), "p")
    return scored.groupBy(query).agg(best).select(query, F.col("b.c").alias("best_s1"), F.col("b.p").alias("p"))


def sweep(best: DataFrame, truth: DataFrame, query: str = "query_id", thresholds: tuple = THRESHOLDS) -> DataFrame:
    """(threshold, f05) by one pass: the thresholds are exploded onto the predictions, not looped over."""
    rows = best.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).where(F.col("p") >= F.col("threshold"))
    points = truth.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    return macro_f05(rows.select("threshold", query, "best_s1"), truth, query, by=points)


def best_threshold(swept: DataFrame) -> DataFrame:
    """The greatest f05, ties to the lowest threshold."""
    return swept.orderBy(F.desc("f05"), "threshold").limit(1)


def expected_f05(best: DataFrame, gamma: float = 1.0, miss: float = 0.5, floor: float = 0.02, query: str = "query_id") -> DataFrame:
    """For each entity the accepted queries, by greatest expected F0.5: q = p ** gamma above floor, taking the k
    likeliest if 1.25 * sum / (0.25 * (total + miss) + k) beats the chance that none is right. W01 for the running sum;
    the product is folded, as logarithms fail at q = 1."""
    rows = best.withColumn("q", F.pow("p", F.lit(gamma))).where(F.col("q") >= floor)
    order = Window.partitionBy("best_s1").orderBy(F.desc("q"), query)
    per = Window.partitionBy("best_s1")
    rows = rows.withColumns({"k": F.row_number().over(order), "cum": F.sum("q").over(order.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("q").over(per)})
    rows = rows.withColumn("value", 1.25 * F.col("cum") / (0.25 * (F.col("total") + miss) + F.col("k")))
    pick = rows.groupBy("best_s1").agg(
        F.max(F.struct("value", (-F.col("k")).alias("k"))).alias("b"), F.aggregate(F.array_sort(F.collect_list("q")), F.lit(1.0), lambda a, x: a * (1 - x)).alias("none")
    )
    pick = pick.where(F.col("b.value") > F.col("none")).select("best_s1", (-F.col("b.k")).alias("take"))
    return rows.join(pick, "best_s1").where("k <= take").select(query, "best_s1", "p")


def tune_expected(best: DataFrame, truth: DataFrame, gammas=(0.5, 0.75, 1.0, 1.25, 1.5, 2.0), misses=(0.0, 0.25, 0.5, 1.0, 2.0), query: str = "query_id") -> DataFrame:
    """(gamma, miss, f05), best first: a grid of few points, each one aggregation."""
    found = None
    for g in gammas:
        for m in misses:
            one = macro_f05(expected_f05(best, g, m, query=query).select(query, "best_s1"), truth, query).select(F.lit(g).alias("gamma"), F.lit(m).alias("miss"), "f05")
            found = one if found is None else found.unionByName(one)
    return found.orderBy(F.desc("f05"), "gamma", "miss")
