"""Reciprocal-rank fusion (B10-B12, J06): one aggregation gives the sum, the pivot and the tie keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fuse(hits: DataFrame, methods: list[str], k: int = 60, query: str = "query_id", candidate: str = "s1_id", parts: bool = False) -> DataFrame:
    """(query, candidate, rrf, fused_rank, <m>_score, <m>_rank): hits (query, method, rank, candidate, score).

    rrf is the sum of 1 / (k + rank); ties go to the candidate seen first, by method order, then rank. A search that
    missed a candidate leaves nulls. parts adds <m>_name_score and <m>_address_score.
    """
    place = F.element_at(F.create_map(*(F.lit(x) for i, m in enumerate(methods) for x in (m, i))), F.col("method"))
    known = hits.where(F.col("method").isin(methods)).withColumn("_at", place)
    cells = []
    for m in methods:
        here = F.col("method") == m
        cells += [F.max(F.when(here, F.col("score"))).alias(f"{m}_score"), F.min(F.when(here, F.col("rank"))).alias(f"{m}_rank")]
        if parts:
            cells += [F.max(F.when(here, F.col(f"{p}_score"))).alias(f"{m}_{p}_score") for p in ("name", "address")]
    rows = known.groupBy(query, candidate).agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("rrf"), F.min(F.struct("_at", "rank")).alias("_seen"), *cells)
    order = Window.partitionBy(query).orderBy(F.desc(F.round("rrf", 12)), "_seen", candidate)
    return rows.withColumn("fused_rank", F.row_number().over(order)).drop("_seen")
