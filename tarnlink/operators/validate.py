"""Checks of the two output tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def output_issues(output: DataFrame, required: DataFrame, ids: str, key: str = "source1_entity_id", candidates: DataFrame | None = None, prefixes: tuple = ("S2-", "S3-")) -> DataFrame:
    """(kind, level, n, sample): rows of an output (key, ids: comma list) against the required keys.

    duplicate_row, repeated_id, s1_id, bad_prefix, missing_s1, unknown_s1 are errors; match_not_candidate, against a
    candidate table of the same shape, is a warning. No row: no issue.
    """
    cut = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")
    rows = output.select(key, cut(F.col(ids)).alias("m"))
    foreign = lambda x: ~F.coalesce(*(F.when(x.startswith(p), True) for p in prefixes), F.lit(False)) & ~x.startswith("S1-")
    tests = {
        "repeated_id": F.size("m") != F.size(F.array_distinct("m")),
        "s1_id": F.exists("m", lambda x: x.startswith("S1-")),
        "bad_prefix": F.exists("m", foreign),
    }
    found = rows.select(key, F.explode(F.array_compact(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items())))).alias("kind"))
    found = found.unionByName(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, F.lit("duplicate_row").alias("kind")))
    found = found.unionByName(required.select(key).join(rows, key, "left_anti").withColumn("kind", F.lit("missing_s1")))
    found = found.unionByName(rows.select(key).join(required, key, "left_anti").withColumn("kind", F.lit("unknown_s1")))
    if candidates is not None:
        wider = candidates.select(key, cut(F.col(candidates.columns[1])).alias("c"))
        lost = rows.join(wider, key).where(F.size(F.array_except("m", "c")) > 0)
        found = found.unionByName(lost.select(key, F.lit("match_not_candidate").alias("kind")))
    level = F.when(F.col("kind") == "match_not_candidate", "WARNING").otherwise("ERROR")
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("sample")).select("kind", level.alias("level"), "n", "sample")


def raw_line_issues(lines: DataFrame, header: str) -> DataFrame:
    """(kind, n) over raw lines (value): lines without a tab, and a missing header."""
    broken = lines.where((F.trim("value") != "") & ~F.col("value").contains("\t"))
    heads = lines.where(F.lower(F.trim("value")) == header)
    return broken.agg(F.lit("malformed").alias("kind"), F.count(F.lit(1)).alias("n")).unionByName(
        heads.agg(F.lit("header").alias("kind"), F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("long").alias("n"))
    ).where("n > 0")


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """Df, or an error if a record was scored twice."""
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"scored twice: {[r[0] for r in twice]}")
    return df
