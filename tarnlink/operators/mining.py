"""Variant and unseen-token reports."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def aligned(left: list[str], right: list[str]) -> list[tuple[str, str]]:
    """(variant of right, word of left): equal runs, and replaced runs of equal length, word by word."""
    out = []
    for kind, i, j, k, m in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if kind == "equal" or (kind == "replace" and j - i == m - k):
            out += zip(right[k:m], left[i:j], strict=True)
    return out


def variants(pairs: DataFrame, left: str, right: str, least: int = 3) -> DataFrame:
    """(variant, canonical, pairs, same, precision) from matched texts (left is the canonical side)."""

    @F.pandas_udf("array<struct<v: string, c: string>>")
    def align(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"v": v, "c": c} for v, c in aligned(list(x), list(y))] for x, y in zip(a, b, strict=True)])

    cut = lambda c: F.filter(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), ",", " "), r"\s+"), lambda w: (w != "") & ~w.rlike(r"\d"))
    rows = pairs.select(F.explode(align(cut(left), cut(right))).alias("z")).groupBy("z.v", "z.c").agg(F.count(F.lit(1)).alias("n"))
    per = Window.partitionBy("v")
    rows = rows.withColumns({"total": F.sum("n").over(per), "same": F.sum(F.when(F.col("v") == F.col("c"), F.col("n")).otherwise(0)).over(per)})
    rows = rows.where((F.col("v") != F.col("c")) & (F.col("n") >= least))
    return rows.select(F.col("v").alias("variant"), F.col("c").alias("canonical"), F.col("n").alias("pairs"), "same", (F.col("n") / F.col("total")).alias("precision"))


def lookup_of(found: DataFrame, least: int = 10, precision: float = 0.6) -> DataFrame:
    return found.where((F.col("pairs") >= least) & (F.col("precision") >= precision))


def unseen_tokens(test: DataFrame, train: DataFrame, token: str, country: str, least: int = 20) -> DataFrame:
    """(token, test_count, main_country, main_country_share) of tokens that train never has."""
    counts = test.join(train.select(token).distinct(), token, "left_anti").groupBy(token, country).agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy(token).orderBy(F.desc("n"), country)
    counts = counts.withColumns({"test_count": F.sum("n").over(Window.partitionBy(token)), "_r": F.row_number().over(best)})
    return counts.where((F.col("_r") == 1) & (F.col("test_count") >= least)).select(
        token, "test_count", F.col(country).alias("main_country"), (F.col("n") / F.col("test_count")).alias("main_country_share")
    )
