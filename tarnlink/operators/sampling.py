"""Samples, splits, folds, negatives (M01-M07): decided by hashes of ids, so stable under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit(key: Column, seed: int = 42) -> Column:
    """A number in [0, 1) from the first 8 hexadecimal digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def entity_split(entities: DataFrame, records: DataFrame, entity: str, record: str, fraction: float = 0.05, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Marks both frames with is_eval. Records follow their entity (null or "": their own id)."""
    mark = lambda c: unit(c, seed) < fraction
    own = F.when(F.coalesce(F.col(entity), F.lit("").cast("string")) != "", F.col(entity)).otherwise(F.col(record))
    return entities.withColumn("is_eval", mark(F.col(entity))), records.withColumn("is_eval", mark(own))


def fold(entity: Column, own: Column) -> Column:
    """M03: "A" or "B" by crc32 parity of the entity, or the own id of an unmatched record."""
    key = F.coalesce(F.nullif(entity.cast("string"), F.lit("")), own.cast("string"))
    return F.when(F.crc32(key.cast("binary")) % 2 == 0, "A").otherwise("B")


def negatives(fused: DataFrame, label: str = "label", query: str = "query_id", hard: int = 10, random: int = 5, candidate: str = "s1_id", seed: int = 0) -> DataFrame:
    """Positives, the negatives in a window of `hard` fused ranks from the best negative, `random` others."""
    negative = F.col(label) == 0
    first = F.min(F.when(negative, F.col("fused_rank"))).over(Window.partitionBy(query))
    rows = fused.withColumn("_hard", negative & (F.col("fused_rank") <= first + (hard - 1)))
    rest = negative & ~F.col("_hard")
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(query).cast("string"), F.col(candidate).cast("string")).cast("binary"))
    order = Window.partitionBy(query, rest).orderBy(draw, candidate)
    rows = rows.withColumn("_rest", rest).withColumn("_r", F.row_number().over(order))
    return rows.where(~negative | F.col("_hard") | (F.col("_rest") & (F.col("_r") <= random))).drop("_hard", "_rest", "_r")


def training_pairs(fused: DataFrame, label: str = "label", query: str = "query_id", top: int = 5, random: int = 2, candidate: str = "s1_id", seed: int = 0) -> DataFrame:
    """The top ranks, all positives and a few random lower candidates."""
    low = (F.col("fused_rank") > top) & (F.col(label) == 0)
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(query).cast("string"), F.col(candidate).cast("string")).cast("binary"))
    rows = fused.withColumn("_low", low).withColumn("_r", F.row_number().over(Window.partitionBy(query, low).orderBy(draw, candidate)))
    return rows.where(~F.col("_low") | (F.col("_r") <= random)).drop("_low", "_r")


def pair_text(name: Column, address: Column, mode: str = "both") -> Column:
    """M07."""
    return {"both": F.concat_ws(" | ", name, address), "name": name, "address": address}[mode]
