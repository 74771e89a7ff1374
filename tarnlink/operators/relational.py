"""Joins, sets, groups and orders in the forms linkage needs (J, A, W, O, U)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled


def explode_ids(df: DataFrame, key: str, ids: str, out: str) -> DataFrame:
    """One row per id of a comma-joined list; empty lists give none."""
    return df.select(key, F.explode(F.filter(F.split(ids, ","), lambda x: x != "")).alias(out))


def join_ids(links: DataFrame, everyone: DataFrame, key: str, member: str, out: str) -> DataFrame:
    """The sorted distinct members of each key, comma-joined; "" for keys without any."""
    lists = links.select(key, member).distinct().groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.col(member).cast("string"))), ",").alias(out))
    return everyone.select(key).join(lists, key, "left").withColumn(out, F.coalesce(out, F.lit("")))


def left_fill(left: DataFrame, right: DataFrame, keys: list[str], fill) -> DataFrame:
    """Left join; what is missing on the right becomes fill."""
    return left.join(right, keys, "left").fillna(fill, [c for c in right.columns if c not in keys])


def lookup(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A join that fails, when it runs, on a key that is missing on the right."""
    rows = left.join(right.withColumn("_found", F.lit(True)), keys, "left")
    found = F.coalesce(F.col("_found"), F.raise_error(F.lit(f"a key of {keys} has no row")).cast("boolean"))
    return rows.where(found).drop("_found")


def best_per_group(df: DataFrame, group: list[str], *order: Column) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_r = 1").drop("_r")


def hash_limit(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """N rows by a hash of their key: the same ones however the data are partitioned."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """W01 over all rows: adds running sums {out: column} in that order, and the whole sums as <out>_all.

    Rows are range-partitioned and settled, so that a row's part cannot change between two reads; only one row of sums
    a part is summed in a single task.
    """
    spread = settled(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    whole = spread.groupBy("_p").agg(*(F.sum(c).alias(f"_w{i}") for i, c in enumerate(sums.values())))
    before, everything = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    cols = {f"_b{i}": F.coalesce(F.sum(f"_w{i}").over(before), F.lit(0)) for i in range(len(sums))}
    whole = whole.withColumns(cols | {f"{out}_all": F.sum(f"_w{i}").over(everything) for i, out in enumerate(sums)})
    here = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = spread.join(F.broadcast(whole), "_p")
    rows = rows.withColumns({out: F.col(f"_b{i}") + F.sum(c).over(here) for i, (out, c) in enumerate(sums.items())})
    return rows.drop("_p", *(f"{x}{i}" for x in ("_w", "_b") for i in range(len(sums))))


def parts(df: DataFrame, order: str, n: int) -> DataFrame:
    """Contiguous parts 0 to n - 1 of nearly equal size, the first ones larger by a row; no task sorts all rows."""
    rows = running(df.withColumn("_one", F.lit(1).cast("long")), [F.col(order)], {"_at": "_one"})
    at, size, big = F.col("_at") - 1, F.expr(f"_at_all div {n}"), F.col("_at_all") % n
    wide = big * (size + 1)
    part = F.when(at < wide, F.floor(at / (size + 1))).otherwise(big + F.floor((at - wide) / F.greatest(size, F.lit(1))))
    return rows.withColumn("part", part.cast("int")).drop("_one", "_at", "_at_all")


def first_seen(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Marks the first row of each key."""
    return df.withColumn("first_seen", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def run_starts(df: DataFrame, group: list[str], value: str, *order: Column) -> DataFrame:
    """Marks rows whose value differs from that of the row before them in their group."""
    before = F.struct(value)  # a struct, so that a null value differs from no row at all
    return df.withColumn("run_start", ~before.eqNullSafe(F.lag(before).over(Window.partitionBy(*group).orderBy(*order))))


def rank_among(df: DataFrame, group: list[str], kept: Column, *order: Column) -> DataFrame:
    """The place of each kept row among the kept ones of its group, null for others."""
    running_count = F.count(F.when(kept, F.lit(1))).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("kept_rank", F.when(kept, running_count))


def set_equal(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def subset(a: Column, b: Column) -> Column:
    """U04."""
    return F.size(F.array_except(a, b)) == 0


def shares(df: DataFrame, group: str) -> DataFrame:
    """(group, n, share)."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))  # one row
    return counts.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_total")).drop("_total")
