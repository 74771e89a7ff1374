"""Helpers the corpus operators share: shared-folder tables, bounded bitmaps, salted lookups, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more rows than this is salted over all shuffle partitions.
HOT_ROWS = 2048


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one where that is unset, but on one machine only (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tarnlink-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/tarnlink/{label}-{uuid.uuid4().hex}"


#: Shuffle files go when the query that made them has ended, not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, done: Sequence[DataFrame] = ()) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and lost executors cost nothing.

    done names tables of materialize() that nothing reads from now on; they are deleted.
    """
    spark = df.sparkSession
    path, old = scratch_path(spark, label), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if old is None else spark.conf.set(CLEANUP, old)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    release(*done)
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > min(heap.maxMemory() / 4, 1 << 31):  # broadcasts go only when the driver collects its garbage
        spark._jvm.System.gc()
    trim(spark)
    return out


def trim(spark: SparkSession) -> bool:
    """Asks the driver's JVM to return freed native memory, which the C library otherwise keeps for each of its threads. False
    where the JVM has no such command (before 17.0.9, or not on Linux)."""
    jvm, args = spark._jvm, spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    # by reflection on the interface, as the server's own class is not open to py4j
    call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    try:
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:
        return False
    return True


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(*tables: DataFrame) -> None:
    """Deletes tables of materialize(); their last reader must have run."""
    for table in tables:
        _delete(table.sparkSession, table._scratch)


def release_scratch(spark: SparkSession) -> None:
    """Deletes every table materialize() has written below the shared folder."""
    _delete(spark, f"{scratch_root(spark)}/tarnlink")


def quoted(name: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def shield(docs: DataFrame, own: Sequence[str]) -> DataFrame:
    """docs with its own columns first and all others as c0, c1, ..., so that no name of theirs can clash."""
    rest = [c for c in docs.columns if c not in own]
    return docs.select(*own, *(quoted(c).alias(f"c{i}") for i, c in enumerate(rest)))


def unshield(rows: DataFrame, docs: DataFrame, own: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """rows of shield(docs, own) with the columns of docs by name and order, and then more."""
    rest = iter(range(len(docs.columns)))
    return rows.select(*(c if c in own else f"c{next(rest)}" for c in docs.columns), *more).toDF(*docs.columns, *more)


def with_content_key(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows with k1 and k2, 128 bits of hash over the columns, nulls told from empty: rows of equal content have equal keys."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return rows.withColumns({"k1": F.xxhash64(F.lit(31), *parts), "k2": F.xxhash64(F.lit(37), *reversed(parts))})


def number_of(*parts: Column | str | int) -> Column:
    """A whole number below 2**60 from an MD5 of the parts, the same in any SQL engine that has MD5."""
    return F.conv(F.substring(digest_of(*parts), 1, 15), 16, 10).cast("long")


def digest_of(*parts: Column | str | int) -> Column:
    """The MD5 of the parts in hexadecimal, bars between."""
    return F.md5(F.concat_ws("|", *(F.lit(x).cast("string") if isinstance(x, int) else F.col(x).cast("string") if isinstance(x, str) else x.cast("string") for x in parts)))


def repeated(rows: DataFrame, count: str, index: str) -> DataFrame:
    """Each row as often as count (1 or more) says, with its index from 0; no array has more than 4096 entries of a row."""
    rows = rows.withColumn("_step", F.explode(F.expr(f"sequence(0L, `{count}` - 1L, 4096L)")))
    return rows.withColumn(index, F.explode(F.expr(f"sequence(_step, least(_step + 4095L, `{count}` - 1L))"))).drop("_step")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Longs of a bitmap row.
LANES = 16


def _slots(keys: list[str], bits: int) -> dict[str, Column]:
    slot = F.pmod(F.xxhash64(F.lit(17), *keys), F.lit(1 << bits))
    lane = F.shiftright(slot, 6).bitwiseAND(F.lit(LANES - 1))
    return {"_word": F.shiftright(slot, 10), "_lane": lane.cast("int"), "_bit": slot.bitwiseAND(F.lit(63)).cast("int")}


def bitmap(keys: DataFrame, names: list[str], bits: int) -> DataFrame:
    """A bitmap of 2**bits bits as rows (_word, _mask: LANES longs): at most 2**(bits - 10) rows whatever the input."""
    lanes = [F.expr(f"bit_or(if(_lane = {i}, shiftleft(1L, _bit), 0L))") for i in range(LANES)]
    return keys.select(*(c.alias(k) for k, c in _slots(names, bits).items())).groupBy("_word").agg(F.array(*lanes).alias("_mask"))


def maybe_in(df: DataFrame, names: list[str], words: DataFrame, bits: int) -> DataFrame:
    """Adds _maybe: false only if the row's key is certainly not in the bitmap. The broadcast has 2**(bits - 10) rows at most."""
    return (
        df.withColumns(_slots(names, bits))
        .join(F.broadcast(words), "_word", "left")
        .withColumn("_maybe", F.expr("coalesce(shiftright(_mask[_lane], _bit) & 1L, 0L) = 1L"))
        .drop("_word", "_lane", "_bit", "_mask")
    )


def prefilter(df: DataFrame, names: list[str], keys: DataFrame, bits: int = 22) -> DataFrame:
    """Drops most rows of df whose key is not in keys, before the join that decides. A full bitmap only prunes less."""
    return maybe_in(df, names, bitmap(keys, names, bits), bits).where("_maybe").drop("_maybe")


def salted_lookup(rows: DataFrame, table: DataFrame, keys: list[str], count: str, spread: list[str], how: str = "inner") -> DataFrame:
    """rows joined with table (unique on keys; count = rows of each key), hot keys dealt over all partitions.

    Keys in a bitmap of the hot ones are salted by hash(spread) on the row side and copied once a salt on the
    table side, so no task holds a whole hot key and no row is dropped.
    """
    n = partitions(rows.sparkSession)
    if hasattr(table, "_scratch") and table.where(F.col(count) > HOT_ROWS).isEmpty():
        return rows.join(table, keys, how)
    hot = bitmap(table.where(F.col(count) > HOT_ROWS), keys, 16)
    left = maybe_in(rows, keys, hot, 16).withColumn(
        "_salt", F.when(F.col("_maybe"), F.pmod(F.xxhash64(F.lit(5), *spread), F.lit(n))).otherwise(F.lit(0)).cast("int")
    )
    right = maybe_in(table, keys, hot, 16).withColumn(
        "_salt", F.explode(F.when(F.col("_maybe"), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0))))
    )
    return left.drop("_maybe").join(right.drop("_maybe"), [*keys, "_salt"], how).drop("_salt")


def fetch_texts(docs: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text, wanted's columns) of each row with a wanted key; only texts that pass a bitmap are shuffled."""
    texts = docs.select(key, "text").where(F.col(key).isNotNull())
    return prefilter(texts, [key], wanted).join(wanted.hint("shuffle_hash"), key)


def connected_components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """A table (node, comp) of every node of edges (u, v: long); comp is the smallest node of its component.

    Alternating large-star and small-star steps; each round ends in a shared table. The rows of a hub meet its one minimum in
    a plain join, so that adaptive execution splits them.
    """
    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            near = pairs.union(pairs.select("v", "u")).toDF("u", "v")
        else:
            near = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        best = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        out = near.join(best, "u")
        moved = out.where("v > u") if large else out
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            moved = moved.union(best.select("u", "m"))
        return moved.where("u <> v").distinct()

    now = materialize(edges.select("u", "v").where("u <> v").distinct(), label)
    seen = None
    while True:
        now = materialize(stars(stars(now, True), False), label, done=(now,))
        mark = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    out = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp"))
    return materialize(out.unionByName(now.select(F.col("v").alias("node")).distinct().withColumn("comp", F.col("node"))), label, done=(now,))
