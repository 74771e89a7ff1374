"""Readers and writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE = ("entity_id", "business_name", "business_address", "country")


def read_tsv(spark: SparkSession, paths: str | list[str], columns: tuple[str, ...] = SOURCE, rows: int | None = None, line_feeds: bool = True) -> DataFrame:
    """All strings; quotes doubled inside quotes, tabs kept there; empty is "" and "null" text. line_feeds keeps those
    inside quotes too, for which a file cannot be split among tasks; without them, say False for large files."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    df = spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", line_feeds).csv(paths)
    df = df.fillna("")
    return df if rows is None else df.limit(rows)


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """S12."""
    df.write.mode(mode).option("sep", "\t").option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def write_hits(df: DataFrame, path: str) -> None:
    """Scores with four decimals."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    write_tsv(df.withColumns({c: F.format_string("%.4f", F.col(c).cast("double")) for c in floats}), path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """S09."""
    return spark.read.text(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where=None) -> DataFrame:
    """The columns and the filter reach the scan."""
    df = spark.read.parquet(path)
    df = df if where is None else df.where(where)
    return df if columns is None else df.select(*columns)


def write_once(df: DataFrame, path: str) -> DataFrame:
    """Written unless there; what is there is read. A job commits all of its files or none."""
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def aligned_vectors(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Rows joined with their vectors; fails if one has none."""
    if not rows.join(vectors, key, "left_anti").isEmpty():
        raise ValueError("rows without a vector")
    return rows.join(vectors, key)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def read_json(spark: SparkSession, *paths: str) -> dict:
    """Maps in order, later ones win; through Spark, so any store will do."""
    out: dict = {}
    for p in paths:
        out |= json.loads(spark.read.text(p, wholetext=True).first()[0])
    return out


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """Sorted keys, UTF-8."""
    at = _path(spark, path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(json.dumps(value, sort_keys=True, ensure_ascii=False, indent=1).encode()))
    finally:
        out.close()


def source_of(entity_id: str = "entity_id"):
    return F.substring_index(entity_id, "-", 1)
