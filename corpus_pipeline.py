"""documents to packed batches in five stages; each reads what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlink.llm.common import load, materialize, repeated, with_content_key
from tarnlink.llm.language_id import accept_documents
from tarnlink.llm.line_dedup import line_dedup
from tarnlink.llm.mixing import mix
from tarnlink.llm.ngram_join import jaccard_rows
from tarnlink.llm.packing import count_words, pack

#: The columns every stage but the last returns; n_chars follows the text.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the text model knows; others go. A null doc_id does not matter."""
    return accept_documents(docs).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of three-line windows; one that loses every character goes. Rows of null doc_id
    stay whole."""
    rows = line_dedup(docs).where("n_removed = 0 or trim(text) <> ''")
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component: the one of smallest doc_id, a null one last, then of smallest content hash.
    Rows without words have no component and stay; rows that are equal in every column are one."""
    rows = with_content_key(docs.select(*COLUMNS), COLUMNS)
    found = jaccard_rows(rows, ("k1", "k2"))
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("best")
    first = found.where("comp is not null").groupBy("comp").agg(best).select("best.k1", "best.k2")
    stay = materialize(first.unionByName(found.where("comp is null").select("k1", "k2").distinct()), "pipeline-stay")
    rows = rows.join(stay, ["k1", "k2"], "left_semi")
    return rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("_rows"), *(F.first(c).alias(c) for c in COLUMNS)).select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mixture draws it, once at least. Rows of equal doc_id (null is one), source and number of
    tokens are drawn as one run and share the draws, the first by their other columns one more if they do not divide."""
    drawn = mix(docs).groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("n_tokens").alias("_tokens"))
    # epoch 0 draws every row once, so it counts the rows
    drawn = drawn.agg(F.count(F.lit(1)).alias("_draws"), F.sum((F.col("epoch") == 0).cast("long")).alias("_rows"))
    drawn = materialize(drawn, "pipeline-drawn")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.coalesce("source", F.lit("")) == F.col("_source")) & (F.col("_words") == F.col("_tokens"))
    rows = docs.select(*COLUMNS, (count_words() + 1).alias("_words"))
    out = rows.join(drawn.where("_rows = 1"), same).withColumn("_times", F.col("_draws"))
    if not drawn.where("_rows > 1").isEmpty():
        several = rows.join(drawn.where("_rows > 1"), same).groupBy(*out.drop("_times").columns).agg(F.count(F.lit(1)).alias("_same"))
        order = Window.partitionBy("_id", "_source", "_tokens").orderBy("lang", "n_chars", "text", "source").rowsBetween(Window.unboundedPreceding, -1)
        several = several.withColumn("_at", F.coalesce(F.sum("_same").over(order), F.lit(0)))
        more = "greatest(0L, least(_at + _same, _draws % _rows) - _at)"
        several = several.withColumn("_times", F.expr(f"_same * (_draws div _rows) + {more}"))
        out = out.unionByName(several.select(*out.columns))
    return repeated(out.where("_times > 0"), "_times", "_draw").select(*COLUMNS)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per segment with its bucket, batch and slot."""
    return pack(docs)


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("near_duplicates", near_stage), ("mixing", mix_stage), ("packing", pack_stage)]

#: Trained models and iterated components have no SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
