"""Line deduplication over overlapping windows of three consecutive lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import bitmap, materialize, maybe_in, prefilter, salted_lookup, shield, unshield

WINDOW = 3
#: What names a document: rows of one doc_id with different texts are documents of their own, by a hash of the text.
PLACE = ["doc_id", "t"]


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, t, pos, h1, h2): a 128-bit hash of each three consecutive lines."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    three = F.arrays_zip(lines.alias("a"), F.slice(lines, 2, F.size(lines)).alias("b"), F.slice(lines, 3, F.size(lines)).alias("c"))
    rows = docs.where(F.col("doc_id").isNotNull()).select(*PLACE, F.posexplode(three).alias("pos", "w"))
    rows = rows.select(*PLACE, "pos", "w.a", "w.b", "w.c").where("c is not null")
    return rows.select(*PLACE, "pos", F.xxhash64(F.lit(1), "a", "b", "c").alias("h1"), F.xxhash64(F.lit(2), "c", "b", "a").alias("h2"))


def repeated_windows(found: DataFrame) -> DataFrame:
    """(doc_id, t, pos) of each window that an earlier (doc_id, t, pos) also has."""
    here = F.struct(*PLACE, "pos")
    firsts = found.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = prefilter(found, ["h1"], firsts.select("h1"), 22)
    return salted_lookup(rows, firsts, ["h1", "h2"], "n", [*PLACE, "pos"]).where(here > F.col("first")).select(*PLACE, "pos")


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with text replaced, plus n_lines and n_removed (int): lines that a later occurrence of a window covers go.

    A window is three consecutive lines, line feeds between; its first occurrence by (doc_id, line) stays. Covered
    positions are merged, so overlapping repeats remove each line once. Texts of fewer than three lines stay whole,
    null stays null with 0 lines, and rows of null doc_id stay whole. Rows that repeat a doc_id and its text are judged as
    one document: what repeats between them counts as at the same place and stays; different texts of one doc_id are
    different documents, in the order of a hash. Other columns pass through, whatever their names; n_lines and n_removed of
    docs are replaced.
    """
    docs, own = docs.drop("n_lines", "n_removed"), ["doc_id", "text"]
    rows = shield(docs, own).withColumn("t", F.xxhash64("text"))
    found = materialize(windows(rows), "line-windows")
    covered = materialize(repeated_windows(found).groupBy(*PLACE).agg(F.collect_set("pos").alias("at")), "line-cover", done=(found,))
    near = maybe_in(rows, PLACE, bitmap(covered, PLACE, 22), 22)
    hit = near.where("_maybe").drop("_maybe").join(covered.hint("shuffle_hash"), PLACE, "left")
    names = [c for c in rows.columns if c != "t"]
    counts = [StructField(c, IntegerType()) for c in ("n_lines", "n_removed")]
    cut = hit.select(*names, "at").mapInArrow(_cut, StructType([*rows.select(*names).schema.fields, *counts]))
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    whole = near.where("not _maybe").select(*names).withColumns({"n_lines": lines, "n_removed": F.lit(0)})
    return unshield(cut.unionByName(whole), docs, own, ["n_lines", "n_removed"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        k, texts, n, gone = b.schema.get_field_index("text"), [], [], []
        for text, at in zip(b.column(k).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
            lines = [] if text is None else text.split("\n")
            covered = {p + i for p in at or () for i in range(WINDOW)}
            texts.append("\n".join(x for i, x in enumerate(lines) if i not in covered) if covered else text)
            n.append(len(lines))
            gone.append(len(covered))
        cols = [pa.array(texts, pa.string()) if i == k else b.column(i) for i in range(b.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int32()), pa.array(gone, pa.int32())], [*b.schema.names[:-1], "n_lines", "n_removed"])


QUERY_SQL = """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM l),
w AS (SELECT doc_id, pos, line, lead(line, 1) OVER o AS l2, lead(line, 2) OVER o AS l3 FROM x
      WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
d AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, pos) AS rn FROM w WHERE l3 IS NOT NULL),
g AS (SELECT DISTINCT doc_id, pos + k AS pos FROM d, (VALUES (0), (1), (2)) AS t(k) WHERE rn > 1)
SELECT x.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(g.pos) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(x.line, chr(10) ORDER BY x.pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_sha256
FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.pos = g.pos GROUP BY x.doc_id
"""
