"""Exact deduplication as a stateful stream: RocksDB keyed state without expiry, bytes checked on hits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, prefilter, release, salted_lookup, scratch_path

SPACE = b" \t\n\x0b\x0c\r"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every state partition takes megabytes of disk at once
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}


def normalise(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, SPACE)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


#: Where the content of a row stands: its file, and its place there.
LOCATOR = "struct(_metadata.file_path as file, _metadata.row_index as row) as locator"


def fingerprints(docs: DataFrame, digest=sha256, keep_text: bool = False) -> DataFrame:
    """(others, n_points, digest, text_sha256[, norm]) of each row; text is replaced."""
    rest = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            norms = [normalise(x) for x in texts]
            cols = [b.column(b.schema.get_field_index(f.name)) for f in rest]
            sums = pa.array(map(sha256, norms), pa.string())
            cols += [pa.array([len(x or "") for x in texts], pa.int64()), sums if digest is sha256 else pa.array(map(digest, norms), pa.string()), sums]
            names = [*(f.name for f in rest), "n_points", "digest", "text_sha256"]
            if keep_text:
                cols.append(pa.array(norms, pa.binary()))
                names.append("norm")
            yield pa.RecordBatch.from_arrays(cols, names)

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rest]
    return docs.mapInArrow(run, ", ".join([*kinds, "n_points long", "digest string", "text_sha256 string", *(["norm binary"] * keep_text)]))


class DedupStream:
    """Keyed state digest -> (best row: stable identifier and content locator, copies so far), kept for ever.

    process() takes whatever is new in a Parquet folder, so a second call after files were added goes on from the
    checkpoint; groups() is the state after the last call. State and log live in the shared folder.
    """

    def __init__(self, spark: SparkSession, where: str | None = None, digest=sha256):
        self.spark, self.digest = spark, digest
        self.where = where or scratch_path(spark, "exact-dedup")

    def process(self, path: str, schema) -> None:
        old = {k: self.spark.conf.get(k, None) for k in STATE}
        for k, v in STATE.items():
            self.spark.conf.set(k, v)
        try:
            path = path.rstrip("/")
            # as a pattern, since a stream takes one file only that way
            rows = self.spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
            rows = rows.selectExpr("doc_id", "text", LOCATOR)
            state = fingerprints(rows, self.digest).groupBy("digest").agg(
                F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("rid"), "locator")).alias("best"),
                F.count(F.lit(1)).alias("group_size"),
            )
            log = f"{self.where}/log"
            query = (
                state.writeStream.outputMode("update")
                .option("checkpointLocation", f"{self.where}/state")
                .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{log}/batch={n}"))
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()
        finally:
            for k, v in old.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def groups(self) -> DataFrame:
        """(digest, keep_id, locator, group_size): the last update of each digest has the largest count."""
        schema = "digest string, best struct<n_points: long, rid: long, locator: struct<file: string, row: long>>, group_size long, batch long"
        last = self.spark.read.schema(schema).option("recursiveFileLookup", "false").parquet(f"{self.where}/log")
        last = last.groupBy("digest").agg(F.max_by("best", "group_size").alias("best"), F.max("group_size").alias("group_size"))
        return last.select("digest", F.bitwise_not("best.rid").alias("keep_id"), "best.locator", "group_size")


def exact_dedup(spark: SparkSession, path: str, digest=sha256) -> DataFrame:
    """One row per row of the Parquet data at path (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical without ASCII white space; the row with the most code points, then the smallest
    doc_id, stays. Null text counts as empty, all empty texts are one group, and a null doc_id loses every tie. Rows
    that repeat a doc_id and its text are one document: each counts in group_size and all share the verdict; rows of one
    doc_id with different texts are judged each by its own. An empty table gives no rows; other columns are ignored.
    On a hit the content of the row that stays is fetched by its locator and compared byte by byte; the rows of a digest
    under which texts differ are grouped again by the bytes.
    """
    docs = spark.read.parquet(path).selectExpr("doc_id", "text", LOCATOR)
    stream = DedupStream(spark, digest=digest)
    stream.process(path, docs.select("doc_id", "text").schema)
    groups = materialize(stream.groups(), "dedup-groups")
    several = groups.where("group_size > 1")
    content = prefilter(fingerprints(docs, digest, True), ["digest"], several).select("doc_id", "locator", "n_points", "digest", "norm", "text_sha256")
    stays = prefilter(content.select("locator", F.col("norm").alias("kept_norm")), ["locator"], several)
    stays = stays.join(several.select("digest", "locator", "group_size").hint("shuffle_hash"), "locator").withColumnRenamed("locator", "kept_at")
    hits = salted_lookup(content.select("locator", "digest", "norm"), stays, ["digest"], "group_size", ["locator"])
    bad = materialize(hits.where("locator <> kept_at and norm <> kept_norm").select("digest").distinct(), "dedup-collisions")
    own = fingerprints(docs.drop("locator"), digest)
    found = salted_lookup(own, groups.select("digest", "keep_id", "group_size"), ["digest"], "group_size", ["doc_id"])
    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    if bad.isEmpty():
        release(bad)
        return found.select(*columns)
    sure = found.join(bad, "digest", "left_anti")
    torn = materialize(content.drop("locator").join(bad, "digest", "left_semi"), "dedup-torn")
    exact = torn.groupBy("digest", "norm").agg(F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("rid"))).alias("best"), F.count(F.lit(1)).alias("group_size"))
    exact = exact.select("digest", "norm", F.bitwise_not("best.rid").alias("keep_id"), "group_size")
    torn = salted_lookup(torn, exact, ["digest", "norm"], "group_size", ["doc_id"])
    return sure.select(*columns).unionByName(torn.select(*columns))
