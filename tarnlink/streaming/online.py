"""Streams of query records against a fixed index, batch by batch (an extension; linkage itself is batch)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.linkage import Config, candidates, standardize


def link_stream(records: DataFrame, s1: DataFrame, config: Config, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts the query: each batch is standardized, searched and fused, then handed to write(candidates, batch id).
    s1 is standardized already. Top-k windows need the whole batch, hence foreachBatch."""

    def batch(rows: DataFrame, n: int) -> None:
        write(candidates(standardize(rows, config), s1, config), n)

    return records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()


def tsv_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Source records arriving as TSV files."""
    schema = "entity_id string, business_name string, business_address string, country string"
    return spark.readStream.schema(schema).option("sep", "\t").option("header", True).option("escape", '"').csv(folder)
