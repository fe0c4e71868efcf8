"""Continuous ingestion of paper files: each micro-batch runs the batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from litloom.plans.ingest import ingest
from litloom.sources.shared import scratch
from litloom.sources.store import Store

INPUT = "arxiv_id string, title string, year int, abstract string, pages array<string>"


def ingest_stream(
    spark: SparkSession, path: str, store: Store, extractor: Callable, checkpoint: str, domain: str, encode: Callable | None = None,
) -> StreamingQuery:
    """JSON files under ``path`` are ingested once each.

    A micro-batch's number is committed with what it writes, under the name of its checkpoint folder; Spark numbers a
    batch alike when it repeats it after a failure, so a batch that was committed before changes nothing, failure rows included.
    """

    def publish(batch: DataFrame, number: int) -> None:
        with scratch(spark):
            ingest(store, batch, extractor, domain, "insert", True, encode, (checkpoint, number))

    rows = spark.readStream.schema(INPUT).json(path)
    return rows.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
