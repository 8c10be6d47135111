"""Incremental ingest: new rows of a raw table run through the batch operators, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, operator: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Apply a batch operator to each batch of new Parquet files and append the outcome once.

    Each batch overwrites its own partition of the target, so a batch repeated after a failure leaves no double rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return spark.readStream.schema(schema).parquet(source).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
