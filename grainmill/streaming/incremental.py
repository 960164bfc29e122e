"""Continuous processing of a growing table of files.

An extension: batches of a stream go through the chunkers, and the sink keeps one folder for each
batch, so that a batch that runs again after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunkers import chunk


def write_batches(folder: str):
    """A sink for ``foreachBatch``: the chunks of a batch in a folder of its own, replaced when it runs again."""

    def sink(batch: DataFrame, number: int) -> None:
        chunk(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return sink


def chunk_stream(spark: SparkSession, source: str, schema: str, folder: str, checkpoint: str, per_batch: int = 1000) -> StreamingQuery:
    """Chunk files that arrive as Parquet under ``source`` (name, suffix, text and other columns) until none is left."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(source)
    return rows.writeStream.foreachBatch(write_batches(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
