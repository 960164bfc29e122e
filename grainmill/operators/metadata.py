"""Figures of files and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_file(files: DataFrame, chunks: DataFrame, key: list[str], words: str = "words") -> DataFrame:
    """``files`` with the number of its chunks and their words, 0 where it has none."""
    per = chunks.groupBy(*key).agg(F.count("*").alias("chunks"), F.sum(words).alias("words"))
    zero = F.lit(0).cast("bigint")
    return files.join(per, key, "left").withColumn("chunks", F.coalesce("chunks", zero)).withColumn("words", F.coalesce("words", zero))


def summary(processed: DataFrame) -> DataFrame:
    """``(total_files_processed, total_words)`` in one row, 0 for an empty run."""
    return processed.agg(F.count("*").alias("total_files_processed"), F.coalesce(F.sum("words"), F.lit(0)).cast("bigint").alias("total_words"))


def entries(listing: DataFrame) -> DataFrame:
    """Number of listed entries, folders included."""
    return listing.agg(F.count("*").alias("entries"))
