"""Chunks of single files on disk."""

from __future__ import annotations

import logging
import os

from pyspark.sql import SparkSession

from ..functions.formatting import format_chunk
from ..functions.library import SUBDIRS
from ..operators import chunkers
from ..session import ship
from ..sources.reader import read_text

log = logging.getLogger(__name__)


class FileChunker:
    """Chunk and format files one by one, by the same operators as a run over a tree."""

    def __init__(self, spark: SparkSession, mode: str = "compat"):
        self.spark, self.mode = spark, mode
        ship(spark)

    def _table(self, path: str):
        name = os.path.basename(path)
        dot = name.rfind(".")
        suffix = name[dot:] if 0 < dot < len(name) - 1 else ""
        text, _, error = read_text(path)
        if error:
            log.warning("Error reading %s: %s", path, error)
        return self.spark.createDataFrame([(name, suffix, text)], "name string, suffix string, text string")

    def chunk_file(self, path: str) -> tuple[list[dict], int]:
        """The chunks of a file, with the fields they have, and its number of lines."""
        row = chunkers.chunked(self._table(path), self.mode).first()
        return [{k: v for k, v in c.asDict(recursive=True).items() if v is not None} for c in row["chunks"]], row["lines"]

    def texts(self, path: str) -> list[str]:
        """The chunks of a file as text."""
        rows = chunkers.chunk(self._table(path), self.mode).withColumn("formatted", format_chunk(self.mode))
        return [r["formatted"] for r in rows.orderBy("chunk_idx").select("formatted").collect()]

    @staticmethod
    def subdir(path: str) -> str:
        """The output folder of a file."""
        return SUBDIRS.get(os.path.splitext(os.path.basename(path))[1], "other")
