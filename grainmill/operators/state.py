"""Files against the saved hashes of earlier runs.

The state is joined by path and hash; Spark broadcasts it while it is small and shuffles both
sides, without contents, when it isn't.
"""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, hash string"


def changed(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files whose path and hash are not in the state together; a null hash is never known."""
    return files.join(state.select("path", "hash"), ["path", "hash"], "left_anti")


def unchanged(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files that the state knows with the same hash."""
    return files.join(state.select("path", "hash"), ["path", "hash"], "left_semi")


def upsert(state: DataFrame, new: DataFrame) -> DataFrame:
    """The state with new rows in place of old ones of the same path; paths that are gone stay."""
    new = new.select("path", "hash")
    return state.select("path", "hash").join(new, "path", "left_anti").select("path", "hash").unionByName(new)


def load(spark: SparkSession, path: str) -> DataFrame:
    """State from a JSON mapping; empty if it is missing or broken."""
    from ..functions.library import load_json

    held = load_json(path, "hashes") if os.path.exists(path) else {}
    return spark.createDataFrame([(k, v) for k, v in held.items()] if isinstance(held, dict) else [], SCHEMA)


def save(state: DataFrame, path: str) -> None:
    """State as a JSON mapping, one entry at a time, so that the driver never holds it whole."""
    from ..functions.library import write_whole

    def parts():
        yield "{"
        for n, r in enumerate(state.orderBy("path").toLocalIterator(prefetchPartitions=True)):
            yield ",\n    " if n else "\n    "
            yield f"{json.dumps(r['path'])}: {json.dumps(r['hash'])}"
        yield "\n}"

    write_whole(path, parts())


class StateTable:
    """State as Parquet: one folder for each run, of which the last that is whole holds. Nothing passes through the driver."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def versions(self) -> list[int]:
        held = os.listdir(self.folder) if os.path.isdir(self.folder) else []
        return sorted(int(n[4:]) for n in held if n.startswith("run=") and os.path.exists(os.path.join(self.folder, n, "_SUCCESS")))

    def load(self) -> DataFrame:
        held = self.versions()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/run={held[-1]}") if held else self.spark.createDataFrame([], SCHEMA)

    def save(self, state: DataFrame) -> None:
        """The next version; the one before stays for readers, older ones go."""
        held = self.versions()
        state.select("path", "hash").write.mode("overwrite").parquet(f"{self.folder}/run={held[-1] + 1 if held else 0}")
        for n in held[:-1]:
            shutil.rmtree(f"{self.folder}/run={n}", ignore_errors=True)
