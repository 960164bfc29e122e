"""Session settings that operators read."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is unset and executors run in the driver's process (tests, a single
    machine) a temporary folder takes its place; on a cluster that is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="grainmill-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed by ``release``, else when the driver ends."""
    folder = f"{shared_dir(spark)}/grainmill-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(release)
    _made.append((spark, folder))
    return folder


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back.

    Later stages then depend on files all executors share, so losing an executor costs no more
    than the tasks it ran.
    """
    folder = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def release(since: int = 0) -> None:
    """Remove the folders made since a mark; their tables must have been used up by then."""
    while len(_made) > since:
        spark, folder = _made.pop()
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has gone, and its folder with it
            pass


@contextmanager
def stages():
    """``with stages():`` removes what was staged inside when the block ends, for callers who use up their results in it."""
    since = len(_made)
    try:
        yield
    finally:
        release(since)


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, once for a session.

    Nothing is done where they have it: on the ``PYTHONPATH`` they share with the driver, or as
    one of Spark's own Python files.
    """
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    sc = spark.sparkContext
    if getattr(sc, "_grainmill", False) or not os.path.isdir(package):
        return
    sc._grainmill = True
    if root in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="grainmill-"), "grainmill.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), root))
    sc.addPyFile(target)  # served by the driver


def shipped(df: DataFrame) -> DataFrame:
    """``df``, whose executors have the package."""
    ship(df.sparkSession)
    return df
