"""Listing of a tree of files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import shipped

#: Folders from which on executors walk the tree.
SUBTREES = 256

SCHEMA = "seq bigint, path string, abs_path string, name string, suffix string, is_dir boolean, size bigint, modified_at double"


def entries(folder: str, prune: frozenset[str] = frozenset()) -> Iterator[tuple]:
    """The entries of one folder: name, path, name, suffix, is it a folder, size, time; links to folders are not folders.

    Names that are no UTF-8 can't stand in a table and are left out, like folders in ``prune``.
    """
    with os.scandir(folder) as it:
        for e in it:
            try:
                e.path.encode()
            except UnicodeEncodeError:
                continue
            is_dir = e.is_dir(follow_symlinks=False)
            if is_dir and e.name in prune:
                continue
            stat = e.stat(follow_symlinks=not is_dir) if is_dir or e.is_file() else None
            if stat is None:
                continue
            dot = e.name.rfind(".")
            suffix = e.name[dot:] if 0 < dot < len(e.name) - 1 else ""
            yield e.name, e.path, e.name, suffix, is_dir, 0 if is_dir else stat.st_size, stat.st_mtime


def walk(root: str, prune: frozenset[str] = frozenset()) -> Iterator[tuple]:
    """Every entry below ``root`` by its path relative to it, hidden ones too; folders named in ``prune`` are left out whole."""
    stack = [root]
    while stack:
        for _, path, *rest in entries(stack.pop(), prune):
            yield os.path.relpath(path, root), path, *rest
            if rest[2]:
                stack.append(path)


def subtrees(root: str, prune: frozenset[str] = frozenset(), enough: int = SUBTREES) -> tuple[list[tuple], list[str]]:
    """The entries near the root, level by level until ``enough`` folders are open, and those folders, relative to the root, still to be walked."""
    near: list[tuple] = []
    open_ = [""]
    while open_ and len(open_) < enough:
        below = []
        for folder in open_:
            for rel, *rest in entries(os.path.join(root, folder) if folder else root, prune):
                inside = os.path.join(folder, rel) if folder else rel
                near.append((inside, *rest))
                if rest[3]:
                    below.append(inside)
        open_ = below
    return near, open_


def listing(spark: SparkSession, root: str, prune: frozenset[str] = frozenset()) -> DataFrame:
    """The tree as a table; ``seq`` grows with the path.

    The driver lists some ``SUBTREES`` folders near the root, executors walk what is below them;
    they must reach the same paths. Each subtree is walked by one task, all are sorted by ranges.
    """
    near, open_ = subtrees(root, prune)
    types = SCHEMA.removeprefix("seq bigint, ")
    rows = spark.createDataFrame(near, types)
    if open_:
        spread = spark.createDataFrame([(f,) for f in open_], "folder string").repartition(min(len(open_), SUBTREES))

        def run(batches):
            for batch in batches:
                for folder in batch.column(0).to_pylist():
                    held = [(os.path.join(folder, rel), *rest) for rel, *rest in walk(os.path.join(root, folder), prune)]
                    for k in range(0, len(held), 1 << 14):
                        part = list(zip(*held[k : k + (1 << 14)]))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, (pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.float64()))], names=[t.split()[0] for t in types.split(", ")])

        rows = rows.unionByName(shipped(spread).mapInArrow(run, types))
    ordered = rows.repartitionByRange("path").sortWithinPartitions("path")
    return ordered.select(F.monotonically_increasing_id().alias("seq"), *rows.columns)


class _Part(InputPartition):
    def __init__(self, root: str, folder: str | None):
        super().__init__(folder)
        self.root, self.folder = root, folder


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        tops = sorted(e.name for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False))
        return [_Part(self.root, None), *(_Part(self.root, t) for t in tops)]

    def read(self, part):
        from .reader import read_text

        base = self.root if part.folder is None else os.path.join(self.root, part.folder)
        for rel, path, name, suffix, is_dir, size, _ in walk(base):
            inside = rel if part.folder is None else os.path.join(part.folder, rel)
            if is_dir or part.folder is None and os.sep in inside:
                continue
            text, digest, error = read_text(path)
            yield inside, name, suffix, size, digest, text, error


class TreeSource(DataSource):
    """``spark.read.format("tree").load(root)``: every file with its text, one partition for each top folder."""

    @classmethod
    def name(cls):
        return "tree"

    def schema(self):
        return "path string, name string, suffix string, size bigint, hash string, text string, error string"

    def reader(self, schema):
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)
