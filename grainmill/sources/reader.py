"""Contents of listed files."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import shipped

#: Files of an Arrow batch; with the size limit this bounds a worker's memory.
BATCH = 16


def read_text(path: str) -> tuple[str | None, str | None, str | None]:
    """Text, md5 and error of a file; text is null if it isn't UTF-8, both if it can't be read."""
    try:
        with open(path, "rb") as f:
            raw = f.read()
    except OSError as e:
        return None, None, f"read: {e.strerror or e}"
    digest = hashlib.md5(raw, usedforsecurity=False).hexdigest()
    try:
        return raw.decode("utf-8"), digest, None
    except UnicodeDecodeError as e:
        return None, digest, f"decode: {e}"


def read_files(files: DataFrame, path_col: str = "abs_path") -> DataFrame:
    """``files`` with ``text``, ``hash`` and ``error``; one read of each file, on the executors."""
    names = files.columns
    at = names.index(path_col)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, BATCH):
                batch = whole.slice(k, BATCH)
                got = [read_text(p) for p in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.string()) for c in zip(*got))], names=[*names, "text", "hash", "error"])

    return shipped(files).mapInArrow(run, f"{types}, text string, hash string, error string")
