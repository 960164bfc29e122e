"""Output files with exact names."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shipped


def write_texts(rows: DataFrame, folder: str, order: list[str]) -> DataFrame:
    """Write ``formatted`` of all rows of a ``rel_file``, in order, each followed by a blank line.

    A file holds at most the words of a bin, so the rows of one fit into a task. Files are
    written beside their place and renamed: a task that runs twice leaves one whole file. Gives
    ``(rel_file, chars)``, lazily.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "formatted"))), lambda x: F.concat(x["formatted"], F.lit("\n\n"))), "")
    joined = rows.groupBy("rel_file").agg(text.alias("text"))

    def run(batches):
        import uuid

        import pyarrow as pa

        for batch in batches:
            names, sizes = [], []
            for rel, content in zip(*(c.to_pylist() for c in batch.columns)):
                target = os.path.join(folder, rel)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                beside = f"{target}.{uuid.uuid4().hex}"
                with open(beside, "w", encoding="utf-8", newline="") as f:
                    f.write(content)
                os.replace(beside, target)
                names.append(rel)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["rel_file", "chars"])

    return shipped(joined).mapInArrow(run, "rel_file string, chars bigint")
