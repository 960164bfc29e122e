"""Ordered packing of chunks into output files.

A file is closed before the first chunk that would carry it beyond its limit; a chunk is never
split, one that is larger than the limit stands alone. Where files are cut thus depends on all
chunks before, but only through the words in the open file. The ordered chunks are range
partitioned into blocks, and each block is summarised as a function of the words it finds in the
open file: as soon as it closes one file, everything after depends only on where. A single task
composes these functions, which hold at most as many entries as fit into one file, and all
blocks then number their chunks in parallel.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import partitions, shipped, stage

REMAINING = "remaining"
#: Chunks of a block, and output files that are counted in one task.
BLOCK_ROWS, COUNTED = 1 << 19, 1 << 16


def _starts(words: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Running totals, and for a file that begins at each chunk the chunk that begins the next (the number of chunks if none)."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    after = np.searchsorted(total, total[:-1] + limit, side="right") - 1
    return total, np.minimum(np.maximum(after, np.arange(n) + 1), n)


def summarise(words: np.ndarray, limit: int) -> list[tuple[int, int, int, int]]:
    """``(most, left, closed, same)``: with at most ``most`` words in the open file, ``left`` are in it after the block and ``closed`` files were closed.

    ``same`` is 1 if none was, and ``left`` come to the words before. Entries ascend; the last,
    for more words than fit at all, is also what a block does that begins a file. There are no
    more entries than chunks in one file, and two.
    """
    n = len(words)
    total, after = _starts(words, limit)
    left, closed = np.empty(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        k = after[i]
        left[i], closed[i] = (total[n] - total[i], 0) if k >= n else (left[k], closed[k] + 1)
    out = [(1 << 62, int(left[0]), int(closed[0]) + 1, 0)]
    first = np.minimum.accumulate(limit - total[1:])  # chunks 0..j fit while at most first[j] words are there
    bound = limit
    for j in range(n):
        if first[j] < bound:  # with more than first[j], up to bound, words chunk j closes the file
            out.append((int(bound), int(left[j]), int(closed[j]) + 1, 0))
            bound = first[j]
        if bound < 0:
            break
    if bound >= 0:
        out.append((int(bound), int(total[n]), 0, 1))
    return out[::-1]


def numbered(words: np.ndarray, limit: int, inside: int, number: int, begun: bool) -> np.ndarray:
    """The file of every chunk of a block that finds ``inside`` words in file ``number``."""
    n = len(words)
    total, after = _starts(words, limit)
    out = np.full(n, number, np.int64)
    at = 0
    if begun:
        over = np.flatnonzero(inside + total[1:] > limit)
        if not len(over):
            return out
        at = int(over[0])
        number += 1
    while at < n:
        out[at : after[at]] = number
        at, number = int(after[at]), number + 1
    return out


def next_fit(chunks: DataFrame, limit: int, order: list[str], words: str = "words", blocks: int | None = None) -> DataFrame:
    """``(*order, words, bin)``: the output file of every chunk, numbered from 0.

    ``order`` must be unique; null words count as 0; an empty table gives an empty result.
    Integers alone travel; no text does.
    """
    import pyarrow as pa

    spark = shipped(chunks).sparkSession
    narrow = stage(chunks.select(*order, F.greatest(F.coalesce(F.col(words), F.lit(0)), F.lit(0)).cast("bigint").alias("words")), "words")
    blocks = blocks or max(partitions(spark), -(-narrow.count() // BLOCK_ROWS))  # the count reads no column
    ranged = narrow.repartitionByRange(blocks, *order).sortWithinPartitions(*order)
    held = stage(ranged.withColumn("block", F.spark_partition_id()), "blocks")

    def functions(t: pa.Table) -> pa.Table:
        t = t.sort_by([(o, "ascending") for o in order])
        rows = summarise(t["words"].to_numpy(), limit)
        block = t["block"][0].as_py()
        return pa.table({"block": pa.array([block] * len(rows), pa.int32()), **{k: pa.array([r[i] for r in rows], pa.int64()) for i, k in enumerate(("most", "left", "closed", "same"))}})

    made = held.groupBy("block").applyInArrow(functions, "block int, most bigint, left bigint, closed bigint, same bigint")

    def compose(batches):
        inside, number, begun = 0, 0, False
        block, rows = None, []
        out: list[tuple[int, int, int, bool]] = []

        def step():
            nonlocal inside, number, begun
            out.append((block, inside, number, begun))
            if not begun:  # nothing to close: a file begins with the first chunk, as after a full one
                _, left, closed, _ = rows[-1]
                inside, number, begun = left, number + closed - 1, True
                return
            _, left, closed, same = next(r for r in rows if inside <= r[0])
            inside, number = (inside + left if same else left), number + closed

        for batch in batches:
            for b, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if b != block:
                    if rows:
                        step()
                    block, rows = b, []
                rows.append(tuple(row))
        if rows:
            step()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.bool_()))], names=["block", "inside", "number", "begun"])

    # a few entries for each block: the only step in one task
    states = made.repartition(1).sortWithinPartitions("block", "most").mapInArrow(compose, "block int, inside bigint, number bigint, begun boolean")

    def number(t: pa.Table) -> pa.Table:
        t = t.sort_by([(o, "ascending") for o in order])
        bins = numbered(t["words"].to_numpy(), limit, t["inside"][0].as_py(), t["number"][0].as_py(), t["begun"][0].as_py())
        return t.select([*order, "words"]).append_column("bin", pa.array(bins))

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema)
    return held.join(states, "block").groupBy("block").applyInArrow(number, f"{types}, bin bigint")


def _named(per: DataFrame) -> DataFrame:
    """Names for files of ``subdir`` and ``bin``, counted from 0 in each folder.

    Bins are numbered without gaps, so files are counted in runs of ``COUNTED`` bins, and runs
    are put one after the other by running totals: a folder that holds most files is spread.
    """
    rows = per.withColumn("run", F.floor(F.col("bin") / COUNTED))
    totals = rows.groupBy("subdir", "run").agg(F.count("*").alias("n"))  # a row for each folder and COUNTED files
    before = W.partitionBy("subdir").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("subdir", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("subdir", "run").orderBy("bin")) - 1).join(totals, ["subdir", "run"])
    rows = rows.withColumn("file_idx", (F.col("before") + F.col("nth")).cast("int"))
    return rows.select("bin", "subdir", "file_idx", F.concat_ws("/", "subdir", F.concat(F.lit("chunk_"), F.col("file_idx").cast("string"), F.lit(".txt"))).alias("rel_file"), "words", "chunks")


def files_by_folder(bins: DataFrame) -> DataFrame:
    """Like ``files`` where every file holds chunks of one folder and lies in it: a bin with chunks of two is two files."""
    return _named(bins.groupBy("subdir", "bin").agg(F.sum("words").alias("words"), F.count("*").alias("chunks")))


def files(bins: DataFrame, order: list[str]) -> DataFrame:
    """``(bin, subdir, file_idx, rel_file, words, chunks)`` of ``bins`` with ``subdir`` of each chunk.

    A file lies in the folder of the chunk that closed it, the first of the next file; the last
    lies in ``remaining``. Files are counted from 0 in each folder.
    """
    per = bins.groupBy("bin").agg(F.min(F.struct(*order, "subdir")).alias("f"), F.sum("words").alias("words"), F.count("*").alias("chunks"))
    closed_by = per.select((F.col("bin") - 1).alias("bin"), F.col("f.subdir").alias("next"))
    return _named(per.join(closed_by, "bin", "left").withColumn("subdir", F.coalesce("next", F.lit(REMAINING))))
