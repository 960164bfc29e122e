"""Long spans that stand verbatim in more than one record (problem 10).

A window is ``span`` consecutive characters. Its key is the least hash of the runs of ``m``
characters inside it, so two records that have a window in common have it under the same key.
Consecutive windows with the same key form one super-k-mer, a string that holds them all.

1. A scan gives the keys of every record, each once. Keys of a single record drop out by an
   aggregate that combines before the shuffle; the others make a filter of fixed size.
2. A second scan packs the super-k-mers of the keys in the filter straight from the text: each
   run of windows travels as one string to the bucket of its key. No text is shuffled.
3. In a bucket, equal strings count once; the windows of the others are sorted, and those that
   stand in more than one record are merged into stretches. A key with more strings than a task
   should sort is cut into its windows, whose digests are grouped over all tasks instead.

What comes out are stretches, and sets of records that share a window, each set once with its
members. Pairs are made from these only where they are asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import partitions, shipped, stage

SPAN = 200
M = 100

#: Strings of a key that one task sorts; keys with more are spread over all tasks.
BUCKET = 2048

#: Factor of the rolling hash, odd; characters that are hashed at once.
FACTOR = 0x9E3779B97F4A7C15
BLOCK = 1 << 20

#: Bits of the filter of shared keys as a power of two: 16 MB, whatever the number of keys.
FILTER_BITS = 27


@lru_cache(maxsize=16)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for factor in (FACTOR, pow(FACTOR, -1, 1 << 64)):
        p = np.full(n, factor, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _rolling(points: np.ndarray, m: int) -> np.ndarray:
    """A mixed 64-bit hash of every run of ``m`` characters."""
    n = len(points)
    up, down = _powers(1 << max(12, n.bit_length()))
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    h = (prefix[m:] - prefix[:-m]) * down[: n - m + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """The least of every ``w`` consecutive values, by running minima of blocks from both ends."""
    n = len(values)
    padded = np.full(-(-n // w) * w, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def runs_of(texts: list[str], span: int = SPAN, m: int = M) -> tuple[np.ndarray, ...]:
    """Super-k-mers of ``texts``: ``(text, key, begin, windows)``, number of the text, place of the first window and how many follow on end with the same key."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) < span:
        return (np.empty(0, np.int64),) * 4
    key = _sliding_min(_rolling(points, m), span - m + 1).view(np.int64)
    windows = np.maximum(lengths - span + 1, 0)
    doc = np.repeat(np.arange(len(texts)), windows)  # of each window inside a text
    first = np.cumsum(windows) - windows
    place = np.arange(len(doc)) - first[doc]
    key = key[place + (ends - lengths)[doc]]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(fresh)
    return doc[at], key[at], place[at], np.diff(np.append(at, len(doc)))


def _blocks(ids: list, texts: list[str], span: int) -> Iterator[tuple[list, list[str], list[int]]]:
    """Texts with their ids in blocks of ``BLOCK`` characters, and where each begins in its record: longer texts are cut into parts that have ``span - 1`` characters in common, so that each window is in one part."""
    held: tuple[list, list[str], list[int]] = ([], [], [])
    size = 0
    for i, t in zip(ids, texts):
        if i is None or t is None or len(t) < span:
            continue
        for begin in range(0, len(t) - span + 1, BLOCK):
            part = t if len(t) <= BLOCK else t[begin : begin + BLOCK + span - 1]
            if size and size + len(part) > BLOCK:
                yield held
                held, size = ([], [], []), 0
            for column, value in zip(held, (i, part, begin)):
                column.append(value)
            size += len(part)
            if part is t:
                break
    if size:
        yield held


def keys_of(docs: DataFrame, span: int = SPAN, m: int = M) -> DataFrame:
    """``(key, doc_id, n)``: the keys of every record of ``docs(doc_id, text)`` and how many super-k-mers have it, each once for a block of text."""

    def run(batches):
        for batch in batches:
            for ids, texts, _ in _blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist(), span):
                doc, key, _, _ = runs_of(texts, span, m)
                if len(doc):
                    doc = np.array(ids, np.int64)[doc]
                    order = np.lexsort((doc, key))
                    doc, key = doc[order], key[order]
                    fresh = np.ones(len(doc), bool)
                    fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                    at = np.flatnonzero(fresh)
                    n = np.diff(np.append(at, len(doc))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(doc[at]), pa.array(n)], names=["key", "doc_id", "n"])

    return shipped(docs).select("doc_id", "text").mapInArrow(run, "key bigint, doc_id bigint, n int")


def _bits(keys: np.ndarray, k: int) -> np.ndarray:
    """The places of keys in the filter by its ``k``-th hash."""
    factor = np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)[k])
    return (keys.view(np.uint64) * factor) >> np.uint64(64 - FILTER_BITS)


def key_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of ``keys(key)`` as words of 64 bits. Beyond some ten million keys it lets more and more others pass, which costs traffic and changes no result."""

    def run(batches):
        words = np.zeros(1 << FILTER_BITS - 6, np.uint64)
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for k in range(3):
                at = _bits(keys, k)
                np.bitwise_or.at(words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        held = np.flatnonzero(words)
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(words[held].view(np.int64))], names=["word", "bits"])

    rows = shipped(keys).select("key").mapInArrow(run, "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most the words of the filter
    words = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return words


def packed(docs: DataFrame, keys: DataFrame, span: int = SPAN, m: int = M) -> DataFrame:
    """``(key, doc_id, begin, s)``: the super-k-mers of keys in a filter of ``keys``, cut from the text as it is scanned."""
    shared = docs.sparkSession.sparkContext.broadcast(key_filter(keys))

    def run(batches):
        words = shared.value
        for batch in batches:
            for ids, texts, offsets in _blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist(), span):
                doc, key, place, n = runs_of(texts, span, m)
                held = np.ones(len(doc), bool)
                for k in range(3):
                    at = _bits(key, k)
                    held &= (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
                doc, key, place, n = doc[held], key[held], place[held], n[held]
                if len(doc):
                    strings = [texts[d][p : p + c + span - 1] for d, p, c in zip(doc.tolist(), place.tolist(), n.tolist())]
                    begin = place + np.array(offsets, np.int64)[doc]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.array(ids, np.int64)[doc]), pa.array(begin), pa.array(strings, pa.string())], names=["key", "doc_id", "begin", "s"])

    return shipped(docs).select("doc_id", "text").mapInArrow(run, "key bigint, doc_id bigint, begin bigint, s string")


def shared_windows(group: dict[str, list[tuple[int, int]]], span: int) -> tuple[list[tuple[int, ...]], list[tuple[int, int, int]]]:
    """Sets of records that share a window, and the shared stretches ``(doc_id, begin, end)``.

    ``group``: the strings of one key, each with the places ``(doc_id, begin)`` it stands at. The
    windows of all strings are sorted, so equal ones lie side by side.
    """
    members = {s: sorted({d for d, _ in at}) for s, at in group.items()}
    sets, stretches = set(), []
    if len({d for ds in members.values() for d in ds}) < 2:
        return [], []
    if len(group) == 1:
        ((s, at),) = group.items()
        return [tuple(members[s])], [(d, b, b + len(s)) for d, b in at]
    strings, windows = list(group), []
    for j, s in enumerate(strings):
        last, begin = None, 0
        for k in range(len(s) - span + 1):
            w = s[k : k + span]
            if w != last:  # in a long run of one character all windows are alike
                if last is not None:
                    windows.append((last, j, begin, k))
                last, begin = w, k
        windows.append((last, j, begin, len(s) - span + 1))
    windows.sort()
    hits: dict[int, list[tuple[int, int]]] = {}
    i = 0
    while i < len(windows):
        j = i + 1
        while j < len(windows) and windows[j][0] == windows[i][0]:
            j += 1
        owners = {o[1] for o in windows[i:j]}
        docs = members[strings[windows[i][1]]] if len(owners) == 1 else sorted({d for o in owners for d in members[strings[o]]})
        if len(docs) > 1:
            sets.add(tuple(docs))
            for _, o, first, upto in windows[i:j]:
                hits.setdefault(o, []).append((first, upto))
        i = j
    for o, ks in hits.items():
        ks.sort()
        first, upto = ks[0]
        parts = []
        for a, b in ks[1:]:
            if a > upto:
                parts.append((first, upto + span - 1))
                first = a
            upto = b
        parts.append((first, upto + span - 1))
        stretches += [(d, b + x, b + y) for d, b in group[strings[o]] for x, y in parts]
    return list(sets), stretches


FOUND = "set_id binary, doc_id bigint, begin bigint, end bigint"


def set_id(docs: tuple[int, ...]) -> bytes:
    """A name for a set of records that is the same wherever the set is found."""
    return hashlib.blake2b(np.array(docs, np.int64).tobytes(), digest_size=16).digest()


def _sorted_buckets(strings: DataFrame, span: int) -> DataFrame:
    """Rows ``(set, doc, null, null)`` of members and ``(null, doc, begin, end)`` of stretches."""
    types = (pa.binary(), pa.int64(), pa.int64(), pa.int64())

    def run(batches):
        key, group, known, out = None, {}, set(), []

        def close():
            sets, stretches = shared_windows(group, span) if group else ((), ())
            for docs in sets:
                name = set_id(docs)
                if name not in known:
                    known.add(name)
                    out.extend((name, d, None, None) for d in docs)
            out.extend((None, *x) for x in stretches)

        def rows():
            held = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["set_id", "doc_id", "begin", "end"])
            out.clear()
            return held

        for batch in batches:
            for k, doc, begin, s in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    close()
                    key, group = k, {}
                group.setdefault(s, []).append((doc, begin))
            if len(known) > 1 << 20:
                known.clear()
            if out:
                yield rows()
        close()
        if out:
            yield rows()

    rows = strings.select("key", "doc_id", "begin", "s")
    return shipped(rows).repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, FOUND)


def _spread_buckets(strings: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """Members and stretches of keys that no task should sort alone, by digests of their windows."""

    def run(batches):
        for batch in batches:
            rows = []
            for d, b, s in zip(*(c.to_pylist() for c in batch.columns)):
                for k in range(len(s) - span + 1):
                    rows.append((hashlib.blake2b(s[k : k + span].encode("utf-8", "surrogatepass"), digest_size=16).digest(), d, b + k))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64()))], names=["digest", "doc_id", "begin"])

    windows = stage(shipped(strings).select("doc_id", "begin", "s").mapInArrow(run, "digest binary, doc_id bigint, begin bigint"), "windows")
    member = windows.select("digest", "doc_id").distinct()
    sets = member.groupBy("digest").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("u"), F.bit_xor(F.xxhash64(F.lit(1), "doc_id")).alias("v")
    ).where("n > 1")
    one = sets.groupBy("n", "u", "v").agg(F.min("digest").alias("digest")).select("digest")
    members = member.join(one, "digest").select(F.col("digest").alias("set_id"), "doc_id")
    stretches = windows.join(sets.select("digest"), "digest", "left_semi").select("doc_id", "begin", (F.col("begin") + span).alias("end"))
    return members, stretches


def shared_groups(docs: DataFrame, span: int = SPAN, m: int | None = None, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """Members ``(set_id, doc_id)`` of sets of records, and shared stretches ``(doc_id, begin, end)`` of ``docs(doc_id, text)``.

    Two records have ``span`` or more consecutive characters (code points) in common, compared
    exactly, if and only if they are members of one set. A set that many windows have comes once,
    so the rows grow with the records, not with their pairs. Stretches may overlap; together they
    cover what a record shares. Null texts, null ids and texts under ``span`` characters share
    nothing; rows with the same id count as one record; other columns are not read; an empty
    table gives empty results.
    """
    m = min(M, max(1, span // 2)) if m is None else m
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    per = keys_of(docs, span, m).groupBy("key").agg(F.sum("n").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    keys = stage(per.where("a < b").select("key", "n"), "keys")
    strings = packed(docs, keys, span, m)
    hot = keys.where(F.col("n") > bucket).select("key")
    spread = not hot.isEmpty()
    if spread:
        strings = stage(strings, "superkmers")
    found = stage(_sorted_buckets(strings.join(hot, "key", "left_anti") if spread else strings, span), "shared")
    members = found.where("set_id is not null").select("set_id", "doc_id")
    stretches = found.where("set_id is null").select("doc_id", "begin", "end")
    if spread:
        more, further = _spread_buckets(strings.join(hot, "key", "left_semi"), span)
        members, stretches = members.union(more), stretches.union(further)
    return members.distinct(), stretches


def shared_spans(docs: DataFrame, span: int = SPAN, m: int | None = None, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """All pairs ``(doc_id_a, doc_id_b)``, smaller id first, and the stretches of ``shared_groups``.

    A set of n records makes n(n - 1)/2 pairs: ask for them only where that many are wanted.
    """
    members, stretches = shared_groups(docs, span, m, bucket)
    held = stage(members, "members")
    pairs = held.alias("x").join(held.alias("y"), "set_id").where("x.doc_id < y.doc_id").select(F.col("x.doc_id").alias("doc_id_a"), F.col("y.doc_id").alias("doc_id_b"))
    return pairs.distinct(), stretches


def representatives(docs: DataFrame, span: int = SPAN, m: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """``(doc_id, with_id, records)``: each record of a set with the least of the set, and how many the set has; rows grow with the records of each set, not with pairs."""
    members, _ = shared_groups(docs, span, m, bucket)
    held = stage(members, "members")
    sets = held.groupBy("set_id").agg(F.min("doc_id").alias("with_id"), F.count("*").alias("records"))
    return held.join(sets, "set_id").groupBy("doc_id", "with_id").agg(F.max("records").alias("records"))


def shared_share(docs: DataFrame, span: int = SPAN, m: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """``(doc_id, n_chars, shared_chars, shared_spans, share)`` of every record of ``docs``.

    ``shared_chars`` counts the characters inside any stretch of ``span`` or more characters
    that stands in another record too. Records without such a stretch, and null or empty texts,
    get 0; rows with the same id count as one record, by their longest text.
    """
    from pyspark.sql import Window as W

    _, spans = shared_groups(docs, span, m, bucket)
    before = W.partitionBy("doc_id").orderBy("begin", "end").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("reached", F.max("end").over(before))
    covered = spans.groupBy("doc_id").agg(
        F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("begin", F.coalesce("reached", F.lit(0))))).alias("shared_chars"),
        F.sum(F.when(F.col("reached").isNull() | (F.col("begin") > F.col("reached")), 1).otherwise(0)).alias("shared_spans"),
    )
    sizes = docs.groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).cast("bigint").alias("n_chars"))
    zero = F.lit(0).cast("bigint")
    return sizes.join(covered, "doc_id", "left").select(
        "doc_id", "n_chars", F.coalesce("shared_chars", zero).alias("shared_chars"), F.coalesce("shared_spans", zero).alias("shared_spans"),
        F.when(F.col("n_chars") > 0, F.coalesce("shared_chars", zero) / F.col("n_chars")).otherwise(F.lit(0.0)).alias("share"),
    )
