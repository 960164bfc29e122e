"""Mixing sources to target weights (problem 9).

Records are counted by source and exact number of tokens. The total is the largest that every
source with records can serve at its share with its repetitions, or one that is given. Each source's budget is met by
using all its records as often as it holds, then a part of them once more: in proportion from
every length, and the last stretch by a bounded-knapsack dynamic program over the lengths still
left, which hits the budget to the token where it can be hit. Which records of a length are taken
is decided by a seeded hash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .ranks import spread_rank
from .tokenize import count

#: Greatest remaining budget, in tokens, for the dynamic program.
REACH = 1 << 16


def fit(left: dict[int, int], budget: int) -> dict[int, int]:
    """How many of each length to take so that their sum is the greatest within ``budget``."""
    lengths = [n for n in sorted(left, reverse=True) if 0 < n <= budget and left[n] > 0]
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    steps: list[tuple[int, int, np.ndarray]] = []
    for n in lengths:
        have, part = min(left[n], budget // n), 1
        while have > 0:
            k = min(part, have)
            fresh = np.zeros(budget + 1, bool)
            fresh[k * n :] = reached[: budget + 1 - k * n]
            fresh &= ~reached
            if fresh.any():
                reached |= fresh
                steps.append((n, k, np.flatnonzero(fresh)))
            have -= k
            part *= 2
        if reached[budget]:
            break
    at = int(np.flatnonzero(reached)[-1])
    out: dict[int, int] = {}
    for n, k, fresh in reversed(steps):
        i = np.searchsorted(fresh, at)
        if i < len(fresh) and fresh[i] == at:
            out[n] = out.get(n, 0) + k
            at -= n * k
    return out


def choose(histogram: dict[int, int], budget: int, repeats: int) -> tuple[int, dict[int, int]]:
    """``(base, extra)``: uses of every record, and how many of each length are used once more."""
    total = sum(n * c for n, c in histogram.items())
    if total <= 0 or budget <= 0 or repeats <= 0:
        return 0, {}
    base = min(repeats, budget // total)
    rest = 0 if base == repeats else budget - base * total
    extra = {n: int(c * rest // total) for n, c in histogram.items()}
    rest -= sum(n * c for n, c in extra.items())
    left = {n: c - extra[n] for n, c in histogram.items()}
    for n in sorted(left, reverse=True):  # what rounding left over, from the longest on, until the program can take it
        if rest <= REACH:
            break
        k = min(left[n], (rest - REACH // 2) // n)
        if k > 0:
            extra[n] += k
            left[n] -= k
            rest -= n * k
    if rest > 0:
        for n, k in fit(left, min(rest, REACH)).items():
            extra[n] += k
    return int(base), {n: k for n, k in extra.items() if k > 0}


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7, path: str | None = None, total: int | None = None) -> DataFrame:
    """``(doc_id, source, n_tokens, uses)`` of every record in the mixture.

    ``documents``: doc_id, text, source; ``targets``: source, target_share, max_repeats. Records
    of sources without a target, and texts without tokens (null, empty), are not used; targets
    without records get nothing and the shares of the others grow in proportion. ``total``: the
    tokens wanted; a source that can't serve its share of them gives all it may, and ``shares``
    says what share that is. Without it, the total is what the scarcest source can serve. Of rows with
    the same doc_id one counts; a source listed twice counts with its greatest share; a null
    ``max_repeats`` counts as 1. Empty tables give an empty mixture.
    """
    spark = documents.sparkSession
    wanted = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("repeats"))
    counted = stage(count(documents.select("doc_id", "source", "text").where("source is not null and doc_id is not null"), path=path), "lengths")
    held = counted.where("n_tokens > 0").groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("r")).select("doc_id", "r.source", "r.n_tokens")
    held = held.join(wanted.select("source"), "source", "left_semi")
    histogram: dict[str, dict[int, int]] = {}
    # one row for each source in targets and length in tokens; the lengths are at most the root of twice the tokens
    for r in held.groupBy("source", "n_tokens").agg(F.count("*").alias("n")).collect():
        histogram.setdefault(r["source"], {})[r["n_tokens"]] = r["n"]
    goals = {r["source"]: (r["share"], r["repeats"]) for r in wanted.collect() if r["source"] in histogram and r["repeats"] > 0}
    whole = sum(s for s, _ in goals.values())
    most = min((sum(n * c for n, c in histogram[s].items()) * reps / (share / whole) for s, (share, reps) in goals.items()), default=0) if total is None else total
    takes = []
    for s, (share, reps) in sorted(goals.items()):
        base, extra = choose(histogram[s], round(most * share / whole), int(reps))
        takes += [(s, n, base, extra.get(n, 0)) for n in histogram[s] if base or n in extra]
    plan = spark.createDataFrame(takes, "source string, n_tokens bigint, base int, extra bigint")
    ordered = F.xxhash64(F.lit(seed), "doc_id")
    rows = spread_rank(held.join(plan, ["source", "n_tokens"]), ["source", "n_tokens"], [ordered, F.col("doc_id")], F.xxhash64(F.lit(seed + 1), "doc_id"))
    uses = (F.col("base") + (F.col("rank") < F.col("extra")).cast("int")).cast("int")
    return rows.select("doc_id", "source", "n_tokens", uses.alias("uses")).where("uses > 0")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, records, uses, tokens, share)`` for every source in ``targets``."""
    per = mixture.groupBy("source").agg(F.count("*").alias("records"), F.sum("uses").alias("uses"), F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"))
    total = per.agg(F.sum("tokens").alias("total"))
    rows = targets.groupBy("source").agg(F.max("target_share").alias("target_share")).join(per, "source", "left").crossJoin(F.broadcast(total))  # one row
    zero = F.lit(0).cast("bigint")
    return rows.select(
        "source", "target_share", F.coalesce("records", zero).alias("records"), F.coalesce("uses", zero).alias("uses"), F.coalesce("tokens", zero).alias("tokens"),
        F.when(F.col("total") > 0, F.coalesce("tokens", zero) / F.col("total")).otherwise(F.lit(0.0)).alias("share"),
    )
