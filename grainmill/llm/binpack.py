"""Filling containers of fixed capacity with items (problem 4).

Items are integers of size; what matters for the number of containers is only how many there are
of each size, a histogram of at most ``capacity`` entries whatever the number of items. Sizes are
exact at any capacity.

The plan is the configuration linear program: a configuration is a multiset of sizes that fits a
container, and as few containers as possible have to cover the histogram. Sizes of a sixteenth of
the capacity and less are a volume that any room takes. The program is a game between prices of
sizes and configurations, which both move by multiplicative weights; a knapsack dynamic program
finds the configuration that is worth most under the present prices, which joins the game and
proves a lower bound. It ends at a stated gap between the averaged solution and the bound. Where
there are more sizes than ``GROUPS``, those of a group count as its largest in the program, and
are given out exactly. The solution is rounded down, what is left fills real rooms by best fit,
and the better of this and best fit alone is taken. Containers are then handed out to the items
by their rank within their size, which is a join, not a loop.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shipped, stage
from .ranks import spread_rank

#: Part of the capacity up to which sizes are only a volume in the program; sizes it tells apart.
SMALL, GROUPS = 1 / 16, 48
#: The gap to the lower bound at which the program ends, and the rounds of pricing at most.
GAP, ROUNDS = 0.002, 120
#: Steps of the weights between two pricings.
STEPS = 400

Config = dict[int, int]
Plan = list[tuple[Config, int]]


def best_configuration(sizes: np.ndarray, prices: np.ndarray, most: np.ndarray, capacity: int, room_price: float = 0.0) -> tuple[dict[int, int], float]:
    """The multiset of sizes within ``capacity`` of the greatest price, by dynamic programming, and the price.

    ``most`` bounds how often a size may be taken; multiples are split into powers of two. What
    is left of the capacity counts ``room_price`` a unit.
    """
    value = np.zeros(capacity + 1)
    picks: list[tuple[int, int, np.ndarray]] = []
    gain = prices - room_price * sizes
    for k in np.flatnonzero(gain > 0):
        size, left = int(sizes[k]), int(min(most[k], capacity // sizes[k]))
        part = 1
        while left > 0:
            n = min(part, left)
            w = n * size
            better = np.zeros(capacity + 1, bool)
            trial = value[: capacity + 1 - w] + n * gain[k]
            better[w:] = trial > value[w:] + 1e-12
            value[w:] = np.where(better[w:], trial, value[w:])
            picks.append((k, n, better))
            left -= n
            part *= 2
    at, out = int(np.argmax(value)), Counter()
    best = float(value[at]) + room_price * capacity
    for k, n, better in reversed(picks):
        if better[at]:
            out[int(k)] += n
            at -= n * int(sizes[k])
    return dict(out), best


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Containers that any packing needs: by volume, and by items over half the capacity."""
    volume = sum(s * n for s, n in histogram.items())
    return max(-(-volume // capacity), sum(n for s, n in histogram.items() if 2 * s > capacity))


def grouped(histogram: dict[int, int], groups: int = GROUPS) -> list[list[int]]:
    """The sizes in at most ``groups`` groups of about as many items, each in falling order."""
    sizes = sorted(histogram, reverse=True)
    if len(sizes) <= groups:
        return [[s] for s in sizes]
    total, out, held, passed = sum(histogram.values()), [[]], 0, 0
    for s in sizes:
        if held and (passed + histogram[s] / 2) * groups > total * len(out) and len(out) < groups:
            out.append([])
            held = 0
        out[-1].append(s)
        held += histogram[s]
        passed += histogram[s]
    return out


def solve(sizes: np.ndarray, demand: np.ndarray, volume: int, capacity: int, start: list[dict[int, int]], gap: float = GAP, rounds: int = ROUNDS) -> tuple[list[tuple[dict[int, int], float]], float, np.ndarray, float]:
    """The configuration program by multiplicative weights: ``(solution, bound, prices, room_price)``.

    ``solution``: configurations, sizes by their number, with how many containers of each; it
    covers ``demand`` and leaves ``volume`` of room. ``bound`` is proven by the prices.
    """
    m = len(sizes)
    columns = [c for c in start if c] or [{0: int(capacity // sizes[0])}]
    known = {tuple(sorted(c.items())) for c in columns}
    for k in range(m):
        alone = {k: int(min(demand[k], capacity // sizes[k]))}
        if not any(k in c for c in columns):
            columns.append(alone)
    if volume and not any(sum(int(sizes[k]) * n for k, n in c.items()) < capacity for c in columns):
        columns.append({})
    rows = m + (volume > 0)

    def rates(c: dict[int, int]) -> np.ndarray:
        out = np.zeros(rows)
        for k, n in c.items():
            out[k] = n / demand[k]
        if volume:
            out[m] = (capacity - sum(int(sizes[k]) * n for k, n in c.items())) / volume
        return out

    a = np.array([rates(c) for c in columns]).T
    total = float((sizes * demand).sum() + volume)
    w = np.append(sizes * demand, [volume] if volume else []) / total  # prices begin as the bound by volume
    best, best_solution, bound, best_prices = np.inf, np.full(len(columns), 1.0), 0.0, (sizes / capacity, 1 / capacity if volume else 0.0)
    p = np.full(len(columns), 1 / len(columns))
    most = np.ceil(demand).astype(int)
    for _ in range(rounds):
        # the configuration that is worth most joins; its worth bounds the game
        prices, room = w[:m] / demand, (w[m] / volume if volume else 0.0)
        config, worth = best_configuration(sizes, prices, most, capacity, room)
        if worth > 0 and 1 / worth > bound:
            bound, best_prices = 1 / worth, (prices / worth, room / worth)
        name = tuple(sorted(config.items()))
        if config and name not in known:
            known.add(name)
            columns.append(config)
            a = np.column_stack([a, rates(config)])
            p, best_solution = np.append(p * 0.9, 0.1), np.append(best_solution, 0.0)
        if best <= bound * (1 + gap):
            break
        # both sides move by optimistic multiplicative weights; the averages come close to the value
        scale = 0.25 / max(float(a.max()), 1e-300) * max(1.0, float(a.max()) / max(1e-300, 8 * (1 / max(bound, 1.0))))
        gain, loss = a.T @ w, a @ p
        sum_p, sum_w = np.zeros(len(p)), np.zeros(rows)
        lp, lw = np.log(np.maximum(p, 1e-12)), np.log(np.maximum(w, 1e-12))
        last_gain, last_loss = gain, loss
        for _ in range(STEPS):
            lp += scale * (2 * gain - last_gain)
            lw -= scale * (2 * loss - last_loss)
            lp -= lp.max()
            lw -= lw.max()
            p, w = np.exp(lp), np.exp(lw)
            p /= p.sum()
            w /= w.sum()
            last_gain, last_loss = gain, loss
            gain, loss = a.T @ w, a @ p
            sum_p += p
            sum_w += w
        for q in (sum_p / STEPS, p):
            value = float((a @ q).min())
            if value > 0 and 1 / value < best:
                best, best_solution = 1 / value, q / value
        average = sum_w / STEPS
        if float((a.T @ average).max()) < float((a.T @ w).max()):
            w = average
    return [(columns[k], float(x)) for k, x in enumerate(best_solution) if x > 1e-9 and k < len(columns)], bound, best_prices[0], best_prices[1]


def best_fit(histogram: dict[int, int], capacity: int) -> Plan:
    """Best fit decreasing over a histogram: every container takes the largest sizes that still fit, all alike at once."""
    return fill([], histogram, capacity)


def fill(held: Plan, histogram: dict[int, int], capacity: int) -> Plan:
    """``held`` with the items of ``histogram`` in the rooms of its containers, the largest that fit first, then in new ones."""
    left = {s: n for s, n in histogram.items() if n > 0}
    sizes = sorted(left)
    out: Plan = []
    queue = [(dict(c), n, capacity - sum(s * k for s, k in c.items())) for c, n in held]
    queue.sort(key=lambda x: x[2])
    at = 0
    while at < len(queue) or sizes:
        if at < len(queue):
            config, times, room = queue[at]
            at += 1
        else:
            config, times, room = {}, None, capacity
        need: Counter = Counter()
        k = len(sizes) - 1
        while k >= 0 and room >= sizes[0]:
            k = min(k, bisect_right(sizes, room) - 1)
            if k < 0:
                break
            s = sizes[k]
            n = min(room // s, left[s])
            if n > 0:
                need[s] += n
                room -= n * s
            k -= 1
        alike = min((left[s] // n for s, n in need.items()), default=times)
        if times is not None and alike < times:  # the others of this kind are looked at again
            queue.insert(at, (config, times - alike, capacity - sum(s * n for s, n in config.items())))
            times = alike
        elif times is None:
            times = alike
        out.append((dict(Counter(config) + need), times))
        for s, n in need.items():
            left[s] -= n * times
            if not left[s]:
                sizes.pop(bisect_left(sizes, s))
    return out


def given_out(config: dict[int, int], times: int, groups: list[list[int]], left: dict[int, int]) -> Plan:
    """``times`` containers of a configuration of groups with exact sizes, the largest first; ``left`` loses them."""
    out: Plan = []
    while times > 0:
        exact: Counter = Counter()
        for g, n in config.items():
            for s in groups[g]:
                k = min(n, left[s] - exact[s])
                if k > 0:
                    exact[s] += k
                    n -= k
                if not n:
                    break
        if not exact:
            break
        alike = max(1, min(times, *(left[s] // k for s, k in exact.items())))
        out.append((dict(exact), alike))
        for s, k in exact.items():
            left[s] -= k * alike
        times -= alike
    return out


def plan(histogram: dict[int, int], capacity: int, gap: float = GAP, rounds: int = ROUNDS) -> tuple[Plan, float]:
    """Configurations ``({size: how many}, containers)`` that hold the whole histogram, and a proven lower bound of their number.

    Sizes are positive and at most ``capacity``.
    """
    if not histogram:
        return [], 0
    count = lambda p: sum(n for _, n in p)
    found, bound = best_fit(histogram, capacity), float(lower_bound(histogram, capacity))
    large = {s: n for s, n in histogram.items() if s > SMALL * capacity}
    if not large:
        return found, bound
    volume = sum(s * n for s, n in histogram.items() if s not in large)
    groups = grouped(large)
    sizes = np.array([g[0] for g in groups])
    demand = np.array([sum(large[s] for s in g) for g in groups], float)
    of = {s: k for k, g in enumerate(groups) for s in g}
    start: dict[tuple, dict[int, int]] = {}
    for c, _ in best_fit({int(s): int(n) for s, n in zip(sizes, demand)}, capacity):
        mapped = {of[s]: n for s, n in c.items()}
        start[tuple(sorted(mapped.items()))] = mapped
    for turn in range(2):
        if count(found) <= np.ceil(bound - 1e-6) * (1 + gap):
            break
        solution, proven, prices, room = solve(sizes, demand, volume, capacity, list(start.values()), gap, rounds * (turn + 1))
        if len(groups) < len(large):  # every size at its group's price, and one program more over all sizes, proves the bound
            exact = np.array(sorted(large, reverse=True))
            price = prices[[of[int(s)] for s in exact]]
            amount = np.array([large[int(s)] for s in exact], float)
            _, worth = best_configuration(exact, price, amount.astype(int), capacity, room)
            proven = float((price * amount).sum() + room * volume) / worth if worth > 0 else 0.0
        bound = max(bound, proven)
        left, made = dict(large), []
        for config, x in sorted(solution, key=lambda c: -c[1]):
            times = min(int(x + 1e-6), *(sum(left[s] for s in groups[g]) // n for g, n in config.items())) if config else 0
            if times > 0:
                made += given_out(config, times, groups, left)
        rounded = fill(made, {**left, **{s: n for s, n in histogram.items() if s not in large}}, capacity)
        if count(rounded) < count(found):
            found = rounded
    return found, bound


def cut(items: DataFrame, configs: DataFrame) -> DataFrame:
    """A row for each configuration and piece of an item: one over the capacity is cut into full pieces and a rest."""
    cap = F.col("capacity")
    rows = items.crossJoin(F.broadcast(configs))  # a few rows
    n = F.greatest(F.lit(1), F.ceil(F.col("size") / cap).cast("int"))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(1), n)))
    rows = rows.withColumn("size", F.least(F.col("size") - (F.col("piece") - 1) * cap, cap).cast("bigint")).withColumn("piece", F.col("piece") - 1)
    return rows.withColumn("slot", F.when(F.col("size") >= cap, -1).otherwise(F.col("size")).cast("bigint"))


RANGES = "config_id bigint, slot bigint, begin bigint, each bigint, first bigint, containers bigint, bound double"


def planned(pieces: DataFrame, gap: float = GAP, rounds: int = ROUNDS) -> DataFrame:
    """The plan of each configuration as ranges of ranks, ``(config_id, slot, begin, each, first)``, planned side by side, each in one task over its histogram.

    The ranks of a slot from ``begin`` on go to containers from ``first`` on, ``each`` into one.
    ``containers`` and ``bound`` are those of the configuration. Slot -1 are full containers.
    """
    histogram = pieces.groupBy("config_id", "capacity", "slot").agg(F.count("*").alias("n"))

    def run(t: pa.Table) -> pa.Table:
        config, capacity = t["config_id"][0].as_py(), t["capacity"][0].as_py()
        held = dict(zip(t["slot"].to_pylist(), t["n"].to_pylist()))
        first = full = held.pop(-1, 0)
        made, bound = plan({s: n for s, n in held.items() if s > 0}, capacity, gap, rounds)
        out, taken, total = [(-1, 0, 1, 0), (0, 0, 1 << 62, 0)], Counter(), first + sum(n for _, n in made)
        for c, times in made:
            for slot, n in c.items():
                out.append((slot, taken[slot], n, first))
                taken[slot] += n * times
            first += times
        rows = [(config, *r, total, bound + full) for r in out]
        return pa.table({f.split()[0]: list(c) for f, c in zip(RANGES.split(", "), zip(*rows))}).cast(pa.schema([(f.split()[0], pa.float64() if "double" in f else pa.int64()) for f in RANGES.split(", ")]))

    return shipped(histogram).groupBy("config_id").applyInArrow(run, RANGES)


def pack_all(items: DataFrame, configs: DataFrame, key: list[str], size_col: str = "size", gap: float = GAP, rounds: int = ROUNDS) -> DataFrame:
    """``(config_id, *key, piece, size, container)``: every item in a container of at most ``capacity``, for each row of ``configs(config_id, capacity)``.

    ``items`` has ``key``, which is unique, and ``size_col``. An item is whole unless it is
    larger than the capacity: then it fills containers of its own, and its rest is an item like
    others. Null and negative sizes count as 0; items of size 0 go to container 0. Containers are
    numbered from 0 on; an empty table gives an empty result; configurations with the same number
    count once, by the greatest capacity. Which of equal items goes where is decided by the key.
    """
    size = F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("bigint")
    configs = configs.where("capacity >= 1").groupBy(F.col("config_id").cast("bigint").alias("config_id")).agg(F.max("capacity").cast("bigint").alias("capacity"))
    pieces = stage(cut(items.select(*key, size.alias("size")), configs), "pieces")
    # bounded by the capacities and the rounds, not by the items
    table: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
    for r in planned(pieces, gap, rounds).collect():
        table.setdefault((r["config_id"], r["slot"]), []).append((r["begin"], r["each"], r["first"]))
    table = {k: tuple(np.array(sorted(v), np.int64).T) for k, v in table.items()}
    rows = spread_rank(pieces, ["config_id", "slot"], [F.col(k) for k in (*key, "piece")], F.xxhash64(*key, "piece"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select("config_id", *key, "piece", "size").schema)
    shared = items.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            configs, slots, ranks = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, batch.num_columns - 2, batch.num_columns - 1))
            out = np.zeros(len(slots), np.int64)
            order = np.lexsort((slots, configs))
            edges = np.flatnonzero(np.diff(configs[order], prepend=configs[order[0]] - 1) | np.diff(slots[order], prepend=slots[order[0]]))
            for a, b in zip(edges, np.append(edges[1:], len(order))):
                here = order[a:b]
                begins, each, firsts = shared.value[int(configs[here[0]]), int(slots[here[0]])]
                at = np.searchsorted(begins, ranks[here], side="right") - 1
                out[here] = firsts[at] + (ranks[here] - begins[at]) // each[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out)], names=[*batch.schema.names[:-2], "container"])

    return shipped(rows).select("config_id", *key, "piece", "size", "slot", "rank").mapInArrow(run, f"{types}, container bigint")


def pack(items: DataFrame, capacity: int, key: list[str], size_col: str = "size", gap: float = GAP, rounds: int = ROUNDS) -> DataFrame:
    """``(*key, piece, size, container)``: ``pack_all`` for one capacity."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    one = items.sparkSession.range(1).select(F.lit(0).alias("config_id"), F.lit(capacity).alias("capacity"))
    return pack_all(items, one, key, size_col, gap, rounds).drop("config_id")
