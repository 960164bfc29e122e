import random
from collections import Counter

import pytest

from grainmill.llm import binpack as B
from grainmill.llm import mixing as M


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_everything(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 97, 1000])
    histogram = Counter(rnd.randint(1, capacity) for _ in range(rnd.choice([1, 50, 3000])))
    made, bound = B.plan(dict(histogram), capacity)
    held = Counter()
    for config, times in made:
        assert times > 0 and sum(s * n for s, n in config.items()) <= capacity
        for s, n in config.items():
            held[s] += n * times
    assert held == histogram
    assert B.lower_bound(dict(histogram), capacity) <= bound <= sum(t for _, t in made) <= bound * 1.05 + 2


@pytest.mark.parametrize("histogram, capacity, least", [
    ({45: 1000, 35: 1000, 20: 1000}, 100, 1000), ({44: 300, 30: 300, 26: 300}, 100, 300), ({260: 500, 350: 500, 390: 500}, 1000, 500),
    ({45: 1000, 35: 1000, 17: 1000, 3: 1000}, 100, 1000), ({450001: 70, 350007: 70, 199992: 70}, 1000000, 70), ({67: 223000}, 500000, 30),
])
def test_program_reaches_the_bound_where_best_fit_does_not(histogram, capacity, least):
    made, bound = B.plan(dict(histogram), capacity)
    assert least <= sum(t for _, t in made) <= least * 1.01 and bound <= least + 1e-6
    assert len(histogram) == 1 or sum(t for _, t in B.best_fit(dict(histogram), capacity)) > least * 1.01
    assert B.plan({}, 10) == ([], 0)


@pytest.mark.parametrize("seed", range(4))
def test_many_sizes_in_groups(seed):
    rnd = random.Random(seed)
    histogram = {s: rnd.randint(1, 30) for s in range(201, 400)}
    made, bound = B.plan(dict(histogram), 1000, rounds=30)
    held = Counter()
    for config, times in made:
        assert sum(s * n for s, n in config.items()) <= 1000
        for s, n in config.items():
            held[s] += n * times
    n = sum(t for _, t in made)
    assert held == histogram and bound <= n <= bound * 1.04 and n <= sum(t for _, t in B.best_fit(dict(histogram), 1000))


@pytest.mark.parametrize("seed", range(20))
def test_bound_is_proven(seed):
    """Against the least number of containers by trying all ways."""
    rnd = random.Random(seed)
    items = sorted((rnd.randint(1, 10) for _ in range(7)), reverse=True)

    def least(k, rooms):
        if k == len(items):
            return len(rooms)
        ways = [least(k + 1, (*rooms, 10 - items[k]))]
        ways += [least(k + 1, (*rooms[:i], r - items[k], *rooms[i + 1 :])) for i, r in enumerate(rooms) if r >= items[k]]
        return min(ways)

    made, bound = B.plan(dict(Counter(items)), 10)
    assert bound - 1e-6 <= least(0, ()) <= sum(t for _, t in made) <= least(0, ()) + 1


def check_packing(rows, items, capacity):
    per = Counter()
    for r in rows:
        per[r["container"]] += r["size"]
    assert all(w <= capacity for w in per.values())
    sizes = Counter()
    for r in rows:
        sizes[r["id"]] += r["size"]
    assert {k: v for k, v in sizes.items()} == items
    whole = Counter(r["id"] for r in rows)
    assert all(whole[k] == max(1, -(-v // capacity)) for k, v in items.items())
    return len(per)


@pytest.mark.parametrize("capacity", [1, 20, 50_000])
def test_pack(spark, capacity):
    rnd = random.Random(capacity)
    items = {k: rnd.choice([0, 1, 7, 7, 7, 13, 20, 61]) for k in range(300)}
    df = spark.createDataFrame([(k, v, 5) for k, v in items.items()], "id long, size int, container int")
    n = check_packing(B.pack(df, capacity, ["id"]).collect(), items, capacity)
    assert n <= max(1, -(-sum(items.values()) // capacity)) * 1.15 + 2


def test_several_configurations_in_one_pass(spark):
    rnd = random.Random(3)
    items = {k: rnd.choice([0, 1, 7, 13, 20, 61]) for k in range(200)}
    df = spark.createDataFrame(list(items.items()), "id long, size int")
    configs = spark.createDataFrame([(1, 20), (2, 61), (2, 61), (7, None), (9, 1000)], "config_id int, capacity int")
    rows = B.pack_all(df, configs, ["id"]).collect()
    assert {r["config_id"] for r in rows} == {1, 2, 9}
    for c, capacity in ((1, 20), (2, 61), (9, 1000)):
        check_packing([r for r in rows if r["config_id"] == c], items, capacity)


def test_pack_edges(spark):
    df = spark.createDataFrame([(1, None), (2, -3), (3, 4)], "id long, size int")
    assert sorted((r["id"], r["size"], r["container"]) for r in B.pack(df, 4, ["id"]).collect()) == [(1, 0, 0), (2, 0, 0), (3, 4, 0)]
    assert B.pack(df.limit(0), 4, ["id"]).count() == 0
    with pytest.raises(ValueError):
        B.pack(df, 0, ["id"])


@pytest.mark.parametrize("seed", range(30))
def test_fit_against_all_subsets(seed):
    rnd = random.Random(seed)
    left = {rnd.randint(1, 12): rnd.randint(1, 3) for _ in range(4)}
    budget = rnd.randint(1, 40)
    got = M.fit(dict(left), budget)
    sums = {0}
    for n, c in left.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    assert sum(n * k for n, k in got.items()) == max(s for s in sums if s <= budget)
    assert all(k <= left[n] for n, k in got.items())


def test_choose():
    assert M.choose({5: 4}, 100, 3) == (3, {}) and M.choose({5: 4}, 30, 3) == (1, {5: 2}) and M.choose({}, 5, 1) == (0, {}) and M.choose({5: 1}, 0, 1) == (0, {})
    base, extra = M.choose({n: 50 for n in range(1, 400)}, 3_000_001, 2)
    assert base * sum(50 * n for n in range(1, 400)) + sum(n * k for n, k in extra.items()) == 3_000_001


DOCS = "doc_id long, text string, source string, uses int"
TARGETS = "source string, target_share double, max_repeats int"


def test_mix(spark):
    rnd = random.Random(4)
    docs = [(n, "word " * rnd.randint(1, 40), rnd.choice(["a", "a", "a", "b"]), 0) for n in range(400)] + [(1000, None, "a", 0), (1001, "", "b", 0), (1002, "x y", None, 0), (1003, "x", "other", 0), (1004, "rare words " * 9, "c", 0), (1004, "rare words " * 9, "c", 0)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 4), ("none", 0.1, 1), ("c", 0.1, 4), (None, 0.2, 1)], TARGETS)
    mixture = M.mix(spark.createDataFrame(docs, DOCS), targets)
    rows = mixture.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and {r["source"] for r in rows} <= {"a", "b", "c"}
    most = {"a": 1, "b": 2, "c": 4}
    assert all(1 <= r["uses"] <= most[r["source"]] for r in rows) and not {1000, 1001} & {r["doc_id"] for r in rows}
    got = {r["source"]: r for r in M.shares(mixture, targets).collect()}
    assert got["none"]["tokens"] == 0 and got["c"]["uses"] == 4
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert abs(got[s]["share"] - share / 0.9) < 0.01
    again = {tuple(r) for r in M.mix(spark.createDataFrame(docs[::-1], DOCS), targets).collect()}
    assert again == {tuple(r) for r in rows}


def test_mix_edges(spark):
    docs, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, None)], TARGETS)
    assert M.mix(docs, targets).count() == 0
    one = spark.createDataFrame([(1, "a b c", "a", 0)], DOCS)
    assert [r["uses"] for r in M.mix(one, targets).collect()] == [1]
    assert M.mix(one, targets.limit(0)).count() == 0


def test_given_total_with_sources_that_cannot_serve_it(spark):
    docs = spark.createDataFrame([(n, "word " * 9 + "end", "big" if n < 90 else "tiny") for n in range(93)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("tiny", 0.5, 2), ("none", 0.2, 1)], "source string, target_share double, max_repeats int")
    small = {r["source"]: r["tokens"] for r in M.shares(M.mix(docs, targets), targets).collect()}
    assert small["big"] == small["tiny"] == 6 * (small["tiny"] // 6)
    got = {r["source"]: (r["tokens"], r["share"]) for r in M.shares(M.mix(docs, targets, total=small["tiny"] * 10), targets).collect()}
    each = small["tiny"] // 6
    assert got["tiny"][0] == 6 * each and got["big"][0] == small["tiny"] * 5 and got["none"] == (0, 0.0)
    assert abs(got["tiny"][1] - 6 / 36) < 1e-9
    assert M.mix(docs, targets, total=0).count() == 0
