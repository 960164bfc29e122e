from datetime import datetime

import pytest
from pyspark.sql import functions as F

from grainmill.operators import changes, state

T = datetime(2025, 1, 1)
FILES = "seq long, repo string, path string, hash string, listed_at timestamp_ntz, extra int"
HASHES = "run_id long, repo string, path string, hash string, saved_at timestamp_ntz"
PROCESSED = "run_id long, repo string, path string"
RUNS = "run_id long, status string"


def tables(spark, files, hashes, processed, runs):
    return spark.createDataFrame(files, FILES), spark.createDataFrame(hashes, HASHES), spark.createDataFrame(processed, PROCESSED), spark.createDataFrame(runs, RUNS)


def test_pending(spark):
    later = datetime(2025, 1, 2)
    files = [
        (1, "r", "a/same.py", "h1", T, 0), (1, "r", "a/same.py", "h1", T, 0),
        (2, "r", "a/new.py", "h2", T, 0),
        (3, "r", "a/changed.py", "h3", T, 0),
        (4, "r", "a/unconfirmed.py", "h4", T, 0),
        (5, "r", "a/failed.py", "h5", T, 0),
        (6, "r", "a/nohash.py", None, T, 0),
        (7, "r", "a/listed.py", "old", T, 0), (7, "r", "a/listed.py", "h7", later, 0),
        (8, "r", "a/upper.py", "ABC", T, 0),
        (9, None, None, "h9", T, 0),
        (None, "r", "x", "h", T, 0),
    ]
    hashes = [
        (1, "r", "./a/same.py", "h1", T), (1, "r", "a\\changed.py", "other", T), (1, "r", "a/unconfirmed.py", "h4", T), (2, "r", "a/failed.py", "h5", T),
        (1, "r", "/srv/x/r/a/listed.py", "h7", T), (1, "r", "D:\\t\\r\\a\\upper.py", "abc", T), (1, "r", "a/upper.py", "zzz", datetime(2024, 1, 1)),
    ]
    processed = [(1, "r", "a/same.py"), (1, "r", "a/changed.py"), (2, "r", "a/failed.py"), (1, "r", "a/listed.py"), (1, "r", "a/upper.py")]
    got = changes.pending(*tables(spark, files, hashes, processed, [(1, "ok"), (2, "failed")]))
    assert sorted(r["seq"] for r in got.collect()) == [2, 3, 4, 5, 9]


def test_last_run_holds(spark):
    files = [(1, "r", "a", "h2", T, 0)]
    hashes = [(1, "r", "a", "h2", T), (2, "r", "a", "h1", T)]
    processed = [(1, "r", "a"), (2, "r", "a"), (2, "r", "a")]
    assert changes.pending(*tables(spark, files, hashes, processed, [(1, "ok"), (2, "ok")])).count() == 1
    assert changes.pending(*tables(spark, files, hashes, processed, [(1, "ok"), (2, "aborted")])).count() == 0
    assert changes.pending(*tables(spark, files, [], [], [])).count() == 1
    assert changes.pending(*tables(spark, [], hashes, processed, [(1, "ok")])).count() == 0


LOG = "repo string, path string, hash string, at timestamp_ntz"


def second(n):
    return datetime(2025, 1, 1, 0, 0, n)


def changes_of(spark, tmp_path, most=100):
    log = changes.ChangeLog(spark, f"{tmp_path}/log", 2)
    return log, changes.ChangeRun(spark, f"{tmp_path}/sink", log, changes.KEY, ["at", "hash"], most)


def written(spark, tmp_path):
    return spark.read.parquet(*[str(p) for p in (tmp_path / "sink").glob("batch-*")])


class Lost(Exception):
    pass


def test_three_batches_and_three_failures(spark, tmp_path):
    """Lost before the result, after it, and between result and commit; a late row and a tied one; each record exactly once."""
    log, run = changes_of(spark, tmp_path)
    first = [("r", f"p{n}", f"h{n}", second(20)) for n in range(8)]
    assert log.append(spark.createDataFrame(first, LOG), "day 1") and not log.append(spark.createDataFrame(first, LOG), "day 1")

    def lose(rows):
        raise Lost

    with pytest.raises(Lost):
        run.run(lose)
    plan = run.plan()
    log.append(spark.createDataFrame([("r", "late", "x", second(5)), ("r", "tied", "y", second(20)), ("r", "p3", "older", second(4)), (None, None, "none", second(20))], LOG), "day 2")
    assert run.plan() == plan and run.rows(plan).count() == 8  # a plan is replayed as it was written, with the very same rows
    assert run.run(lambda rows: rows)

    plan = run.plan()
    run.write(plan, run.rows(plan).limit(1))  # half a result, then lost
    assert run.result().count() == 8
    assert run.run(lambda rows: rows)
    log.append(spark.createDataFrame([("r", "p4", "newer", second(30))], LOG), "day 3")

    plan = run.plan()
    run.write(plan, run.rows(plan))  # the whole result, no commit
    again = changes.ChangeRun(spark, f"{tmp_path}/sink", log, changes.KEY, ["at", "hash"])
    assert again.run(lambda rows: rows) and not again.run(lambda rows: rows)
    got = {r["path"]: r["hash"] for r in again.result().collect()}
    assert got == {**{f"p{n}": f"h{n}" for n in range(8)}, "late": "x", "tied": "y", "p4": "newer", None: "none"}
    rows = written(spark, tmp_path)
    assert rows.count() == 13 and rows.select("partition", "offset").distinct().count() == 13
    again.compact()
    assert {r["path"]: r["hash"] for r in again.result().collect()} == got and not list((tmp_path / "sink").glob("batch-*"))
    assert len(list((tmp_path / "sink").glob("plan-*"))) == 1
    log.append(spark.createDataFrame([("r", "p4", "newest", second(31))], LOG), "day 4")
    assert again.run(lambda rows: rows)
    assert {r["path"]: r["hash"] for r in again.result().collect()} == got | {"p4": "newest"}


def test_batches_are_bounded_and_a_lost_delivery_is_whole(spark, tmp_path):
    log, run = changes_of(spark, tmp_path, most=3)
    rows = spark.createDataFrame([("r", f"p{n}", "h", second(1)) for n in range(20)] + [("r", "p0", "h", second(1))], LOG)
    rows.withColumn("partition", F.lit(0)).withColumn("offset", F.lit(0)).write.parquet(f"{tmp_path}/log/rows-0")  # written, lost before its manifest
    assert run.plan() is None and run.result() is None
    assert log.append(rows, "one")
    batches = 0
    while run.run(lambda rows: rows):
        batches += 1
    assert batches >= 4 and written(spark, tmp_path).count() == 21 and run.result().count() == 20
    assert max(r["n"] for r in spark.read.parquet(f"{tmp_path}/sink/batch-0").groupBy("partition").agg(F.count("*").alias("n")).collect()) <= 3


def test_capture_agrees_with_joins_at_every_delivery(spark, tmp_path):
    files = [(n, "r", f"a{n}", f"h{n}", second(10), 0) for n in range(12)]
    hashes = [(1, "r", f"./a{n}", f"H{n}", T) for n in range(8)] + [(2, "r", "a1", "other", T)]
    processed = [(1, "r", f"a{n}") for n in range(6)] + [(2, "r", "a1")]
    runs = spark.createDataFrame([(1, "ok"), (2, "ok"), (3, "failed")], RUNS)
    more_files = [(3, "r", "a3", "new", second(11), 0), (4, "r", "a4", "outdated", second(9), 0), (30, "r", "gone", None, second(10), 0), (12, None, None, "h", second(10), 0)]
    more_hashes, more_processed = [(1, "r", "a9", "h9", T), (3, "r", "a10", "h10", T)], [(1, "r", "a9"), (1, "r", "a7"), (3, "r", "a10")]
    held = changes.ChangedFiles(spark, str(tmp_path), 3)
    parts = [(files, hashes, processed), ([], more_hashes, more_processed), (more_files, [], [])]
    sofar = ([], [], [])
    for n, part in enumerate(parts):
        sofar = tuple(a + b for a, b in zip(sofar, part))
        held.deliver(*tables(spark, *part, [])[:3], f"d{n}")
        want = changes.pending(*tables(spark, *sofar, [])[:3], runs)
        assert sorted(map(tuple, held.pending(runs).collect())) == sorted(map(tuple, want.collect()))
    later = spark.createDataFrame([(1, "ok"), (3, "ok")], RUNS)
    assert {r["seq"] for r in held.pending(later).collect()} == {r["seq"] for r in changes.pending(*tables(spark, *sofar, [])[:3], later).collect()}
    held.run.compact()
    assert held.pending(runs).count() == want.count()
    assert not held.deliver(*tables(spark, *parts[0], [])[:3], "d0")


def test_no_rows_at_all(spark, tmp_path):
    held = changes.ChangedFiles(spark, str(tmp_path))
    held.deliver(*tables(spark, [], [], [], [])[:3], "nothing")
    assert held.log.manifest()["ends"] == {}


def test_state(spark, tmp_path):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("gone", "3")], "path string, hash string")
    files = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "4"), ("d", None)], "path string, hash string")
    assert sorted(r["path"] for r in state.changed(files, old).collect()) == ["b", "c", "d"]
    assert [r["path"] for r in state.unchanged(files, old).collect()] == ["a"]
    new = state.upsert(old, files.where("hash is not null"))
    assert {r["path"]: r["hash"] for r in new.collect()} == {"a": "1", "b": "9", "c": "4", "gone": "3"}
    state.save(new, str(tmp_path / "h.json"))
    assert {tuple(r) for r in state.load(spark, str(tmp_path / "h.json")).collect()} == {tuple(r) for r in new.collect()}
    (tmp_path / "h.json").write_text("{")
    assert state.load(spark, str(tmp_path / "h.json")).count() == 0
