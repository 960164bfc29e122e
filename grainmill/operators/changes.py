"""Processing only new or changed records (problem 2).

Changes are captured in a log. Its partitions are buckets of the record's key; a row's offset is
given when the row is taken in and never depends on the times it bears, so what comes late or at
the same time is still to be read. A batch is a range of offsets of each partition: the plan is
written ahead and replayed with the very same rows after a failure, the result goes to a folder
of its own, the commit comes last. The sink keeps rows by key and version and counts one written
twice once.

``ChangedFiles`` runs the listing of files, the saved state and the log of runs through it: an
event is a listed file, a saved hash or a confirmation, and what the present listing has beside
the last confirmed state is pending. ``pending`` says the same by joins of whole tables.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Partitions of the change log, rows of each in a batch, and batches from which on they are folded into one table.
PARTITIONS, MOST, BATCHES = 64, 1 << 20, 16

KEY = ["repo", "path"]


def relative_path(path, repo):
    """A path below its repository, with ``/`` between names.

    Absolute paths (``/...`` or with a drive letter) are cut after the folder named like the
    repository, if there is one; a leading ``./`` and doubled separators go.
    """
    p = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"/{2,}", "/")
    mark = F.concat(F.lit("/"), repo, F.lit("/"))
    at = F.instr(p, mark)
    absolute = p.rlike(r"^(?:[A-Za-z]:)?/")
    p = F.when(absolute & repo.isNotNull() & (at > 0), F.substring(p, at + F.length(mark), F.length(p))).otherwise(p)
    return F.regexp_replace(p, r"^(?:\./)+", "")


def hash_key(column):
    """A hash in lower case without blanks; blank counts as null."""
    h = F.lower(F.trim(column))
    return F.when(h != "", h)


def latest(files: DataFrame) -> DataFrame:
    """``(seq, repo, path, hash, listed_at)``: the last listing of each ``seq``; of rows listed at the same time the one with a hash, and the greatest."""
    row = F.struct(F.col("listed_at"), hash_key(F.col("hash")).alias("hash"), "repo", "path")
    held = files.where("seq is not null").groupBy("seq").agg(F.max(row).alias("r"))
    return held.select("seq", F.col("r.repo").alias("repo"), relative_path(F.col("r.path"), F.col("r.repo")).alias("path"), F.col("r.hash").alias("hash"), F.col("r.listed_at").alias("listed_at"))


def committed(hashes: DataFrame, processed: DataFrame, runs: DataFrame) -> DataFrame:
    """``(repo, path, hash, offset)``: the last committed row of each key.

    Of several rows of one key and offset the one saved last holds. ``runs`` is joined by its
    number, so Spark broadcasts it while it is small and shuffles it when it isn't.
    """
    ok = runs.where("status = 'ok'").select("run_id").distinct()
    rel = relative_path(F.col("path"), F.col("repo")).alias("path")
    log = hashes.select("run_id", "repo", rel, hash_key(F.col("hash")).alias("hash"), "saved_at").join(ok, "run_id", "left_semi")
    confirmed = processed.select("run_id", "repo", rel).distinct()
    log = log.join(confirmed, ["run_id", *KEY], "left_semi")
    return log.groupBy(*KEY).agg(F.max(F.struct(F.col("run_id").alias("offset"), "saved_at", "hash")).alias("r")).select(*KEY, F.col("r.hash").alias("hash"), F.col("r.offset").alias("offset"))


def pending(files: DataFrame, hashes: DataFrame, processed: DataFrame, runs: DataFrame) -> DataFrame:
    """``(seq, repo, path, hash, offset)``: every listed file with a hash whose last committed state is missing or has another hash.

    ``offset`` is that of the state it replaces, null if there is none. A null hash in the
    state counts as another hash; files with a null repo or path have no state; empty state
    tables leave every file pending; extra columns are not read.
    """
    now = latest(files).where("hash is not null")
    held = committed(hashes, processed, runs).withColumnRenamed("hash", "held")
    return now.join(held, KEY, "left").where(F.col("held").isNull() | (F.col("held") != F.col("hash"))).select("seq", *KEY, "hash", "offset")


def partition_of(partitions: int = PARTITIONS):
    """The partition of a key, as a column."""
    return F.pmod(F.xxhash64(*KEY), F.lit(partitions)).cast("int")


class Store:
    """Small files of a run in a shared folder, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop, self._conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        self._fs = self._path().getFileSystem(self._conf)

    def _path(self, *names: str):
        return self._hadoop.Path("/".join((self.folder, *names)))

    def read(self, name: str) -> dict | None:
        path = self._path(name)
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            java = self.spark._jvm.java.io
            return json.loads(java.BufferedReader(java.InputStreamReader(stream, "UTF-8")).readLine())
        finally:
            stream.close()

    def write(self, name: str, value: dict) -> None:
        """Written beside its place and renamed over it in one step, so that there is always the old file or the new one, whole."""
        target, beside = self._path(name), self._path(f".{name}.tmp")
        stream = self._fs.create(beside, True)
        stream.write(bytearray((json.dumps(value) + "\n").encode()))
        stream.close()
        over = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 1)
        over[0] = self._hadoop.Options.Rename.OVERWRITE
        files = self._hadoop.FileContext.getFileContext(target.toUri(), self._conf)
        files.rename(files.makeQualified(beside), files.makeQualified(target), over)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def numbered(self, prefix: str) -> dict[int, str]:
        """The files ``prefix-N.json`` and ``prefix-N-name.json``, by number."""
        root = self._path()
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        held = [n for n in names if n.startswith(f"{prefix}-") and n.endswith(".json")]
        return dict(sorted((int(n[len(prefix) + 1 : -5].split("-")[0]), n) for n in held))


class ChangeLog:
    """An append-only log in a shared folder: segments of rows with ``partition`` and ``offset``.

    A row's place is given when it is taken in, whatever times it bears: its partition by its
    key, its offset by counting on from the end of that partition. Rows that come late or at the
    same time thus lie behind all that was read before. A segment counts once its manifest is
    there; the manifest has the ends of all partitions, so only the last one need be read.
    """

    def __init__(self, spark: SparkSession, folder: str, partitions: int = PARTITIONS):
        self.spark, self.partitions, self.store = spark, partitions, Store(spark, folder)

    def manifest(self, number: int | None = None) -> dict:
        """The manifest of a segment, or of the last."""
        held = self.store.numbered("segment")
        if not held:
            return {"number": -1, "begins": {}, "ends": {}}
        return self.store.read(held[max(held) if number is None else number])

    def append(self, rows: DataFrame, delivery: str) -> bool:
        """Take in a delivery of rows (``repo``, ``path`` and others); false if one of that name is there already.

        A delivery that was lost on the way is written again as a whole.
        """
        name = re.sub(r"\W", "_", delivery)
        held = self.store.numbered("segment")
        if any(n.endswith(f"-{name}.json") for n in held.values()):
            return False
        last = self.manifest()
        number, folder = last["number"] + 1, f"{self.store.folder}/rows-{last['number'] + 1}"
        begins = self.spark.createDataFrame([(int(p), e) for p, e in last["ends"].items()], "partition int, begin bigint")
        kept = rows.drop("partition", "offset")
        placed = kept.withColumn("partition", partition_of(self.partitions)).join(F.broadcast(begins), "partition", "left")  # a row for each partition
        within = W.partitionBy("partition").orderBy(*KEY)
        placed = placed.withColumn("offset", F.coalesce("begin", F.lit(0)) + F.row_number().over(within) - 1)
        placed.select("partition", "offset", *kept.columns).write.mode("overwrite").parquet(folder)
        ends = dict(last["ends"])
        for r in self.spark.read.parquet(folder).groupBy("partition").agg(F.max("offset").alias("top")).collect():
            ends[str(r["partition"])] = r["top"] + 1
        self.store.write(f"segment-{number}-{name}.json", {"number": number, "begins": last["ends"], "ends": ends})
        return True

    def read(self, begins: dict[str, int], ends: dict[str, int], first: int = 0) -> DataFrame | None:
        """The rows of each partition from ``begins`` (0 if missing) up to, without, ``ends``; null if there are none. Only segments from ``first`` on that reach into a range are read."""
        parts = []
        for n in self.store.numbered("segment"):
            if n >= first:
                m = self.manifest(n)
                if any(max(begins.get(p, 0), m["begins"].get(p, 0)) < min(e, m["ends"].get(p, 0)) for p, e in ends.items()):
                    parts.append(f"{self.store.folder}/rows-{n}")
        if not parts:
            return None
        spans = self.spark.createDataFrame([(int(p), begins.get(p, 0), e) for p, e in ends.items()], "partition int, from_ bigint, upto bigint")
        return self.spark.read.parquet(*parts).join(F.broadcast(spans), "partition").where("offset >= from_ and offset < upto").drop("from_", "upto")


def newest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """By ``key`` the row that is greatest by ``order``, then by offset: the same for rows written once or twice."""
    order = [*(c for c in order if c != "offset"), "offset"]
    rest = [c for c in rows.columns if c not in (*key, *order)]
    return rows.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("r")).select(*key, "r.*")


class ChangeRun:
    """Exactly-once processing of a change log in batches.

    A batch is planned from where the last one ended, in offsets of each partition, and at most
    ``most`` rows of each; the plan is written before the batch is run. Its rows come from the
    log, which doesn't change, and its result goes to a folder of its own; the commit comes last,
    with the offsets reached. A plan without a commit is run again with the very same rows. The
    sink holds, by key and order, the newest of all committed rows, so a row written twice counts
    once; ``compact`` folds batches that are done into one table and forgets their plans.
    """

    def __init__(self, spark: SparkSession, folder: str, log: ChangeLog, key: list[str] = KEY, order: list[str] = ["offset"], most: int = MOST):
        self.spark, self.log, self.store = spark, log, Store(spark, folder)
        self.key, self.order, self.most = key, order, most

    def reached(self) -> dict:
        """``{number, ends, first}`` of the last commit: its batch, the offset each partition is read up to, the first segment that may hold more."""
        held = self.store.numbered("commit")
        return self.store.read(held[max(held)]) if held else {"number": -1, "ends": {}, "first": 0}

    def plan(self) -> dict | None:
        """The batch to run next: one that was planned and not committed, or a new one, written ahead; null if nothing is left."""
        at = self.reached()
        number = at["number"] + 1
        planned = self.store.read(f"plan-{number}.json")
        if planned is None:
            tops = self.log.manifest()["ends"]
            ends = {p: min(top, at["ends"].get(p, 0) + self.most) for p, top in tops.items() if top > at["ends"].get(p, 0)}
            if not ends:
                return None
            planned = {"number": number, "begins": at["ends"], "ends": ends, "first": at["first"]}
            self.store.write(f"plan-{number}.json", planned)
        return planned

    def rows(self, plan: dict) -> DataFrame:
        """The rows of a planned batch."""
        return self.log.read(plan["begins"], plan["ends"], plan["first"])

    def write(self, plan: dict, result: DataFrame) -> None:
        """Put the result of a batch in its place, over that of a run that was lost."""
        result.write.mode("overwrite").parquet(f"{self.store.folder}/batch-{plan['number']}")

    def commit(self, plan: dict) -> None:
        ends = plan["begins"] | plan["ends"]
        last = self.log.manifest()
        first = last["number"] + 1 if ends == last["ends"] else plan["first"]
        self.store.write(f"commit-{plan['number']}.json", {"number": plan["number"], "ends": ends, "first": first})

    def run(self, process: Callable[[DataFrame], DataFrame]) -> bool:
        """Run one batch; false if nothing is pending. ``process`` keeps the columns of key and order, and ``offset``."""
        planned = self.plan()
        if planned is None:
            return False
        self.write(planned, process(self.rows(planned)))
        self.commit(planned)
        return True

    def _tables(self) -> tuple[list[str], int]:
        """The folders whose rows count, and the last batch among them."""
        base, at = self.store.numbered("base"), self.reached()["number"]
        upto = max(base, default=-1)
        folders = [f"{self.store.folder}/base-{upto}"] if base else []
        return [*folders, *(f"{self.store.folder}/batch-{n}" for n in range(upto + 1, at + 1))], at

    def result(self, folded: bool = False) -> DataFrame | None:
        """All committed rows, by key the newest, each once; null before the first commit.

        ``folded``: every batch holds a key once, so one table alone needs no further fold.
        """
        folders, _ = self._tables()
        if not folders:
            return None
        rows = self.spark.read.parquet(*folders)
        return rows if folded and len(folders) == 1 else newest(rows, self.key, self.order)

    def compact(self) -> None:
        """Fold all committed batches into one table, then forget their folders, plans and commits but the last."""
        folders, at = self._tables()
        if len(folders) < 2:
            return
        self.result().write.mode("overwrite").parquet(f"{self.store.folder}/base-{at}")
        self.store.write(f"base-{at}.json", {"number": at})
        for prefix in ("plan", "commit", "base"):
            for n, name in self.store.numbered(prefix).items():
                if n < at:
                    self.store.delete(name)
        for f in folders:
            self.store.delete(f.rpartition("/")[2])


#: What makes an event of the saved state one record, and what makes one version of it newer.
EVENT, VERSION = ["kind", *KEY, "id"], ["version", "hash"]


def events(files: DataFrame, hashes: DataFrame, processed: DataFrame) -> DataFrame:
    """The listing, the saved state and the log of runs as events ``(kind, repo, path, id, version, hash)``.

    ``listing``: ``id`` is the file, ``version`` the time of listing. ``state``: a run saved a
    hash. ``confirmed``: the run lists the file itself.
    """
    rel = relative_path(F.col("path"), F.col("repo")).alias("path")
    kind = lambda k: F.lit(k).alias("kind")
    time = lambda c: F.col(c).cast("timestamp_ntz").alias("version")
    hashed = hash_key(F.col("hash")).alias("hash")
    listed = files.where("seq is not null").select(kind("listing"), "repo", rel, F.col("seq").cast("bigint").alias("id"), time("listed_at"), hashed)
    saved = hashes.select(kind("state"), "repo", rel, F.col("run_id").cast("bigint").alias("id"), time("saved_at"), hashed)
    done = processed.select(kind("confirmed"), "repo", rel, F.col("run_id").cast("bigint").alias("id"), F.lit(None).cast("timestamp_ntz").alias("version"), F.lit(None).cast("string").alias("hash"))
    return listed.unionByName(saved).unionByName(done.distinct())


def pending_of(held: DataFrame, runs: DataFrame) -> DataFrame:
    """Like ``pending``, from the sink of the events' log."""
    ok = runs.where("status = 'ok'").select(F.col("run_id").cast("bigint").alias("id")).distinct()
    now = held.where("kind = 'listing'").groupBy("id").agg(F.max(F.struct("version", "hash", *KEY)).alias("r")).select(F.col("id").alias("seq"), "r.repo", "r.path", "r.hash").where("hash is not null")
    saved = held.where("kind = 'state'").select(*KEY, "id", "version", "hash").join(ok, "id", "left_semi")
    saved = saved.join(held.where("kind = 'confirmed'").select(*KEY, "id"), [*KEY, "id"], "left_semi")
    last = saved.groupBy(*KEY).agg(F.max(F.struct("id", "version", "hash")).alias("s")).select(*KEY, F.col("s.hash").alias("held"), F.col("s.id").alias("offset"))
    return now.join(last, KEY, "left").where("held is null or held <> hash").select("seq", *KEY, "hash", "offset")


class ChangedFiles:
    """The files that the next run has to process, kept up by change capture in a folder.

    ``deliver`` takes a delivery of rows of the three tables into the log, ``pending`` brings the
    sink up to date, by batches, and gives what is to be done. Each later call reads what was
    delivered since, not the history.
    """

    def __init__(self, spark: SparkSession, folder: str, partitions: int = PARTITIONS, most: int = MOST):
        self.log = ChangeLog(spark, f"{folder}/log", partitions)
        self.run = ChangeRun(spark, f"{folder}/sink", self.log, EVENT, VERSION, most)

    def deliver(self, files: DataFrame, hashes: DataFrame, processed: DataFrame, delivery: str) -> bool:
        return self.log.append(events(files, hashes, processed), delivery)

    def pending(self, runs: DataFrame) -> DataFrame:
        """``(seq, repo, path, hash, offset)`` as of all deliveries. A run's rows count once ``runs`` calls it ``ok``, also if that comes later."""
        while self.run.run(lambda rows: newest(rows, EVENT, VERSION)):
            pass
        if len(self.run._tables()[0]) > BATCHES:
            self.run.compact()
        held = self.run.result(folded=True)
        if held is None:
            raise ValueError("nothing was delivered")
        return pending_of(held, runs)
