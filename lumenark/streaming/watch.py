"""The change stream: classify, drop echoes, detect moves, rescan, apply once.

Events are (event_id, ts, kind, path, content_hash, mtime). A batch is applied by
``foreachBatch`` to a store of notes that is partitioned by a hash of the path: only the
partitions that a batch touches are written anew, under the batch's number, and a small
manifest says which version of each partition is the present one. A batch that runs again
after a failure writes the same: exactly once, where arrival order decides."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def classify(events: DataFrame, exclude: str | None = None) -> DataFrame:
    """Notes only: other endings, hidden and excluded paths go; creations of paths that
    are gone are deletions, removals of paths that are there go; what cannot be told
    asks for a full rescan. ``exists`` (optional column) says if the path is there."""
    out = events.where(F.col("path").isNull() | (F.col("path").endswith(".md") & ~F.col("path").rlike(r"(^|/)\.")))
    if exclude:
        out = out.where(F.col("path").isNull() | ~F.col("path").rlike(exclude))
    there = F.col("exists") if "exists" in events.columns else F.lit(None).cast("boolean")
    deleted, written = F.col("kind") == "deleted", F.col("kind").isin("created", "changed")
    op = F.when(F.col("path").isNull(), "rescan").when(written & (F.coalesce(there, F.lit(True))), "upsert").when(written, "delete").when(deleted & ~F.coalesce(there, F.lit(False)), "delete").when(deleted, "skip").otherwise("rescan")
    return out.withColumn("op", op).where("op <> 'skip'")


def latest(ops: DataFrame) -> DataFrame:
    """The last operation on each path: earlier ones of a batch need no work."""
    top = ops.groupBy("path").agg(F.max("event_id").alias("event_id"))
    return ops.join(top, ["path", "event_id"], "left_semi")


def detect_moves(ops: DataFrame, stored: DataFrame) -> DataFrame:
    """(from_path, to_path): a deleted path whose stored content appears under a new
    path of the same batch. Copies pair off by path order; one move per path."""
    gone = ops.where("op = 'delete'").select("path").join(stored.select("path", "content_hash"), "path")
    fresh = ops.where("op = 'upsert'").select("path", "content_hash").join(stored.select("path"), "path", "left_anti")
    nth = F.row_number().over(W.partitionBy("content_hash").orderBy("path"))
    a = gone.select("content_hash", F.col("path").alias("from_path"), nth.alias("n"))
    b = fresh.select("content_hash", F.col("path").alias("to_path"), nth.alias("n"))
    return a.join(b, ["content_hash", "n"]).select("from_path", "to_path")


def echoes(ops: DataFrame, own_writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``ops`` without those that our own writes (path, mtime, and ``writes`` if a row
    stands for several) caused, and (path, mtime, used): the writes that this took. A write
    takes one change with its time, the first; a second such change is another's."""
    times = F.sum("writes") if "writes" in own_writes.columns else F.count(F.lit(1))
    log = own_writes.groupBy("path", "mtime").agg(times.alias("_writes")).where(F.col("_writes") > 0)
    nth = F.row_number().over(W.partitionBy("path", "mtime").orderBy("event_id"))
    met = ops.join(log, ["path", "mtime"]).withColumn("_nth", nth)  # only what has a write
    used = met.where(F.col("_nth") <= F.col("_writes")).groupBy("path", "mtime").agg(F.count(F.lit(1)).alias("used"))
    rest = ops.join(log.select("path", "mtime"), ["path", "mtime"], "left_anti").select(ops.columns)
    return rest.unionByName(met.where(F.col("_nth") > F.col("_writes")).select(ops.columns)), used


def drop_echoes(ops: DataFrame, own_writes: DataFrame) -> DataFrame:
    """Without changes that our own writes caused, one for each write."""
    return echoes(ops, own_writes)[0]


def apply_batch(stored: DataFrame, ops: DataFrame) -> DataFrame:
    """``stored`` (path, content_hash, mtime and more) after a batch: deletions, then the
    last versions. A moved note keeps its other columns under its new path. Rows that ask
    for a rescan change nothing here: a diff answers them (see ``settle``)."""
    last = latest(ops.where("op <> 'rescan'"))
    more = [c for c in stored.columns if c not in ("path", "content_hash", "mtime")]
    moves = detect_moves(last, stored)
    kept = stored.join(last.select("path"), "path", "left_anti")
    fresh = last.where("op = 'upsert'").select("path", "content_hash", "mtime")
    # what a moved or rewritten note keeps, under the path that it has now
    old = stored.select("path", *more).join(moves.select(F.col("from_path").alias("path"), "to_path"), "path", "left").withColumn("path", F.coalesce("to_path", "path")).drop("to_path")
    return kept.unionByName(fresh.join(old, "path", "left").select(stored.columns))


def rescan(found: DataFrame, stored: DataFrame) -> DataFrame:
    """The operations that a full diff asks for."""
    from lumenark.operators.store import diff

    op = F.when(F.col("change") == "deleted", "delete").otherwise("upsert")
    return diff(found, stored).select("path", op.alias("op"))


def settle(ops: DataFrame, scan: Callable[[], DataFrame] | None, stored: DataFrame) -> DataFrame:
    """The operations of a batch: if any asks for a rescan, those of a full diff with
    ``scan()`` (path, content_hash, mtime) instead. Without a scan, what cannot be told
    is left for the next one."""
    if scan is None or not ops.where("op = 'rescan'").limit(1).count():
        return ops.where("op <> 'rescan'")
    found = scan()
    todo = rescan(found, stored).join(found.select("path", "content_hash", "mtime"), "path", "left")
    return todo.withColumn("event_id", F.lit(0).cast("long"))


BUCKETS = 64


@dataclass
class Store:
    """Notes under ``root``, partitioned by a hash of the path, versioned by batch."""

    spark: SparkSession
    root: str
    fields: str = "path string, content_hash string, mtime long"
    buckets: int = BUCKETS

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")

    def manifest(self, version: int) -> dict[int, int]:
        """The version of each partition: at most ``buckets`` rows."""
        if version <= 0:
            return {}
        rows = self.spark.read.schema("bucket int, version long").parquet(f"{self.root}/manifest/v{version}").collect()
        return {r["bucket"]: r["version"] for r in rows}

    def read(self, version: int, only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.root}/notes/v{v}/bucket={b}" for b, v in sorted(self.manifest(version).items()) if only is None or b in only]
        return self.spark.read.schema(self.fields).parquet(*paths) if paths else self.spark.createDataFrame([], self.fields)

    def write(self, notes: DataFrame, version: int, touched: set[int]) -> None:
        """``notes`` are all notes of the touched partitions."""
        out = notes.withColumn("bucket", self.bucket()).repartition("bucket")
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/notes/v{version}")
        # partitions that hold nothing any more have no folder
        now = {r["bucket"] for r in self.spark.read.schema(f"{self.fields}, bucket int").parquet(f"{self.root}/notes/v{version}").select("bucket").distinct().collect()} if touched else set()
        present = {b: v for b, v in self.manifest(version - 1).items() if b not in touched} | {b: version for b in touched & now}
        rows = self.spark.createDataFrame(list(present.items()), "bucket int, version long")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/v{version}")
        self.forget(version)

    def taken(self, version: int) -> DataFrame:
        """(path, mtime, taken): own writes whose echo has come, up to a version."""
        fields = "path string, mtime long, taken long"
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/echoes/v{version}")
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(fields).parquet(str(at)) if there else self.spark.createDataFrame([], fields)

    def without_echoes(self, ops: DataFrame, own_writes: DataFrame, version: int) -> DataFrame:
        """The operations of the batch that makes ``version``, without echoes of writes that
        no batch before has taken; notes which this one takes. What left the log is
        forgotten, and a batch that runs again finds the same."""
        log = own_writes.groupBy("path", "mtime").agg(F.count(F.lit(1)).alias("writes"))
        known = log.join(self.taken(version - 1), ["path", "mtime"], "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
        rest, used = echoes(ops, known.withColumn("writes", F.col("writes") - F.col("taken")))
        now = known.join(used, ["path", "mtime"], "left").select("path", "mtime", (F.col("taken") + F.coalesce("used", F.lit(0).cast("long"))).alias("taken"))
        now.where("taken > 0").write.mode("overwrite").parquet(f"{self.root}/echoes/v{version}")
        return rest

    def forget(self, version: int) -> None:
        """Delete versions of notes that neither this manifest nor the one before needs."""
        needed = {*self.manifest(version).values(), *self.manifest(version - 1).values(), version}
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.root}/notes")
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.listStatus(top):
            name = status.getPath().getName()
            if name.startswith("v") and name[1:].isdigit() and int(name[1:]) not in needed and int(name[1:]) < version:
                fs.delete(status.getPath(), True)
        for old in range(max(1, version - 3), version - 1):
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/v{old}"), True)
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.root}/echoes/v{old}"), True)


@dataclass
class Follower:
    """One batch after another into a store. ``scan`` lists all files, ``own_writes``
    (path, mtime) is the log of our own writes, each of which takes one change away, once;
    ``on_change`` is told once per
    batch which paths changed and what was there before and after: the place to
    reconcile links (``graph.reconcile``)."""

    store: Store
    scan: Callable[[], DataFrame] | None = None
    own_writes: Callable[[], DataFrame] | None = None
    exclude: str | None = None
    on_change: Callable[[DataFrame, DataFrame, DataFrame], None] | None = None
    done: list[int] = field(default_factory=list)

    def step(self, events: DataFrame, number: int) -> None:
        store, version = self.store, number + 1
        events = events.persist()
        try:
            ops = classify(events, self.exclude)
            if self.own_writes is not None:
                ops = store.without_echoes(ops, self.own_writes(), version)
            whole = store.read(number)
            ops = settle(ops, self.scan, whole).withColumn("_bucket", store.bucket())
            touched = {r["_bucket"] for r in ops.select("_bucket").distinct().collect()}  # at most ``buckets``
            ops = ops.drop("_bucket")
            before = store.read(number, touched)
            store.write(apply_batch(before, ops), version, touched)
            if self.on_change is not None:
                self.on_change(latest(ops).select("path", "op"), before, store.read(version, touched))
            self.done.append(number)
        finally:
            events.unpersist()


def follow(events: DataFrame, root: str, checkpoint: str, once: bool = True, **more):
    """Run the stream into the store under ``root``, version batch + 1; returns the query.
    ``once`` takes all that is there and stops (start-up); else every two seconds."""
    fields = more.pop("fields", "path string, content_hash string, mtime long")
    follower = Follower(Store(events.sparkSession, root, fields), **more)
    writer = events.writeStream.foreachBatch(follower.step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def start_up(store: Store, scan: Callable[[], DataFrame], version: int) -> DataFrame:
    """What changed while nothing followed: the diff of a scan, as version + 1."""
    stored = store.read(version)
    found = scan()
    ops = rescan(found, stored).join(found.select("path", "content_hash", "mtime"), "path", "left").withColumn("event_id", F.lit(0).cast("long"))
    store.write(apply_batch(stored, ops), version + 1, set(range(store.buckets)))
    return store.read(version + 1)


def pending(ops: DataFrame) -> DataFrame:
    """Units of work left: a move counts two."""
    return ops.agg(F.sum(F.when(F.col("op") == "move", 2).otherwise(1)).alias("pending"))
