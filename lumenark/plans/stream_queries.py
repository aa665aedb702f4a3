"""The change stream, as batches over its events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenark.plans.registry import query
from lumenark.session import shared_dir
from lumenark.streaming import watch as W

_OPS = ", op AS (SELECT event_id, path, CASE WHEN kind = 'deleted' THEN 'delete' ELSE 'upsert' END AS op FROM events_v)"


def _ops(v):
    e = v.events.withColumns({"content_hash": F.sha2("event_type", 256), "mtime": F.col("event_id")})
    return W.classify(e)


@query(_OPS + " SELECT op, count(*) AS n FROM op GROUP BY op")
def watch_classify(v):
    """T2."""
    return _ops(v).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query(_OPS + " SELECT path, arg_max(op, event_id) AS op FROM op GROUP BY path")
def watch_latest(v):
    """The last operation on each path."""
    return W.latest(_ops(v)).select("path", "op")


@query(_OPS + " SELECT count(*) AS n FROM op WHERE event_id % 10 <> 0")
def watch_echoes(v):
    """T4: our own writes are no changes."""
    own = v.events.where("event_id % 10 = 0").select("path", F.col("event_id").alias("mtime"))
    return W.drop_echoes(_ops(v), own).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'old/' || doc_id AS from_path, 'new/' || doc_id AS to_path FROM documents")
def watch_moves(v):
    """Deleted here, the same content there."""
    d = v.table("documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("content_hash"))
    stored = d.select(F.concat(F.lit("old/"), "doc_id").alias("path"), "content_hash")
    ops = stored.select("path", "content_hash", F.lit("delete").alias("op")).unionByName(d.select(F.concat(F.lit("new/"), "doc_id").alias("path"), "content_hash", F.lit("upsert").alias("op")))
    return W.detect_moves(ops, stored)


@query(_OPS + ", st AS (SELECT 'user/' || u || '.md' AS path, 'old' AS content_hash FROM range(0, 100) t(u)), la AS (SELECT o.path, arg_max(o.op, o.event_id) AS op, arg_max(sha256(e.event_type), o.event_id) AS content_hash, max(o.event_id) AS mtime FROM op o JOIN events_v e USING (event_id) GROUP BY o.path) SELECT path, content_hash, mtime FROM la WHERE op = 'upsert' UNION ALL SELECT path, content_hash, 0 FROM st WHERE path NOT IN (SELECT path FROM la)")
def watch_apply(v):
    """T5: the store after all events."""
    stored = v.spark.range(100).select(F.concat(F.lit("user/"), "id", F.lit(".md")).alias("path"), F.lit("old").alias("content_hash"), F.lit(0).cast("long").alias("mtime"))
    return W.apply_batch(stored, _ops(v))


@query(", f AS (SELECT 'n' || doc_id AS path FROM documents WHERE doc_id % 2 = 0), s AS (SELECT 'n' || doc_id AS path FROM documents WHERE doc_id % 3 = 0) SELECT path, 'upsert' AS op FROM f WHERE path NOT IN (SELECT path FROM s) UNION ALL SELECT path, 'delete' FROM s WHERE path NOT IN (SELECT path FROM f)")
def watch_rescan(v):
    """A rescan as a diff."""
    d = v.table("documents").select("doc_id", F.concat(F.lit("n"), "doc_id").alias("path"), F.lit("h").alias("content_hash"))
    return W.rescan(d.where("doc_id % 2 = 0"), d.where("doc_id % 3 = 0"))


@query("SELECT CASE WHEN doc_id % 5 = 1 THEN 'm/n' ELSE 'n' END || doc_id AS path, 'h' || doc_id AS content_hash, CASE WHEN doc_id % 3 > 0 THEN source END AS created_by FROM documents WHERE doc_id % 5 <> 2")
def watch_settle(v):
    """A batch with an event that cannot be told. The diff that answers it finds
    notes that moved (and keep their author), went, came and stayed."""
    d = v.table("documents").select("doc_id", F.concat(F.lit("n"), "doc_id").alias("path"), F.concat(F.lit("h"), "doc_id").alias("content_hash"), F.lit(1).cast("long").alias("mtime"), F.col("source").alias("created_by"))
    stored = d.where("doc_id % 3 > 0").drop("doc_id")
    found = d.where("doc_id % 5 <> 2").select(F.when(F.col("doc_id") % 5 == 1, F.concat(F.lit("m/"), "path")).otherwise(F.col("path")).alias("path"), "content_hash", "mtime")
    events = v.spark.range(1).select(F.lit(1).cast("long").alias("event_id"), F.lit("overflow").alias("kind"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast("long").alias("mtime"))
    ops = W.settle(W.classify(events), lambda: found, stored)
    return W.apply_batch(stored, ops).select("path", "content_hash", "created_by")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_event_windows(v):
    """The events read as a stream into daily windows, run to its end. Each trigger
    writes the windows to the shared folder; nothing comes to the driver."""
    import uuid

    schema = v.table("events").schema
    stream = v.spark.readStream.schema(schema).parquet(f"{v.sf_dir}/event*.parquet")
    counts = stream.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    top = f"{shared_dir(v.spark)}/lumenark/events-{uuid.uuid4().hex}"
    last = []

    def step(batch, number):
        batch.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n").write.mode("overwrite").parquet(f"{top}/v{number}")
        last[:] = [number]

    q = counts.writeStream.outputMode("complete").foreachBatch(step).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    fields = "day timestamp_ntz, event_type string, n long"
    return v.spark.read.schema(fields).parquet(f"{top}/v{last[0]}") if last else v.spark.createDataFrame([], fields)
