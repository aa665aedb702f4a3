"""Connected components of a distributed edge list, by alternating stars.

Each round joins every vertex's neighbours to the smallest of them (first the larger
ones, then the smaller ones); rounds stop when nothing changes, after a number that
grows with the logarithm of the longest chain. Nothing is collected: minima combine
map-side, joins are left to Spark's skew-aware join, and each round's edges are
written to the shared folder. Up to ``LOCAL_EDGES`` distinct edges (16 bytes each) are
joined within one executor task instead, which gives the same result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.llm.common import remove_shared, returning, write_shared

#: Counted bound on the edges that one task may join: 16 MB.
LOCAL_EDGES = 1_000_000


def lowest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n vertices reaches over edges (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        # the minimum also goes to the vertices that the ends are labelled by
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    u, v = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]) for k in (0, 1))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    out = ids[lowest(len(ids), at[: len(u)], at[len(u) :])]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(out)], names=["id", "component"])


def _minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, component) of all vertices of ``edges`` (a, b: long), component being
    the smallest id of each component. No edges: no rows."""
    spark = edges.sparkSession
    now = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    now = now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    path = write_shared(now, "edges")
    now = spark.read.schema("u long, v long").parquet(path)
    mark = None
    if now.limit(local_edges + 1).count() <= local_edges:
        return now.coalesce(1).mapInArrow(returning(_in_one_task), "id long, component long")
    while True:  # ends when a round changes nothing
        found = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if found["n"] == 0 or tuple(found) == mark:
            break
        mark = tuple(found)
        # larger neighbours to the smallest one
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _minimum(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # smaller neighbours and the vertex itself to the smallest one
        low = _minimum(large)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = write_shared(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        remove_shared(spark, path)
        path = step
        now = spark.read.schema("u long, v long").parquet(path)
    # now a star for each component
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
