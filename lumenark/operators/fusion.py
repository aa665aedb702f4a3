"""From lanes to one ranking: collapse, reciprocal ranks, calibration, pool, floor.

A lane is rows (file_id, seq, score). Everything after the lanes is bounded by their
widths, so windows without a partition here run over at most a few hundred rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ("file_id", "seq")
RRF_K = 60


@dataclass(frozen=True)
class Calibration:
    cosine: float = 20.777
    bm25: float = 13.377
    bias: float = -8.762
    floor: float = 0.75


def by_score(score: str = "score") -> list[Column]:
    return [F.desc_nulls_last(score), F.asc("file_id"), F.asc("seq")]


def collapse(lane: DataFrame, cap: int = 0) -> DataFrame:
    """Best score per chunk, at most ``cap`` chunks per file (0: any)."""
    best = lane.groupBy(*KEY).agg(F.max("score").alias("score"))
    return cap_per_file(best, cap, by_score())


def cap_per_file(rows: DataFrame, cap: int, order: list[Column]) -> DataFrame:
    if cap <= 0:
        return rows
    return rows.withColumn("_r", F.row_number().over(W.partitionBy("file_id").orderBy(*order))).where(F.col("_r") <= cap).drop("_r")


def normalise(lane: DataFrame) -> DataFrame:
    """Scores to [0.1, 1] by their range; 1 where all are equal."""
    w = W.partitionBy(F.lit(0))
    low, high = F.min("score").over(w), F.max("score").over(w)
    return lane.withColumn("norm", F.when(high > low, 0.1 + 0.9 * (F.col("score") - low) / (high - low)).otherwise(1.0))


def seeds(lanes: list[DataFrame]) -> DataFrame:
    """Best normalised score per file over lanes; the first lane wins ties."""
    out = None
    for i, lane in enumerate(lanes):
        x = normalise(lane).select(*KEY, F.col("norm").alias("score"), F.lit(i).alias("lane"))
        out = x if out is None else out.unionByName(x)
    w = W.partitionBy("file_id").orderBy(F.desc("score"), "lane", "seq")
    return out.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def with_temporal_seeds(seeds: DataFrame, dated: DataFrame) -> DataFrame:
    """Notes in range at seq 0 with score 1 replace weaker seeds of the same file."""
    both = seeds.select(*KEY, "score", F.lit(0).alias("_d")).unionByName(dated.select("file_id", F.lit(0).cast("long").alias("seq"), F.lit(1.0).alias("score"), F.lit(1).alias("_d")))
    w = W.partitionBy("file_id").orderBy(F.desc("score"), "_d", "seq")
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_d")


def rrf(lanes: dict[str, tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """Sum over lanes of weight / (k + rank). Ties by file and seq. ``confidence`` is
    the share of the best in percent; ``lanes`` are the lanes that found the chunk."""
    out = None
    for name, (lane, weight) in lanes.items():
        rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*by_score()))
        x = lane.withColumn("rank", rank).select(*KEY, F.lit(name).alias("lane"), "rank", (F.lit(weight) / (k + F.col("rank"))).alias("part"))
        out = x if out is None else out.unionByName(x)
    fused = out.groupBy(*KEY).agg(F.sum("part").alias("rrf"), F.min("rank").alias("best_rank"), F.array_sort(F.collect_set("lane")).alias("lanes"))
    top = F.max("rrf").over(W.partitionBy(F.lit(0)))
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("rrf"), *KEY)
    return fused.withColumns({"confidence": F.when(top > 0, F.col("rrf") * 100 / top).otherwise(0.0), "rrf_rank": F.row_number().over(order)})


def probability(cosine: Column, bm25: Column, c: Calibration = Calibration()) -> Column:
    """Missing features count 0, the cosine within [0, 1]."""
    x = F.least(F.greatest(F.coalesce(cosine, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return 1 / (1 + F.exp(-(c.cosine * x + c.bm25 * F.coalesce(bm25, F.lit(0.0)) + c.bias)))


def mark_answers(pool: DataFrame, floor: float, score: str = "score") -> DataFrame:
    """``pool`` with ``answer``: whether the row reaches the floor. A floor of 0 or less
    keeps all; unscored rows are kept."""
    keep = F.lit(True) if floor <= 0 else F.col(score).isNull() | (F.col(score) >= floor)
    return pool.withColumn("answer", keep)


def split_at_floor(pool: DataFrame, floor: float, score: str = "score") -> tuple[DataFrame, DataFrame]:
    """Answers and the rest, as ``mark_answers`` has them."""
    marked = mark_answers(pool, floor, score)
    return marked.where("answer").drop("answer"), marked.where("not answer").drop("answer")


def cap_answers(rows: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` answers a file (0: any), the best by score; what is no answer
    stays."""
    if cap <= 0:
        return rows
    place = F.row_number().over(W.partitionBy("file_id", "answer").orderBy(F.desc("score"), F.asc("seq")))
    return rows.withColumn("_r", place).where(~F.col("answer") | (F.col("_r") <= cap)).drop("_r")


def build_pool(content: DataFrame, graph: DataFrame, temporal: DataFrame, budget: int = 32, graph_reserve: int = 8, temporal_reserve: int = 4) -> DataFrame:
    """The shortlist: content up to its allowance, then the graph's and the dated
    candidates' reserves, then what is left of each, content first. A chunk takes one
    slot, under the first source that brings it in. Inputs are (file_id, seq, rank)."""
    dated = F.max(F.lit(1)).over(W.partitionBy(F.lit(0)))
    t = temporal.withColumn("_any", dated)
    tagged = content.select(*KEY, "rank", F.lit(0).alias("src")).unionByName(graph.select(*KEY, "rank", F.lit(1).alias("src"))).unionByName(t.select(*KEY, "rank", F.lit(2).alias("src")))
    has = F.max((F.col("src") == 2).cast("int")).over(W.partitionBy(F.lit(0)))
    tagged = tagged.withColumn("_has", has)
    allowance = F.lit(budget - graph_reserve) - F.when(F.col("_has") == 1, temporal_reserve).otherwise(0)
    # content within its allowance first; reserves count only chunks not yet in
    first = tagged.withColumn("_in", (F.col("src") == 0) & (F.col("rank") <= allowance))
    taken = F.max(F.col("_in").cast("int")).over(W.partitionBy(*KEY))
    rest = first.withColumn("_taken", taken)
    n = F.row_number().over(W.partitionBy("src", "_taken").orderBy("rank"))
    rest = rest.withColumn("_n", n)
    quota = F.when(F.col("src") == 1, graph_reserve).when(F.col("src") == 2, temporal_reserve).otherwise(0)
    tier = F.when(F.col("_in"), 0).when((F.col("_taken") == 0) & (F.col("_n") <= quota), F.col("src")).otherwise(3 + F.col("src"))
    rest = rest.withColumn("tier", tier)
    one = rest.withColumn("_f", F.row_number().over(W.partitionBy(*KEY).orderBy("tier", "rank"))).where("_f = 1")
    slot = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("tier", "rank", *KEY))
    return one.withColumn("slot", slot).where(F.col("slot") <= budget).select(*KEY, "src", "tier", "slot")


def interleave(content: DataFrame, reserved: DataFrame) -> DataFrame:
    """Without a scorer: three content rows, then a reserved one. Inputs (.., rank)."""
    i, j = F.col("rank") - 1, F.col("rank") - 1
    key = content.withColumn("_k", 4 * F.floor(i / 3) + i % 3).unionByName(reserved.withColumn("_k", 4 * j + 3))
    n = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("_k", "file_id", "seq"))
    total = F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))
    return key.withColumn("position", n).withColumn("confidence", (total - F.col("position") + 1) * 100.0 / total).drop("_k")
