"""Fitting the calibrated probability on judged candidates.

A weighted logistic fit by Newton steps: each step is one aggregation to the ten sums
of a 3x3 system, solved on the driver, so the points may be any number."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenark.operators.fusion import Calibration

RIDGE = 1e-3


def fit(points: DataFrame, ridge: float = RIDGE, steps: int = 50) -> Calibration:
    """(cosine, bm25n, y): positives weigh as much as negatives together."""
    n = points.agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n")).first()
    weight = F.when(F.col("y") == 1, n["n"] / max(n["p"], 1)).otherwise(1.0)
    x = [F.col("cosine"), F.col("bm25n"), F.lit(1.0)]
    beta = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + F.exp(-sum((b * c for b, c in zip(map(float, beta), x)), F.lit(0.0))))
        slope = [F.sum(weight * (F.col("y") - p) * c).alias(f"g{i}") for i, c in enumerate(x)]
        bend = [F.sum(weight * p * (1 - p) * x[i] * x[j]).alias(f"h{i}{j}") for i in range(3) for j in range(i, 3)]
        row = points.agg(*slope, *bend).first()
        h = np.array([[row[f"h{min(i, j)}{max(i, j)}"] or 0.0 for j in range(3)] for i in range(3)]) + ridge * np.eye(3)
        step = np.linalg.solve(h, np.array([row[f"g{i}"] or 0.0 for i in range(3)]) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return Calibration(*map(float, beta))


def leave_one_out(points: DataFrame, ridge: float = RIDGE) -> dict[str, Calibration]:
    """For each query, the fit on all the others."""
    return {r["query"]: fit(points.where(F.col("query") != r["query"]), ridge) for r in points.select("query").distinct().collect()}


def window_metrics(ranked: DataFrame, window: int = 5) -> DataFrame:
    """(query, file_id, seq, score, tier: 1, 2 or noise 0): per query the tier-1 chunks
    in the window, the first one's rank and the noise above the last one."""
    w = W.partitionBy("query").orderBy(F.desc("score"), "file_id", "seq")
    top = ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= window)
    last = top.where("tier = 1").groupBy("query").agg(F.count(F.lit(1)).alias("covered"), F.min("rank").alias("first"), F.max("rank").alias("last"))
    above = top.where("tier = 0").join(last, "query").where("rank < last").groupBy("query").agg(F.count(F.lit(1)).alias("inversions"))
    return ranked.select("query").distinct().join(last.drop("last"), "query", "left").join(above, "query", "left").fillna(0, ["covered", "inversions"])
