"""Near-duplicates among embeddings by int8 tile products with error bounds.

Identical vectors of a label are one vector with a multiplicity first, so copies
cost nothing later. The distinct vectors of a label are dealt to tiles of about
``TILE`` by hash, and each pair of tiles is one small task, however large the label.

A vector x of length 1 is s*q + e with q int8 and s = max|x| / 127. For two of them
|x.y - s s' q.q'| <= |e| + |s q| |e'|, so the integer product (exact in float32:
below 2**24 for up to 1040 dimensions, float64 above) shows which pairs cannot reach
the threshold.

1. Each distinct vector is quantised once; only int8 rows and three figures travel to the
   pairs of tiles, which return the rows (not the pairs) that have a partner possibly at
   the threshold.
2. Only those rows' whole vectors travel to their pairs of tiles; there the pairs
   possibly at the threshold are computed in double precision, which decides.

A tile pair returns, per vector, the number of vectors linked and the smallest id it
reaches within the pair; pairs are never emitted. Sums and components follow by
shuffle. All pairs within a label are compared, so work grows with the square of a
label's distinct vectors; the tasks do not grow.

Norms are taken of vectors divided by their largest component, so that neither very small
nor very large finite components under- or overflow.

Defined results: rows with a null label, a null id or a vector that is null, zero,
empty or holds a null or non-finite component link with nothing; vectors of
different lengths do not link; very long vectors are compared whole; of equal smallest
ids there is one component; repeated rows are vectors of their own (their ids may
repeat); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.llm.common import cut, few
from lumenark.llm.components import components, lowest

TILE = 2048
ROWS = 256
BROADCAST_LABELS = 50_000


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, scales, norms of scale * row and norms of what is lost, of rows of
    length 1."""
    s = np.abs(x).max(1) / 127
    q = np.rint(x / s[:, None]).astype(np.int8)
    near = q * s[:, None]
    return q, s, np.linalg.norm(near, axis=1), np.linalg.norm(x - near, axis=1)


def units(vectors: list) -> np.ndarray:
    """The vectors at length 1, in double precision."""
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Tile:
    """Quantised rows of one tile."""

    q: np.ndarray
    scale: np.ndarray
    near: np.ndarray
    lost: np.ndarray

    @staticmethod
    def of(rows: pd.DataFrame) -> Tile:
        q = np.frombuffer(b"".join(rows["q"]), np.int8).reshape(len(rows), -1)
        return Tile(q, *(rows[c].to_numpy() for c in ("scale", "near", "lost")))


def possible(a: Tile, b: Tile, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j) of pairs that may reach the threshold, in blocks of rows of a;
    with ``same`` (a is b) i < j."""
    wide = np.float32 if a.q.shape[1] <= 1040 else np.float64
    right = b.q.T.astype(wide)
    for lo in range(0, len(a.q), ROWS):
        hi = min(lo + ROWS, len(a.q))
        whole = a.q[lo:hi].astype(wide) @ right
        bound = a.lost[lo:hi, None] + a.near[lo:hi, None] * b.lost[None, :] + 1e-6
        maybe = whole * a.scale[lo:hi, None] * b.scale[None, :] + bound >= threshold
        if same:
            maybe &= np.arange(lo, hi)[:, None] < np.arange(len(b.q))[None, :]
        i, j = np.nonzero(maybe)
        if len(i):
            yield i + lo, j


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    """The rows of either tile of a pair, and whether it is one tile with itself."""
    first, second = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    pdf = pdf.sort_values("rep")
    one, two = pdf[pdf["tile"] == first], pdf[pdf["tile"] == second]
    return one, two, first == second


def survivors(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Of a pair of tiles, the rows with a partner that may reach the threshold."""
    one, two, same = _sides(pdf)
    marks = np.zeros(len(one), bool), np.zeros(len(two), bool)
    if len(one) and len(two):
        for i, j in possible(Tile.of(one), Tile.of(two), threshold, same):
            marks[0][i], marks[1][j] = True, True
    found = [one[marks[0] | marks[1]]] if same else [one[marks[0]], two[marks[1]]]
    return pd.concat(found)[["label", "dim", "rep", "tile", "i", "j"]]


def compare(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Of a pair of tiles' survivors: rep, links and the smallest rep reached, of linked
    rows."""
    one, two, same = _sides(pdf)
    both = one if same else pd.concat([one, two])
    rep, copies = both["rep"].to_numpy(), both["copies"].to_numpy()
    x = units(both["embedding"].tolist())
    shift = 0 if same else len(one)
    found = []
    for i, j in possible(Tile.of(one), Tile.of(two), threshold, same) if len(one) and len(two) else ():
        for k in range(0, len(i), 32768):
            u, v = i[k : k + 32768], j[k : k + 32768] + shift
            sure = np.einsum("nd,nd->n", x[u], x[v]) >= threshold
            found.append((u[sure], v[sure]))
    i, j = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))
    links = np.zeros(len(x), np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    low = rep[lowest_of(rep, i, j)]
    some = links > 0
    return pd.DataFrame({"rep": rep[some], "links": links[some], "low": low[some]})


def lowest_of(rep: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each row, the one of smallest rep that it reaches over edges (i, j)."""
    order = np.argsort(rep, kind="stable")
    place = np.empty(len(rep), np.int64)
    place[order] = np.arange(len(rep))
    return order[lowest(len(rep), place[i], place[j])[place]]


def quantised(distinct: DataFrame) -> DataFrame:
    """``distinct`` (label, embedding, rep, copies, dim) with q, scale, near and lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding").to_pylist()
            dims = np.array([len(v) for v in vectors])
            q: list = [b""] * len(vectors)
            figures = np.zeros((3, len(vectors)))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                own, *rest = quantise(units([vectors[i] for i in at]))
                figures[:, at] = rest
                for i, row in zip(at, own):
                    q[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(q, pa.binary()), *map(pa.array, figures)], names=[*batch.schema.names, "q", "scale", "near", "lost"])

    fields = distinct.select("*").schema.add("q", "binary").add("scale", "double").add("near", "double").add("lost", "double")
    return distinct.mapInArrow(run, fields)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """One row per vector: id, n_links, component_id and kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda v: v != 0)
    good = rows.where(F.coalesce(fine, F.lit(False)))
    distinct = good.groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    distinct = cut(quantised(distinct.withColumn("dim", F.size("embedding"))), "vectors")
    sizes = cut(distinct.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")), "sizes")
    dealt = distinct.join(few(sizes, BROADCAST_LABELS), ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pair = ["label", "dim", "i", "j"]
    paired = other.select("label", "dim", "rep", "tile", "q", "scale", "near", "lost", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    fields = paired.select("label", "dim", "rep", "tile", "i", "j").schema
    left = cut(paired.groupBy(pair).applyInPandas(lambda pdf: survivors(pdf, threshold), fields), "survivors")
    whole = left.join(distinct.select("label", "dim", "rep", "copies", "embedding", "q", "scale", "near", "lost"), ["label", "dim", "rep"])
    found = whole.groupBy(pair).applyInPandas(lambda pdf: compare(pdf, threshold), "rep long, links long, low long")
    found = cut(found, "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b"))).withColumnRenamed("id", "rep")
    known = distinct.join(links, "rep", "left").join(joined, "rep", "left")
    # rows find their vector by a 128-bit hash, so whole vectors do not travel again
    plain = F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0))  # one zero
    marks = {f"h{k}": F.xxhash64(F.lit(k), plain) for k in (1, 2)}
    known = known.withColumns(marks).select("label", "h1", "h2", "rep", "copies", "links", "component")
    marks = {n: F.when(F.coalesce(fine, F.lit(False)), h) for n, h in marks.items()}
    out = rows.withColumns(marks).select("id", "label", "h1", "h2").join(known, ["label", "h1", "h2"], "left")
    component = F.coalesce("component", "rep", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


ORACLE_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
r AS (SELECT vec_id AS id, vec_id AS reached FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
