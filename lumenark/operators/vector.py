"""Semantic lane: exact cosine top-k, and the deterministic hash embedder."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class EmbedModel(Protocol):
    """A model plug-in: texts in, vectors of length 1 out."""

    width: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Vectors from SHA-256 of the text: repeatable, no meaning."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            raw, block = b"", 0
            while len(raw) < self.width:
                raw += hashlib.sha256(t.encode() + block.to_bytes(4, "little") * (block > 0)).digest()
                block += 1
            v = [b / 127.5 - 1 for b in raw[: self.width]]
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


def embed(df: DataFrame, model: EmbedModel, text_col: str = "text", out_col: str = "vector") -> DataFrame:
    """A vector per row, in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.embed(list(texts.fillna(""))))

    return df.withColumn(out_col, run(F.col(text_col)))


def embed_each(df: DataFrame, model: EmbedModel, text_col: str = "text") -> DataFrame:
    """``df`` with ``vector`` and ``error``: a batch that the model refuses is tried row by
    row, and rows that it refuses then have the error instead."""

    @F.pandas_udf("vector array<float>, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            asked = list(texts.fillna(""))
            try:
                found = [(v, None) for v in model.embed(asked)]
            except Exception:
                found = []
                for t in asked:
                    try:
                        found.append((model.embed([t])[0], None))
                    except Exception as e:  # whatever one text raises is that text's
                        found.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(found, columns=["vector", "error"])

    return df.withColumn("_made", run(F.col(text_col))).select(*df.columns, "_made.*")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Also of vectors that are not of length 1; 0 for a zero vector."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def knn(vectors: DataFrame, query: list[float], k: int = 60, vector_col: str = "vector") -> DataFrame:
    """The k nearest rows, with ``score``; ties by (file_id, seq). Scope is applied by
    the caller before, so that k rows of the scope come back. The query is one literal
    and the plan one TakeOrderedAndProject: no shuffle of vectors. Rows of another
    width are an error."""
    q = F.array(*(F.lit(float(x)) for x in query))
    v = F.when(F.size(vector_col) == len(query), F.col(vector_col)).otherwise(F.raise_error(F.lit("vector width differs from the query's")))
    return vectors.withColumn("score", cosine(v, q)).drop(vector_col).orderBy(F.desc("score"), "file_id", "seq").limit(k)
