"""Ranked search: lanes, fusion, calibrated probability, floor, blocks, budget.

One lazy plan per question. Scope filters come below every limit; texts and
properties join only after the shortlist is cut."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenark.functions import text as T
from lumenark.operators import fusion, lexical, present, vector
from lumenark.operators import graph as G


@dataclass(frozen=True)
class Options:
    top_n: int = 5
    width: int = 60
    candidates: int = 32
    graph_reserve: int = 8
    temporal_reserve: int = 4
    shortlist_cap: int = 8
    per_note_cap: int = 0
    budget_tokens: int = 8192
    coalesce: bool = True
    columns: dict = field(default_factory=lambda: {"text": 1.0, "heading_path": 1.0})
    weights: dict = field(default_factory=lambda: {"semantic": 1.0, "fts": 1.0})
    calibration: fusion.Calibration = fusion.Calibration()
    #: What scores the shortlist: "calibrated", "rerank" (a model reads the texts), or
    #: "degraded" (nothing: content and reserves interleave, scores are null).
    scorer: str = "calibrated"
    rerank_chars: int = 0
    #: Show what the floor rejected in the places that answers leave free.
    less_relevant: bool = False
    walk: G.Walk = G.Walk()


def lanes(chunks: DataFrame, vectors: DataFrame | None, query: str, query_vector: list[float] | None, o: Options, corpus: DataFrame | None = None, known: lexical.Statistics | None = None, keyword: DataFrame | None = None) -> dict[str, DataFrame]:
    """The content lanes, each at most ``width`` rows. ``keyword``: the keyword scores, if
    a stored index has given them."""
    found = (lexical.bm25(chunks, query, o.columns, corpus, known=known) if keyword is None else keyword).withColumn("score", F.col("bm25"))
    out = {"fts": found.select("file_id", "seq", "score", lexical.normalized(F.col("bm25"), F.col("bound")).alias("bm25n")).orderBy(*fusion.by_score()).limit(o.width)}
    if vectors is not None and query_vector is not None:
        out["semantic"] = vector.knn(vectors, query_vector, o.width).select("file_id", "seq", "score")
    return out


@dataclass(frozen=True)
class Dated:
    """A date range of the question: the notes of the scope with their dates, and the
    range in epoch seconds."""

    notes: DataFrame  # file_id, note_date
    start: int
    end: int

    def seeds(self) -> DataFrame:
        return self.notes.where(F.col("note_date").between(self.start, self.end))

    def promotions(self, candidates: DataFrame) -> DataFrame:
        """(file_id, seq, rank) of the candidates (a shortlist) whose note has a date,
        those in or near the range first."""
        near = self.notes.where(F.col("note_date").isNotNull()).join(F.broadcast(candidates.select("file_id", "seq").distinct()), "file_id")
        order = fusion.W.partitionBy(F.lit(0)).orderBy(F.desc(T.temporal_score(F.col("note_date"), self.start, self.end)), "file_id", "seq")
        return near.select("file_id", "seq", F.row_number().over(order).alias("rank"))


def shortlist(chunks: DataFrame, vectors: DataFrame | None, query: str, query_vector: list[float] | None, o: Options = Options(), edges: DataFrame | None = None, corpus: DataFrame | None = None, dated: Dated | None = None, keyword: DataFrame | None = None) -> DataFrame:
    """(file_id, seq, src, slot, rrf, confidence, cosine, bm25n, score): pooled and scored
    by calibrated probability, best first by (score, rrf rank, file, seq)."""
    known = lexical.statistics(corpus if corpus is not None else chunks, query, o.columns) if keyword is None and lexical.query_terms(query) else None
    found = lanes(chunks, vectors, query, query_vector, o, corpus, known, keyword)
    content = {n: fusion.collapse(f.select("file_id", "seq", "score"), o.shortlist_cap) for n, f in found.items()}
    fused = fusion.rrf({n: (f, o.weights[n]) for n, f in content.items()})
    ranked = fused.select("file_id", "seq", F.col("rrf_rank").alias("rank"))
    none = ranked.limit(0)
    graph = none
    if edges is not None:
        seeds = fusion.seeds(list(content.values()))
        if dated is not None:
            seeds = fusion.with_temporal_seeds(seeds, dated.seeds())
        # the date range's notes are not bounded, the lanes are
        walked = G.expand(seeds, edges, chunks, o.walk, few=dated is None)
        w = fusion.W.partitionBy(F.lit(0)).orderBy(*fusion.by_score())
        graph = walked.withColumn("rank", F.row_number().over(w)).select("file_id", "seq", "rank")
    temporal = none if dated is None else dated.promotions(ranked.select("file_id", "seq").union(graph.select("file_id", "seq")))
    pool = fusion.build_pool(ranked, graph, temporal, o.candidates, o.graph_reserve if edges is not None else 0, o.temporal_reserve)
    # features that a lane did not bring are looked up for the pool's chunks only
    features = keyword if keyword is not None else lexical.bm25(chunks.join(F.broadcast(pool.select("file_id", "seq")), ["file_id", "seq"], "left_semi"), query, o.columns, corpus if corpus is not None else chunks, known=known)
    out = pool.drop("tier").join(features.select("file_id", "seq", lexical.normalized(F.col("bm25"), F.col("bound")).alias("bm25n")), ["file_id", "seq"], "left")
    if vectors is not None and query_vector is not None:
        q = F.array(*(F.lit(float(x)) for x in query_vector))
        near = vectors.join(F.broadcast(pool.select("file_id", "seq")), ["file_id", "seq"], "left_semi").select("file_id", "seq", vector.cosine(F.col("vector"), q).alias("cosine"))
        out = out.join(near, ["file_id", "seq"], "left")
    else:
        out = out.withColumn("cosine", F.lit(None).cast("double"))
    out = out.join(fused.select("file_id", "seq", "rrf", "rrf_rank", "confidence"), ["file_id", "seq"], "left")
    return out.withColumn("score", fusion.probability(F.col("cosine"), F.col("bm25n"), o.calibration))


def ranked_search(chunks: DataFrame, vectors: DataFrame | None, query: str, query_vector: list[float] | None = None, o: Options = Options(), edges: DataFrame | None = None, corpus: DataFrame | None = None, dated: Dated | None = None, model: RerankModel | None = None, keyword: DataFrame | None = None, properties: DataFrame | None = None) -> DataFrame:
    """At most ``top_n`` answers as blocks, with ``admitted`` by the token budget; none
    if nothing reaches the floor. Chunks are taken in rank order until they make so many
    blocks. With ``o.less_relevant`` the best of what the floor rejected follows as single
    chunks, ``answer`` false and never admitted. ``properties`` (file_id, name, value):
    those of the notes shown come along."""
    scored = shortlist(chunks, vectors, query, query_vector, o, edges, corpus, dated, keyword)
    if o.scorer == "rerank":
        read = scored.join(chunks.select("file_id", "seq", "text"), ["file_id", "seq"], "left")
        scored = rerank(read, query, model, chars=o.rerank_chars).drop("text").withColumn("score", F.col("rerank"))
    elif o.scorer == "degraded":
        scored = degraded(scored)
    by = ("position",) if o.scorer == "degraded" else (F.desc_nulls_last("score"), F.asc_nulls_last("rrf_rank"))
    order = fusion.W.partitionBy(F.lit(0)).orderBy(F.desc("answer"), *by, "file_id", "seq")
    ranked = fusion.mark_answers(scored, o.calibration.floor)
    if not o.less_relevant:
        ranked = ranked.where("answer")
    ranked = fusion.cap_answers(ranked, o.per_note_cap).withColumn("rank", F.row_number().over(order))
    shown = ranked.join(chunks.select("file_id", "seq", "heading_path", "text"), ["file_id", "seq"], "left")
    if o.coalesce:
        shown = present.coalesce_adjacent(present.admit(shown, o.top_n))
    else:
        shown = shown.withColumns({"n_chunks": F.lit(1).cast("long"), "tokens": present.T.packaging_tokens(F.col("text"))})
    top = present.fill(shown, o.top_n) if o.less_relevant else shown.orderBy("rank", "file_id", "seq").limit(o.top_n)
    out = present.pack_budget(top, o.budget_tokens).withColumn("admitted", F.col("admitted") & F.col("answer"))
    return out if properties is None else present.with_properties(out, properties)


def degraded(pool: DataFrame) -> DataFrame:
    """The pool without a scorer: three of content, then one of the reserves; scores are
    null and ``confidence`` follows the position."""
    nth = F.row_number().over(fusion.W.partitionBy(F.col("src") == 0).orderBy("slot"))
    rows = pool.drop("confidence").withColumns({"rank": nth, "score": F.lit(None).cast("double")})
    return fusion.interleave(rows.where("src = 0"), rows.where("src <> 0")).drop("rank")


class RerankModel(Protocol):
    """A scorer plug-in: how well each text answers the question, 0 to 1."""

    def score(self, question: str, texts: list[str]) -> list[float]: ...


def rerank(pool: DataFrame, question: str, model: RerankModel | None = None, text_col: str = "text", chars: int | None = None) -> DataFrame:
    """``pool`` with ``rerank``: the model's score in Arrow batches, or, without a
    model, the shared four-character shingles of question and text. ``chars`` caps what
    the model reads (0 or None: all)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    if chars:
        text = F.substring(text, 1, chars)
    if model is None:
        return pool.withColumn("rerank", T.shingle_jaccard(T.shingles(text), T.shingles(F.lit(question))))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(question, list(texts)), dtype="float64")

    return pool.withColumn("rerank", scored(text))


def legacy_search(found: dict[str, DataFrame], chunks: DataFrame, question: str, model: RerankModel | None = None, depth: int = 30, weights: dict[str, float] | None = None) -> DataFrame:
    """The older ranking: fuse the lanes, rerank the first ``depth``, and fuse again
    with the reranked ones as a lane of their own."""
    w = {"semantic": 1.0, "fts": 1.0, "graph": 0.8, "rerank": 1.0, "temporal": 0.0} | (weights or {})
    lanes_ = {n: (f.select("file_id", "seq", "score"), w[n]) for n, f in found.items()}
    top = fusion.rrf(lanes_).where(F.col("rrf_rank") <= depth).select("file_id", "seq")
    texts = top.join(chunks.select("file_id", "seq", "text"), ["file_id", "seq"], "left")
    lane = rerank(texts, question, model).select("file_id", "seq", F.col("rerank").alias("score"))
    return fusion.rrf(lanes_ | {"rerank": (lane, w["rerank"])})


def explain(fused: DataFrame) -> DataFrame:
    """A line per result that says which lanes found it and how well."""
    return fused.withColumn("explain", F.concat(F.format_number("rrf", 6), F.lit(" from "), F.array_join("lanes", " + "), F.lit(", best rank "), F.col("best_rank")))


#: What is put before a question or a document, by embedding family: (question, document).
PROMPTS = {"plain": ("", ""), "query-passage": ("query: ", "passage: "), "search": ("search_query: ", "search_document: ")}


def prompted(text: Column, family: str, question: bool, title: Column | None = None) -> Column:
    lead = PROMPTS[family][0 if question else 1]
    body = text if title is None else F.concat_ws("\n", title, text)
    return F.concat(F.lit(lead), body)
