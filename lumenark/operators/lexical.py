"""Keyword lane over texts: document frequencies and weighted BM25 without an index.

A query's terms are a handful of literals: a chunk's tokens are counted within its row, and
nothing is exploded or shuffled. ``keyword`` has the stored index, with the same scores."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def query_terms(query: str) -> list[str]:
    """Whitespace tokens with a letter or digit, first of equal ones (any case)."""
    out: dict[str, str] = {}
    for t in query.split():
        if any(c.isalnum() for c in t):
            out.setdefault(t.lower(), t)
    return list(out.values())


def sub_terms(term: str) -> list[str]:
    """What the tokeniser makes of a quoted token: a phrase if several."""
    return [x for x in re.split(r"[^\w]|_", term.lower()) if x]


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def phrase_hits(toks: Column, phrase: list[str]) -> Column:
    """How often the words stand next to each other in a token array."""
    if len(phrase) == 1:
        return F.size(F.filter(toks, lambda x: x == phrase[0]))
    words = F.array(*map(F.lit, phrase))
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(toks) - len(phrase) + 1, F.lit(1))), lambda i: F.slice(toks, i, len(phrase)) == words))


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.ln((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))


def document_frequency(chunks: DataFrame, terms: list[str], text_col: str = "text") -> DataFrame:
    """(term, df): chunks that hold each term's phrase."""
    toks = chunks.select(tokens(F.col(text_col)).alias("t"))
    hits = [F.count_if(phrase_hits(F.col("t"), sub_terms(t)) > 0).alias(f"d{i}") for i, t in enumerate(terms)]
    row = toks.agg(*hits)
    return row.select(F.inline(F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"d{i}").alias("df")) for i, t in enumerate(terms)))))


@dataclass(frozen=True)
class Statistics:
    """What a query's terms need to know of the whole store: rows, mean length, and the
    rows that hold each term."""

    rows: int
    mean: float
    holding: tuple[int, ...]


def _counted(df: DataFrame, terms: list[list[str]], columns: dict[str, float]) -> DataFrame:
    df = df.withColumns({f"_t{j}": tokens(F.col(c)) for j, c in enumerate(columns)})
    length = sum((F.size(f"_t{j}") for j in range(len(columns))), F.lit(0))
    freq = {f"_f{i}": sum((phrase_hits(F.col(f"_t{j}"), p) * F.lit(w) for j, w in enumerate(columns.values())), F.lit(0.0)) for i, p in enumerate(terms)}
    hits = {f"_h{i}": sum((phrase_hits(F.col(f"_t{j}"), p) for j in range(len(columns))), F.lit(0)) for i, p in enumerate(terms)}
    return df.withColumns({"_len": length, **freq, **hits}).drop(*(f"_t{j}" for j in range(len(columns))))


def _summed(whole: DataFrame, n: int) -> DataFrame:
    return whole.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), *(F.count_if(F.col(f"_h{i}") > 0).alias(f"_d{i}") for i in range(n)))


def statistics(corpus: DataFrame, query: str, columns: dict[str, float]) -> Statistics:
    """One pass over the store and one row back, for all that a search does with it."""
    terms = [s for s in map(sub_terms, query_terms(query)) if s]
    row = _summed(_counted(corpus, terms, columns), len(terms)).first()
    return Statistics(row["_n"], row["_avg"] or 0.0, tuple(row[f"_d{i}"] for i in range(len(terms))))


def bm25(chunks: DataFrame, query: str, columns: dict[str, float], corpus: DataFrame | None = None, require_all: bool = False, known: Statistics | None = None) -> DataFrame:
    """``chunks`` that hold any of the query's terms, with ``bm25`` and ``bound``.

    ``columns`` maps declared columns to weights; length counts all of them. Statistics
    come from ``corpus`` (default: the chunks themselves), so a scoped search is
    filtered first and still weighs terms as the whole store does. One pass for the
    statistics, which are a single row joined by a constant, unless they are ``known``;
    no shuffle of text."""
    terms = [s for s in map(sub_terms, query_terms(query)) if s]
    if not terms:
        return chunks.limit(0).withColumns({"bm25": F.lit(0.0), "bound": F.lit(0.0)})

    any_hit = [F.col(f"_h{i}") > 0 for i in range(len(terms))]
    keep = any_hit[0]
    for h in any_hit[1:]:
        keep = (keep & h) if require_all else (keep | h)
    mine = _counted(chunks, terms, columns).where(keep)
    if known is not None:
        mine = mine.withColumns({"_n": F.lit(known.rows), "_avg": F.lit(known.mean), **{f"_d{i}": F.lit(d) for i, d in enumerate(known.holding)}})
    else:
        one = F.lit(1)  # the statistics are a single row
        stats = _summed(_counted(corpus if corpus is not None else chunks, terms, columns), len(terms))
        mine = mine.withColumn("_k", one).join(F.broadcast(stats.withColumn("_k", one)), "_k")
    score, bound = F.lit(0.0), F.lit(0.0)
    for i in range(len(terms)):
        w, f = idf(F.col("_n"), F.col(f"_d{i}")), F.col(f"_f{i}")
        score += w * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
        bound += w * (K1 + 1)
    return mine.withColumns({"bm25": score, "bound": bound}).select(*chunks.columns, "bm25", "bound")


def normalized(score: Column, bound: Column) -> Column:
    return F.when(bound <= 0, 0.0).otherwise(F.least(F.greatest(score / bound, F.lit(0.0)), F.lit(1.0)))
