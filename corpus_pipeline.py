"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame, which is written as Parquet to the shared folder and read again
as the next stage's ``docs``. All but the last return the columns of documents.

No oracle SQL: language codes, signatures and packing cannot be put in SQL; the
stages are tested against brute-force versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenark.llm import language_id, line_dedup, minhash_dedup, packing, quality_rules
from lumenark.llm.common import cut, few
from lumenark.session import prepare, table

ORACLE_SQL = None


#: The columns that stages read or rewrite.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns that no stage knows under names that no operator makes."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c in OWN else f"_column_{i}") for i, c in enumerate(docs.columns)))


def _back(judged: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, as they were called."""
    return judged.select(*(F.col(c if c in OWN else f"_column_{i}").alias(c) for i, c in enumerate(docs.columns)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass their own rules and whose host does."""
    return _back(quality_rules.judge(_apart(docs)).where("kept"), docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and not ambiguous."""
    found = language_id.identify(_apart(docs), language_id.train(_apart(docs)))
    return _back(found.where((F.col("lang_pred") != language_id.UNKNOWN) & ~F.col("ambiguous")), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat across documents."""
    return _back(line_dedup.dedup_lines(_apart(docs)), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest id."""
    gone = cut(minhash_dedup.near_duplicates(_apart(docs)).where(~F.col("kept")).select("doc_id").distinct(), "gone")
    return docs.join(few(gone), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(_apart(docs), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("language ID", language), ("line dedup", lines), ("near-duplicates", near_duplicates), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
