"""The dealt operators' queries and their oracle SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenark.llm import embedding_dedup, html_extract, katz, language_id, line_dedup, minhash_dedup, pieces, quality_rules, source_audit, spelling, token_files, url_filters
from lumenark.llm.packing import Limits, pack
from lumenark.session import table

DOCUMENTS = Limits(loss_tokens=2047)
QUERIES: dict = {}
ORACLES: dict = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2048 tokens, 128 segments and 2047
    loss-bearing tokens: each holds a first or end id, which bear none, so no sequence
    is the inside of one document alone."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limits=DOCUMENTS, bare_ends=True)


@_query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every document by its own figures and its host's shrunk failure rate."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules.judge(docs, keep_text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLES["op4_quality_rules"] = quality_rules.ORACLE_SQL


@_query
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page's URL."""
    return url_filters.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op6_url_filters"] = url_filters.ORACLE_SQL


@_query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Take lines found in three documents or more out of all but one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, digest=True).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


ORACLES["op7_line_dedup"] = line_dedup.ORACLE_SQL


@_query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict every document's language from two thirds of the labelled rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs)
    out = language_id.identify(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(language_id.fold_of("doc_id", 3) == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


@_query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@_query
def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link all embeddings of a label with cosine 0.93 or more."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op10_embedding_dedup"] = embedding_dedup.ORACLE_SQL


@_query
def op9_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document into pieces, decode them again and compare."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.decode(pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model), model)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids_crc32", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


@_query
def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicates among all documents."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@_query
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document by a Katz model of nine tenths of them."""
    return katz.score(table(spark, sf_dir, "documents"))


@_query
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's ids to files of directly addressable codes and read them back."""
    root = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.index(spark, root).select("doc_id", "start", "n_tokens", "ids_crc32")


@_query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, one in 97 of a document's misspelt, with their forms and roots."""
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents"), one_in=97))


@_query
def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language stand apart, and by which terms."""
    return source_audit.audit(table(spark, sf_dir, "documents"))


ORACLES["op11_source_audit"] = source_audit.ORACLE_SQL
