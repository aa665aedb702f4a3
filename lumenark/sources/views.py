"""The note data model, projected from the relational test tables.

notes (file_id, path, content_hash, mtime, docid, created_by, note_date, text),
note_tags, chunks (conversation turns), lines (document lines as chunks), vectors,
edges, props, links and events. ``PRELUDE`` says the same in SQL."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenark.functions import text as T
from lumenark.operators import keyword
from lumenark.session import shared_dir, table

#: Links go from orders to parts, whose keys overlap.
PART_OFFSET = 1_000_000_000
EPOCH = 1_704_067_200  # 2024-01-01


_INDEXES: dict[tuple[str, str], keyword.Index] = {}


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def notes(self) -> DataFrame:
        d = self.table("documents")
        path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc-"), F.col("doc_id"), F.lit(".md"))
        return d.select(
            F.col("doc_id").alias("file_id"), path.alias("path"), T.content_hash(F.col("text")).alias("content_hash"), F.col("doc_id").alias("mtime"), T.docid(path).alias("docid"),
            F.col("source").alias("created_by"), (F.lit(EPOCH) + 86400 * (F.col("doc_id") % 365)).cast("long").alias("note_date"), "text",
        )

    @cached_property
    def note_tags(self) -> DataFrame:
        d, q = self.table("documents"), self.table("labels")
        kinds = [(d, "doc_id", "lang/", "lang"), (d, "doc_id", "src/", "source"), (q, "doc_id", "quality/", "quality"), (q, "doc_id", "toxic/", "toxic")]
        parts = [t.where(F.col(c).isNotNull()).select(F.col(i).alias("file_id"), F.concat(F.lit(p), F.col(c).cast("string")).alias("tag")) for t, i, p, c in kinds]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @cached_property
    def chunks(self) -> DataFrame:
        c = self.table("conversations")
        return c.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("seq"), F.col("role").alias("heading"), F.col("role").alias("heading_path"), F.col("text"), T.chunk_tokens(F.col("text")).alias("token_count"))

    @cached_property
    def keyword(self) -> keyword.Index:
        """The stored keyword index of the chunks: made by the first query that asks for it,
        read by all later ones of the session."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _INDEXES:
            _INDEXES[key] = keyword.write(self.chunks, f"{shared_dir(self.spark)}/lumenark/keyword-{uuid.uuid4().hex}")
        return _INDEXES[key]

    @cached_property
    def lines(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n", -1)).alias("seq", "text")).withColumn("seq", F.col("seq").cast("long"))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("label").cast("long").alias("file_id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("vector"))

    @cached_property
    def edges(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("from_file"), F.col("l_linenumber").cast("long").alias("from_chunk_seq"), (F.col("l_partkey") + PART_OFFSET).alias("to_file"), F.lit(-1).cast("long").alias("to_chunk_seq"), F.lit("wikilink").alias("edge_type")
        )

    @cached_property
    def props(self) -> DataFrame:
        o = self.table("orders")
        pairs = F.array(
            F.struct(F.lit("status").alias("name"), F.col("o_orderstatus").alias("value")),
            F.struct(F.lit("priority").alias("name"), F.col("o_orderpriority").alias("value")),
            F.struct(F.lit("total").alias("name"), F.floor("o_totalprice").cast("string").alias("value")),
            F.struct(F.lit("open").alias("name"), (F.col("o_orderstatus") == "O").cast("string").alias("value")),
        )
        flat = o.select(F.col("o_orderkey").alias("file_id"), F.lit(-1).cast("long").alias("chunk_seq"), F.inline(pairs))
        return flat.withColumn("kind", T.value_kind(F.col("value")))

    @cached_property
    def links(self) -> DataFrame:
        return self.table("pages").select(F.col("page_id").alias("file_id"), F.explode(F.array_distinct(F.expr("regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)"))).alias("target"))

    @cached_property
    def events(self) -> DataFrame:
        """A change stream: an operation on a path in arrival order."""
        e = self.table("events")
        kind = F.when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "signup", "created").otherwise("changed")
        return e.select("event_id", "ts", kind.alias("kind"), F.concat(F.lit("user/"), F.col("user_id"), F.lit(".md")).alias("path"), F.col("event_type"))


PRELUDE = r"""
WITH notes AS (SELECT doc_id AS file_id, source || '/' || lang || '/doc-' || doc_id || '.md' AS path, sha256(text) AS content_hash, doc_id AS mtime,
    substr(sha256(source || '/' || lang || '/doc-' || doc_id || '.md'), 1, 6) AS docid, source AS created_by, (1704067200 + 86400 * (doc_id % 365))::BIGINT AS note_date, text FROM documents),
note_tags AS (SELECT doc_id AS file_id, 'lang/' || lang AS tag FROM documents WHERE lang IS NOT NULL UNION ALL SELECT doc_id, 'src/' || source FROM documents WHERE source IS NOT NULL
    UNION ALL SELECT doc_id, 'quality/' || quality FROM labels WHERE quality IS NOT NULL UNION ALL SELECT doc_id, 'toxic/' || toxic FROM labels WHERE toxic IS NOT NULL),
chunks AS (SELECT conv_id AS file_id, turn AS seq, role AS heading, role AS heading_path, text, ceil(strlen(text) / 4.0)::BIGINT AS token_count FROM conversations),
lines AS (SELECT doc_id AS file_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::BIGINT AS seq, unnest(string_split(text, chr(10))) AS text FROM documents),
vectors AS (SELECT label::BIGINT AS file_id, vec_id AS seq, embedding AS vector FROM embeddings),
edges AS (SELECT l_orderkey AS from_file, l_linenumber::BIGINT AS from_chunk_seq, l_partkey + 1000000000 AS to_file, (-1)::BIGINT AS to_chunk_seq, 'wikilink' AS edge_type FROM lineitem),
rawprops AS (SELECT o_orderkey AS file_id, (-1)::BIGINT AS chunk_seq, unnest(['status', 'priority', 'total', 'open']) AS name,
    unnest([o_orderstatus, o_orderpriority, floor(o_totalprice)::BIGINT::VARCHAR, CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END]) AS value FROM orders),
props AS (SELECT *, CASE WHEN value IS NULL OR trim(value) = '' THEN 'empty' WHEN lower(value) IN ('true', 'false') THEN 'checkbox' WHEN regexp_matches(value, '^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$') THEN 'number' ELSE 'text' END AS kind FROM rawprops),
links AS (SELECT DISTINCT page_id AS file_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages),
events_v AS (SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'deleted' WHEN 'signup' THEN 'created' ELSE 'changed' END AS kind, 'user/' || user_id || '.md' AS path, event_type FROM events)
"""
