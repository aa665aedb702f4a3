"""Names, edits, envelopes, embeddings and calibration."""

import pandas as pd
from pyspark.sql import functions as F

from lumenark.operators import calibrate, edits, fusion, lexical, links, present, resolve, search, store, vector
from lumenark.plans.ranked_queries import _Q, _RRF, COLUMNS, _two_lanes, _words
from lumenark.plans.registry import query


def _names(v, prefix):
    return v.notes.select(F.concat(F.lit(prefix), "file_id").alias("name"))


@query("SELECT 'DOC_' || file_id AS name, path, 2 AS step, false AS ambiguous FROM notes WHERE path IS NOT NULL")
def resolve_names(v):
    """File names in another case and with other separators."""
    return resolve.candidates(_names(v, "DOC_"), v.notes, fuzzy=False)


@query("SELECT 'dok-' || file_id AS name, path, 4 AS step, false AS ambiguous FROM notes WHERE path IS NOT NULL")
def resolve_near_names(v):
    """A slip of the pen is forgiven if one note alone is that near."""
    return resolve.candidates(_names(v, "dok-"), v.notes)


@query("SELECT '#' || docid AS name, path, 0 AS step, false AS ambiguous FROM notes")
def resolve_docids(v):
    """Short ids."""
    return resolve.candidates(v.notes.select(F.concat(F.lit("#"), "docid").alias("name")), v.notes, fuzzy=False)


@query("""SELECT '{"file_id":' || file_id || ',"path":"' || path || '"}' AS json FROM notes""")
def json_envelope(v):
    """Results as JSON lines."""
    return present.envelope(v.notes.select("path", "file_id"))


def _content(v):
    """Every note's whole text under a title."""
    return F.concat(F.lit("# T\n\n"), F.coalesce("text", F.lit("")), F.lit("\n"))


#: The same in SQL.
_TEXT = "coalesce(text, '')"
_CONTENT = f"'# T' || chr(10) || chr(10) || {_TEXT} || chr(10)"


def _edited(v, what, how, **more):
    notes = v.notes.select("path", _content(v).alias("content"), "mtime")
    names = {"heading": None, "text": None, "key": None, "value": None, **more}
    todo = notes.select(
        "path", F.lit(0).alias("n"), F.lit(what).alias("what"), F.lit(names["heading"]).cast("string").alias("heading"), F.lit(how).alias("how"), F.lit(names["text"]).cast("string").alias("text"),
        F.lit(names["key"]).cast("string").alias("key"), F.lit(names["value"]).cast("string").alias("value"), F.when(F.expr("mtime % 10 = 0"), F.col("mtime") + 1).alias("expected_mtime"),
    )
    return edits.apply(notes, todo).select("path", "content", "fault")


_FAULT = "CASE WHEN file_id % 10 = 0 THEN 'conflict: the note has changed' END AS fault FROM notes"


@query("SELECT path, CASE WHEN file_id % 10 = 0 THEN '' ELSE '---' || chr(10) || 'state: done' || chr(10) || '---' || chr(10) END || " + _CONTENT + " AS content, " + _FAULT)
def edit_properties(v):
    """A property set on many notes; notes changed meanwhile are conflicts."""
    return _edited(v, "property", "set", key="state", value="done")


@query("SELECT path, CASE WHEN file_id % 10 = 0 THEN " + _CONTENT + " ELSE '# T' || chr(10) || chr(10) || CASE WHEN trim(" + _TEXT + ", chr(10)) = '' THEN '' ELSE trim(" + _TEXT + ", chr(10)) || chr(10) || chr(10) END || 'new' || chr(10) END AS content, " + _FAULT)
def edit_sections(v):
    """Text appended to a section."""
    return _edited(v, "section", "append", heading="T", text="new")


@query("SELECT path, CASE WHEN file_id % 10 = 0 THEN '# T' ELSE '# New' END || chr(10) || chr(10) || " + _TEXT + " || chr(10) AS content, " + _FAULT)
def edit_renames(v):
    """A section under another name."""
    notes = v.notes.select("path", "file_id", _content(v).alias("content"))

    @F.pandas_udf("string")
    def rename(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: edits.rename_section(c, "T", "New"))

    done = F.expr("file_id % 10 = 0")
    return notes.select("path", F.when(done, F.col("content")).otherwise(rename("content")).alias("content"), F.when(done, "conflict: the note has changed").alias("fault"))


@query("SELECT n_nationkey AS file_id, 'We met in [[' || n_name || ']] and left ' || n_name || '.' AS content FROM nation")
def apply_links(v):
    """The first mention of each note becomes a link."""
    rows = [(r["n_name"], f"places/{r['n_name']}.md", "exact") for r in v.table("nation").select("n_name").collect()]  # the nations are 25 names

    @F.pandas_udf("string")
    def linked(contents: pd.Series) -> pd.Series:
        index = links.NameIndex(rows)
        return contents.map(lambda c: links.apply_links(c, links.discover(c, "", index)))

    text = F.concat(F.lit("We met in "), "n_name", F.lit(" and left "), "n_name", F.lit("."))
    return v.table("nation").select(F.col("n_nationkey").alias("file_id"), linked(text).alias("content"))


@query(_Q + "SELECT file_id, seq FROM (SELECT file_id, seq, row_number() OVER (PARTITION BY file_id ORDER BY bm25 DESC, seq) AS r FROM bm) WHERE r = 1")
def best_chunks(v):
    """The best chunk of each file that has any."""
    found = lexical.bm25(v.chunks, _words(v), COLUMNS)
    return found.groupBy("file_id").agg(F.max_by("seq", F.struct("bm25", (-F.col("seq")).alias("s"))).alias("seq"))


@query("SELECT file_id, seq, 64 AS width, 1.0::DOUBLE AS norm FROM chunks")
def embed_chunks(v):
    """Vectors of length 1 from the repeatable embedder."""
    e = vector.embed(v.chunks.select("file_id", "seq", "text"), vector.HashEmbedder())
    return e.select("file_id", "seq", F.size("vector").alias("width"), F.round(F.sqrt(vector.dot(F.col("vector"), F.col("vector"))), 4).alias("norm"))


@query("SELECT file_id, seq, len(vector)::INT AS width FROM vectors")
def vectors_of_files(v):
    """The vectors of all notes, of the width expected."""
    return store.vectors_of(v.vectors, 64).select("file_id", "seq", F.size("vector").alias("width"))


@query()
def calibration_fit(v):
    """The fit on judged points (here a made-up judgement on embeddings)."""
    points = v.table("embeddings").select(F.abs(F.col("embedding")[0]).cast("double").alias("cosine"), F.abs(F.col("embedding")[1]).cast("double").alias("bm25n"), (F.col("label") > 4).cast("int").alias("y"))
    c = calibrate.fit(points)
    return v.spark.range(1).select(*(F.lit(round(x, 4)).alias(n) for n, x in (("cosine", c.cosine), ("bm25", c.bm25), ("bias", c.bias))))


@query("SELECT name, count(*) AS n FROM (SELECT unnest(['parser', 'chunker', 'link', 'fts', 'embedding', 'reranker']) AS name) GROUP BY name")
def fingerprint_keys(v):
    """What is fingerprinted."""
    now = store.fingerprints({"chunker": {"target": 512}})
    return v.spark.range(1).select(F.explode(F.array(*map(F.lit, now))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'lang/' || lang AS tag, count(*) AS notes, round(avg(n_chars), 4) AS chars, min(n_chars) AS shortest, max(n_chars) AS longest FROM documents GROUP BY ALL")
def folder_statistics(v):
    """Figures per folder."""
    return v.table("documents").groupBy(F.concat(F.lit("lang/"), "lang").alias("tag")).agg(F.count(F.lit(1)).alias("notes"), F.round(F.avg("n_chars"), 4).alias("chars"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))


@query(_Q + _RRF + r""", qs AS (SELECT array_to_string(([x FOR x IN string_split_regex(text, '\s+') IF x <> ''])[1:4], ' ') AS q FROM qt),
t30 AS (SELECT file_id, seq FROM rf ORDER BY rrf DESC, file_id, seq LIMIT 30), tx AS (SELECT file_id, seq, lower(coalesce(c.text, '')) AS t, lower(q) AS q FROM t30 LEFT JOIN chunks c USING (file_id, seq), qs),
sh AS (SELECT file_id, seq, list_distinct([substr(t, i, 4) FOR i IN range(1, greatest(length(t) - 2, 1))]) AS a, list_distinct([substr(q, i, 4) FOR i IN range(1, greatest(length(q) - 2, 1))]) AS b FROM tx),
sc AS (SELECT file_id, seq, CASE WHEN len(list_distinct(a || b)) = 0 THEN 0.5 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END AS s FROM sh),
al AS (SELECT file_id, seq, r FROM ra UNION ALL SELECT file_id, seq, row_number() OVER (ORDER BY s DESC, file_id, seq) FROM sc)
SELECT file_id, seq, round(sum(1.0 / (60 + r)), 8) AS rrf FROM al GROUP BY file_id, seq""")
def legacy_ranking(v):
    """Fused, reranked and fused again."""
    a, b = _two_lanes(v)
    return search.legacy_search({"semantic": a, "fts": b}, v.chunks, _words(v)).select("file_id", "seq", F.round("rrf", 8).alias("rrf"))


@query(_Q + _RRF + "SELECT file_id, seq, 'best rank ' || min(best_rank) || ' in ' || any_value(lanes) AS explain FROM rf GROUP BY file_id, seq")
def explain_results(v):
    """Where each result comes from."""
    a, b = _two_lanes(v)
    f = search.explain(fusion.rrf({"semantic": (a, 1.0), "fts": (b, 1.0)}))
    return f.select("file_id", "seq", F.concat(F.lit("best rank "), F.col("best_rank"), F.lit(" in "), F.array_join("lanes", ",")).alias("explain"))


@query("SELECT file_id AS rank, file_id || '. ' || file_id || '#0 (0.500)' || chr(10) || text AS line FROM notes WHERE text IS NOT NULL")
def render_results(v):
    """Results as text."""
    return present.render_text(v.notes.select("file_id", F.lit(0).alias("seq"), F.col("file_id").alias("rank"), F.lit(0.5).alias("score"), "text")).where("line is not null")


@query("SELECT file_id, 'search_document: ' || path || chr(10) || text AS input FROM notes")
def prompt_templates(v):
    """Document inputs with a title."""
    return v.notes.select("file_id", search.prompted(F.col("text"), "search", False, F.col("path")).alias("input"))


@query("SELECT unnest(['due', 'rating']) AS name, unnest(['date', 'number']) AS declared")
def declared_types(v):
    """Property types from JSON."""
    return store.declared_types(v.spark.range(1).select(F.lit('{"types": {"due": "date", "rating": "number"}}').alias("json")))


@query("SELECT file_id, path FROM notes")
def delete_and_restore(v):
    """Into the trash and back."""
    notes = v.notes.select("file_id", "path", "docid")
    name = notes.where("file_id = 7").first()["path"]
    return store.undelete(store.soft_delete(notes, name), name).select("file_id", "path")
