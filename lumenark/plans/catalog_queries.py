"""Scopes, listings, lookups and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenark.operators import catalog as C
from lumenark.operators.scope import Scope
from lumenark.plans.registry import query


@query("SELECT file_id, path FROM notes WHERE file_id IN (SELECT file_id FROM note_tags WHERE tag = 'lang/en') AND file_id NOT IN (SELECT file_id FROM note_tags WHERE tag = 'toxic' OR starts_with(tag, 'toxic/1')) AND (starts_with(path, 'src1/') OR starts_with(path, 'src2/'))")
def scope_all_any_none(v):
    """tags, folders and exclusions together."""
    s = Scope.parse(all=("=#lang/en",), any=("src1/", "src2/"), none=("#toxic/1",))
    return s.apply(v.notes, v.note_tags).select("file_id", "path")


@query("SELECT DISTINCT n.file_id, path FROM notes n JOIN note_tags t USING (file_id) WHERE tag = 'quality' OR starts_with(tag, 'quality/')")
def scope_tag_subtree(v):
    """a tag's subtree."""
    return Scope.parse(all=("#quality",)).apply(v.notes, v.note_tags).select("file_id", "path")


@query("SELECT file_id FROM notes WHERE starts_with(path, 'src3/') AND instr(substr(path, 6), '/') = 0")
def scope_folder_exact(v):
    """direct children only (here there are none)."""
    return Scope.parse(all=("=src3/",)).apply(v.notes, v.note_tags).select("file_id")


@query("SELECT file_id FROM notes WHERE starts_with(path, 'src4/en/') OR file_id IN (SELECT file_id FROM note_tags WHERE tag = 'lang/de')")
def scope_mixed_any(v):
    """a path term or a tag term."""
    return Scope.parse(any=("src4/en/", "#lang/de")).apply(v.notes, v.note_tags).select("file_id")


@query("SELECT count(*) AS n FROM notes WHERE NOT starts_with(path, 'src0/')")
def scope_archive_default(v):
    """the archive is out by default."""
    return Scope(archive="src0").apply(v.notes).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM notes WHERE starts_with(path, 'src0/de/')")
def scope_archive_lifted(v):
    """a folder term inside the archive lifts the exclusion."""
    return Scope.parse(all=("src0/de/",), archive="src0").apply(v.notes).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT file_id FROM (SELECT DISTINCT o_orderkey AS file_id FROM orders) WHERE file_id IN (SELECT file_id FROM props WHERE name = 'status' AND value = 'F')")
def scope_property(v):
    """a property with a value."""
    notes = v.table("orders").select(F.col("o_orderkey").alias("file_id"), F.lit("p").alias("path"))
    return Scope.parse(property="status=F").apply(notes, props=v.props).select("file_id")


@query("SELECT DISTINCT from_file AS file_id FROM edges WHERE to_file = (SELECT min(to_file) FROM edges)")
def scope_links_to(v):
    """notes that link to a note."""
    target = v.edges.agg(F.min("to_file")).first()[0]
    notes = v.table("orders").select(F.col("o_orderkey").alias("file_id"), F.lit("p").alias("path"))
    return Scope(links_to=target).apply(notes, edges=v.edges).select("file_id")


@query("SELECT DISTINCT to_file AS file_id FROM edges WHERE from_file = (SELECT min(from_file) FROM edges)")
def scope_linked_from(v):
    """notes that a note links to."""
    source = v.edges.agg(F.min("from_file")).first()[0]
    notes = v.edges.select(F.col("to_file").alias("file_id"), F.lit("p").alias("path")).distinct()
    return Scope(linked_from=source).apply(notes, edges=v.edges).select("file_id")


@query("SELECT file_id, note_date FROM notes WHERE note_date BETWEEN 1706745600 AND 1709164800")
def scope_dates(v):
    """an inclusive date range."""
    return Scope(dates=(1706745600, 1709164800)).apply(v.notes).select("file_id", "note_date")


@query("SELECT created_by, count(*) AS n FROM notes WHERE created_by = 'src5' GROUP BY 1")
def scope_created_by(v):
    """by author."""
    return Scope(created_by="src5").apply(v.notes).groupBy("created_by").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT file_id FROM notes WHERE path LIKE 'src1/%'")
def files_by_prefix(v):
    """by path prefix, pushed to the scan as a prefix where the path is stored."""
    return v.notes.where(F.col("path").like("src1/%")).select("file_id")


_LIST = """, li AS (SELECT to_file AS file_id, count(DISTINCT from_file) AS links_in FROM edges WHERE from_file <> to_file GROUP BY 1),
cs AS (SELECT file_id, count(*) AS chunk_count, sum(token_count)::BIGINT AS token_count FROM chunks GROUP BY 1),
nn AS (SELECT p_partkey + 1000000000 AS file_id, 'part/' || p_partkey AS path FROM part),
al AS (SELECT file_id, path, coalesce(links_in, 0) AS links_in, coalesce(chunk_count, 0) AS chunk_count, coalesce(token_count, 0) AS token_count FROM nn LEFT JOIN li USING (file_id) LEFT JOIN cs USING (file_id)) """


def _parts(v):
    return v.table("part").select((F.col("p_partkey") + 1_000_000_000).alias("file_id"), F.concat(F.lit("part/"), F.col("p_partkey")).alias("path"))


@query(_LIST + "SELECT * FROM al ORDER BY path LIMIT 100")
def listing_by_path(v):
    """L1, L3: a page of the listing by path."""
    return C.listing(_parts(v), v.chunks, v.edges)


@query(_LIST + "SELECT * FROM al WHERE path > 'part/150' ORDER BY path LIMIT 50")
def listing_after_path(v):
    """L2: the next page by key, never by offset."""
    return C.listing(_parts(v), v.chunks, v.edges, after="part/150", limit=50)


@query(_LIST + "SELECT * FROM al ORDER BY links_in DESC, path LIMIT 40")
def listing_by_links(v):
    """L1: most linked first."""
    return C.listing(_parts(v), v.chunks, v.edges, order="links", limit=40)


@query(_LIST + ", k AS (SELECT links_in AS n FROM al WHERE path = 'part/100') SELECT al.* FROM al, k WHERE links_in < n OR (links_in = n AND path > 'part/100') ORDER BY links_in DESC, path LIMIT 40")
def listing_after_links(v):
    """L2: the page after a note in link order."""
    return C.listing(_parts(v), v.chunks, v.edges, order="links", after="part/100", limit=40)


@query(_LIST + "SELECT * FROM al ORDER BY links_in, path LIMIT 40")
def listing_fewest_links(v):
    """L1: least linked first."""
    return C.listing(_parts(v), v.chunks, v.edges, order="fewest", limit=40)


@query("SELECT file_id, path, docid, content_hash FROM notes WHERE docid = (SELECT min(docid) FROM notes)")
def lookup_by_docid(v):
    """By short id."""
    low = v.notes.agg(F.min("docid")).first()[0]
    return v.notes.where(F.col("docid") == low).select("file_id", "path", "docid", "content_hash")


@query("SELECT * FROM chunks WHERE file_id = 3 ORDER BY seq")
def chunks_by_file(v):
    """A note's chunks."""
    return v.chunks.where("file_id = 3").orderBy("seq")


@query("SELECT file_id, list(seq ORDER BY seq) AS seqs FROM chunks WHERE heading = 'user' GROUP BY file_id")
def chunk_seqs_with_heading(v):
    """Where a heading occurs."""
    return v.chunks.where("heading = 'user'").groupBy("file_id").agg(F.array_sort(F.collect_list("seq")).alias("seqs"))


@query("SELECT path, mtime FROM notes ORDER BY mtime DESC, path LIMIT 10")
def recent_files(v):
    """Latest first."""
    return C.recent(v.notes)


@query("SELECT file_id, string_agg(tag, chr(31) ORDER BY tag) AS tags FROM (SELECT DISTINCT file_id, tag FROM note_tags) GROUP BY file_id")
def file_tags(v):
    """Tags of each note."""
    return C.file_tags(v.note_tags)


_FOLDERS = ", p AS (SELECT c_custkey AS file_id, (['00-Inbox', '01-Projects', 'Areas', 'misc', 'log', 'folk'])[c_nationkey % 6 + 1] AS folder, c_nationkey % 6 AS k, c_custkey % 10 AS d FROM customer), n AS (SELECT folder, count(*) AS notes FROM p GROUP BY folder)"


def _folders(v):
    k = F.col("c_nationkey") % 6
    folder = F.element_at(F.array(*map(F.lit, ("00-Inbox", "01-Projects", "Areas", "misc", "log", "folk"))), k.cast("int") + 1)
    name = F.when((k == 4) & (F.col("c_custkey") % 10 < 7), F.lit("2024-01-02")).otherwise(F.lit("x"))
    return v.table("customer").select(F.col("c_custkey").alias("file_id"), F.concat(folder, F.lit("/"), name, F.lit(" "), "c_custkey", F.lit(".md")).alias("path"))


@query(_FOLDERS + """ SELECT CASE folder WHEN '00-Inbox' THEN 'inbox' WHEN '01-Projects' THEN 'projects' ELSE 'areas' END AS role, folder, 'name' AS found_by, notes FROM n WHERE folder IN ('00-Inbox', '01-Projects', 'Areas')
UNION ALL SELECT 'method', CASE (SELECT count(*) FROM n WHERE folder IN ('00-Inbox', '01-Projects', 'Areas')) WHEN 3 THEN 'para' ELSE 'folders' END, 'shape', 0""")
def vault_profile(v):
    """A vault by numbered folders."""
    return C.profile(_folders(v), v.spark.createDataFrame([], "file_id long"))


@query(_FOLDERS + """ SELECT role, folder, found_by, notes FROM (SELECT 'inbox' AS role, '00-Inbox' AS folder, 'name' AS found_by UNION ALL SELECT 'daily', 'log', 'notes' FROM (SELECT count_if(d < 7) AS a, count(*) AS b FROM p WHERE folder = 'log') WHERE a * 100 // b >= 60
UNION ALL SELECT 'people', 'folk', 'notes' FROM (SELECT count_if(d < 8) AS a, count(*) AS b FROM p WHERE folder = 'folk') WHERE a * 100 // b >= 60) JOIN n USING (folder) UNION ALL SELECT 'method', 'folders', 'shape', 0""")
def vault_profile_by_notes(v):
    """Folders whose notes tell what they are for."""
    notes = _folders(v).where("path not like '01-%' AND path not like 'Areas/%'")
    return C.profile(notes, notes.where("file_id % 10 < 8 AND path like 'folk/%'"))


@query(_FOLDERS + " SELECT 'inbox-pending' AS finding, file_id FROM p WHERE folder = '00-Inbox' UNION ALL SELECT 'work-tag-missing', file_id FROM p WHERE folder = 'misc' AND d % 2 = 1")
def health_hygiene(v):
    """Notes that wait, and notes of work without its tag."""
    notes = _folders(v).withColumn("path", F.regexp_replace("path", "^misc/", "Work/"))
    tags = notes.where("file_id % 2 = 0").select("file_id", F.lit("WORK").alias("tag"))
    return C.hygiene(notes, tags, "00-Inbox/").select("finding", "file_id")


@query("SELECT file_id, name, value, kind FROM props WHERE name = 'priority'")
def properties_of_files(v):
    """A property of all notes."""
    return v.props.where("name = 'priority'").select("file_id", "name", "value", "kind")


@query("SELECT file_id, count(*) AS n_names, string_agg(name || '=' || value, ';' ORDER BY name) AS flat FROM props WHERE value IS NOT NULL GROUP BY file_id")
def note_properties(v):
    """Properties as one map per note (flattened here to compare)."""
    m = C.note_properties(v.props.where("value IS NOT NULL"))
    flat = F.array_join(F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"][0])), ";")
    return m.select("file_id", F.size("properties").cast("long").alias("n_names"), flat.alias("flat"))


@query("SELECT tag, count(DISTINCT file_id) AS notes FROM note_tags WHERE tag = 'src' OR starts_with(tag, 'src/') GROUP BY tag")
def tags_under(v):
    """A1: the vocabulary below a prefix."""
    return C.tags_under(v.note_tags, "src")


@query("SELECT tag, count(DISTINCT file_id) AS notes FROM note_tags GROUP BY tag ORDER BY notes DESC, tag LIMIT 20")
def top_tags(v):
    """A2."""
    return C.top_tags(v.note_tags)


@query("SELECT split_part(tag, '/', 1) AS axis, count(DISTINCT file_id) AS notes FROM note_tags GROUP BY 1")
def tag_axes(v):
    """A3, P9."""
    return C.tag_axes(v.note_tags)


@query("SELECT count(DISTINCT file_id) AS tagged_notes FROM note_tags")
def tagged_file_count(v):
    """A4."""
    return C.tagged_count(v.note_tags)


@query("SELECT name, count(DISTINCT file_id) AS notes, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM props GROUP BY name")
def property_registry(v):
    """A5."""
    return C.property_registry(v.props)


@query("SELECT value, kind, count(DISTINCT file_id) AS notes FROM props WHERE name = 'priority' GROUP BY ALL")
def property_values(v):
    """A6."""
    return C.property_values(v.props, "priority")


@query("SELECT to_file, count(DISTINCT from_file) AS links_in FROM edges GROUP BY to_file ORDER BY links_in DESC, to_file LIMIT 10")
def top_linked_files(v):
    """A7."""
    return C.top_linked(v.edges)


@query(""", ends AS (SELECT from_file AS f FROM edges UNION SELECT to_file FROM edges), o AS (SELECT o_orderkey AS f FROM orders)
SELECT (SELECT count(*) FROM edges) AS total, (SELECT count(*) FROM edges WHERE edge_type = 'wikilink') AS wikilinks,
(SELECT count(*) FROM o WHERE f IN (SELECT f FROM ends)) AS connected, (SELECT count(*) FROM o WHERE f NOT IN (SELECT f FROM ends)) AS isolated""")
def edge_stats(v):
    """A8."""
    return C.edge_stats(v.edges, v.table("orders").select(F.col("o_orderkey").alias("file_id")))


@query("SELECT file_id, count(*) AS edges FROM (SELECT from_file AS file_id FROM edges UNION ALL SELECT to_file FROM edges) GROUP BY file_id")
def edge_counts(v):
    """A9."""
    return C.edge_counts(v.edges)


@query("SELECT CASE WHEN instr(path, '/') > 0 THEN split_part(path, '/', 1) ELSE '(root)' END AS folder, count(*) AS notes FROM notes GROUP BY 1")
def folder_note_counts(v):
    """A10."""
    return C.folder_counts(v.notes)


@query(", s AS (SELECT file_id FROM notes WHERE starts_with(path, 'src1/')) SELECT (SELECT count(*) FROM s) AS files, (SELECT count(*) FROM chunks WHERE file_id IN (SELECT file_id FROM s)) AS chunks, (SELECT count(*) FROM edges WHERE from_file IN (SELECT file_id FROM s)) AS edges")
def totals_in_scope(v):
    """A11."""
    return C.totals(Scope.parse(all=("src1/",)).apply(v.notes), v.chunks, v.edges)


@query("SELECT count(*) AS files, count(note_date) AS dated, max(file_id) + 1 AS next_id FROM notes")
def store_stats(v):
    """A12."""
    return v.notes.agg(F.count(F.lit(1)).alias("files"), F.count("note_date").alias("dated"), (F.max("file_id") + 1).alias("next_id"))


@query(""", r AS (SELECT 'folder' AS section, split_part(path, '/', 1) AS name, count(*) AS n FROM notes GROUP BY ALL),
t AS (SELECT tag, count(DISTINCT file_id) AS c FROM note_tags GROUP BY tag ORDER BY c DESC, tag LIMIT 20),
x AS (SELECT split_part(tag, '/', 1) AS a, count(DISTINCT file_id) AS c FROM note_tags GROUP BY 1),
k AS (SELECT to_file, count(DISTINCT from_file) AS c FROM edges GROUP BY 1 ORDER BY c DESC, to_file LIMIT 10),
m AS (SELECT path, mtime FROM notes ORDER BY mtime DESC, path LIMIT 10)
SELECT * FROM r UNION ALL SELECT 'tag', tag, c FROM t UNION ALL SELECT 'axis', a, c FROM x UNION ALL SELECT 'linked', to_file::VARCHAR, c FROM k UNION ALL SELECT 'recent', path, mtime FROM m""")
def vault_map(v):
    """A13, A14."""
    return C.vault_map(v.notes, v.note_tags, v.edges)


@query("SELECT regexp_replace(path, '/[^/]*$', '') AS folder, count(*) AS notes, sum(regexp_matches(split_part(path, '/', -1), '^\\d{4}-\\d{2}-\\d{2}')::INT)::BIGINT AS daily, max(len(string_split(path, '/')) - 1)::BIGINT AS depth, floor(sum(regexp_matches(split_part(path, '/', -1), '^\\d{4}-\\d{2}-\\d{2}')::INT) * 100 / count(*)) >= 60 AS is_daily FROM notes GROUP BY 1".replace("\\\\", "\\"))
def vault_structure(v):
    """A15, A17."""
    return C.structure(v.notes)


@query(""", d AS (SELECT unnest(['status', 'colour']) AS name, 'text' AS declared), g AS (SELECT name, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM props GROUP BY name)
SELECT 'mixed-kinds' AS rule, name, kinds AS detail FROM g WHERE instr(kinds, ',') > 0 UNION ALL SELECT 'declared-unused', name, declared FROM d WHERE name NOT IN (SELECT name FROM g)""")
def property_findings(v):
    """A16, V12."""
    declared = v.spark.range(1).select(F.explode(F.array(F.lit("status"), F.lit("colour"))).alias("name"), F.lit("text").alias("declared"))
    return C.property_findings(v.props, declared)


@query("SELECT t.tag, n.path FROM note_tags t JOIN notes n USING (file_id) WHERE t.tag = 'lang/fr'")
def join_tags_files(v):
    """Tags to notes."""
    return v.note_tags.where("tag = 'lang/fr'").join(v.notes.select("file_id", "path"), "file_id").select("tag", "path")


@query("SELECT p.file_id, p.name, p.value, c.seq, n.path FROM props p LEFT JOIN chunks c ON c.file_id = p.file_id AND c.seq = 0 LEFT JOIN notes n ON n.file_id = p.file_id WHERE p.name = 'status'")
def join_properties(v):
    """Properties with their chunk and note, outer."""
    c = v.chunks.where("seq = 0").select("file_id", "seq")
    return v.props.where("name = 'status'").join(c, "file_id", "left").join(v.notes.select("file_id", "path"), "file_id", "left").select("file_id", "name", "value", "seq", "path")


@query("SELECT doc_id AS file_id FROM labels WHERE toxic = 1 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def join_anti(v):
    """An anti join."""
    return v.table("labels").where("toxic = 1").select(F.col("doc_id").alias("file_id")).join(v.table("documents").where("lang = 'en'").select(F.col("doc_id").alias("file_id")), "file_id", "left_anti")
