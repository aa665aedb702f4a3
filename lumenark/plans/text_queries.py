"""Text functions, literal match and parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenark.functions import text as T
from lumenark.operators import markdown, match
from lumenark.plans.registry import query


@query("SELECT file_id, seq, ceil(strlen(text) / 4.0)::BIGINT AS chunk_tokens, ceil(length(text) * 100 / 333.0)::BIGINT AS packaging_tokens, (strlen(text) // 4 + 1)::BIGINT AS mock_tokens FROM chunks")
def token_estimates(v):
    """The three token estimates, kept apart."""
    t = F.col("text")
    return v.chunks.select("file_id", "seq", T.chunk_tokens(t).alias("chunk_tokens"), T.packaging_tokens(t).alias("packaging_tokens"), T.mock_tokens(t).alias("mock_tokens"))


@query("SELECT file_id, CASE WHEN strlen(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS snippet FROM notes")
def snippets(v):
    """P7."""
    return v.notes.select("file_id", T.snippet(F.col("text")).alias("snippet"))


@query("SELECT file_id, docid, content_hash FROM notes")
def identities(v):
    """S3, short ids and content hashes."""
    return v.notes.select("file_id", "docid", "content_hash")


@query("SELECT name, value, kind, count(*) AS n FROM props GROUP BY ALL")
def value_kinds(v):
    """P13."""
    return v.props.groupBy("name", "value", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT file_id, string_agg(DISTINCT tag, ' ' ORDER BY tag) AS tags_text FROM note_tags GROUP BY file_id")
def lexical_fields(v):
    """P18."""
    return v.note_tags.groupBy("file_id").agg(F.collect_list("tag").alias("t")).select("file_id", T.tags_text(F.col("t")).alias("tags_text"))


@query("SELECT file_id, path || ' > ' || created_by || ' > ' || docid AS breadcrumb, path || chr(10) || text AS input FROM notes")
def breadcrumbs(v):
    """Breadcrumb and prefixed embedding input."""
    return v.notes.select("file_id", T.breadcrumb(F.col("path"), F.array("created_by", "docid")).alias("breadcrumb"), F.concat_ws("\n", "path", "text").alias("input"))


@query("SELECT event_id, epoch(date_trunc('day', ts))::BIGINT AS note_date FROM events")
def note_dates(v):
    """A date within a path."""
    path = F.concat(F.lit("log/"), F.date_format("ts", "yyyy-MM-dd"), F.lit("-note.md"))
    return v.table("events").select("event_id", T.note_date(F.lit(None).cast("string"), path).alias("note_date"))


_LINKED = "'See [[' || split_part(url, '/', 3) || '#Top|the site]] and [[' || split_part(url, '/', 3) || ']] or ![[img]].'"


@query(f", t AS (SELECT page_id, split_part(url, '/', 3) AS h, {_LINKED} AS x FROM pages) SELECT page_id, h || '#Top,' || h AS links, 'See the site and ' || h || ' or img.' AS rendered FROM t")
def wikilinks(v):
    """Links of a text, and the text as it reads."""
    h = F.split_part("url", F.lit("/"), F.lit(3))
    text = F.concat(F.lit("See [["), h, F.lit("#Top|the site]] and [["), h, F.lit("]] or ![[img]]."))
    return v.table("pages").select("page_id", F.array_join(T.wikilinks(text), ",").alias("links"), T.render_wikilinks(text).alias("rendered"))


@query("SELECT file_id, target FROM links")
def page_links(v):
    """Links of pages, distinct per page."""
    return v.links.select("file_id", "target")


@query("SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name)::INT AS far, round(1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)), 6) AS near FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def name_distances(v):
    """Edit distances within a region."""
    a = v.table("nation").select("n_regionkey", F.col("n_nationkey").alias("ka"), F.col("n_name").alias("a"))
    b = v.table("nation").select("n_regionkey", F.col("n_nationkey").alias("kb"), F.col("n_name").alias("b"))
    return a.join(b, "n_regionkey").where("ka < kb").select("a", "b", F.levenshtein("a", "b").alias("far"), F.round(T.normalized_levenshtein(F.col("a"), F.col("b")), 6).alias("near"))


def _lines(v):
    return v.lines.join(v.notes.select("file_id", "path"), "file_id").withColumn("heading_path", F.lit(""))


_HITS = ", h AS (SELECT file_id, path, l.text AS line, min(seq) AS seq FROM lines l JOIN notes USING (file_id) WHERE {} GROUP BY ALL) "


@query(_HITS.format("contains(lower(l.text), 'the was')") + "SELECT file_id, path, line, seq FROM h ORDER BY path, seq, line LIMIT 50")
def match_page(v):
    """M1, M2, M4: the first lines that hold a phrase, in any case."""
    m = match.Match("the was")
    return match.page(match.hits(match.lines(_lines(v)), m)).select("file_id", "path", "line", "seq")


@query(_HITS.format("contains(lower(l.text), 'the was')") + "SELECT count(DISTINCT file_id) AS notes, count(*) AS lines FROM h")
def match_counts(v):
    """M1: counts are never cut."""
    return match.counts(match.hits(match.lines(_lines(v)), match.Match("the was")))


@query(_HITS.format(r"regexp_matches(lower(l.text), '(^|[^\p{L}\p{N}_])ing($|[^\p{L}\p{N}_])')") + "SELECT count(DISTINCT file_id) AS notes, count(*) AS lines FROM h")
def match_word(v):
    """M3: whole words."""
    return match.counts(match.hits(match.lines(_lines(v)), match.Match("ing", word=True)))


@query(_HITS.format("contains(l.text, 'The ')") + "SELECT count(DISTINCT file_id) AS notes, count(*) AS lines FROM h")
def match_case(v):
    """M5: in this case only."""
    return match.counts(match.hits(match.lines(_lines(v)), match.Match("The ", case_sensitive=True)))


@query(r", f AS (SELECT DISTINCT file_id FROM (SELECT file_id, 'source: ' || created_by AS line FROM notes) WHERE contains(line, 'src1')) SELECT count(*) AS notes, count(*) AS lines FROM f")
def match_frontmatter(v):
    """M5, M6: frontmatter only; refused if some note's was never recorded."""
    front = v.notes.select("file_id", "path", F.concat(F.lit("source: "), "created_by").alias("frontmatter"))
    match.require_frontmatter(front)
    return match.counts(match.hits(match.lines(_lines(v), front), match.Match("src1", part="frontmatter")))


def _markdown(v):
    """Notes made of conversations: a title, a section per turn, of all turns."""
    turn = F.concat(F.lit("## "), "role", F.lit(" "), "turn", F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\n"))
    rows = v.table("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", turn.alias("t")))).alias("ts"))
    body = F.concat(F.lit("---\ntags: [chat/log]\nrating: 5\n---\n# Conversation "), "conv_id", F.lit("\n\n"), F.array_join(F.transform("ts", lambda x: x["t"]), ""))
    return rows.select(F.col("conv_id").alias("file_id"), F.concat(F.lit("chat/"), "conv_id", F.lit(".md")).alias("path"), body.alias("content"))


@query("SELECT DISTINCT conv_id AS file_id, 'rating' AS name, '5' AS value, 'number' AS kind, 'chat/log' AS tag FROM conversations")
def parse_notes(v):
    """Frontmatter, tags and properties of notes."""
    p = markdown.parse(_markdown(v)).select("file_id", F.inline("properties"), F.col("tags")[0]["folded"].alias("tag"))
    return p.where("name = 'rating'")


#: Chunks of more than 512 tokens (2048 bytes) are cut at sentence ends: a part is a range of sentences (a, b) with as many
#: as fit; the next one opens with those last ones that make 50 tokens at most and leave room for the sentence that follows.
_PIECES = r""",
big AS (SELECT file_id, n, heading_path, regexp_extract_all(text, '(?s).+?(?:\. |\n|\z)') AS ss FROM made WHERE strlen(text) > 2048),
ends AS (SELECT *, len(ss) AS m, [list_sum([strlen(x) FOR x IN ss[:j]]) FOR j IN range(0, len(ss) + 1)] AS c0 FROM big),
sums AS (SELECT * EXCLUDE (c0), [coalesce(x, 0)::BIGINT FOR x IN c0] AS c FROM ends),
parts AS (SELECT file_id, n, 0 AS part, 1::BIGINT AS a, (1 + len([j FOR j IN range(2, m + 1) IF c[j + 1] <= 2048]))::BIGINT AS b FROM sums
    UNION ALL SELECT file_id, n, part + 1, a, (b + len([j FOR j IN range(b + 1, m + 1) IF c[j + 1] - c[a] <= 2048]))::BIGINT
        FROM (SELECT p.file_id, p.n, part, m, c, b + 1 - len([j FOR j IN range(a, b + 1) IF c[b + 1] - c[j] <= 200 AND c[b + 2] - c[j] <= 2048]) AS a, b + 1 AS b
            FROM parts p JOIN sums s ON s.file_id = p.file_id AND s.n = p.n WHERE b < m)),
pieces AS (SELECT file_id, n, 0 AS part, heading_path, text FROM made WHERE strlen(text) <= 2048
    UNION ALL SELECT p.file_id, p.n, part, heading_path, regexp_replace(array_to_string(ss[a:b], ''), '^\s+|\s+$', '', 'g') FROM parts p JOIN sums s ON s.file_id = p.file_id AND s.n = p.n)
SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY n, part) - 1 AS seq, heading_path, ceil(strlen(text) / 4.0)::BIGINT AS token_count, md5(text) AS text_md5 FROM pieces"""
#: Sections of a conversation in order: one under 120 bytes joins the chunk before, if there is room; a heading without a
#: body goes to the next section. (The texts have no blank lines, so a section is one paragraph.)
_SECTIONS = r"""
, turns AS (SELECT conv_id AS file_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS k, role || ' ' || turn AS head, trim(coalesce(text, ''), chr(10) || ' ') AS t FROM conversations),
grown AS (SELECT DISTINCT file_id, 0::BIGINT AS k, 0 AS n, '' AS path, '' AS text, '' AS lead FROM turns
    UNION ALL SELECT file_id, k, CASE WHEN t = '' OR joins THEN n ELSE n + 1 END, CASE WHEN t = '' OR joins THEN path ELSE 'Conversation ' || file_id || ' > ' || head END,
        CASE WHEN t = '' THEN text WHEN joins THEN text || chr(10) || chr(10) || whole ELSE whole END, CASE WHEN t = '' THEN lead || '## ' || head || chr(10) ELSE '' END
        FROM (SELECT *, n > 0 AND strlen(t) < 120 AND ceil(strlen(text) / 4.0) + ceil(strlen(whole) / 4.0) <= 542 AS joins
            FROM (SELECT g.file_id, x.k, n, path, text, lead, head, t, lead || '## ' || head || chr(10) || t AS whole FROM grown g JOIN turns x ON x.file_id = g.file_id AND x.k = g.k + 1))),
last AS (SELECT file_id, n, path AS heading_path, text, lead, row_number() OVER (PARTITION BY file_id ORDER BY k DESC) AS back, row_number() OVER (PARTITION BY file_id, n ORDER BY k DESC) AS newest FROM grown),
made AS (SELECT file_id, n, heading_path, CASE WHEN back > 1 OR lead = '' THEN text WHEN n = 0 THEN rtrim(lead, chr(10)) ELSE text || chr(10) || chr(10) || rtrim(lead, chr(10)) END AS text
    FROM last WHERE newest = 1 AND (n > 0 OR back = 1))"""


@query(_SECTIONS + _PIECES.replace(", md5(text) AS text_md5", ""), recursive=True)
def chunk_notes(v):
    """Notes as chunks under their heading paths."""
    return markdown.chunk(_markdown(v)).select("file_id", "seq", "heading_path", "token_count")


@query(_SECTIONS + _PIECES, recursive=True)
def chunk_texts(v):
    """The chunks' texts, by digest."""
    return markdown.chunk(_markdown(v)).select("file_id", "seq", "heading_path", "token_count", F.md5("text").alias("text_md5"))


@query(", made AS (SELECT doc_id AS file_id, 1 AS n, CASE WHEN trim(coalesce(text, '')) = '' THEN '' ELSE 'Note ' || doc_id END AS heading_path, '# Note ' || doc_id || CASE WHEN trim(coalesce(text, '')) = '' THEN '' ELSE chr(10) || text END AS text FROM documents)" + _PIECES, recursive=True)
def split_notes(v):
    """Sections of any length cut at sentence ends, with what they share."""
    d = v.table("documents")
    content = F.concat(F.lit("# Note "), "doc_id", F.lit("\n"), F.coalesce("text", F.lit("")))
    chunks = markdown.chunk(d.select(F.col("doc_id").alias("file_id"), F.lit("").alias("path"), content.alias("content")))
    return chunks.select("file_id", "seq", "heading_path", "token_count", F.md5("text").alias("text_md5"))


#: Expressions that Spark and the oracle read alike: notes of conversations with tags, aliases, fields and bold headings.
_META = """'---' || chr(10) || 'tags: ' || CASE conv_id % 3 WHEN 0 THEN '[One, two/Three]' WHEN 1 THEN 'One, two' ELSE chr(10) || '  - One' || chr(10) || '  - 2024' END
    || chr(10) || 'aliases: ' || CASE conv_id % 2 WHEN 0 THEN '[The Talk, the talk, Talk ' || conv_id || ']' ELSE 'Talk ' || conv_id END || chr(10) || '---' || chr(10) || '# Conversation ' || conv_id"""
_SAID = """CASE turn % 2 WHEN 0 THEN '## ' || role || chr(10) ELSE '' END || CASE turn % 3
    WHEN 0 THEN '#' || role || '/' || turn || ' said' || chr(10) || 'speaker:: [[' || role || ']] and [[note ' || turn || ']]'
    WHEN 1 THEN 'length:: ' || length(t) || chr(10) || '`#code` and (mood:: calm)'
    ELSE '```' || chr(10) || '#fenced' || chr(10) || '# fenced' || chr(10) || 'fenced:: x' || chr(10) || '```' || chr(10) || '- done:: true' END
    || chr(10) || '**Turn ' || turn || ':**' || chr(10) || t"""
_NOTED = f""", c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations),
ids AS (SELECT DISTINCT conv_id AS file_id FROM c),
md AS (SELECT conv_id AS file_id, {_META} || chr(10) || string_agg(s, chr(10) ORDER BY turn, s) AS content FROM (SELECT conv_id, turn, {_SAID} AS s FROM c) GROUP BY conv_id)"""
_OUTLINE = _NOTED + r""", l AS (SELECT file_id, generate_subscripts(string_split(content, chr(10)), 1) AS line, unnest(string_split(content, chr(10))) AS x FROM md),
f AS (SELECT *, sum(starts_with(x, '```')::INT) OVER (PARTITION BY file_id ORDER BY line) % 2 = 1 AS fenced FROM l),
h AS (SELECT file_id, line, CASE WHEN starts_with(x, '#') THEN length(regexp_extract(x, '^#+')) ELSE 255 END AS level, CASE WHEN starts_with(x, '#') THEN regexp_extract(x, '^#+ (.*)$', 1) ELSE regexp_extract(x, '^\*\*(.*?):?\*\*$', 1) END AS heading
    FROM f WHERE NOT fenced AND regexp_matches(x, '^(#{1,6} |\*\*.*\*\*$)'))"""


def _noted(v):
    turns = v.table("conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("t")).select("conv_id", F.struct("turn", F.expr(_SAID).alias("s")).alias("x"))
    notes = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("x"))["s"].alias("s"))
    return notes.select(F.col("conv_id").alias("file_id"), F.concat(F.lit("chat/"), "conv_id", F.lit(".md")).alias("path"), F.concat(F.expr(_META), F.lit("\n"), F.array_join("s", "\n")).alias("content"))


@query(_OUTLINE + "SELECT file_id, line, level, heading FROM h")
def note_headings(v):
    """Headings outside fences, and bold lines as headings."""
    return markdown.outline(_noted(v)).select("file_id", "line", "level", "heading")


@query(_OUTLINE + """, p AS (SELECT *, lead(line) OVER w AS until, last_value(CASE WHEN level < 255 THEN heading END IGNORE NULLS) OVER w AS above FROM h WINDOW w AS (PARTITION BY file_id ORDER BY line)),
spot AS (SELECT file_id, min(line) AS line, arg_min(until, line) AS until FROM p WHERE level = 255 AND above = 'user' AND heading = 'Turn 2' GROUP BY file_id)
SELECT l.file_id, string_agg(x, chr(10) ORDER BY l.line) AS text FROM l JOIN spot USING (file_id) WHERE l.line >= spot.line AND (until IS NULL OR l.line < until) GROUP BY l.file_id""")
def note_sections(v):
    """A section by its path, over all notes."""
    return markdown.sections(_noted(v), "user > Turn 2").select("file_id", "text")


@query(_NOTED + """SELECT DISTINCT file_id, lower(tag) AS folded, tag AS display FROM (
    SELECT file_id, unnest(CASE file_id % 3 WHEN 0 THEN ['One', 'two/Three'] WHEN 1 THEN ['One', 'two'] ELSE ['One'] END) AS tag FROM ids UNION ALL SELECT conv_id, role || '/' || turn FROM c WHERE turn % 3 = 0)""")
def note_tags_found(v):
    """Tags of the frontmatter in three forms, and of the body outside code."""
    return markdown.parse(_noted(v)).select("file_id", F.inline("tags"))


@query(_NOTED + "SELECT file_id, lower(a) AS folded, a AS display FROM (SELECT file_id, unnest(CASE file_id % 2 WHEN 0 THEN ['The Talk', 'Talk ' || file_id] ELSE ['Talk ' || file_id] END) AS a FROM ids)")
def note_aliases(v):
    """P10: aliases as a list or a scalar, folded and without repeats."""
    return markdown.parse(_noted(v)).select("file_id", F.inline("aliases"))


@query(_NOTED + """SELECT conv_id AS file_id, name, value, kind, count(*) AS n FROM (
    SELECT conv_id, 'speaker' AS name, unnest(['[[' || role || ']]', '[[note ' || turn || ']]']) AS value, 'link' AS kind FROM c WHERE turn % 3 = 0
    UNION ALL SELECT conv_id, 'length', length(t)::VARCHAR, 'number' FROM c WHERE turn % 3 = 1 UNION ALL SELECT conv_id, 'mood', 'calm', 'text' FROM c WHERE turn % 3 = 1
    UNION ALL SELECT conv_id, 'done', 'true', 'checkbox' FROM c WHERE turn % 3 = 2) GROUP BY ALL""")
def note_fields(v):
    """Inline fields of lines and in brackets, links one by one."""
    return markdown.parse(_noted(v)).select("file_id", F.inline("properties")).groupBy("file_id", "name", "value", "kind").agg(F.count(F.lit(1)).alias("n"))
