"""Lint over notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenark.operators import lint as L
from lumenark.plans.registry import query
from lumenark.plans.text_queries import _markdown

#: Expressions that Spark and the oracle read alike: a turn of a conversation as a section that
#: some rule finds or passes, and the opening and the end of a note.
_TURN = """CASE (conv_id + turn) % 8
    WHEN 0 THEN '## ' || role || chr(10) || chr(10) || t || chr(10)
    WHEN 1 THEN '### ' || role || ' ' || turn || ' ##' || chr(10) || t || chr(10)
    WHEN 2 THEN '## empty ' || turn || chr(10) || chr(10)
    WHEN 3 THEN '## code' || chr(10) || '```python' || chr(10) || '# no heading' || chr(10) || '[[no link' || chr(10) || '```' || chr(10) || t
    WHEN 4 THEN '## Code' || chr(10) || 'See [[' || role || ' and [[' || role || ']] or `[[`.' || chr(10) || chr(10) || t
    WHEN 5 THEN '# ' || role || chr(10) || t
    WHEN 6 THEN '## short' || chr(10) || 'Only this.' || chr(10)
    ELSE '## long ' || turn || chr(10) || repeat(replace(t, chr(10), ' ') || ' ', 12) || chr(10) || '- item' END"""
_HEAD = """CASE conv_id % 6
    WHEN 0 THEN '---' || chr(10) || 'tags: [chat/log]' || chr(10) || 'rating: 5' || chr(10) || '---' || chr(10) || '# Conversation ' || conv_id
    WHEN 1 THEN '---' || chr(10) || 'tags: 5' || chr(10) || 'rating: high' || chr(10) || '---'
    WHEN 2 THEN '---' || chr(10) || 'title: x' || chr(10) || '# Conversation ' || conv_id
    WHEN 3 THEN '# Conversation ' || conv_id || CASE WHEN conv_id % 12 = 3 THEN '�' ELSE '' END
    WHEN 4 THEN '---' || chr(10) || 'related: [[Other note]]' || chr(10) || 'tags: [a b, ok, 9to5, 2024-01]' || chr(10) || '---' || chr(10) || '# Conversation ' || conv_id
    ELSE '---' || chr(10) || 'just words' || chr(10) || '---' || chr(10) || '# Conversation ' || conv_id END"""
_TAIL = "CASE conv_id % 6 WHEN 5 THEN chr(10) || '```' || chr(10) || 'open' ELSE '' END"
_FAULTY = f""", md AS (SELECT conv_id AS file_id, {_HEAD} || chr(10) || string_agg(s, chr(10) ORDER BY turn, s) || {_TAIL} AS content
    FROM (SELECT conv_id, turn, {_TURN} AS s FROM (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations)) GROUP BY conv_id)"""
_PLAIN = """, md AS (SELECT conv_id AS file_id, '---' || chr(10) || 'tags: [chat/log]' || chr(10) || 'rating: 5' || chr(10) || '---' || chr(10) || '# Conversation ' || conv_id || chr(10) || chr(10)
    || string_agg('## ' || role || ' ' || turn || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10), '' ORDER BY turn) AS content FROM conversations GROUP BY conv_id)"""

#: Every rule on one note, over md (file_id, content): findings (file_id, line, severity, rule). The fences of these
#: notes are plain ones, so the parity of the fence lines says what is inside; lines count from 1 in the whole note.
_RULES = r"""
, cut AS (SELECT file_id, content, string_split(content, chr(10)) AS ls FROM md WHERE NOT contains(content, '�')),
closed AS (SELECT file_id, ls, rtrim(ls[1]) = '---' AS opened, CASE WHEN rtrim(ls[1]) = '---' THEN coalesce(list_position([rtrim(x) FOR x IN ls[2:]], '---'), 0) ELSE 0 END AS c FROM cut),
front AS (SELECT *, CASE WHEN c > 0 THEN c + 1 ELSE 0 END AS skip FROM closed),
l AS (SELECT file_id, opened, c, skip, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM front),
block AS (SELECT * FROM l WHERE c > 0 AND i > 1 AND i <= c),
tags AS (SELECT file_id, regexp_extract(line, '^tags: (.*)$', 1) AS v FROM block WHERE starts_with(line, 'tags: ')),
tag AS (SELECT file_id, trim(unnest(string_split(trim(v, '[]'), ','))) AS t FROM tags WHERE starts_with(v, '[')),
marked AS (SELECT file_id, i, skip, line, regexp_matches(line, '^\s{0,3}(```+|~~~+)') AS mark FROM l WHERE i > skip),
body AS (SELECT *, mark OR sum(mark::INT) OVER (PARTITION BY file_id ORDER BY i) % 2 = 1 AS fenced, regexp_matches(line, '^#{1,6}([ 	]|$)') AS atx FROM marked),
heads AS (SELECT file_id, i, length(regexp_extract(line, '^#{1,6}')) AS level, lower(trim(regexp_extract(line, '^#{1,6}(?:[ 	]+(.*?))?(?:[ 	]+#+)?[ 	]*$', 1))) AS name FROM body WHERE atx AND NOT fenced),
placed AS (SELECT *, lead(i) OVER w AS nexti, lead(level) OVER w AS nextlevel, row_number() OVER w AS k, row_number() OVER (PARTITION BY file_id, level ORDER BY i) AS same FROM heads WINDOW w AS (PARTITION BY file_id ORDER BY i)),
under AS (SELECT a.file_id, a.i, a.name, coalesce((SELECT max(b.i) FROM heads b WHERE b.file_id = a.file_id AND b.i < a.i AND b.level < a.level), 0) AS parent FROM heads a),
sections AS (SELECT p.file_id, i, level, nextlevel, regexp_replace(array_to_string(ls[i + 1 : coalesce(nexti, len(ls) + 1) - 1], chr(10)), '^\s+|\s+$', '', 'g') AS text FROM placed p JOIN front USING (file_id)),
prose AS (SELECT *, fenced OR atx OR trim(line) = '' OR regexp_matches(line, '^\s*(?:[-*+>|]|\d+[.)])\s?') AS stops FROM body),
paragraphs AS (SELECT *, sum(stops::INT) OVER (PARTITION BY file_id ORDER BY i) AS g FROM prose),
found AS (SELECT file_id, 1 AS line, 'file-unreadable' AS rule FROM md WHERE contains(content, '�')
    UNION ALL SELECT file_id, 1, 'malformed-frontmatter' FROM front WHERE opened AND c = 0
    UNION ALL SELECT file_id, 1, 'malformed-frontmatter' FROM block GROUP BY file_id HAVING count_if(regexp_matches(line, '^\S+:( |$)')) = 0
    UNION ALL SELECT file_id, i, 'unquoted-link' FROM block WHERE regexp_matches(line, '^\s*(?:[^:#\n]+:|-)\s+\[\[[^\]\n]+\]\]\s*$')
    UNION ALL SELECT file_id, 1, 'malformed-tags' FROM tags WHERE regexp_matches(v, '^\d+$')
    UNION ALL SELECT file_id, 1, 'malformed-tags' FROM tag WHERE NOT regexp_full_match(t, '#?[\w/-]*[A-Za-z_][\w/-]*')
    UNION ALL SELECT file_id, 1, 'type-mismatch' FROM block WHERE starts_with(line, 'rating: ') AND NOT regexp_matches(line, '^rating: \d+$')
    UNION ALL SELECT file_id, max(i) FILTER (mark), 'unterminated-fence' FROM body GROUP BY file_id HAVING count_if(mark) % 2 = 1
    UNION ALL SELECT file_id, i, 'malformed-wikilink' FROM (SELECT file_id, i, regexp_replace(line, '`[^`]*`', '', 'g') AS s FROM body WHERE NOT fenced)
        WHERE (length(s) - length(replace(s, '[[', ''))) / 2 > len(regexp_extract_all(s, '\[\[.+?\]\]'))
    UNION ALL SELECT f.file_id, skip + 1, 'missing-title' FROM front f LEFT JOIN placed p ON p.file_id = f.file_id AND k = 1 WHERE level IS NULL OR level <> 1
    UNION ALL SELECT file_id, i, 'multiple-titles' FROM placed WHERE level = 1 AND same > 1
    UNION ALL SELECT file_id, i, 'duplicate-sibling' FROM (SELECT *, row_number() OVER (PARTITION BY file_id, parent, name ORDER BY i) AS n FROM under) WHERE n > 1
    UNION ALL SELECT file_id, i, 'empty-section' FROM sections WHERE text = '' AND (nextlevel IS NULL OR nextlevel <= level)
    UNION ALL SELECT file_id, i, 'short-section' FROM sections WHERE text <> '' AND length(text) < 120
    UNION ALL SELECT file_id, min(i), 'long-paragraph' FROM paragraphs WHERE NOT stops GROUP BY file_id, g HAVING sum(length(line)) + count(*) - 1 > 2048),
findings AS (SELECT file_id, line::BIGINT AS line, CASE WHEN rule IN ('unterminated-fence', 'malformed-frontmatter', 'malformed-wikilink', 'file-unreadable') THEN 'error' ELSE 'warning' END AS severity, rule FROM found)
"""


def _faulty(v):
    """Notes of conversations that break each rule somewhere, and keep it elsewhere."""
    turns = v.table("conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("t")).select("conv_id", F.struct("turn", F.expr(_TURN).alias("s")).alias("x"))
    notes = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("x"))["s"].alias("s"))
    content = F.concat(F.expr(_HEAD), F.lit("\n"), F.array_join("s", "\n"), F.expr(_TAIL))
    return notes.select(F.col("conv_id").alias("file_id"), F.concat(F.lit("chat/"), "conv_id", F.lit(".md")).alias("path"), content.alias("content"))


@query(_FAULTY + _RULES + "SELECT * FROM findings")
def lint_rules(v):
    """Every finding on notes that break the rules."""
    return L.lint(_faulty(v), declared={"rating": "number"}).select("file_id", "line", "severity", "rule")


@query(_FAULTY + _RULES + "SELECT count_if(severity = 'error')::BIGINT AS errors, count_if(severity = 'warning')::BIGINT AS warnings, count_if(severity = 'error') = 0 AS ok FROM findings")
def lint_report_all(v):
    """The verdict of all rules."""
    return L.report(L.lint(_faulty(v), declared={"rating": "number"}))


def _notes(v):
    return v.notes.select("file_id", "path", F.col("text").alias("content"))


@query("SELECT file_id, 1::BIGINT AS line, 'warning' AS severity FROM notes WHERE text IS NULL OR NOT regexp_matches(text, '(^|\\n) {0,3}#{1,6}([ \\t]|$)')".replace("\\\\", "\\"))
def lint_missing_title(v):
    """V5: notes without a title."""
    return L.lint(_notes(v)).where("rule = 'missing-title'").select("file_id", "line", "severity")


@query(_PLAIN + _RULES + "SELECT rule, severity, count(*) AS n FROM findings GROUP BY ALL")
def lint_all(v):
    """V1 to V11 on structured notes."""
    return L.lint(_markdown(v)).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(", f AS (SELECT doc_id FROM documents) SELECT 0::BIGINT AS errors, count(*) AS warnings, true AS ok FROM f")
def lint_report(v):
    """Errors, warnings and the verdict (here of the title rule)."""
    return L.report(L.lint(_notes(v)).where("rule = 'missing-title'"))


@query("SELECT file_id, target FROM links WHERE target NOT IN (SELECT target FROM links l JOIN (SELECT DISTINCT '/' || split_part(c_name, '#', 1) AS t FROM customer) ON t = target)")
def lint_unresolvable(v):
    """Links to no note."""
    links = v.links.select("file_id", F.lit("").alias("path"), F.lit(1).alias("line"), "target")
    notes = v.table("customer").select(F.col("c_custkey").alias("file_id"), F.col("c_name").alias("path"))
    return L.unresolvable(links, notes).select("file_id", F.substr("message", F.lit(9)).alias("target"))
