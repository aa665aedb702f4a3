"""Vault lint: every rule as findings (path, line, severity, rule, message).

Rules on one note are plain functions run in Arrow batches; links to notes that do not
exist are an anti join; rules over properties of all notes are aggregates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.operators import catalog, graph
from lumenark.operators import markdown as M

ERRORS = {"unterminated-fence", "malformed-frontmatter", "malformed-wikilink", "file-unreadable"}
LONG_PARAGRAPH = 512 * 4
FIELDS = "file_id long, path string, line long, severity string, rule string, message string"


def _fences(body: str) -> Iterator[tuple[int, str, str]]:
    opened = [i for i, line in enumerate(body.split("\n")) if M._FENCE.match(line)]
    if len(opened) % 2:
        yield opened[-1], "unterminated-fence", "code fence is never closed"


def _frontmatter(content: str) -> Iterator[tuple[int, str, str]]:
    first = content.split("\n", 1)[0].rstrip()
    block, _ = M.split_frontmatter(content)
    if first == "---" and block is None:
        yield 0, "malformed-frontmatter", "frontmatter is never closed"
    if block:
        try:
            if not isinstance(yaml.safe_load(block) or {}, dict):
                yield 0, "malformed-frontmatter", "frontmatter is not a mapping"
        except yaml.YAMLError as e:
            yield 0, "malformed-frontmatter", f"frontmatter is not YAML: {str(e).splitlines()[0]}"
        for i, line in enumerate(block.split("\n"), 1):
            if re.match(r"^\s*(?:[^:#\n]+:|-)\s+\[\[[^\]\n]+\]\]\s*$", line):
                yield i, "unquoted-link", "a link in frontmatter needs quotes"


def _brackets(body: str) -> Iterator[tuple[int, str, str]]:
    for i, line, fenced in M.prose_lines(body):
        line = M._CODE.sub("", line)
        if not fenced and line.count("[[") > len(M._LINK.findall(line)):
            yield i, "malformed-wikilink", "link is never closed"


def _sections(body: str, shortest: int) -> Iterator[tuple[int, str, str]]:
    marks, rows = M.headings(body), body.split("\n")
    titles = [h for h in marks if h.level == 1]
    if not marks or marks[0].level != 1:
        yield 0, "missing-title", "the first heading is not a title"
    for h in titles[1:]:
        yield h.line, "multiple-titles", f"another title: {h.text}"
    stack: list[M.Heading] = []
    seen: set[tuple] = set()
    for k, h in enumerate(marks):
        while stack and stack[-1].level >= h.level:
            stack.pop()
        parent = tuple(x.line for x in stack)
        stack.append(h)
        if (parent, h.text.lower()) in seen:
            yield h.line, "duplicate-sibling", f"a sibling has the heading {h.text}"
        seen.add((parent, h.text.lower()))
        end = marks[k + 1].line if k + 1 < len(marks) else len(rows)
        text = "\n".join(rows[h.line + 1 : end]).strip()
        if not text:
            if k + 1 == len(marks) or marks[k + 1].level <= h.level:
                yield h.line, "empty-section", f"nothing under {h.text}"
        elif len(text) < shortest:
            yield h.line, "short-section", f"{len(text)} characters under {h.text}"


def _paragraphs(body: str) -> Iterator[tuple[int, str, str]]:
    start, part = 0, []
    for i, line, fenced in [*M.prose_lines(body), (body.count("\n") + 1, "", False)]:
        if fenced or not line.strip() or M._ATX.match(line) or re.match(r"^\s*(?:[-*+>|]|\d+[.)])\s?", line):
            n = len("\n".join(part))
            if n > LONG_PARAGRAPH:
                yield start, "long-paragraph", f"{n} characters in one paragraph"
            part = []
        else:
            start = i if not part else start
            part.append(line)


def _tags(content: str) -> Iterator[tuple[int, str, str]]:
    meta = M.load_yaml(M.split_frontmatter(content)[0])
    for key in ("tags", "tag"):
        v = meta.get(key)
        if v is not None and not (isinstance(v, str) or isinstance(v, list) and all(isinstance(x, str) for x in v)):
            yield 0, "malformed-tags", "tags are a list of words"
        elif v is not None:
            for t in [x for s in ([v] if isinstance(v, str) else v) for x in re.split(r"[,\s]+", s) if x] if isinstance(v, str) else v:
                if not re.fullmatch(r"#?[\w/-]*[^\W\d][\w/-]*", t):
                    yield 0, "malformed-tags", f"not a tag: {t}"


_ACCEPTS = {"text": {"text", "link", "number", "empty"}, "number": {"number", "empty"}, "checkbox": {"checkbox", "empty"}, "date": {"text", "empty"}, "datetime": {"text", "empty"}, "multitext": {"text", "link", "number", "empty"}}


def note_findings(content: str, shortest: int = M.ChunkOptions.min_chars, declared: dict[str, str] | None = None) -> list[tuple[int, str, str]]:
    """(line from 1, rule, message) of the rules that need one note only."""
    if "�" in content:
        return [(1, "file-unreadable", "not UTF-8 text")]
    _, body = M.split_frontmatter(content)
    skip = content.count("\n") - body.count("\n")
    out = [(i + 1, r, m) for i, r, m in (*_frontmatter(content), *_tags(content))]
    out += [(i + skip + 1, r, m) for i, r, m in (*_fences(body), *_brackets(body), *_sections(body, shortest), *_paragraphs(body))]
    for name, _, kind in M.properties(content):
        want = (declared or {}).get(name)
        if want in _ACCEPTS and kind not in _ACCEPTS[want]:
            out.append((1, "type-mismatch", f"{name} is declared {want}, found {kind}"))
    return sorted(out)


def lint(notes: DataFrame, shortest: int = M.ChunkOptions.min_chars, declared: dict[str, str] | None = None) -> DataFrame:
    """Findings on each note (file_id, path, content) by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, p, *f) for i, p, t in zip(*(b.column(k).to_pylist() for k in range(3))) for f in note_findings(t or "", shortest, declared)]
            c = list(zip(*rows)) if rows else [[]] * 5
            severity = ["error" if r in ERRORS else "warning" for r in c[3]]
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.string()), pa.array(c[2], pa.int64()), pa.array(severity, pa.string()), pa.array(c[3], pa.string()), pa.array(c[4], pa.string())], names=["file_id", "path", "line", "severity", "rule", "message"])

    return notes.select("file_id", "path", "content").mapInArrow(run, FIELDS)


def unresolvable(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Findings for links (file_id, path, line, target) to no note."""
    known = graph.resolve(links, notes).select("target")
    bad = links.join(known, "target", "left_anti")
    return bad.select("file_id", "path", F.col("line").cast("long").alias("line"), F.lit("warning").alias("severity"), F.lit("unresolvable-wikilink").alias("rule"), F.concat(F.lit("no note "), "target").alias("message"))


def property_rules(props: DataFrame, declared: DataFrame) -> DataFrame:
    f = catalog.property_findings(props, declared)
    return f.select(F.lit(None).cast("long").alias("file_id"), F.lit("").alias("path"), F.lit(0).cast("long").alias("line"), F.lit("warning").alias("severity"), "rule", F.concat("name", F.lit(": "), "detail").alias("message"))


def report(*findings: DataFrame, strict: bool = False) -> DataFrame:
    """Errors, warnings and whether the vault passes."""
    all_ = reduce(DataFrame.unionByName, findings)
    n = all_.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return n.withColumn("ok", (F.col("errors") == 0) & (F.lit(not strict) | (F.col("warnings") == 0)))
