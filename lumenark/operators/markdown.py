"""Markdown notes as structure: frontmatter, headings, sections, chunks, tags,
aliases, properties. Plain functions on one note; ``parse`` and ``chunk`` run them in
Arrow batches."""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame

_FENCE = re.compile(r"^\s{0,3}(```+|~~~+)")
_ATX = re.compile(r"^(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_BOLD = re.compile(r"^\s*(?:\*\*(?!\s)([^*\n]+?)(?<!\s)\*\*|__(?!\s)([^_\n]+?)(?<!\s)__):?\s*$")
_TAG = re.compile(r"(?<![\w/#&])#([\w/-]+)")
_CODE = re.compile(r"`[^`\n]*`")
_INLINE = re.compile(r"[\[(]([^\[\]()\n:]+)::\s*([^\n]*?)[\])]")
_FIELD = re.compile(r"^\s*(?:[-*]\s+)?([A-Za-z_][\w -]*?)::\s*(.*)$")
_LINK = re.compile(r"(!?)\[\[((?:(?!\]\])[^\n])+)\]\]")
BUILT_IN = {"tags", "tag", "aliases", "alias", "cssclasses", "cssclass"}
#: The level of a line promoted to a heading because it is bold and nothing else.
PROMOTED = 255


@dataclass(frozen=True)
class Heading:
    line: int
    level: int
    text: str


@dataclass(frozen=True)
class ChunkOptions:
    target_tokens: int = 512
    overlap_tokens: int = 50
    min_chars: int = 120
    promote_bold: bool = True
    carry_orphans: bool = True


def tokens(text: str) -> int:
    return -(-len(text.encode()) // 4)


def split_frontmatter(content: str) -> tuple[str | None, str]:
    """The block between a first line ``---`` and the next one, and the rest."""
    all_lines = content.split("\n")
    if all_lines[0].rstrip() == "---":
        for i in range(1, len(all_lines)):
            if all_lines[i].rstrip() == "---":
                return "\n".join(all_lines[1:i]), "\n".join(all_lines[i + 1 :])
    return None, content


def prose_lines(body: str) -> Iterator[tuple[int, str, bool]]:
    """(number, line, inside a fence)."""
    fence = None
    for i, line in enumerate(body.split("\n")):
        m = _FENCE.match(line)
        if m and fence is None:
            fence = m[1]
            yield i, line, True
        elif m and fence and m[1][0] == fence[0] and len(m[1]) >= len(fence) and line.strip() == m[1]:
            fence = None
            yield i, line, True
        else:
            yield i, line, fence is not None


def headings(body: str, promote_bold: bool = False) -> list[Heading]:
    out = []
    for i, line, fenced in prose_lines(body):
        if fenced:
            continue
        m = _ATX.match(line)
        if m:
            out.append(Heading(i, len(m[1]), (m[2] or "").strip()))
        elif promote_bold and (b := _BOLD.match(line)):
            out.append(Heading(i, PROMOTED, (b[1] or b[2]).strip().rstrip(":")))
    return out


def heading_key(text: str) -> str:
    return re.sub(r"\s*\(cont\.\)\s*$", "", re.sub(r"^#+\s*", "", text)).strip().lower()


def find_section(body: str, wanted: str) -> tuple[int, int] | None:
    """(heading line, line after the section) by text or by ``A > B`` path; a section
    ends at the next heading of its level or above."""
    found, path = headings(body, True), [heading_key(x) for x in wanted.split(" > ")]
    stack: list[Heading] = []
    for k, h in enumerate(found):
        while stack and stack[-1].level >= h.level:
            stack.pop()
        stack.append(h)
        here = [heading_key(x.text) for x in stack]
        if here[-len(path) :] == path:
            end = next((n.line for n in found[k + 1 :] if n.level <= h.level), len(body.split("\n")))
            return h.line, end
    return None


def chunk_note(content: str, o: ChunkOptions = ChunkOptions()) -> list[dict]:
    """Chunks (seq, heading, heading_path, text): one per section between headings;
    sections over the target are packed by paragraphs under a repeated heading;
    sections under ``min_chars`` bytes join the chunk before; headings without a body
    are carried into the next section (or the last chunk)."""
    _, body = split_frontmatter(content)
    if not body.strip():
        return []
    rows = body.split("\n")
    marks = headings(body, o.promote_bold)
    # a promoted line without a body is no heading
    ends = [m.line for m in marks[1:]] + [len(rows)]
    marks = [m for m, e in zip(marks, ends) if m.level != PROMOTED or "\n".join(rows[m.line + 1 : e]).strip()]
    out: list[dict] = []

    def put(heading: str, path: list[str], head: list[str], text: str) -> None:
        lead = "\n".join(head)
        whole = "\n".join(x for x in (lead, text.strip("\n")) if x).strip()
        if not whole:
            return
        if out and text.strip() and len(text.strip().encode()) < o.min_chars and tokens(out[-1]["text"]) + tokens(whole) <= o.target_tokens + o.min_chars // 4:
            out[-1]["text"] += "\n\n" + whole
            return
        if tokens(whole) <= o.target_tokens:
            out.append({"heading": heading, "heading_path": list(path), "text": whole})
            return
        budget, part = o.target_tokens - tokens(lead), []
        for p in re.split(r"\n\s*\n", text.strip("\n")):
            if part and tokens("\n\n".join([*part, p])) > budget:
                out.append({"heading": heading, "heading_path": list(path), "text": "\n".join(x for x in (lead, "\n\n".join(part)) if x)})
                part = []
            part.append(p)
        out.append({"heading": heading, "heading_path": list(path), "text": "\n".join(x for x in (lead, "\n\n".join(part)) if x)})

    put("", [], [], "\n".join(rows[: marks[0].line if marks else len(rows)]))
    stack: list[Heading] = []
    carried: list[str] = []
    for k, h in enumerate(marks):
        while stack and stack[-1].level >= h.level:
            stack.pop()
        stack.append(h)
        end = marks[k + 1].line if k + 1 < len(marks) else len(rows)
        text = "\n".join(rows[h.line + 1 : end])
        if not text.strip():
            deeper = k + 1 < len(marks) and h.level < marks[k + 1].level < PROMOTED
            if o.carry_orphans and not deeper:
                carried.append(rows[h.line].rstrip())
            continue
        put(h.text, [x.text for x in stack], [*carried, rows[h.line].rstrip()], text)
        carried = []
    if carried:
        if out:
            out[-1]["text"] += "\n\n" + "\n".join(carried)
        else:
            out.append({"heading": "", "heading_path": [], "text": "\n".join(carried)})
    return [{"seq": i, **c} for i, c in enumerate(out)]


def split_oversized(chunks: list[dict], count, limit: int, overlap: int) -> list[dict]:
    """Chunks over ``limit`` tokens (by ``count``) cut at sentence ends and line ends;
    each piece opens with up to ``overlap`` tokens of the one before."""
    out = []
    for c in chunks:
        if count(c["text"]) <= limit:
            out.append(dict(c))
            continue
        part: list[str] = []
        for s in re.findall(r".+?(?:\. |\n|\Z)", c["text"], re.S):
            if part and count("".join([*part, s])) > limit:
                out.append({**c, "text": "".join(part).strip()})
                kept: list[str] = []
                for old in reversed(part):
                    if count("".join([old, *kept])) > overlap or count("".join([old, *kept, s])) > limit:
                        break
                    kept.insert(0, old)
                part = kept
            part.append(s)
        out.append({**c, "text": "".join(part).strip()})
    return [{**c, "seq": i} for i, c in enumerate(out)]


def load_yaml(block: str | None) -> dict:
    """The frontmatter as a mapping; broken or other YAML is empty."""
    try:
        out = yaml.safe_load(block) if block else None
    except yaml.YAMLError:
        return {}
    return out if isinstance(out, dict) else {}


def scalar(x) -> str | None:
    if isinstance(x, bool):
        return "true" if x else "false"
    if x is None:
        return ""
    if isinstance(x, (datetime.date, datetime.datetime)):
        return x.isoformat()
    return str(x) if isinstance(x, (str, int, float)) else None


def scalars(x) -> list[str]:
    return [s for s in (scalar(v) for v in (x if isinstance(x, list) else [x])) if s is not None]


def tags(content: str) -> list[tuple[str, str]]:
    """(folded, as first written): frontmatter tags, then ``#tag`` outside code."""
    block, body = split_frontmatter(content)
    meta = load_yaml(block)
    found = []
    for key in ("tags", "tag"):
        v = meta.get(key)
        found += [t.lstrip("#") for s in scalars(v) if v is not None for t in (re.split(r"[,\s]+", s) if isinstance(v, str) else [s])]
    for _, line, fenced in prose_lines(body):
        if not fenced:
            found += _TAG.findall(_CODE.sub(lambda m: " " * len(m[0]), line))
    out: dict[str, str] = {}
    for t in (x.strip("/") for x in found):
        if t and not t.isdigit() and re.fullmatch(r"[\w/-]+", t):
            out.setdefault(t.lower(), t)
    return list(out.items())


def aliases(content: str) -> list[tuple[str, str]]:
    meta = load_yaml(split_frontmatter(content)[0])
    out: dict[str, str] = {}
    for key in ("aliases", "alias"):
        for a in scalars(meta[key]) if key in meta else []:
            if a.strip():
                out.setdefault(a.strip().lower(), a.strip())
    return list(out.items())


def value_kind(value: str) -> str:
    v = value.strip()
    if not v:
        return "empty"
    if re.fullmatch(r"\[\[[^\n]+\]\]", v):
        return "link"
    if v.lower() in ("true", "false"):
        return "checkbox"
    return "number" if re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", v) else "text"


def link_target(value: str) -> str | None:
    m = _LINK.fullmatch(value.strip())
    return re.split(r"\\?\||#", m[2])[0].strip() if m else None


def properties(content: str) -> list[tuple[str, str, str]]:
    """(name, value, kind) of the frontmatter, a row per scalar of a list."""
    block = split_frontmatter(content)[0]
    # a bare [[link]] reads as a nested list: quote it first
    quoted = re.sub(r"(?m)((?:^[^:\n#]+:|^\s*-)\s+)(\[\[[^\]\n]+\]\])\s*$", r'\1"\2"', block or "")
    return [(str(k), v, value_kind(v)) for k, x in load_yaml(quoted).items() if str(k).lower() not in BUILT_IN for v in scalars(x)]


def inline_fields(text: str) -> list[tuple[str, str, str]]:
    """``name:: value`` lines and ``[name:: value]`` marks outside fences; lists by
    comma; several links are several rows."""
    out = []
    for _, line, fenced in prose_lines(text):
        if fenced:
            continue
        m = _FIELD.match(line)
        for name, value in [(m[1], m[2])] if m else _INLINE.findall(line):
            links = _LINK.findall(value)
            parts = [f"[[{x}]]" for _, x in links] if links else [p.strip() for p in value.split(",")]
            out += [(name.strip(), p, value_kind(p)) for p in parts]
    return out


def parse(notes: DataFrame) -> DataFrame:
    """(file_id, path, content) with frontmatter, tags, aliases and properties."""
    pair = pa.list_(pa.struct([("folded", pa.string()), ("display", pa.string())]))
    prop = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            named = lambda rows, *n: [dict(zip(n, r)) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), pa.array([split_frontmatter(t)[0] or "" for t in texts]), pa.array([named(tags(t), "folded", "display") for t in texts], pair),
                    pa.array([named(aliases(t), "folded", "display") for t in texts], pair), pa.array([named([*properties(t), *inline_fields(split_frontmatter(t)[1])], "name", "value", "kind") for t in texts], prop),
                ],
                names=["file_id", "path", "frontmatter", "tags", "aliases", "properties"],
            )

    fields = "file_id long, path string, frontmatter string, tags array<struct<folded:string,display:string>>, aliases array<struct<folded:string,display:string>>, properties array<struct<name:string,value:string,kind:string>>"
    return notes.select("file_id", "path", "content").mapInArrow(run, fields)


def chunk(notes: DataFrame, o: ChunkOptions = ChunkOptions()) -> DataFrame:
    """(file_id, path, content) as chunks (file_id, path, seq, heading, heading_path,
    text, token_count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, p, t in zip(*(b.column(k).to_pylist() for k in range(3))):
                for c in split_oversized(chunk_note(t or "", o), tokens, o.target_tokens, o.overlap_tokens):
                    rows.append((i, p, c["seq"], c["heading"], " > ".join(c["heading_path"]), c["text"], tokens(c["text"])))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
            columns = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file_id", "path", "seq", "heading", "heading_path", "text", "token_count"])

    return notes.select("file_id", "path", "content").mapInArrow(run, "file_id long, path string, seq long, heading string, heading_path string, text string, token_count long")


def outline(notes: DataFrame, promote_bold: bool = True) -> DataFrame:
    """A row for each heading of the notes (file_id, path, content): line (from 1, in the
    whole note), level and heading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, p, t in zip(*(b.column(k).to_pylist() for k in range(3))):
                body = split_frontmatter(t or "")[1]
                skip = (t or "").count("\n") - body.count("\n")
                rows += [(i, p, h.line + skip + 1, h.level, h.text) for h in headings(body, promote_bold)]
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file_id", "path", "line", "level", "heading"])

    return notes.select("file_id", "path", "content").mapInArrow(run, "file_id long, path string, line long, level long, heading string")


def sections(notes: DataFrame, wanted: str) -> DataFrame:
    """The section ``wanted`` (a heading, or a path ``A > B``) of each note (file_id, path,
    content) that has one, with its heading: file_id, path, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, p, t in zip(*(b.column(k).to_pylist() for k in range(3))):
                body = split_frontmatter(t or "")[1]
                at = find_section(body, wanted)
                if at is not None:
                    rows.append((i, p, "\n".join(body.split("\n")[at[0] : at[1]])))
            columns = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["file_id", "path", "text"])

    return notes.select("file_id", "path", "content").mapInArrow(run, "file_id long, path string, text string")


def digest(notes: DataFrame, o: ChunkOptions = ChunkOptions()) -> DataFrame:
    """What ``parse`` and ``chunk`` make of each note (file_id, path, content), in one row,
    with ``chunks`` and ``error``: a note that cannot be made has the error and nothing
    else."""
    pair = pa.list_(pa.struct([("folded", pa.string()), ("display", pa.string())]))
    prop = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string()), ("kind", pa.string())]))
    part = pa.list_(pa.struct([("seq", pa.int64()), ("heading", pa.string()), ("heading_path", pa.string()), ("text", pa.string()), ("token_count", pa.int64())]))
    named = lambda rows, *n: [dict(zip(n, r)) for r in rows]

    def made(t: str) -> dict:
        block, body = split_frontmatter(t)
        pieces = split_oversized(chunk_note(t, o), tokens, o.target_tokens, o.overlap_tokens)
        return {
            "frontmatter": block or "", "tags": named(tags(t), "folded", "display"), "aliases": named(aliases(t), "folded", "display"), "properties": named([*properties(t), *inline_fields(body)], "name", "value", "kind"),
            "chunks": [{"seq": c["seq"], "heading": c["heading"], "heading_path": " > ".join(c["heading_path"]), "text": c["text"], "token_count": tokens(c["text"])} for c in pieces], "error": None,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(2).to_pylist():
                try:
                    rows.append(made(t or ""))
                except Exception as e:  # whatever one note raises is that note's
                    rows.append({"error": f"{type(e).__name__}: {e}"})
            kinds = {"frontmatter": pa.string(), "tags": pair, "aliases": pair, "properties": prop, "chunks": part, "error": pa.string()}
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r.get(n) for r in rows], k) for n, k in kinds.items())], names=["file_id", "path", *kinds])

    named_pair = "array<struct<folded:string,display:string>>"
    fields = f"file_id long, path string, frontmatter string, tags {named_pair}, aliases {named_pair}, properties array<struct<name:string,value:string,kind:string>>, chunks array<struct<seq:long,heading:string,heading_path:string,text:string,token_count:long>>, error string"
    return notes.select("file_id", "path", "content").mapInArrow(run, fields)
