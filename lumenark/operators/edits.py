"""Edits of notes: text in, text out. ``apply`` runs a table of edits over notes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.operators import markdown as M


class Refused(ValueError):
    """An edit that would lose or garble something."""


def newline_of(text: str) -> str:
    return "\r\n" if "\r\n" in text else "\n"


def _keeping_newlines(edit):
    """Run an edit on plain newlines and give the note its own back."""

    def run(content: str, *args, **kw) -> str:
        nl = newline_of(content)
        out = edit(content.replace("\r\n", "\n"), *args, **kw)
        return out.replace("\n", nl) if nl != "\n" else out

    return run


def _parts(content: str) -> tuple[str, str]:
    """Frontmatter with its fences (or nothing) and body."""
    _, body = M.split_frontmatter(content)
    return content[: len(content) - len(body)], body


@_keeping_newlines
def section_edit(content: str, heading: str, how: str, text: str = "") -> str:
    """replace, append, prepend or remove the text under a heading."""
    head, body = _parts(content)
    at = M.find_section(body, heading)
    if at is None:
        raise LookupError(f"no section {heading!r}")
    rows, (top, end) = body.split("\n"), at
    own = next(h for h in M.headings(body, True) if h.line == top)
    inner = next((h.line for h in M.headings(body, True) if top < h.line < end), end)
    first = M.headings(text)[:1]
    if first and first[0].line == 0 and first[0].level <= own.level:
        raise Refused("a section cannot open with a heading of its own level")
    new = text.strip("\n").split("\n") if text.strip("\n") else []
    old = "\n".join(rows[top + 1 : inner]).strip("\n")
    old = old.split("\n") if old else []
    if how == "remove":
        rows[top:end] = []
    elif how == "replace":
        if inner < end and not M.headings(text):
            raise Refused("the section has subsections that this would leave behind")
        rows[top + 1 : end] = ["", *new, ""]
    elif how in ("append", "prepend"):
        both = [*old, *([""] if old else []), *new] if how == "append" else [*new, *([""] if old else []), *old]
        rows[top + 1 : inner] = ["", *both, ""]
    else:
        raise ValueError(f"unknown edit {how!r}")
    out = "\n".join(rows).rstrip("\n")
    return head + out + "\n"


@_keeping_newlines
def rename_section(content: str, heading: str, new: str) -> str:
    head, body = _parts(content)
    at = M.find_section(body, heading)
    if at is None:
        raise LookupError(f"no section {heading!r}")
    if any(M.heading_key(h.text) == M.heading_key(new) and h.line != at[0] for h in M.headings(body, True)):
        raise Refused(f"another section is called {new!r}")
    rows = body.split("\n")
    rows[at[0]] = re.sub(r"^(#+\s*).*$", lambda m: m[1] + new, rows[at[0]]) if rows[at[0]].startswith("#") else f"**{new}**"
    return head + "\n".join(rows)


@_keeping_newlines
def body_edit(content: str, how: str, text: str) -> str:
    head, body = _parts(content)
    if how == "replace":
        return head + text
    if how == "append":
        return head + body.rstrip("\n") + "\n\n" + text.strip("\n") + "\n"
    if how == "prepend":
        return head + text.strip("\n") + "\n\n" + body.lstrip("\n")
    raise ValueError(f"unknown edit {how!r}")


class Block:
    """A frontmatter block edited line by line: other keys keep their bytes."""

    _KEY = re.compile(r"^([^\s#:\-][^:\n]*):(?:\s+(.*))?$")

    def __init__(self, text: str | None):
        self.rows = text.split("\n") if text else []

    def keys(self) -> dict[str, tuple[int, int]]:
        out: dict[str, tuple[int, int]] = {}
        marks = [(i, m[1].strip()) for i, r in enumerate(self.rows) if (m := self._KEY.match(r))]
        for (i, k), nxt in zip(marks, [*[i for i, _ in marks[1:]], len(self.rows)]):
            if k in out:
                raise Refused(f"the key {k!r} stands twice")
            out[k] = (i, nxt)
        return out

    def _plain(self, key: str) -> tuple[int, int] | None:
        """The key's lines, unless they hold what must not be rewritten."""
        at = self.keys().get(key)
        if at is None:
            return None
        value = (self._KEY.match(self.rows[at[0]])[2] or "").strip()
        nested = any(re.match(r"^\s+[^\s#-][^:]*:\s", r + " ") for r in self.rows[at[0] + 1 : at[1]])
        if value[:1] in ("&", "*", "|", ">", "!", "{") or nested or value.startswith("[") and not value.endswith("]"):
            raise Refused(f"{key!r} is written in a way that cannot be edited line by line")
        return at

    @staticmethod
    def quote(v: str) -> str:
        plain = re.fullmatch(r"[\w][\w ./-]*", v) and v.lower() not in ("true", "false", "null", "yes", "no", "on", "off")
        return v if plain or M.value_kind(v) in ("number", "checkbox") else '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'

    def set(self, key: str, value: str | list[str], after: str | None = None, before: str | None = None) -> None:
        at = self._plain(key)
        if isinstance(value, list):
            flow = at and "[" in self.rows[at[0]]
            new = [f"{key}: [{', '.join(map(self.quote, value))}]"] if flow else [f"{key}:", *(f"  - {self.quote(v)}" for v in value)]
        else:
            new = [f"{key}: {self.quote(value)}"]
        if at:
            self.rows[at[0] : at[1]] = new
            return
        where = len(self.rows)
        if after or before:
            anchor = self.keys().get(after or before)
            if anchor is None:
                raise LookupError(f"no key {after or before!r}")
            where = anchor[1] if after else anchor[0]
        self.rows[where:where] = new

    def items(self, key: str) -> list[str]:
        at = self._plain(key)
        if at is None:
            return []
        meta = M.load_yaml("\n".join(self.rows[at[0] : at[1]]))
        return [] if meta.get(key) is None else M.scalars(meta[key])

    def add(self, key: str, value: str) -> None:
        have = self.items(key)
        if value not in have:
            self.set(key, [*have, value])

    def discard(self, key: str, value: str) -> None:
        have = self.items(key)
        if value in have:
            self.set(key, [x for x in have if x != value])

    def remove(self, key: str) -> None:
        at = self._plain(key)
        if at:
            self.rows[at[0] : at[1]] = []


@_keeping_newlines
def property_edit(content: str, how: str, key: str, value: str | list[str] | None = None, **place) -> str:
    """set, add, discard or remove a property."""
    text, body = M.split_frontmatter(content)
    block = Block(text)
    if how == "set":
        block.set(key, value, **place)
    elif how in ("add", "discard"):
        getattr(block, how)(key, value)
    elif how == "remove":
        block.remove(key)
    else:
        raise ValueError(f"unknown edit {how!r}")
    return "---\n" + "".join(r + "\n" for r in block.rows) + "---\n" + body if block.rows else body


def apply_edits(content: str, edits: list[dict]) -> str:
    """Edits in order; all or none."""
    run = {"section": section_edit, "rename": rename_section, "body": body_edit, "property": property_edit}
    for e in edits:
        e = {k: v for k, v in e.items() if v is not None}
        content = run[e.pop("what")](content, **e)
    return content


def create(title: str, body: str, tags: list[str] | None = None) -> str:
    block = Block(None)
    if tags:
        block.set("tags", tags)
    head = "---\n" + "\n".join(block.rows) + "\n---\n" if block.rows else ""
    return head + f"# {title}\n\n{body.strip(chr(10))}\n"


def apply(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """``notes`` (path, content, mtime) with ``edits`` (path, n, what, heading, how,
    text, key, value, expected_mtime) made in order of n; ``fault`` says why a note's
    edits were not. A note whose mtime is not the expected one is a conflict."""
    names = ["what", "heading", "how", "text", "key", "value", "expected_mtime"]
    per = edits.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("n", *names))).alias("_edits"))

    @F.pandas_udf("struct<content:string,fault:string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for contents, mtimes, lists in batches:
            out = []
            for content, mtime, todo in zip(contents, mtimes, lists):
                rows = [{k: x[k] for k in names} for x in (todo if todo is not None else [])]
                if any(r["expected_mtime"] is not None and r["expected_mtime"] == r["expected_mtime"] and int(r["expected_mtime"]) != int(mtime) for r in rows):
                    out.append((content, "conflict: the note has changed"))
                    continue
                try:
                    out.append((apply_edits(content or "", [{k: v for k, v in r.items() if k != "expected_mtime"} for r in rows]), None))
                except (ValueError, LookupError, TypeError) as e:
                    out.append((content, str(e)))
            yield pd.DataFrame(out, columns=["content", "fault"])

    joined = notes.join(per, "path", "left").withColumn("_r", run("content", "mtime", "_edits"))
    return joined.withColumns({"content": F.col("_r.content"), "fault": F.col("_r.fault")}).drop("_r", "_edits")
