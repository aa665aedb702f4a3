"""Exhaustive literal match over lines of notes, with exact counts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenark.functions import text as T


class StaleIndex(RuntimeError):
    """The store lacks what an exact answer needs."""


@dataclass(frozen=True)
class Match:
    pattern: str
    case_sensitive: bool = False
    word: bool = False
    part: str = "all"  # all, body or frontmatter

    def __post_init__(self):
        if not self.pattern or "\n" in self.pattern:
            raise ValueError("a pattern is one non-empty line")

    def in_text(self, text: Column) -> Column:
        # only a line with a link reads otherwise when rendered
        return self._holds(text) | (F.contains(text, F.lit("[[")) & self._holds(T.render_wikilinks(text)))

    def _holds(self, text: Column) -> Column:
        needle, text = (self.pattern, text) if self.case_sensitive else (self.pattern.lower(), F.lower(text))
        if not self.word:
            return F.contains(text, F.lit(needle))
        # an edge is tested only where the pattern as written has a word character
        inner = lambda c: c.isalnum() or c == "_"
        left = r"(?<![\p{L}\p{N}_])" if inner(self.pattern[0]) else ""
        right = r"(?![\p{L}\p{N}_])" if inner(self.pattern[-1]) else ""
        quoted = re.sub(r"([^\w\s])", r"\\\1", needle)
        # the plain test is cheap and most lines fail it
        return F.contains(text, F.lit(needle)) & text.rlike(left + quoted + right)


def lines(chunks: DataFrame, frontmatter: DataFrame | None = None, part: str = "all") -> DataFrame:
    """(file_id, path, part, seq, heading_path, line): body chunks and, as seq -1, the
    frontmatter's lines."""
    body = chunks.select("file_id", "path", F.lit("body").alias("part"), "seq", "heading_path", F.explode(F.split("text", "\r?\n", -1)).alias("line"))
    if frontmatter is None or part == "body":
        return body
    front = frontmatter.select("file_id", "path", F.lit("frontmatter").alias("part"), F.lit(-1).cast("long").alias("seq"), F.lit("").alias("heading_path"), F.explode(F.split("frontmatter", "\r?\n", -1)).alias("line"))
    return front if part == "frontmatter" else front.unionByName(body)


def hits(rows: DataFrame, m: Match) -> DataFrame:
    """Matching lines, one per (file, part, section, line). The text is tested before
    anything is shuffled."""
    if m.part != "all":
        rows = rows.where(F.col("part") == m.part)
    return rows.where(m.in_text(F.col("line"))).groupBy("file_id", "path", "part", "heading_path", "line").agg(F.min("seq").alias("seq"))


def counts(found: DataFrame) -> DataFrame:
    return found.agg(F.countDistinct("file_id").alias("notes"), F.count(F.lit(1)).alias("lines"))


def page(found: DataFrame, limit: int = 50) -> DataFrame:
    return found.orderBy("path", "seq", "part", "heading_path", "line").limit(limit)


def require_frontmatter(notes: DataFrame) -> None:
    """Refuse when a note's frontmatter was never recorded (null, not empty)."""
    if notes.where(F.col("frontmatter").isNull()).limit(1).count():
        raise StaleIndex("frontmatter of some notes is not indexed")
