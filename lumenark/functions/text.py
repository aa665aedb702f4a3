"""Scalar text functions as Columns (JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIKILINK = r"\[\[((?:(?!\]\])[^\n])+)\]\]"


def docid(path: Column) -> Column:
    """First three bytes of SHA-256, in hex."""
    return F.substring(F.sha2(path, 256), 1, 6)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_tokens(text: Column) -> Column:
    """The chunker's estimate: ceil(bytes / 4)."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def packaging_tokens(text: Column) -> Column:
    """The packager's estimate: ceil(characters * 100 / 333)."""
    return F.ceil(F.char_length(text) * 100 / 333).cast("long")


def mock_tokens(text: Column) -> Column:
    """The mock tokeniser's: bytes / 4 + 1."""
    return (F.floor(F.octet_length(text) / 4) + 1).cast("long")


def snippet(text: Column) -> Column:
    """Texts over 200 bytes: their first 200 characters and dots."""
    return F.when(F.octet_length(text) > 200, F.concat(F.substring(text, 1, 200), F.lit("..."))).otherwise(text)


def tag_axis(tag: Column) -> Column:
    return F.substring_index(tag, "/", 1)


def tags_text(tags: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(tags)), " ")


def breadcrumb(root: Column, headings: Column) -> Column:
    return F.array_join(F.concat(F.array(root), headings), " > ")


def value_kind(value: Column) -> Column:
    """empty, link, checkbox, number or text."""
    v = F.trim(value)
    return (
        F.when(value.isNull() | (v == ""), "empty")
        .when(v.rlike(r"^\[\[[^\n]+\]\]$"), "link")
        .when(F.lower(v).isin("true", "false"), "checkbox")
        .when(v.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), "number")
        .otherwise("text")
    )


def wikilinks(text: Column) -> Column:
    """Distinct ``target`` or ``target#heading`` of a text's links; embeds are none."""
    inner = F.regexp_extract_all(text, F.lit(r"(?<!!)" + WIKILINK), F.lit(1))
    plain = F.transform(inner, lambda x: F.trim(F.split_part(F.replace(x, F.lit("\\|"), F.lit("|")), F.lit("|"), F.lit(1))))
    return F.array_distinct(F.filter(plain, lambda x: x != ""))


def link_note(link: Column) -> Column:
    return F.trim(F.split_part(link, F.lit("#"), F.lit(1)))


def link_heading(link: Column) -> Column:
    h = F.trim(F.split_part(link, F.lit("#"), F.lit(2)))
    return F.when(h == "", F.lit(None)).otherwise(h)


def render_wikilinks(text: Column) -> Column:
    """Links as they are read: the display text if there is one, else the target."""
    shown = F.regexp_replace(text, r"!?\[\[(?:(?!\]\])[^\n|])*\\?\|((?:(?!\]\])[^\n])+)\]\]", "$1")
    return F.regexp_replace(shown, "!?" + WIKILINK, "$1")


def iso_date_seconds(text: Column) -> Column:
    """Epoch seconds (UTC, start of day) of the first YYYY-MM-DD, or null."""
    found = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1)
    return F.unix_timestamp(F.try_to_timestamp(found, F.lit("yyyy-MM-dd")))


def frontmatter_date(content: Column) -> Column:
    """What the frontmatter's ``date`` says, null if it has none."""
    head = F.regexp_extract(content, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    return F.nullif(F.regexp_extract(head, r"(?m)^date:\s*[\"']?([^\s\"']+)", 1), F.lit(""))


def note_date(frontmatter_date: Column, path: Column) -> Column:
    return F.coalesce(iso_date_seconds(F.substring(frontmatter_date, 1, 10)), iso_date_seconds(path))


def temporal_score(date: Column, start: int, end: int) -> Column:
    """1 inside the range, else 1 / (1 + 0.1 * days away)."""
    days = F.when(date < start, start - date).otherwise(date - end) / 86400.0
    return F.when(date.isNull(), 0.0).when(date.between(start, end), 1.0).otherwise(1.0 / (1.0 + 0.1 * days))


def normalized_levenshtein(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def shingles(text: Column, n: int = 4) -> Column:
    """Distinct n-character windows of the lower-cased text. The text is cut into its
    characters once: a substring by place would walk from the text's start each time."""
    chars = F.array_remove(F.split(F.lower(text), "", -1), "")

    def windows(c: Column) -> Column:
        return F.when(F.size(c) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.concat(*(F.get(c, i + (k - 1)) for k in range(n)))))

    # one element, so that the characters are made once
    return F.array_distinct(F.element_at(F.transform(F.array(chars), windows), 1))


def shingle_jaccard(a: Column, b: Column) -> Column:
    """Two arrays of shingles, each without repeats; 0.5 if both are empty."""

    def score(s: Column) -> Column:
        both = F.size(F.array_intersect(s["a"], s["b"]))
        union = F.size(s["a"]) + F.size(s["b"]) - both
        return F.when(s["a"].isNull() | s["b"].isNull(), F.lit(None).cast("double")).when(union == 0, 0.5).otherwise(both / union)

    return F.element_at(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), score), 1)


def fold(name: Column) -> Column:
    return F.lower(F.trim(name))


def heading_key(heading: Column) -> Column:
    """Headings compare without marks, ``(cont.)`` and case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(heading, r"^#+\s*", ""), r"\s*\(cont\.\)\s*$", "")))


def safe_name(title: Column) -> Column:
    """A title as a file name: spaces to hyphens, unsafe characters dropped."""
    return F.concat(F.regexp_replace(F.regexp_replace(F.trim(title), r"[^\p{L}\p{N} _-]", ""), r"\s+", "-"), F.lit(".md"))
