"""The stored keyword index: positional postings by field, phrases, column subsets, snippets.

Postings are rows (term, file_id, seq, field, lengths, positions): where a word stands in
one field of one chunk, and how many words each field of the chunk has. They are laid out
by ranges of (term, file), sorted, so that a reader of a few terms reads a few row groups
(``term`` is pushed down) and a very common term spreads over as many files as it fills;
Parquet's delta coding keeps ids and positions small. Of all chunks a search needs two
numbers a field, which are kept beside (``Counts``), so it reads no text at all.

A declared column that a search leaves out is absent, not zero: it adds neither hits nor
length. A term of several words (hyphens, quotes) is a phrase: its words stand next to each
other in one field. Scores are those of ``lexical.bm25`` over the same columns (tested for
every subset). ``Shape.fold`` makes words of a text and of a question lose their marks."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenark.operators import lexical

#: All that can be declared, in this order.
FIELDS = ("text", "heading_path", "tags_text")


@dataclass(frozen=True)
class Shape:
    """What an index is declared over; another shape asks for another index."""

    fields: tuple[str, ...] = ("text", "heading_path")
    fold: bool = False

    def covers(self, columns: dict[str, float]) -> bool:
        return set(columns) <= set(self.fields)


@dataclass(frozen=True)
class Counts:
    """Chunks, and words of each field."""

    rows: int
    words: tuple[int, ...]

    def __add__(self, other: Counts) -> Counts:
        return Counts(self.rows + other.rows, tuple(a + b for a, b in zip(self.words, other.words)))

    def __sub__(self, other: Counts) -> Counts:
        return Counts(self.rows - other.rows, tuple(a - b for a, b in zip(self.words, other.words)))


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    counts: Counts
    shape: Shape = Shape()


# --- words -------------------------------------------------------------------


@cache
def _marked() -> tuple[str, str]:
    """Letters that are a letter and marks, and the letters without them."""
    pairs = []
    for i in range(0x80, 0x3000):
        parts = unicodedata.normalize("NFD", chr(i))
        if len(parts) > 1 and all(unicodedata.category(x) == "Mn" for x in parts[1:]) and len(parts[0]) == 1:
            pairs.append((chr(i), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, *_marked()), r"\p{Mn}+", "")


def fold(text: str) -> str:
    """What ``folded`` does, of a question."""
    return "".join(x for x in text.translate(str.maketrans(*_marked())) if unicodedata.category(x) != "Mn")


def tokens(text: Column, shape: Shape) -> Column:
    return lexical.tokens(folded(text) if shape.fold else text)


def phrases(query: str, shape: Shape) -> list[list[str]]:
    """The words of each of the question's terms."""
    return [s for s in map(lexical.sub_terms, lexical.query_terms(fold(query) if shape.fold else query)) if s]


# --- making ------------------------------------------------------------------


def _fields(chunks: DataFrame, shape: Shape) -> DataFrame:
    rows = chunks.select("file_id", "seq", *(tokens(F.col(c), shape).alias(f"_t{j}") for j, c in enumerate(shape.fields)))
    return rows.withColumn("lengths", F.array(*(F.size(f"_t{j}") for j in range(len(shape.fields)))))


def lengths(chunks: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """(file_id, seq, lengths): words of each field of each chunk."""
    return _fields(chunks, shape).select("file_id", "seq", "lengths")


def counted(rows: DataFrame, shape: Shape = Shape()) -> Counts:
    """The counts of (lengths) rows."""
    n = len(shape.fields)
    row = rows.agg(F.count(F.lit(1)).alias("rows"), *(F.sum(F.col("lengths")[j].cast("long")).alias(f"w{j}") for j in range(n))).first()
    return Counts(row["rows"], tuple(row[f"w{j}"] or 0 for j in range(n)))


def _places(words: Column) -> Column:
    """(term, positions) of each different word of a text's words, in one pass over them as
    sorted."""

    def runs(at: Column) -> Column:
        n = F.size(at)
        begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(at, i)["term"] != F.get(at, i - 1)["term"]))
        # one element, so that the runs' beginnings are found once
        return F.element_at(F.transform(F.array(begins), lambda b: F.transform(b, lambda i, k: F.struct(F.get(at, i)["term"].alias("term"), F.slice(at, i + 1, F.coalesce(F.get(b, k + 1), n) - i)["at"].alias("positions")))), 1)

    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("at"))))
    return F.element_at(F.transform(F.array(placed), runs), 1)


def postings(chunks: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """(term, file_id, seq, field, lengths, positions); a chunk is one row, in which the
    places of each of its words meet, so that nothing is shuffled for it."""
    each = F.array(*(F.struct(F.lit(j).alias("field"), F.col(f"_t{j}").alias("words")) for j in range(len(shape.fields))))
    texts = _fields(chunks, shape).select("file_id", "seq", "lengths", F.inline(each)).where(F.size("words") > 0)
    return texts.select("file_id", "seq", "field", "lengths", F.inline(_places(F.col("words")))).select("term", "file_id", "seq", "field", "lengths", "positions")


ORDER = ("term", "file_id", "seq", "field")


def laid_out(rows: DataFrame) -> DataFrame:
    return rows.repartitionByRange("term", "file_id").sortWithinPartitions(*ORDER)


def write(chunks: DataFrame, path: str, shape: Shape = Shape()) -> Index:
    """An index of chunks (file_id, seq and the shape's fields) below ``path``."""
    spark = chunks.sparkSession
    laid_out(postings(chunks, shape)).write.option("parquet.writer.version", "v2").parquet(f"{path}/postings")
    lengths(chunks, shape).write.parquet(f"{path}/lengths")
    rows = spark.read.parquet(f"{path}/lengths")
    return Index(spark.read.parquet(f"{path}/postings"), counted(rows, shape), shape)


# --- asking ------------------------------------------------------------------


def _hits(places: list[Column]) -> Column:
    """How often words at these places stand next to each other."""
    first, *rest = places
    if not rest:
        return F.size(F.coalesce(first, F.array().cast("array<int>")))

    def follow(at: Column) -> Column:
        ok = F.lit(True)
        for j, p in enumerate(rest, 1):
            ok = ok & F.coalesce(F.array_contains(p, at + j), F.lit(False))
        return ok

    return F.coalesce(F.size(F.filter(first, follow)), F.lit(0))


def matches(index: Index, query: str, columns: dict[str, float]) -> tuple[DataFrame, list[list[str]]]:
    """(file_id, seq, length, f0.., h0..): chunks with any word of the question in the
    columns, and for each term its weighted and its plain hits there."""
    if not index.shape.covers(columns):
        raise ValueError(f"the index is over {', '.join(index.shape.fields)}, not {', '.join(columns)}")
    asked = phrases(query, index.shape)
    field = {index.shape.fields.index(c): float(w) for c, w in columns.items()}
    words = list(dict.fromkeys(w for p in asked for w in p))
    some = index.postings.where(F.col("term").isin(words) & F.col("field").isin(list(field)))
    at = {(w, j): F.max(F.when((F.col("term") == w) & (F.col("field") == j), F.col("positions"))).alias(f"_{i}_{j}") for i, w in enumerate(words) for j in field}
    rows = some.groupBy("file_id", "seq").agg(F.first("lengths").alias("lengths"), *at.values())
    place = {(w, j): F.col(f"_{i}_{j}") for i, w in enumerate(words) for j in field}
    length = sum((F.col("lengths")[j] for j in field), F.lit(0))
    found = {j: [_hits([place[w, j] for w in p]) for p in asked] for j in field}
    hits = {f"h{i}": sum((found[j][i] for j in field), F.lit(0)) for i in range(len(asked))}
    freq = {f"f{i}": sum((found[j][i] * F.lit(field[j]) for j in field), F.lit(0.0)) for i in range(len(asked))}
    return rows.select("file_id", "seq", length.alias("length"), *(c.alias(n) for n, c in {**hits, **freq}.items())), asked


def document_frequencies(rows: DataFrame, n: int) -> list[int]:
    """One row: chunks that hold each term."""
    row = rows.agg(*(F.count_if(F.col(f"h{i}") > 0).alias(f"d{i}") for i in range(n))).first()
    return [row[f"d{i}"] for i in range(n)]


def bm25(index: Index, query: str, columns: dict[str, float], scope: DataFrame | None = None, require_all: bool = False) -> DataFrame:
    """(file_id, seq, bm25, bound) of the chunks (of ``scope``'s file_ids) that hold any of
    the question's terms, or all; terms weigh as the whole store has them."""
    if not phrases(query, index.shape) or not columns:
        return index.postings.limit(0).select("file_id", "seq", F.lit(0.0).alias("bm25"), F.lit(0.0).alias("bound"))
    rows, asked = matches(index, query, columns)
    holding = document_frequencies(rows, len(asked))
    mean = sum(index.counts.words[index.shape.fields.index(c)] for c in columns) / max(index.counts.rows, 1)
    keep = F.lit(require_all)
    score = bound = F.lit(0.0)
    for i, held in enumerate(holding):
        has, f, w = F.col(f"h{i}") > 0, F.col(f"f{i}"), lexical.idf(F.lit(float(index.counts.rows)), F.lit(float(held)))
        keep = (keep & has) if require_all else (keep | has)
        norm = f + lexical.K1 * (1 - lexical.B + lexical.B * F.col("length") / F.lit(mean))
        score = score + F.when(has, w * f * (lexical.K1 + 1) / norm).otherwise(0.0)
        bound = bound + w * (lexical.K1 + 1)
    if scope is not None:
        rows = rows.join(scope.select("file_id"), "file_id", "left_semi")
    return rows.where(keep).select("file_id", "seq", score.alias("bm25"), bound.alias("bound"))


def phrase(index: Index, words: str, columns: tuple[str, ...]) -> DataFrame:
    """(file_id, seq, hits) of the chunks in which all the words stand next to each other,
    in one of the columns; nothing is weighed."""
    together = lexical.sub_terms(fold(words) if index.shape.fold else words)
    if not together:
        return index.postings.limit(0).select("file_id", "seq", F.lit(0).alias("hits"))
    rows, _ = matches(index, "-".join(together), dict.fromkeys(columns, 1.0))
    return rows.where("h0 > 0").select("file_id", "seq", F.col("h0").alias("hits"))


# --- showing -----------------------------------------------------------------


def snippet(text: Column, query: str, shape: Shape = Shape(), size: int = 64, mark: tuple[str, str] = ("<b>", "</b>"), more: str = "...") -> Column:
    """``size`` words of a text around what a question asks for.

    Of the windows that begin at a hit, the one with the most of the question's different
    words is taken; of equal ones that with the most hits, then the first. It is moved so
    that its hits stand in its middle, within the text. Hits are marked, and ``more`` stands
    where the text goes on. A text without hits gives its first words; what stands before
    the first word of a text is left out. Null reads as empty."""
    words = F.array(*(F.lit(w) for w in dict.fromkeys(w for p in phrases(query, shape) for w in p)) or [F.lit(None).cast("string")])
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}\p{Mn}]+[^\p{L}\p{N}]*" if shape.fold else r"[\p{L}\p{N}]+[^\p{L}\p{N}]*"), F.lit(0))
    plain = F.transform(pieces, lambda p: F.element_at(F.concat(tokens(p, shape), F.array(F.lit(""))), 1))
    at = F.filter(F.transform(plain, lambda w, i: F.when(F.array_contains(words, w), i)), lambda i: i.isNotNull())
    # (pieces, plain, at) once, then windows over the hits only
    base = F.struct(pieces.alias("pieces"), plain.alias("plain"), at.alias("at"))

    def shown(s: Column) -> Column:
        n = F.size(s["pieces"])

        def window(first: Column) -> Column:
            inside = F.filter(s["at"], lambda i: (i >= first) & (i < first + size))
            kinds = F.size(F.array_distinct(F.transform(inside, lambda i: F.element_at(s["plain"], i + 1))))
            return F.struct(kinds.alias("kinds"), F.size(inside).alias("hits"), (-first).alias("back"), F.array_max(inside).alias("last"))

        best = F.array_max(F.transform(s["at"], window))
        first, last = -best["back"], best["last"]
        lead = F.floor((size - (last - first + 1)) / 2)
        start = F.when(F.size(s["at"]) > 0, F.greatest(F.least(first - lead, n - size), F.lit(0))).otherwise(0).cast("int")

        def told(piece: Column, i: Column) -> Column:
            hit = F.array_contains(s["at"], i + start)
            word = F.regexp_extract(piece, r"^[\p{L}\p{N}\p{Mn}]+" if shape.fold else r"^[\p{L}\p{N}]+", 0)
            return F.when(hit, F.concat(F.lit(mark[0]), word, F.lit(mark[1]), F.substr(piece, F.length(word) + 1))).otherwise(piece)

        body = F.array_join(F.transform(F.slice(s["pieces"], start + 1, size), told), "")
        return F.concat(F.when(start > 0, more).otherwise(""), body, F.when(start + size < n, more).otherwise(""))

    # one element, so that what it names is computed once
    return F.element_at(F.transform(F.array(base), shown), 1)
