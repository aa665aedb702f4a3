"""Spelling variants of words, without pairs of words.

Two words are near if one replaced, inserted or deleted code point lies between them. For
replacements, a word of n code points belongs to n wildcard groups, one for each (position,
prefix, suffix); a group keeps its size and its two words of largest count, which is all
that a member must know: its near words there are the others, and the best of them is the
group's best, or the second if it is the best itself. For insertions and deletions, what a
deletion leaves of a word meets the vocabulary once: upwards the longer word learns of the
shorter one, and downwards the shorter one's longer words are counted and their best kept.
Each word then adds up what its groups say: rows grow with the vocabulary's letters, and no
group is ever spread into its pairs. A word of more than ``LONG`` code points has as many
groups as others, but is named by a digest of 128 bits there, and so are its patterns, which
are then differences of sums: its rows stay small, where patterns written out would take the
square of its length.

Words are the maximal runs of ``A-Z a-z U+00C0-U+00FF``, lower-cased in A-Z only; other
code points separate them. They are counted where texts are read, so that a shuffle carries
one row for each distinct word of a task's batch. A word's form is its near word of largest
count (ties: smallest in code-point order), if that is ``ratio`` times its own or more; its
root is reached by following forms, in as many rounds as the longest chain has doublings.

Defined results: null and empty texts have no words; long runs are words like others;
repeated rows and ids count again; null ids read as an empty string where ``misspelt``
hashes them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenark.llm.common import cut, returning

#: Fixed bounds of the words: code points and occurrences, and how much commoner a form is.
LETTERS, TIMES, RATIO = 5, 3, 2
#: What stands for the replaced code point; no word holds it.
WILD = "*"
#: Distinct words, and characters read, after which a task hands on what it has counted.
HELD, READ = 200_000, 1 << 26
#: Code points up to which a word's patterns are written out.
LONG = 64


def _table() -> bytes:
    """Latin-1 bytes of words as they are, A-Z lower-cased; all others become spaces."""
    words = {b: b for b in (*range(0x61, 0x7B), *range(0xC0, 0x100))} | {b: b + 32 for b in range(0x41, 0x5B)}
    return bytes(words.get(b, 0x20) for b in range(256))


_WORDS = _table()


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased runs as Latin-1 bytes: a byte is a code point."""
    return text.encode("latin-1", "replace").translate(_WORDS).split(b" ") if text else []


def misspelt(key: object, word: bytes, one_in: int = 97) -> bytes:
    """``word``, or what is left of it without one code point, for one in so many
    documents: a stand-in for misspellings that is the same at every run."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), zlib.crc32(f"{'' if key is None else key}:".encode()))
    if h % one_in:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int | None = None, letters: int = LETTERS, times: int = TIMES) -> DataFrame:
    """(word, n): words of ``letters`` code points or more that occur ``times`` or more.
    ``one_in``: misspell that share of words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        read = 0

        def flush() -> pa.RecordBatch:
            nonlocal read
            read = 0
            words = [w.decode("latin-1") for w in held]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                # a word's fate in a document is one for all its occurrences there
                for word, n in Counter(words_of(text)).items():
                    held[word if one_in is None or not word else misspelt(key, word, one_in)] += n
                read += len(text)
                if len(held) >= HELD or read >= READ:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(returning(run), "word string, n long")
    return rows.where(F.length("word") >= letters).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def _pieces(wild: str):
    """Each position's (pattern, replaced) of a word, as an array of strings."""
    return F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.lit(wild), F.substring(F.col("word"), i + 1, F.length("word"))))


def _digests(batches: Iterator[pa.RecordBatch], pieces: bool) -> Iterator[pa.RecordBatch]:
    """Two sums of letters' values by powers, modulo 2^64, name a word; without a letter, and
    with the rest moved up or not, they are those of its patterns."""
    for batch in batches:
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            letters = np.frombuffer(word.encode("latin-1"), np.uint8)
            whole, without, moved = [], [], []
            for values, base in _SUMS:
                powers = np.full(len(letters), base, np.uint64)
                powers[0] = 1
                terms = values[letters] * np.multiply.accumulate(powers)
                sums = np.cumsum(terms)
                whole.append(sums[-1])
                without.append(sums[-1] - terms)
                moved.append(sums - terms + (sums[-1] - sums) * np.uint64(pow(int(base), -1, 1 << 64)))
            own = np.array(whole).view(np.int64).tolist()
            if not pieces:
                yield pa.RecordBatch.from_arrays([pa.array([word]), pa.array([n], pa.int64()), *(pa.array([x], pa.int64()) for x in own)], names=["word", "n", "a", "b"])
                continue
            first = np.flatnonzero(np.diff(letters, prepend=letters[0] ^ 1))  # equal neighbours leave the same
            at = np.concatenate([np.arange(len(letters)), np.full(len(first), -1)])
            x, y = (np.concatenate([w, m[first]]).view(np.int64) for w, m in zip(without, moved))
            letter = np.concatenate([letters, letters[first]]).astype(np.int32)
            for lo in range(0, len(at), 50_000):
                k = min(50_000, len(at) - lo)
                columns = [np.full(k, own[0]), np.full(k, own[1]), np.full(k, n), at[lo : lo + k], x[lo : lo + k], y[lo : lo + k], letter[lo : lo + k]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.int32())], names=["a", "b", "n", "at", "x", "y", "letter"])


_RNG = np.random.default_rng(20250611)
_SUMS = [(_RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1), _RNG.integers(0, 2**64, dtype=np.uint64) | np.uint64(1)) for _ in range(2)]


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, never to be broadcast. Spark takes a stored table, even spread into its rows'
    patterns, for as large as its compressed files and would send it through the driver."""
    return df.hint("merge")


def _best(n: Column, word: Column) -> Column:
    """The smaller, the better."""
    return F.struct((-n).alias("less"), word.alias("word"))


def _near_short(words: DataFrame) -> DataFrame:
    # replacements: a row for each word and group; only groups of two or more go on
    short = words.where(F.length("word") <= LONG)
    groups = short.select("word", "n", F.explode(_pieces(WILD)).alias("pattern"))
    group = Window.partitionBy("pattern")
    order = group.orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mine = _best(F.col("n"), F.col("word"))
    member = groups.withColumns({"size": F.count(F.lit(1)).over(group), "first": F.first(mine).over(order), "second": F.nth_value(mine, 2).over(order)})
    replaced = member.where("size > 1").select("word", (F.col("size") - 1).alias("n_near"), F.when(F.col("first.word") == F.col("word"), F.col("second")).otherwise(F.col("first")).alias("best"))
    # deletions: what is left meets the vocabulary, once for both directions
    left = short.select(F.col("word").alias("long"), F.col("n").alias("long_n"), F.explode(F.array_distinct(_pieces(""))).alias("word"))
    met = left.join(shuffled(short), "word")
    longer = met.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(_best(F.col("long_n"), F.col("long"))).alias("best"))
    shorter = met.groupBy(F.col("long").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(mine).alias("best"))
    return replaced.unionByName(longer).unionByName(shorter)


def _near_long(words: DataFrame) -> DataFrame:
    """The same for words of more than ``LONG`` code points, by digests."""
    names = words.where(F.length("word") >= LONG).mapInArrow(returning(lambda b: _digests(b, False)), "word string, n long, a long, b long")
    rows = words.where(F.length("word") > LONG).mapInArrow(returning(lambda b: _digests(b, True)), "a long, b long, n long, at long, x long, y long, letter int")
    group = Window.partitionBy("at", "x", "y")
    order = group.orderBy(F.desc("n"), "letter").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mine = F.struct("a", "b")
    member = rows.where("at >= 0").withColumns({"size": F.count(F.lit(1)).over(group), "first": F.first(mine).over(order), "second": F.nth_value(mine, 2).over(order)})
    other = F.when(F.col("first") == mine, F.col("second")).otherwise(F.col("first"))
    replaced = member.where("size > 1").select("a", "b", (F.col("size") - 1).alias("n_near"), other.alias("other"))
    met = rows.where("at < 0").select("a", "b", "x", "y").join(shuffled(names.select(F.col("a").alias("x"), F.col("b").alias("y"))), ["x", "y"])
    one = F.lit(1).cast("long").alias("n_near")
    both = met.select("a", "b", one, F.struct(F.col("x").alias("a"), F.col("y").alias("b")).alias("other")).unionByName(met.select(F.col("x").alias("a"), F.col("y").alias("b"), one, mine.alias("other")))
    known = names.select(F.struct("a", "b").alias("other"), _best(F.col("n"), F.col("word")).alias("best"))
    return replaced.unionByName(both).join(shuffled(known), "other").join(shuffled(names.select("a", "b", "word")), ["a", "b"]).select("word", "n_near", "best")


def near(words: DataFrame) -> DataFrame:
    """``words`` (word, n) with ``n_near`` and the best near word as ``best`` (n, word)."""
    found = _near_short(words).unionByName(_near_long(words)).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return words.join(shuffled(found), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.struct((-F.col("best.less")).alias("n"), F.col("best.word").alias("word")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the last of each chain. Every round doubles
    the steps taken; counts grow along a chain, so it ends."""
    at = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(at.join(shuffled(on), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return at


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a vocabulary (word, n)."""
    known = cut(words, "words")
    found = near(known)
    ok = F.col("best.n") >= ratio * F.col("n")
    judged = cut(found.select("word", "n", "n_near", F.when(ok, F.col("best.word")).alias("form"), F.when(ok, F.col("best.n")).alias("form_n")), "forms")
    ends = roots(judged.where(F.col("form").isNotNull()))
    return judged.join(shuffled(ends), "word", "left").withColumn("root", F.coalesce("root", "word")).select("word", "n", "n_near", "form", "form_n", "root")
