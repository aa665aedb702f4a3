"""How far the sources of a language stand apart, and by which words.

Every (lang, source) group gives each kept term of its language a smoothed share p, in
units of a thousand-millionth; all arithmetic is on whole numbers. Two questions are asked:
how far a group's shares are from each other source's (summed over all kept terms), and
which fifty terms stand out most above the language's own shares.

Postings (one row for each kept term: what each source counts) are made once and written.
Terms are counted where texts are read, so a shuffle carries a row for each distinct term
of a task's batch and group; a hot source is counted in as many tasks as hold it.

*Terms.* No group's terms are sorted whole. Its terms fall into buckets by count (one for
each count up to 64, then sixteen to a doubling), and a bucket keeps how many terms it has,
the least and largest count, and the extremes of the language's counts. As shares grow with
counts, p of the largest count less q of the least bounds f for the whole bucket. Buckets
are taken best first: the first batch ends where it holds ``top`` terms, its exact values
give a kth value, and the second batch is every bucket left whose bound is not strictly
below it. What is then unseen is strictly below the kth value, so it can't enter, nor tie.

*Pairs.* A group's sum with each other source, as if they shared no term, follows from the
group's histogram of shares and the other's share of a term that it lacks. Postings correct
it for the terms that both hold: tasks add the corrections of their terms into matrices of
``TILE`` x ``TILE`` sources, as many as ``TILES`` at once, and pass on the sums; no pair of
sources is a row for each term.

Defined results: null text, lang and source read as ''; rows repeat as they are; very long
terms are terms like others; a group without terms takes part in pairs; without kept terms
pairs have value 0 and no term is listed; an empty table gives no rows; columns beyond
the three are ignored. Equal values rank by item.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenark.llm.common import cut, returning

#: Documents of a kept term, smoothing, units of a share, terms listed.
DOCUMENTS, ADDED, UNITS, TOP = 30, 5, 1_000_000_000, 50
#: Distinct (group, term) of a task, and bytes read, after which it hands on its counts.
HELD, READ = 300_000, 1 << 26
#: Sources on a side of a matrix of corrections, and matrices that a task holds at once.
TILE, TILES = 256, 64


def _table() -> bytes:
    """UTF-8 bytes of terms as they are, A-Z lower-cased; ASCII that is no letter is space."""
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


_TERMS = _table()


def terms_of(text: str | None) -> list[bytes]:
    return [t for t in text.encode("utf-8", "surrogatepass").translate(_TERMS).split(b" ") if t] if text else []


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's texts; a null term for each group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = read = 0

    def flush() -> pa.RecordBatch:
        nonlocal size, read
        langs, sources, terms, n, docs = [], [], [], [], []
        for (lang, source), (times, holding) in held.items():
            k = len(times) + 1
            langs += [lang] * k
            sources += [source] * k
            terms += [None, *(t.decode("utf-8", "surrogatepass") for t in times)]
            n += [0, *times.values()]
            docs += [0, *(holding[t] for t in times)]
        held.clear()
        size = read = 0
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            text = text.as_py()
            own = Counter(terms_of(text))
            times, holding = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(times)
            times.update(own)
            holding.update(own.keys())
            size += len(times)
            read += len(text)
            if size >= HELD or read >= READ:
                yield flush()
    if held:
        yield flush()


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), written once; a null term for every group that occurs."""
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    rows = docs.select(*text).mapInArrow(returning(_counted), "lang string, source string, term string, n long, docs long")
    return cut(rows.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "source-counts")


def postings(counted: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """(lang, term, total, held [(source, n)]) of the terms that a language keeps, written."""
    terms = counted.where(F.col("term").isNotNull()).groupBy("lang", "term")
    kept = terms.agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("held"))
    return cut(kept.where(F.col("docs") >= documents).select("lang", "term", "total", "held"), "source-postings")


def bucket(n: Column) -> Column:
    """Counts up to 64 have buckets of their own, then sixteen share a doubling."""
    return F.when(n <= 64, n).otherwise(F.floor(F.log2(n.cast("double")) * 16)).cast("long")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNITS * (n + ADDED) / (total + ADDED * terms)), on decimals."""
    total, terms = total.cast("long"), terms.cast("long")
    top = ((n + ADDED).cast("decimal(19,0)") * F.lit(UNITS).cast("decimal(10,0)")).cast("decimal(29,0)")
    below = (total + ADDED * terms).cast("decimal(19,0)")
    # ``div``: the whole part of a decimal quotient, exact
    return 1 + F.call_function("div", top, below)


class Audit:
    """The tables that both parts read: ``postings``, and of every group its totals."""

    def __init__(self, docs: DataFrame, documents: int = DOCUMENTS):
        counted = counts(docs)
        self.postings = postings(counted, documents)
        rows = self.postings.select("lang", "total", F.inline("held"))
        parts = rows.groupBy("lang", "source", bucket(F.col("n")).alias("bucket")).agg(
            F.count(F.lit(1)).alias("terms"), F.sum("n").alias("sum"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("total").alias("rarest"), F.max("total").alias("commonest")
        )
        self.buckets = cut(parts, "source-buckets")
        langs = self.postings.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_sum"))
        own = self.buckets.groupBy("lang", "source").agg(F.sum("terms").alias("terms"), F.sum("sum").alias("sum"))
        every = counted.where(F.col("term").isNull()).select("lang", "source")
        zero = lambda *names: {c: F.coalesce(c, F.lit(0).cast("long")) for c in names}
        found = every.join(own, ["lang", "source"], "left").join(langs, "lang", "left").withColumns(zero("terms", "sum", "v", "lang_sum"))
        found = found.withColumn("absent", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("sum"), F.col("v"))).otherwise(F.lit(0).cast("long")))
        #: (lang, source, terms, sum, v, lang_sum, absent): a row for each group
        self.groups = cut(found.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "source-groups")

    def over(self, top: int = TOP) -> DataFrame:
        """(lang, source, item, value, rank): the terms furthest above the language."""
        p = lambda n: share(n, F.col("sum"), F.col("v"))
        q = lambda n: share(n, F.col("lang_sum"), F.col("v"))
        own = self.groups.select("lang", "source", "sum", "v", "lang_sum")
        group = Window.partitionBy("lang", "source")
        bounded = self.buckets.drop("sum").join(own, ["lang", "source"]).withColumn("bound", p(F.col("most")) - q(F.col("rarest")))
        seen = F.sum("terms").over(group.orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1))
        bounded = cut(bounded.where("bound > 0").select("lang", "source", "bucket", "bound", F.coalesce(seen, F.lit(0).cast("long")).alias("before")), "source-bounds")
        rows = self.postings.select("lang", "term", "total", F.inline("held")).withColumn("bucket", bucket(F.col("n")))

        def evaluated(buckets: DataFrame) -> DataFrame:
            chosen = rows.join(buckets.select("lang", "source", "bucket"), ["lang", "source", "bucket"]).join(own, ["lang", "source"])
            exact = chosen.select("lang", "source", "term", (p(F.col("n")) - q(F.col("total"))).alias("value")).where("value > 0")
            rank = F.row_number().over(group.orderBy(F.desc("value"), "term"))
            return exact.withColumn("rank", rank).where(F.col("rank") <= top)

        first = cut(evaluated(bounded.where(F.col("before") < top)), "source-terms")
        kth = first.where(F.col("rank") == top).select("lang", "source", F.col("value").alias("kth"))
        rest = bounded.where(F.col("before") >= top).join(kth, ["lang", "source"], "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth")))
        both = first.drop("rank").unionByName(evaluated(rest).drop("rank"))
        rank = F.row_number().over(group.orderBy(F.desc("value"), "term"))
        return both.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "source", F.col("term").alias("item"), "value", "rank")

    def apart(self) -> DataFrame:
        """(lang, source, item, value): each group and each other source of its language."""
        # what a group's terms are away from x, summed, for the x of every other group
        rows = self.postings.select("lang", F.inline("held"))
        own = self.groups.select("lang", "source", "at", "terms", "sum", "v", "absent")
        shares = rows.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("times")).join(own, ["lang", "source"])
        histogram = shares.select("lang", "source", share(F.col("n"), F.col("sum"), F.col("v")).alias("p"), "times").groupBy("lang", "source").agg(F.collect_list("p").alias("p"), F.collect_list("times").alias("times"))
        others = own.groupBy("lang").agg(F.collect_list(F.struct("source", "absent", "terms")).alias("others"))
        wide = own.join(histogram, ["lang", "source"], "left").join(others, "lang")
        alone = wide.select("lang", "source", "v", "terms", "absent", "p", "times", F.col("others.source").alias("o_source"), F.col("others.absent").alias("o_absent"), F.col("others.terms").alias("o_terms")).mapInArrow(returning(_alone), "lang string, source string, item string, value long")
        turned = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("value"))
        # term by term, the groups that hold it
        known = self.postings.select("lang", "term", F.inline("held")).join(own, ["lang", "source"])
        lists = known.groupBy("lang", "term").agg(F.collect_list("at").alias("at"), F.collect_list(share(F.col("n"), F.col("sum"), F.col("v"))).alias("p"), F.collect_list("absent").alias("absent"))
        both = lists.where(F.size("at") > 1).select("lang", "at", "p", "absent").mapInArrow(returning(_together), "lang string, i int, j int, value long")
        names = self.groups.select("lang", "source", "at")
        both = both.where("i <> j").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
        both = both.join(names.select("lang", F.col("at").alias("i"), "source"), ["lang", "i"]).join(names.select("lang", F.col("at").alias("j"), F.col("source").alias("item")), ["lang", "j"])
        parts = alone.unionByName(turned).unionByName(both.select("lang", "source", "item", "value"))
        return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a group a and each other b: what a's terms are away from the share of a term that
    b lacks; and, once for both directions, what the other terms of the language are apart."""
    for batch in batches:
        for row in batch.to_pylist():
            p, times = np.array(row["p"] or [], np.int64), np.array(row["times"] or [], np.int64)
            order = np.argsort(p)
            p, times = p[order], times[order]
            many, mass = np.concatenate([[0], np.cumsum(times)]), np.concatenate([[0], np.cumsum(times * p)])
            others = [i for i, s in enumerate(row["o_source"]) if s != row["source"]]
            x = np.array(row["o_absent"], np.int64)[others]
            k = np.searchsorted(p, x)
            away = x * many[k] - mass[k] + (mass[-1] - mass[k]) - x * (many[-1] - many[k])
            # v - |a| - |b| terms would be in neither, were none in both: _together corrects it
            apart = np.abs(x - row["absent"])
            neither = row["v"] - row["terms"] - np.array(row["o_terms"], np.int64)[others]
            first = np.array([row["source"] < row["o_source"][i] for i in others], bool)  # one direction has it
            value = away + np.where(first, apart * neither, 0)
            n = len(others)
            yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * n, pa.string()), pa.array([row["source"]] * n, pa.string()), pa.array([row["o_source"][i] for i in others], pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "item", "value"])


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections for the terms that two groups both hold, summed over a task's terms."""
    tiles: dict[tuple[str, int, int], np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, a, b), sums in tiles.items():
            i, j = np.nonzero(sums)
            columns = [pa.array([lang] * len(i), pa.string()), pa.array(i + a * TILE, pa.int32()), pa.array(j + b * TILE, pa.int32()), pa.array(sums[i, j], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "i", "j", "value"])
        tiles.clear()

    for batch in batches:
        for row in batch.to_pylist():
            at, p, absent = (np.array(row[c], np.int64) for c in ("at", "p", "absent"))
            order = np.argsort(at)
            at, p, absent = at[order], p[order], absent[order]
            cuts = [*np.flatnonzero(np.diff(at // TILE, prepend=-1)).tolist(), len(at)]
            spans = list(zip(cuts, cuts[1:]))
            for a, a_end in spans:
                for b, b_end in spans:
                    left, right = slice(a, a_end), slice(b, b_end)
                    p1, p2, z1, z2 = p[left, None], p[None, right], absent[left, None], absent[None, right]
                    value = np.abs(p1 - p2) - np.abs(p1 - z2) - np.abs(z1 - p2) + np.abs(z1 - z2)
                    key = (row["lang"], int(at[a]) // TILE, int(at[b]) // TILE)
                    if key not in tiles:
                        if len(tiles) >= TILES:
                            yield from flush()
                        tiles[key] = np.zeros((TILE, TILE), np.int64)
                    tiles[key][np.ix_(at[left] % TILE, at[right] % TILE)] += value
    yield from flush()


def audit(docs: DataFrame, documents: int = DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank)."""
    tables = Audit(docs, documents)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = tables.apart().withColumns({"part": F.lit("pair"), "rank": rank})
    terms = tables.over(top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 30),
sizes AS (SELECT lang, count(*) AS v, sum(total) AS lang_sum FROM kept GROUP BY 1),
groups AS (SELECT DISTINCT lang, source FROM docs),
held AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM held h WHERE h.lang = g.lang AND h.source = g.source), 0) AS s FROM groups g),
every AS (SELECT g.lang, g.source, k.term, k.total, coalesce(h.n, 0) AS n, z.v, z.lang_sum, g.s FROM sums g JOIN kept k USING (lang) JOIN sizes z USING (lang) LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
shares AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (s + 5 * v) AS p, 1 + (1000000000::HUGEINT * (total + 5)) // (lang_sum + 5 * v) AS q FROM every),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL SELECT lang, source, 'term', item, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms) WHERE rank <= 50
"""
