"""MinHash near-duplicates: ProbMinHash signatures, banding and verification.

A document is its five-word shingles (words: lower-cased runs of letters, digits and
non-ASCII characters) weighted by how often each occurs. Each shingle d of weight w
is a Poisson process of rate w whose arrivals hit random signature components; a
component keeps the shingle that arrives first, and a process ends as soon as its
next arrival comes after all components' present minima. Two signatures agree in a
component with the probability Jaccard similarity of the weighted shingles.

1. Documents of equal word sequences are one class; only its smallest id goes on.
2. Signatures are cut into bands; documents that share a band are candidates. In each
   band's bucket every member is compared with one pivot, the member that shares most
   buckets with others, so a group of n near copies costs n pairs.
3. Candidates whose sketches could reach the threshold are verified: the exact probability Jaccard similarity of the whole
   texts decides (0.8 or more). Links make components.
4. Buckets that still hold several components have the members outside the pivot's
   component compared with all members, in pairs of blocks of bounded size, by their
   signature sketches: pairs of different components that could reach the threshold,
   each in the first bucket that it shares, are verified like those of step 3. Only a
   pair of blocks with very many such pairs gets whole texts, verifies on the spot and
   emits only links that join components, so no task or table grows with the square
   of a group.

Texts are read twice, to sign and to verify, and only those of candidates travel: the
ids of candidates are broadcast while at most ``common.BROADCAST_IDS``, and beyond that docs are
joined with them by id.

With the default 24 bands of 6, a pair at 0.8 shares a band with probability 0.9993 (1 -
6.8e-04), and its sketches agree too seldom for step 4 with probability 2e-08 at most, so what
step 4 loses is negligible next to what the bands lose.

Defined results: a text of fewer than five words is one shingle; null texts and texts
without a word are alone in their class; rows with the same id are one document; a
null id is alone (class null); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.llm.common import cut, few, mix64, parts, returning, utf8, word_hashes
from lumenark.llm.components import components

WORDS = 5
BANDS, PER_BAND = 24, 6
SIZE = BANDS * PER_BAND
#: Documents and bytes that are signed at once.
BATCH_DOCS, BATCH_BYTES = 250, 1 << 20
BLOCK = 256
#: Pairs of one pivot that one task verifies.
PIVOT_PAIRS = 64
#: Pairs for each row of a block above which the block gets texts instead of emitting them.
DENSE = 4
#: Deviations of a sketch's estimate below the threshold that still count.
SLACK = 6
_PLACE = mix64(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray], list[tuple[int, int] | None]]:
    """For each text: distinct shingle hashes, their counts, and two 64-bit hashes of
    the whole word sequence (None without a word)."""
    with np.errstate(over="ignore"):
        words, sizes = word_hashes([utf8(t.lower()) if t else b"" for t in texts], plain=True)
        n = len(words)
        rolled = np.zeros(n, np.uint64)
        for k in range(WORDS):
            rolled[: n - k] += words[k:] * _PLACE[k]
        rolled = mix64(rolled)
        at, values, counts, keys = 0, [], [], []
        steps = np.arange(1, int(sizes.max(initial=0)) + 1, dtype=np.uint64)
        first, second = mix64(steps) | np.uint64(1), mix64(steps + np.uint64(1 << 40)) | np.uint64(1)
        for size in sizes.tolist():
            own = words[at : at + size]
            if not size:
                values.append(np.zeros(0, np.uint64)), counts.append(np.zeros(0, np.int64)), keys.append(None)
                continue
            if size < WORDS:
                v, c = mix64(np.array([(own * _PLACE[:size]).sum(dtype=np.uint64)], np.uint64)), np.ones(1, np.int64)
            else:
                v, c = np.unique(rolled[at : at + size - WORDS + 1], return_counts=True)
            values.append(v), counts.append(c)
            keys.append((int(mix64((own * first[:size]).sum(dtype=np.uint64, keepdims=True))[0]), int(mix64((own * second[:size]).sum(dtype=np.uint64, keepdims=True))[0])))
            at += size
    return values, counts, keys


def signatures(values: list[np.ndarray], counts: list[np.ndarray], size: int = SIZE) -> np.ndarray:
    """ProbMinHash of each document: for each component the shingle that arrives first."""
    n = len(values)
    first = np.full(n * size, np.inf)
    winner = np.zeros(n * size, np.uint64)
    doc = np.repeat(np.arange(n), [len(v) for v in values])
    d = np.concatenate(values) if n else np.zeros(0, np.uint64)
    w = np.concatenate(counts).astype(np.float64) if n else np.zeros(0)
    h = np.zeros(len(d))
    latest = np.full(n, np.inf)
    step = np.uint64(0)
    with np.errstate(over="ignore"):
        while len(d):
            step += np.uint64(2)
            u = mix64(d ^ mix64(np.array([step])))
            h = h - np.log1p(-(u >> np.uint64(11)).astype(np.float64) * 2.0**-53) / w
            alive = h < latest[doc]
            if not alive.all():
                d, doc, w, h, u = d[alive], doc[alive], w[alive], h[alive], u[alive]
                if not len(d):
                    break
            place = doc * size + (mix64(u + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(size)).astype(np.int64)
            np.minimum.at(first, place, h)
            won = first[place] == h
            winner[place[won]] = d[won]
            docs = np.unique(doc) if len(doc) < n else np.arange(n)
            latest[docs] = first.reshape(n, size)[docs].max(1)
    return winner.reshape(n, size)


def band_keys(signature: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        rows = mix64(signature).reshape(len(signature), BANDS, PER_BAND)
        key = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :].repeat(len(signature), 0)
        for k in range(PER_BAND):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return key


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact up to 12 places: over common d the sum of 1 / sum over d' of max(x'/x, y'/y)."""
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    if x.max() == 1 and y.max() == 1:  # plain sets: the ratio of two whole numbers
        return len(both) / (len(a) + len(b) - len(both))
    x, y = x.astype(float), y.astype(float)
    cx, cy = x[i], y[j]
    order = np.argsort(cx / cy, kind="stable")
    cx, cy = cx[order], cy[order]
    ratio = cx / cy
    # d' with x'/y' >= x/y count by x'/x, the others by y'/y
    from_here = np.searchsorted(ratio, ratio, side="left")
    sum_x = np.concatenate([[0], np.cumsum(cx)])
    sum_y = np.concatenate([[0], np.cumsum(cy)])
    only_x, only_y = x.sum() - cx.sum(), y.sum() - cy.sum()
    above = (sum_x[-1] - sum_x[from_here] + only_x) / cx
    below = (sum_y[from_here] + only_y) / cy
    return round(float((1 / (above + below)).sum()), 12)


def sign(docs: DataFrame) -> DataFrame:
    """(id, k1, k2, bands, sketch) of (id, text); k1 is null without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in parts(texts, BATCH_DOCS, BATCH_BYTES):
                values, counts, keys = shingles(texts[lo:hi])
                s = signatures(values, counts)
                bands = band_keys(s).view(np.int64)
                sketch = (mix64(s) & np.uint64(255)).astype(np.uint8)
                k = np.array([x or (0, 0) for x in keys], np.uint64).reshape(-1, 2).view(np.int64)
                none = np.array([x is None for x in keys])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(k[:, 0], mask=none), pa.array(k[:, 1], mask=none), pa.array(list(bands), pa.list_(pa.int64())), pa.array([x.tobytes() for x in sketch], pa.binary())],
                    names=["id", "k1", "k2", "bands", "sketch"],
                )

    return docs.mapInArrow(returning(run), "id long, k1 long, k2 long, bands array<long>, sketch binary")


def ids_and_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """One text for each of ``ids`` (id), however often its row repeats."""
    return docs.join(few(ids), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))


def alike(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sketches, in a table (rep, sketch), agree often enough to
    be verified. Both sides are tables, so that Spark can split a hot end."""
    both = pairs
    for end in ("a", "b"):
        both = both.join(sketches.select(F.col("rep").alias(end), F.col("sketch").alias(f"sketch_{end}")), end)
    least = least_places(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SIZE) for c in ("sketch_a", "sketch_b"))
            yield batch.select(["a", "b"]).filter(pa.array((one == two).sum(1) >= least))

    return both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(returning(run), "a long, b long")


def verify(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of ids whose texts in ``docs`` (id, text) are similar enough.

    ``pairs`` is a table. The pairs of a pivot b are dealt to groups of about
    ``PIVOT_PAIRS``; each group gets b's text once and that of each a, so one pivot's
    pairs spread over tasks and no text travels twice to a group."""
    per = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PIVOT_PAIRS).cast("int").alias("groups"))
    dealt = pairs.join(per, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("groups")).cast("int").alias("nth"))
    places = dealt.select("b", "nth", F.lit(1).alias("kind"), F.col("a").alias("id")).union(dealt.select("b", "nth", F.lit(0), "b").distinct())
    placed = places.join(ids_and_texts(docs, places.select("id").distinct()), "id")
    # the key is hashed, so that consecutive ids and numbers spread
    placed = placed.repartition(F.xxhash64("b", "nth")).sortWithinPartitions("b", "nth", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = None
        for batch in batches:
            b, nth, kind, ids, texts = (batch.column(c).to_pylist() for c in ("b", "nth", "kind", "id", "text"))
            good = np.zeros(batch.num_rows, bool)
            for lo, hi in parts(texts, BATCH_DOCS, BATCH_BYTES):
                values, counts, _ = shingles(texts[lo:hi])
                for i in range(lo, hi):
                    own = (b[i], nth[i]), values[i - lo], counts[i - lo]
                    if kind[i] == 0:
                        pivot = own
                    elif pivot is not None and pivot[0] == own[0]:
                        good[i] = probability_jaccard(*own[1:], *pivot[1:]) >= threshold
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return placed.select("b", "nth", "kind", "id", "text").mapInArrow(returning(run), "a long, b long")


def least_places(threshold: float) -> float:
    """In how many places the sketches of a pair must agree before it is verified."""
    return SIZE * (threshold - SLACK * (threshold * (1 - threshold) / SIZE) ** 0.5)


class _Block:
    """Members of one bucket that are compared together."""

    def __init__(self, rows: pa.Table):
        rep = rows["rep"].to_numpy()
        _, first = np.unique(rep, return_index=True)  # an id may have several rows
        rows = rows.take(pa.array(first))
        self.rep, self.comp = rep[first], rows["comp"].to_numpy()
        self.near, self.block = rows["near"].to_numpy(zero_copy_only=False), rows["block"].to_numpy()
        self.sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(-1, SIZE)
        self.bands = np.array(rows["bands"].to_pylist(), np.int64).reshape(-1, BANDS)
        self.key, self.kind, self.i, self.j = (rows[c][0].as_py() for c in ("key", "kind", "i", "j"))
        self.rows = rows

    def candidates(self, least: float) -> Iterator[tuple[int, np.ndarray]]:
        """Pairs of different components whose sketches could reach the threshold and
        for which this is the first bucket that they share."""
        if self.kind == 0:  # the group holds one block of either side
            one, two = np.flatnonzero(self.near), np.flatnonzero(~self.near)
        else:
            one, two = np.flatnonzero(self.block == self.i), np.flatnonzero(self.block == self.j)
        if not len(one) or not len(two):
            return
        nth = int(np.flatnonzero(self.bands[one[0]] == self.key)[0])
        for x in one:
            ok = (self.sketch[two] == self.sketch[x]).sum(1) >= least
            ok &= self.comp[two] != self.comp[x]
            if self.kind == 1 and self.i == self.j:
                ok &= two > x
            hit = two[ok]
            if len(hit) and nth:
                hit = hit[~(self.bands[hit, :nth] == self.bands[x, :nth]).any(1)]
            if len(hit):
                yield int(x), hit

    def links(self, least: float, threshold: float) -> list[tuple[int, int]]:
        """Verified links that join components, one for each two that they join."""
        found = list(self.candidates(least))
        if not found:
            return []
        used = np.unique(np.concatenate([np.append(hit, x) for x, hit in found]))
        place = {int(u): k for k, u in enumerate(used)}
        values, counts, _ = shingles(self.rows["text"].take(pa.array(used)).to_pylist())
        sizes = np.array([len(v) for v in values])
        plain = np.array([bool((c == 1).all()) for c in counts])
        _, flat = np.unique(np.concatenate(values), return_inverse=True)
        ids = np.split(flat, np.cumsum(sizes)[:-1])
        mark = np.zeros(int(flat.max(initial=0)) + 1, bool)
        up: dict[int, int] = {}

        def top(c: int) -> int:
            while up.get(c, c) != c:
                c = up[c]
            return c

        out = []
        for x, hit in found:
            k = place[x]
            others = [h for h in hit.tolist() if top(int(self.comp[h])) != top(int(self.comp[x]))]
            if not others:
                continue
            at = [place[h] for h in others]
            near = np.zeros(len(others))
            quick = [n for n, a in enumerate(at) if plain[k] and plain[a] and sizes[a]]
            if quick:  # plain sets: shared shingles over all
                mark[ids[k]] = True
                lengths = sizes[[at[n] for n in quick]]
                shared = np.add.reduceat(mark[np.concatenate([ids[at[n]] for n in quick])].astype(np.int64), np.cumsum(lengths) - lengths)
                mark[ids[k]] = False
                near[quick] = shared / (sizes[k] + lengths - shared)
            for n in set(range(len(at))).difference(quick):
                near[n] = probability_jaccard(values[k], counts[k], values[at[n]], counts[at[n]])
            for n in np.flatnonzero(near >= threshold):
                a, b = top(int(self.comp[x])), top(int(self.comp[others[n]]))
                if a != b:
                    up[max(a, b)] = min(a, b)
                    out.append((int(self.rep[x]), int(self.rep[others[n]])))
        return out


def _runs(batches: Iterator[pa.RecordBatch], group: list[str]) -> Iterator[pa.Table]:
    """The consecutive rows of each group, of sorted batches."""
    last, held = None, []
    for batch in batches:
        marks = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in group], 1)
        edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), len(marks)]
        for lo, hi in zip(edges, edges[1:]):
            if hi == lo:
                continue
            this = tuple(marks[lo])
            if this != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = this
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


_GROUP = ["key", "kind", "i", "j"]


def _blocks(members: DataFrame, pivots: DataFrame, classes: DataFrame) -> DataFrame:
    """Buckets that still hold several components as pairs of blocks: kind 0 has the
    members outside the pivot's component (near) against those within, kind 1 the
    former among themselves. No block holds more than about twice ``BLOCK`` rows."""
    where = members.join(classes, F.col("rep") == F.col("id"), "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    pivot_comp = pivots.join(classes, F.col("pivot") == F.col("id"), "left").select("key", F.coalesce("component", "pivot").alias("base"))
    own = where.join(pivot_comp, "key").withColumn("near", F.col("comp") != F.col("base"))
    blocks = lambda c: F.greatest(F.ceil(c / BLOCK), F.lit(1)).cast("int")
    mixed = own.groupBy("key").agg(F.sum(F.col("near").cast("long")).alias("n_near"), F.count(F.lit(1)).alias("n")).where("n_near > 0")
    mixed = mixed.select("key", blocks(F.col("n") - F.col("n_near")).alias("base_blocks"), blocks(F.col("n_near")).alias("near_blocks"))
    rows = own.join(mixed, "key")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.when(F.col("near"), F.col("near_blocks")).otherwise(F.col("base_blocks"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    to_base = rows.withColumn("o", F.explode(F.when(F.col("near"), upto("base_blocks")).otherwise(upto("near_blocks"))))
    to_base = to_base.withColumns({"kind": F.lit(0), "i": F.when(F.col("near"), F.col("block")).otherwise(F.col("o")), "j": F.when(F.col("near"), F.col("o")).otherwise(F.col("block"))})
    among = rows.where("near").withColumn("o", F.explode(upto("near_blocks"))).withColumns({"kind": F.lit(1), "i": F.least("block", "o"), "j": F.greatest("block", "o")})
    columns = [*_GROUP, "rep", "comp", "near", "block"]
    return to_base.select(columns).union(among.select(columns))


def _rest(members: DataFrame, pivots: DataFrame, classes: DataFrame, reps: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Verified links (a, b) that the pivots left between components.

    Blocks compare sketches first, without texts, and emit the pairs to verify. A
    block with more than ``DENSE`` of them for each of its rows emits none but its
    number; only such blocks get the texts of their rows, and verify on the spot."""
    rows = cut(_blocks(members, pivots, classes), "blocks")
    full = rows.join(reps.select("rep", "bands", "sketch"), "rep")
    columns = [*_GROUP, "rep", "comp", "near", "block", "bands", "sketch"]
    least = least_places(threshold)
    deal = lambda df: df.repartition(F.xxhash64(*_GROUP)).sortWithinPartitions(*_GROUP)
    found_schema = "a long, b long, key long, kind int, i int, j int"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, _GROUP):
            block = _Block(table)
            pairs = [(int(block.rep[x]), int(block.rep[h])) for x, hit in block.candidates(least) for h in hit]
            if len(pairs) > DENSE * table.num_rows:
                out = [(None, None, block.key, block.kind, block.i, block.j)]
            else:
                out = [(max(p), min(p), None, None, None, None) for p in pairs]
            types = [pa.int64()] * 3 + [pa.int32()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], names=["a", "b", *_GROUP])

    found = cut(deal(full.select(columns)).mapInArrow(returning(search), found_schema), "candidates")
    thin = cut(found.where(F.col("a").isNotNull()).select("a", "b").distinct(), "candidate-pairs")
    links = verify(thin, docs, threshold)
    dense = found.where(F.col("a").isNull()).select(_GROUP)
    if dense.limit(1).count() == 0:
        return links
    held = cut(full.join(dense, _GROUP, "left_semi").select(columns), "dense")
    texts = ids_and_texts(docs, held.select(F.col("rep").alias("id")).distinct()).withColumnRenamed("id", "rep")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, _GROUP):
            found = _Block(table).links(least, threshold)
            yield pa.RecordBatch.from_arrays([pa.array([max(f) for f in found], pa.int64()), pa.array([min(f) for f in found], pa.int64())], names=["a", "b"])

    return links.union(deal(held.join(texts, "rep").select(*columns, "text")).mapInArrow(returning(settle), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row per document: id, class_id (the class's smallest id) and kept."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = cut(sign(source.where(F.col("id").isNotNull())), "signed")
    wordy = signed.where(F.col("k1").isNotNull())
    best = wordy.groupBy("k1", "k2").agg(F.min(F.struct("id", "bands", "sketch")).alias("r"))
    reps = cut(best.select("k1", "k2", F.col("r.id").alias("rep"), "r.bands", "r.sketch"), "reps")
    banded = reps.select("rep", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(banded.join(shared, "key"), "members")
    central = members.groupBy("rep").agg(F.sum("n").alias("c"))
    pivots = cut(members.join(central, "rep").groupBy("key").agg(F.max(F.struct("c", (-F.col("rep")).alias("r"))).alias("m")).select("key", (-F.col("m.r")).alias("pivot")), "pivots")
    pairs = members.join(pivots, "key").where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    sketches = cut(reps.groupBy("rep").agg(F.min("sketch").alias("sketch")), "sketches")
    links = cut(verify(cut(alike(cut(pairs, "met"), sketches, threshold), "pairs"), source, threshold), "links")
    classes = cut(components(links), "classes")
    more = cut(_rest(members, pivots, classes, reps, source, threshold), "links")
    # components of components
    joined = more
    for end in ("a", "b"):
        of = classes.select(F.col("id").alias(end), F.col("component").alias("_c"))
        joined = joined.join(of, end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
    merged = components(joined.select("a", "b")).select(F.col("id").alias("first"), F.col("component").alias("top"))
    of = reps.select("k1", "k2", "rep").join(classes.withColumnRenamed("id", "rep"), "rep", "left").withColumn("first", F.coalesce("component", "rep"))
    of = of.join(merged, "first", "left").select("k1", "k2", F.coalesce("top", "first").alias("class_id"))
    found = signed.where(F.col("k1").isNotNull()).select("id", "k1", "k2").join(of, ["k1", "k2"]).select("id", "class_id")
    found = found.union(signed.where(F.col("k1").isNull()).select("id", F.col("id").alias("class_id"))).groupBy("id").agg(F.min("class_id").alias("class_id"))
    empty = source.where(F.col("id").isNull()).select("id", F.lit(None).cast("long").alias("class_id"))
    return found.union(empty).select(F.col("id").alias(id_col), "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))
