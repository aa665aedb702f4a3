"""Line deduplication through a sharded minimal perfect hash.

A line's key is the line stripped of ASCII white space at both ends with A-Z
lower-cased. Keys of at least ``min_chars`` code points found in at least
``min_docs`` documents lose all their lines except in the largest id that holds them.

1. Tasks count the distinct keys of each document (two 64-bit halves of a 128-bit
   hash), combine them in bounded memory and write them once; partial counts are then
   dealt to shards by hash.
2. Each shard builds a minimal perfect hash over its distinct line hashes, which indexes
   compact arrays of fingerprints (the second half), document counts and largest ids.
   Partial counts are added up through the hash; the count array decides which lines
   repeat, and the shard keeps its arrays for those only.
3. Documents probe the arrays. While all shards' arrays together are within
   ``BROADCAST_BYTES`` they are broadcast. Beyond it, the hashes of the documents' lines
   (not the lines) travel to the shards, in as many parts as their counted number asks
   for, so that no task grows with one frequent line, and the hits travel back by
   document (id and a hash of the text).

Defined results: a null or empty text is one empty line (a null text stays null); a
row is a document, so repeated rows count each, and if they hold the largest id each
keeps its lines; a null id is smaller than any other; very long texts are read whole; an
empty table gives no rows; other columns pass through, except that ``n_lines``,
``n_dropped`` and, with ``digest``, ``kept_sha256`` are replaced; ``n_chars``, if
there, is set to the kept text's code points.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.llm.common import SPACES, cut, mix64, others, parts, returning, unused, utf8

BROADCAST_BYTES = 48 << 20
#: Partial counts for one shard, and lines for one task that asks a shard.
SHARD_KEYS = 1 << 18
ASKING = 1 << 19
#: Keys that a task combines before it hands them on, and texts (or characters) it hashes at once.
COMBINED = 200_000
ROWS, CHARACTERS = 500, 4 << 20
_STRIP = SPACES.encode()
#: Stands for a null id; ids of 64 bits are larger.
_NULL_ID = -(2**63)


class PerfectHash:
    """A minimal perfect hash over 64-bit keys: levels of bits, each of twice the
    keys that are left; a key that is alone in its bit is placed there, the others
    go on. A placed key's index is its bit's rank over all levels."""

    def __init__(self, keys: np.ndarray):
        self.levels, base = [], 0
        left = np.unique(keys)
        while len(left):
            words = -(-2 * len(left) // 64) + 1
            at = self._place(left, len(self.levels), words)
            hits = np.bincount(at, minlength=words * 64)
            bits = np.packbits(hits == 1, bitorder="little").view("<u8")
            counts = np.bitwise_count(bits).astype(np.int64)
            self.levels.append((bits, base + np.concatenate([[0], np.cumsum(counts)[:-1]])))
            base += int(counts.sum())
            left = left[hits[at] != 1]
        self.size = base

    @staticmethod
    def _place(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        return (mix64(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(words * 64)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """0 to size - 1, each once over the built keys; other keys get any index or -1."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (bits, rank) in enumerate(self.levels):
            if not len(todo):
                break
            at = self._place(keys[todo], level, len(bits))
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            here = ((word >> bit) & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[here]] = (rank[at >> 6] + below)[here]
            todo = todo[~here]
        return out


class Shard:
    """Perfect hash over distinct line hashes and the arrays it indexes, from partial
    counts: halves of the hash, documents and largest id."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, docs: np.ndarray, largest: np.ndarray):
        self.seed = -1
        while True:  # until the seed tells all distinct pairs of halves apart
            self.seed += 1
            keys = self._keys(h1, h2)
            self.hash = PerfectHash(keys)
            at = self.hash.index(keys)
            self.fingerprint = np.zeros(self.hash.size, np.uint64)
            self.fingerprint[at] = h2
            first = np.zeros(self.hash.size, np.uint64)
            first[at] = h1
            if (self.fingerprint[at] == h2).all() and (first[at] == h1).all():
                break
        self.count = np.zeros(self.hash.size, np.int64)
        np.add.at(self.count, at, docs)
        self.largest = np.full(self.hash.size, _NULL_ID, np.int64)
        np.maximum.at(self.largest, at, largest)
        self._first = first

    def _keys(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return h1 ^ mix64(h2 + np.uint64(self.seed)) if self.seed else h1

    def repeated(self, min_docs: int) -> Shard:
        """The arrays of the lines that enough documents hold."""
        some = self.count >= min_docs
        out = Shard(self._first[some], self.fingerprint[some], self.count[some], self.largest[some])
        del out._first  # only the fingerprints are probed
        return out

    def keepers(self, h1: np.ndarray, h2: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether each line repeats, and the id that keeps it."""
        at = self.hash.index(self._keys(h1, h2))
        found = at >= 0
        if not self.hash.size:
            return found, at
        at = np.maximum(at, 0)
        return found & (self.fingerprint[at] == h2) & (self.count[at] >= min_docs), self.largest[at]


def _keys(text: str | None, min_chars: int) -> list[bytes]:
    """The key of each line, empty if it is too short to count."""
    out = []
    for line in utf8(text).lower().split(b"\n"):
        key = line.strip(_STRIP)
        long = len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_chars)
        out.append(key if long else b"")
    return out


def _halves(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return h >> 64, h & 0xFFFFFFFFFFFFFFFF


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def partial_counts(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, docs, largest): documents that hold a line, and the largest id, of each
    task's lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            h = np.frombuffer(b"".join(seen), ">u8").astype(np.uint64).reshape(-1, 2)
            out = [pa.array(h[:, k].view(np.int64)) for k in (0, 1)] + [pa.array([e[k] for e in seen.values()], pa.int64()) for k in (0, 1)]
            seen.clear()
            return pa.RecordBatch.from_arrays(out, names=["h1", "h2", "docs", "largest"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                i = _NULL_ID if i is None else i
                for key in set(_keys(text, min_chars)):
                    if key:
                        e = seen.setdefault(xxhash.xxh3_128_digest(key), [0, i])
                        e[0] += 1
                        e[1] = max(e[1], i)
                if len(seen) >= COMBINED:
                    yield flush()
        if seen:
            yield flush()

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(returning(run), "h1 long, h2 long, docs long, largest long")


def build_shards(counts: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """One row per shard that holds a repeated line: its number and pickled arrays."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        one = Shard(pdf.h1.to_numpy().view(np.uint64), pdf.h2.to_numpy().view(np.uint64), pdf.docs.to_numpy(), pdf.largest.to_numpy()).repeated(min_docs)
        some = [pickle.dumps(one)] if one.hash.size else []
        return pd.DataFrame({"shard": np.array([pdf["shard"].iloc[0]] * len(some), np.int64), "arrays": some})

    return counts.withColumn("shard", F.pmod("h1", F.lit(shards))).groupBy("shard").applyInPandas(build, "shard long, arrays binary")


def _short(batches: Iterator[pa.RecordBatch], text_col: str | int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of bounded rows and characters."""
    for batch in batches:
        for lo, hi in parts(batch.column(text_col).to_pylist(), ROWS, CHARACTERS):
            yield batch.slice(lo, hi - lo)


def _rewrite(docs: DataFrame, id_col: str, text_col: str, digest: bool, dropped, extra: list[str] = []) -> DataFrame:  # noqa: B006
    """Apply ``dropped(ids, texts, extra columns) -> flags of each row``."""
    names = others(docs.columns, "n_lines", "n_dropped", "kept_sha256", *extra)
    fields = docs.select(*names).schema.add("n_lines", "long").add("n_dropped", "long")
    if digest:
        fields = fields.add("kept_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _short(batches, text_col):
            texts = batch.column(text_col).to_pylist()
            flags = dropped(batch.column(id_col), texts, [batch.column(c) for c in extra])
            kept, n_lines, n_dropped, sums = [], [], [], []
            for text, gone in zip(texts, flags):
                lines = (text or "").split("\n")
                n_lines.append(len(lines))
                n_dropped.append(sum(gone))
                kept.append("\n".join(x for x, g in zip(lines, gone) if not g) if any(gone) else text)
                if digest:
                    sums.append(hashlib.sha256(utf8(kept[-1])).hexdigest())
            columns = {c: batch.column(c) for c in names}
            columns[text_col] = pa.array(kept, batch.column(text_col).type)
            if "n_chars" in columns:
                columns["n_chars"] = pc.coalesce(pc.utf8_length(columns[text_col]).cast(columns["n_chars"].type), columns["n_chars"])
            columns |= {"n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            if digest:
                columns["kept_sha256"] = pa.array(sums, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.select(*names, *extra).mapInArrow(returning(run), fields)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, digest: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text_col``, and n_lines,
    n_dropped and, with ``digest``, kept_sha256."""
    spark = docs.sparkSession
    counts = cut(partial_counts(docs, id_col, text_col, min_chars), "line-counts")
    shards = max(1, -(-counts.count() // SHARD_KEYS))
    built = cut(build_shards(counts, shards, min_docs), "line-shards")
    size = built.agg(F.sum(F.length("arrays"))).first()[0] or 0

    def hashes(texts: list) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Lines of each text, and both halves for each line (0 if too short)."""
        sizes, flat = [], []
        for t in texts:
            k = _keys(t, min_chars)
            sizes.append(len(k))
            flat += [_halves(x) if x else (0, 0) for x in k]
        both = np.array(flat, np.uint64).reshape(-1, 2)
        return sizes, both[:, 0], both[:, 1]

    def ids_of(column: pa.Array) -> np.ndarray:
        return pc.fill_null(column.cast(pa.int64()), _NULL_ID).to_numpy(zero_copy_only=False)

    def slices(flags: np.ndarray, sizes: list[int]) -> list[list[bool]]:
        out, at, flat = [], 0, flags.tolist()
        for s in sizes:
            out.append(flat[at : at + s])
            at += s
        return out

    if size <= broadcast_bytes:
        arrays = {r["shard"]: bytes(r["arrays"]) for r in built.collect()}
        sent = spark.sparkContext.broadcast(arrays)
        loaded: dict[int, Shard] = {}

        def probe(ids: pa.Array, texts: list, _) -> list[list[bool]]:
            if not loaded:
                loaded.update({k: pickle.loads(v) for k, v in sent.value.items()})
            sizes, h1, h2 = hashes(texts)
            own = np.repeat(ids_of(ids), sizes)
            gone = np.zeros(len(h1), bool)
            shard = h1.view(np.int64) % np.int64(shards)
            for k, s in loaded.items():
                mine = np.flatnonzero((shard == k) & ((h1 != 0) | (h2 != 0)))
                found, keeper = s.keepers(h1[mine], h2[mine], min_docs)
                gone[mine] = found & (keeper != own[mine])
            return slices(gone, sizes)

        return _rewrite(docs, id_col, text_col, digest, probe)

    # Too large to broadcast: the hashes travel to the shards instead.
    own, mark, gone, none = (unused(docs.columns, n) for n in ("_own", "_mark", "_gone", "_none"))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _short(batches, 2):
            sizes, h1, h2 = hashes(batch.column(2).to_pylist())
            ids, marks = (np.repeat(batch.column(k).to_numpy(), sizes) for k in (0, 1))
            some = (h1 != 0) | (h2 != 0)
            h1, h2 = h1[some].view(np.int64), h2[some].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1 % np.int64(shards), ids[some], marks[some], h1, h2)], names=["shard", "own", "mark", "h1", "h2"])

    def answer(asking: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
        columns = ["own", "mark", "h1", "h2"]
        if not len(asking) or not len(arrays):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})
        s = pickle.loads(arrays["arrays"].iloc[0])
        found, keeper = s.keepers(asking.h1.to_numpy().view(np.uint64), asking.h2.to_numpy().view(np.uint64), min_docs)
        return asking.loc[found & (keeper != asking.own.to_numpy()), columns].drop_duplicates()

    marked = docs.withColumns({own: F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)), mark: F.xxhash64(text_col)})
    lines = cut(marked.select(own, mark, text_col).mapInArrow(returning(asked), "shard long, own long, mark long, h1 long, h2 long"), "line-asked")
    salts = lines.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / ASKING).cast("long").alias("salts"))
    copies = built.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    lines = lines.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("own", "mark"), F.col("salts"))).drop("salts")
    hits = lines.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(answer, "own long, mark long, h1 long, h2 long")
    hits = hits.groupBy(F.col("own").alias(own), F.col("mark").alias(mark)).agg(F.collect_set(F.struct("h1", "h2")).alias(gone))
    joined = marked.join(hits, [own, mark], "left").select(*docs.columns, F.transform(gone, lambda x: x["h1"]).alias(gone), F.transform(gone, lambda x: x["h2"]).alias(none))

    def told(ids: pa.Array, texts: list, gone: list[pa.Array]) -> list[list[bool]]:
        sizes, h1, h2 = hashes(texts)
        one, two = (slices(h.view(np.int64), sizes) for h in (h1, h2))
        hit = [set(zip(x or (), y or ())) for x, y in zip(*(g.to_pylist() for g in gone))]
        return [[pair in g for pair in zip(*rows)] for *rows, g in zip(one, two, hit)]

    return _rewrite(joined, id_col, text_col, digest, told, [gone, none])


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT r, doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3),
f AS (SELECT k.r, k.doc_id, i, line, m.key IS NOT NULL AND k.doc_id <> m.largest AS gone FROM k LEFT JOIN m USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY r, doc_id
"""
