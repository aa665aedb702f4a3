"""Language-model scoring by Katz backoff, trained and evaluated on whole tables.

The model is a trigram (``order`` 3) or bigram model over words (runs of non-space
bytes, A-Z lower-cased) and one end token per text. A text's first token has its start as
context, the second the start and the first, the others the two tokens before. Counts r
up to 5 are discounted by Good-Turing with Katz's correction; what a context leaves goes
to the words it was not seen with, in proportion to the model of the next lower order;
the unigram model's own remainder belongs to one unknown word. Backoff weights divide by
one minus the seen words' mass in the lower order, so each context's probabilities sum to
exactly one. Counts above 5 are not discounted, so a context of more than 5 occurrences
might leave nothing: each of them counts one occurrence more, which goes to the words it
was not seen with. The rule looks at a context's own count alone, so the same counts give
the same probabilities in a corpus of any size.

Nothing global is broadcast or collected but counts of counts. Texts become chunks of
about ``CHUNK_TOKENS`` tokens (distinct word hashes and indexes into them), written
once to the shared folder. Counting and looking up are one exchange each:

* every chunk sends its distinct words with training counts to hash buckets; a bucket
  adds them up and answers with the words' global numbers and counts (unigram table);
* then it sends its distinct word pairs, each with the words seen before it (its
  trigrams), to buckets by the pair's first word; a bucket answers with the counts of
  pairs and trigrams and, for contexts that held-out texts need, with whole numbers that
  give what the context leaves and the mass of its continuations (n-gram table). Words
  of very many occurrences are spread over several buckets by the second word, and
  their contexts' numbers are added up by the chunk, so no task grows with one word.

Both answers are Parquet tables of compressed column blocks, each row of a bucket and a
chunk. A chunk then evaluates each of its tokens recursively: trigram if it was seen,
else backoff weight times bigram, and so on. Words are known by 64-bit hashes.

A chunk and a bucket share one row, so rows grow with the square of the input, by 1e-12 a
token squared: at 30 GB of text each still holds about 200 entries; far beyond that
``CHUNK_TOKENS`` and ``BUCKET_ENTRIES`` must grow with the executors' memory.

Defined results: a null text is one end token; a null id is not held out; rows are
scored one by one even if ids repeat; very long texts are never cut, but a chunk ends
after each; with no training text every token is unknown with probability one; an empty
table gives no rows.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenark.llm.common import mix64, parts, shared_dir, utf8, word_hashes

CHUNK_TOKENS = 1 << 20
#: Entries for one task of an exchange.
BUCKET_ENTRIES = 1_000_000
#: Counts up to which Good-Turing discounts.
DISCOUNTED = 5
_END = np.uint64(0x5EED0F7E47A11E4D)
_SHIFT = np.uint64(40)
#: The number of the start; words have smaller ones.
_START = np.uint64((1 << 40) - 1)
#: Numbers of one context: continuations seen 1 to DISCOUNTED times, continuations whose
#: lower order was seen so often, and the sum of the larger counts of the lower order.
_NUMBERS = 2 * DISCOUNTED + 1


def pack(a: np.ndarray) -> bytes:
    """A compressed column block: byte planes, so that small numbers cost little."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(b: bytes, dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(bytes(b))
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel() if raw else np.zeros(0, dtype)


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a.astype(np.uint64), prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


@dataclass(frozen=True)
class Discounts:
    """Factors for counts 1 to DISCOUNTED; larger counts keep theirs."""

    factors: tuple[float, ...]

    @staticmethod
    def fit(of_counts: list[int]) -> Discounts:
        """From the numbers of types seen 1, 2, ... DISCOUNTED + 1 times. Where the
        Good-Turing estimate is not between 0 and 1 (few or irregular counts), absolute
        discounting by n1 / (n1 + 2 n2) stands in."""
        n = [0, *of_counts]
        d = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        out = []
        k = DISCOUNTED
        rest = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
        for r in range(1, k + 1):
            x = -1.0
            if n[r] and n[1] and rest < 1:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest)
            out.append(x if 0.02 < x < 0.999 else (r - d) / r)
        return Discounts(tuple(out))

    def of(self, counts: np.ndarray) -> np.ndarray:
        table = np.array([0.0, *self.factors, 1.0])
        return table[np.minimum(counts, DISCOUNTED + 1).astype(np.int64)]


@dataclass(frozen=True)
class Unigrams:
    tokens: int  # N
    types: int  # V
    discounts: Discounts
    left: float  # probability of the unknown word
    scale: float

    @staticmethod
    def fit(tokens: int, types: int, of_counts: list[int]) -> Unigrams:
        d = Discounts.fit(of_counts)
        if not tokens:
            return Unigrams(0, 0, d, 1.0, 0.0)
        left = sum(n * r * (1 - f) for r, (n, f) in enumerate(zip(of_counts, d.factors), 1)) / tokens
        if left <= 0:  # no rare word: the unknown word counts once
            return Unigrams(tokens, types, d, 1 / (tokens + 1), 1 / (tokens + 1))
        return Unigrams(tokens, types, d, left, 1 / tokens)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        p = self.discounts.of(counts) * counts * self.scale
        return np.where(counts > 0, p, self.left)


def divisors(c: np.ndarray) -> np.ndarray:
    """What discounted counts are divided by in contexts of count c."""
    return (c + (c > DISCOUNTED)).astype(np.float64)


def context_weights(c: np.ndarray, numbers: np.ndarray, own: Discounts, lower: Discounts, scale: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """For contexts of count c and numbers as in ``_NUMBERS``, where a word of lower count
    x has the lower-order probability x * factor * scale: the divisor of discounted counts
    and the backoff weight."""
    r = np.arange(1, DISCOUNTED + 1)
    left = numbers[:, :DISCOUNTED] @ (r * (1 - np.array(own.factors)))
    more = c > DISCOUNTED
    divisor = divisors(c)
    mass = (numbers[:, DISCOUNTED:-1] @ (r * np.array(lower.factors)) + numbers[:, -1]) * scale
    return divisor, (left + more) / np.maximum(divisor, 1) / np.maximum(1 - mass, 1e-300)


# --- chunks ------------------------------------------------------------------

_CHUNK = "chunk long, n_tokens long, n_words long, ids binary, nulls binary, held binary, sizes binary, words binary, counts binary, tokens binary"


def held_out(i: int | None, modulus: int) -> bool:
    return i is not None and zlib.crc32(str(i).encode()) % modulus == 0


def chunks(docs: DataFrame, modulus: int) -> DataFrame:
    """(id, text) as chunks; see ``_CHUNK``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 33, 0
        ids: list = []
        hashes: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal made, held
            n = np.concatenate(sizes)
            words = np.concatenate(hashes)
            # an end after each text
            tokens = np.insert(words, np.cumsum(n), _END)
            distinct, at, times = np.unique(tokens, return_inverse=True, return_counts=True)
            # frequent words get small numbers, which take little room
            rank = np.empty(len(distinct), np.uint32)
            rank[_by_count(times)] = np.arange(len(distinct))
            row = [
                task + made, len(tokens), len(distinct), pack(np.array([i or 0 for i in ids], np.int64)), pack(np.array([i is None for i in ids], np.uint8)),
                pack(np.array([held_out(i, modulus) for i in ids], np.uint8)), pack((n + 1).astype(np.uint32)), pack_sorted(distinct), pack(times.astype(np.uint32)), pack(rank[at]),
            ]
            made, held = made + 1, 0
            ids.clear(), hashes.clear(), sizes.clear()
            types = [pa.int64()] * 3 + [pa.binary()] * 7
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=[f.split()[0] for f in _CHUNK.split(", ")])

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in parts(texts, 200, 4 << 20):
                h, n = word_hashes([utf8(t) for t in texts[lo:hi]])
                ids += batch.column(0).slice(lo, hi - lo).to_pylist()
                hashes.append(h), sizes.append(n)
                held += len(h)
                if held >= CHUNK_TOKENS:
                    yield flush()
        if ids:
            yield flush()

    return docs.mapInArrow(run, _CHUNK)


def _by_count(counts: np.ndarray) -> np.ndarray:
    return np.argsort(-counts.astype(np.int64), kind="stable")


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Increasing in h."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


class Chunk:
    """A row of ``_CHUNK``; ``words`` only where the row has them."""

    def __init__(self, row):
        self.id = int(row.chunk)
        self.words = unpack_sorted(row.words) if hasattr(row, "words") else None
        self.n_words = int(row.n_words)
        self.tokens = _by_count(unpack(row.counts, np.uint32))[unpack(row.tokens, np.uint32)]
        self.sizes = unpack(row.sizes, np.uint32).astype(np.int64)
        self.held = unpack(row.held, np.uint8).astype(bool)
        self.ids = unpack(row.ids, np.int64)
        self.nulls = unpack(row.nulls, np.uint8).astype(bool)
        self.training = np.repeat(~self.held, self.sizes)

    def word_slices(self, buckets: int) -> Iterator[tuple[int, slice]]:
        b = _bucket_of(self.words, buckets)
        edges = np.flatnonzero(np.diff(b, prepend=np.uint64(2**63)))
        for lo, hi in zip(edges, [*edges[1:], len(b)]):
            yield int(b[lo]), slice(int(lo), int(hi))


def _word_requests(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pandas().itertuples():
                c = Chunk(row)
                counts = np.bincount(c.tokens[c.training], minlength=len(c.words)).astype(np.uint64)
                out = [(b, c.id, pack_sorted(c.words[s]), pack(counts[s])) for b, s in c.word_slices(buckets)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.binary(), pa.binary()])], names=["bucket", "chunk", "words", "counts"])

    return run


#: An answer to a chunk (kind 0), or a bucket's sums (kind 1): types, tokens and numbers
#: of types seen 1 to DISCOUNTED + 1 times, of words or of pairs and trigrams.
_ANSWER = "kind int, bucket long, chunk long, one binary, two binary, three binary, four binary, sums array<long>"


def _answers(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.split()[0] for f in _ANSWER.split(", ")])


def _of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(counts[counts <= DISCOUNTED + 1].astype(np.int64), minlength=DISCOUNTED + 2)[1:].tolist()


def _count_words(buckets: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        words, counts = [unpack_sorted(x) for x in pdf["words"]], [unpack(x, np.uint64) for x in pdf["counts"]]
        distinct, at = np.unique(np.concatenate(words), return_inverse=True)
        total = np.zeros(len(distinct), np.uint64)
        np.add.at(total, at, np.concatenate(counts))
        bucket, lo, out = int(pdf["bucket"].iloc[0]), 0, []
        # frequent words get small numbers; no bucket's numbers are another's
        number = np.empty(len(distinct), np.uint64)
        number[np.argsort(total, kind="stable")[::-1]] = np.arange(len(distinct), dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket)
        for chunk, w in zip(pdf["chunk"], words):
            own = at[lo : lo + len(w)]
            lo += len(w)
            out.append((0, bucket, int(chunk), pack(number[own]), pack(total[own]), b"", b"", []))
        out.append((1, bucket, -1, b"", b"", b"", b"", [int((total > 0).sum()), int(total.sum()), *_of_counts(total)]))
        return _answers(out)

    return run


# --- pairs and trigrams ------------------------------------------------------


@dataclass(frozen=True)
class Plan:
    """What all chunks must agree on to send and read n-grams."""

    order: int
    pair_buckets: int
    texts: int  # training texts: the count of the start and of the end
    spread: int  # occurrences of a first word for one bucket


class Requests:
    """A chunk's distinct first words (entries), pairs, trigrams and the contexts that
    its held-out tokens need, in the order in which they are sent. Words are local
    indexes; ``number`` and ``count`` are global, the start is the last one."""

    def __init__(self, chunk: Chunk, answers: pd.DataFrame, plan: Plan):
        n = chunk.n_words
        # words are in the order of their hashes, and so of their buckets
        answers = answers.sort_values("bucket")
        self.number, self.count = (np.concatenate([*(unpack(x, np.uint64) for x in answers[c]), np.array([end], np.uint64)]) for c, end in (("one", _START), ("two", plan.texts)))
        begins = np.cumsum(chunk.sizes) - chunk.sizes
        self.first = np.empty(len(chunk.tokens), np.int64)
        self.first[1:] = chunk.tokens[:-1]
        self.first[begins] = n
        inner = np.ones(len(chunk.tokens), bool)
        inner[begins] = False
        #: Tokens with a trigram.
        self.inner = np.flatnonzero(inner) if plan.order > 2 else np.zeros(0, np.int64)
        held = ~chunk.training

        # pairs, by bucket and numbers; first words spread by their second word
        local, at = np.unique(self.first * np.int64(n + 1) + chunk.tokens, return_inverse=True)
        v, w = local // (n + 1), local % (n + 1)
        times = np.minimum(np.maximum(1, -(-self.count.astype(np.int64) // plan.spread)), plan.pair_buckets)
        home = mix64(self.number + np.uint64(1))
        buckets = np.uint64(plan.pair_buckets)
        part = mix64(self.number[w] + np.uint64(0x1234567)) % times[v].astype(np.uint64)
        key = (((home[v] % buckets + part) % buckets) << _SHIFT) | self.number[v]
        order = np.lexsort((self.number[w], key))
        self.pair = np.empty(len(local), np.int64)
        self.pair[order] = np.arange(len(local))
        self.pair = self.pair[at]  # of each token
        self.v, self.w, key = v[order], w[order], key[order]
        self.training = np.bincount(self.pair[chunk.training], minlength=len(local)).astype(np.uint64)

        # entries: a first word in each bucket that may hold pairs of it
        used = np.unique(v)
        all_v = np.repeat(used, times[used])
        nth = np.arange(len(all_v)) - np.repeat(np.cumsum(times[used]) - times[used], times[used])
        entries = (((home[all_v] % buckets + nth.astype(np.uint64)) % buckets) << _SHIFT) | self.number[all_v]
        order = np.argsort(entries)
        self.entries, self.entry_v = entries[order], all_v[order]
        # who backs off, or has no trigram
        needed = np.full(n + 1, plan.order < 3)
        needed[self.first[held]] = True
        needed[n] = True
        self.needed = needed[self.entry_v]
        lo, hi = np.searchsorted(key, self.entries, "left"), np.searchsorted(key, self.entries, "right")
        self.pairs_of_entry = hi - lo
        self.entry_bucket, self.pair_bucket = self.entries >> _SHIFT, key >> _SHIFT

        # trigrams, by pair and number of the word before
        by_number = np.argsort(self.number)
        rank = np.empty(n + 1, np.int64)
        rank[by_number] = np.arange(n + 1)
        u = self.first[self.inner - 1]
        three, self.trigram = np.unique(self.pair[self.inner] * np.int64(n + 1) + rank[u], return_inverse=True)
        self.u, self.trigram_pair = by_number[three % (n + 1)], three // (n + 1)
        self.trigrams_of_pair = np.bincount(self.trigram_pair, minlength=len(local))
        self.training3 = np.bincount(self.trigram[chunk.training[self.inner]], minlength=len(three)).astype(np.uint64)
        self.trigram_ends = np.concatenate([[0], np.cumsum(self.trigrams_of_pair)])

        # contexts of two words that held-out tokens need, by entry and number
        #: Held-out tokens with a trigram (indexes of ``inner``) and their contexts.
        self.asking = np.flatnonzero(held[self.inner])
        contexts, self.context = np.unique(self.first[self.inner[self.asking]] * np.int64(n + 1) + rank[u[self.asking]], return_inverse=True)
        cv, cu = contexts // (n + 1), by_number[contexts % (n + 1)]
        lo, hi = np.searchsorted(cv, self.entry_v, "left"), np.searchsorted(cv, self.entry_v, "right")
        self.contexts_of_entry = hi - lo
        ends = np.cumsum(self.contexts_of_entry)
        #: For each context that is sent, which one it is; and the sent ones' ends by entry.
        self.sent_context = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - self.contexts_of_entry, self.contexts_of_entry) + np.repeat(lo, self.contexts_of_entry)
        self.sent_u = cu[self.sent_context]
        self.context_ends = np.concatenate([[0], ends]).astype(np.int64)
        self.contexts = len(contexts)

    def slices(self) -> Iterator[tuple[int, slice, slice, slice, slice]]:
        """Bucket, its entries, pairs, trigrams and contexts."""
        edges = np.flatnonzero(np.diff(self.entry_bucket, prepend=np.uint64(2**63)))
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(self.entry_bucket)]):
            b = self.entry_bucket[lo]
            p, q = int(np.searchsorted(self.pair_bucket, b, "left")), int(np.searchsorted(self.pair_bucket, b, "right"))
            yield int(b), slice(lo, hi), slice(p, q), slice(int(self.trigram_ends[p]), int(self.trigram_ends[q])), slice(int(self.context_ends[lo]), int(self.context_ends[hi]))


_REQUEST = "bucket long, chunk long, v binary, needed binary, n binary, w binary, w_count binary, training binary, m binary, u binary, training3 binary, k binary, context binary"


def _pair_requests(plan: Plan):
    def run(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in own.itertuples():
            c = Chunk(row)
            r = Requests(c, answers, plan)
            for b, e, p, t, x in r.slices():
                out.append(
                    (
                        b, c.id, pack_sorted(r.entries[e] & _START), pack(r.needed[e].astype(np.uint8)), pack(r.pairs_of_entry[e].astype(np.uint32)), pack(r.number[r.w[p]]), pack(r.count[r.w[p]]), pack(r.training[p]),
                        pack(r.trigrams_of_pair[p].astype(np.uint32)), pack(r.number[r.u[t]]), pack(r.training3[t]), pack(r.contexts_of_entry[e].astype(np.uint32)), pack(r.number[r.sent_u[x]]),
                    )
                )
        return pd.DataFrame(out, columns=[f.split()[0] for f in _REQUEST.split(", ")])

    return run


def _sums(group: np.ndarray, groups: int, own: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """``_NUMBERS`` of each group of continuations seen ``own`` times whose lower order
    was seen ``lower`` times."""
    out = np.zeros((groups, _NUMBERS), np.uint64)
    for k, counts in ((0, own), (DISCOUNTED, lower)):
        small = counts <= DISCOUNTED
        out[:, k : k + DISCOUNTED] = np.bincount(group[small] * DISCOUNTED + counts[small].astype(np.int64) - 1, minlength=groups * DISCOUNTED).reshape(groups, DISCOUNTED)
    large = lower > DISCOUNTED
    np.add.at(out[:, -1], group[large], lower[large])
    return out


def _count_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    vs, ns, ws = [unpack_sorted(x) for x in pdf["v"]], [unpack(x, np.uint32) for x in pdf["n"]], [unpack(x, np.uint64) for x in pdf["w"]]
    v, entry = np.unique(np.concatenate(vs), return_inverse=True)
    w, w_at, w_own = np.unique(np.concatenate(ws), return_index=True, return_inverse=True)
    w_count = np.concatenate([unpack(x, np.uint64) for x in pdf["w_count"]])[w_at]
    v_own = np.repeat(entry, np.concatenate(ns))
    pair, own = np.unique(v_own * np.int64(max(len(w), 1)) + w_own, return_inverse=True)
    total = np.zeros(len(pair), np.uint64)
    np.add.at(total, own, np.concatenate([unpack(x, np.uint64) for x in pdf["training"]]))
    pv, pw, seen = pair // max(len(w), 1), pair % max(len(w), 1), total > 0
    numbers = _sums(pv[seen], len(v), total[seen], w_count[pw[seen]])

    ms, us = [unpack(x, np.uint32) for x in pdf["m"]], [unpack(x, np.uint64) for x in pdf["u"]]
    of_pair = np.repeat(own, np.concatenate(ms)).astype(np.uint64)
    three, own3 = np.unique((of_pair << _SHIFT) | np.concatenate(us), return_inverse=True)
    total3 = np.zeros(len(three), np.uint64)
    np.add.at(total3, own3, np.concatenate([unpack(x, np.uint64) for x in pdf["training3"]]))
    of_pair, u = (three >> _SHIFT).astype(np.int64), three & _START
    context, of_context = np.unique((pv[of_pair].astype(np.uint64) << _SHIFT) | u, return_inverse=True)
    seen3 = total3 > 0
    numbers3 = _sums(of_context[seen3], len(context), total3[seen3], total[of_pair[seen3]])

    bucket, e, k, t, out = int(pdf["bucket"].iloc[0]), 0, 0, 0, []
    for chunk, x, y, z, needed, n_context, asked in zip(pdf["chunk"], vs, ws, us, pdf["needed"], pdf["k"], pdf["context"]):
        mine, pairs, trigrams = entry[e : e + len(x)], own[k : k + len(y)], own3[t : t + len(z)]
        e, k, t = e + len(x), k + len(y), t + len(z)
        wanted = (np.repeat(mine, unpack(n_context, np.uint32)).astype(np.uint64) << _SHIFT) | unpack(asked, np.uint64)
        at = np.minimum(np.searchsorted(context, wanted), max(len(context) - 1, 0))
        told = np.where((context[at] == wanted)[:, None], numbers3[at], np.uint64(0)) if len(context) else np.zeros((len(wanted), _NUMBERS), np.uint64)
        entries = numbers[mine[unpack(needed, np.uint8).astype(bool)]]
        out.append((0, bucket, int(chunk), pack(total[pairs]), pack(entries.T.ravel()), pack(total3[trigrams]), pack(told.T.ravel()), []))
    sums = [int(seen.sum()), int(total.sum()), *_of_counts(total), int(seen3.sum()), int(total3.sum()), *_of_counts(total3)]
    out.append((1, bucket, -1, b"", b"", b"", b"", sums))
    return _answers(out)


def _score(plan: Plan, unigrams: Unigrams, bigrams: Discounts, trigrams: Discounts):
    def numbers(b: bytes) -> np.ndarray:
        return unpack(b, np.uint64).reshape(_NUMBERS, -1).T.astype(np.float64)

    def run(own: pd.DataFrame, words: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in own.itertuples():
            c = Chunk(row)
            r = Requests(c, words, plan)
            got = {int(x.bucket): x for x in pairs.itertuples()}
            two, three = np.zeros(len(r.v), np.uint64), np.zeros(len(r.u), np.uint64)
            n1, n2 = np.zeros((len(r.count), _NUMBERS)), np.zeros((r.contexts, _NUMBERS))
            for b, e, p, t, x in r.slices():
                told = got[b]
                two[p], three[t] = unpack(told.one, np.uint64), unpack(told.three, np.uint64)
                n1[r.entry_v[e][r.needed[e]]] += numbers(told.two)
                n2[r.sent_context[x]] += numbers(told.four)
            times, count = two[r.pair], r.count[c.tokens]
            with np.errstate(divide="ignore", invalid="ignore"):
                # recursively, from the word alone upwards
                score = np.log10(unigrams.probability(r.count))[c.tokens]
                divisor, weight = context_weights(r.count.astype(np.float64), n1, bigrams, unigrams.discounts, unigrams.scale)
                back = np.where(r.count > 0, np.log10(weight), 0.0)[r.first] + score
                score = np.where(times > 0, np.log10(bigrams.of(times) * times / divisor[r.first]), back)
                if len(r.inner):
                    seen, context = three[r.trigram], two[r.pair[r.inner - 1]].astype(np.float64)
                    direct = np.log10(trigrams.of(seen) * seen / divisors(context))
                    back = score[r.inner].copy()
                    if len(r.asking):
                        at = r.inner[r.asking]
                        v, c2 = r.first[at], context[r.asking]
                        _, weight = context_weights(c2, n2[r.context], trigrams, bigrams, 1 / np.maximum(divisor[v], 1))
                        back[r.asking] += np.where(c2 > 0, np.log10(weight), 0.0)
                    score[r.inner] = np.where(seen > 0, direct, back)
            base = np.log10((count + 0.1) / (unigrams.tokens + 0.1 * (unigrams.types + 1)))
            at = np.cumsum(c.sizes) - c.sizes
            out.append(
                pd.DataFrame(
                    {
                        "doc_id": pd.array(np.where(c.nulls, 0, c.ids), dtype="Int64"), "held_out": c.held, "n_tokens": c.sizes, "n_known": np.add.reduceat((count > 0).astype(np.int64), at),
                        "train_tokens": unigrams.tokens, "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(score, at),
                    }
                )
            )
            out[-1].loc[c.nulls, "doc_id"] = pd.NA
        return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "held_out": [], "n_tokens": [], "n_known": [], "train_tokens": [], "base_score": [], "score": []})

    return lambda own, answers: run(own, answers[answers["table"] == 0], answers[answers["table"] == 1])


def _totals(answers: DataFrame, n: int) -> list[int]:
    """The buckets' sums, added up."""
    row = answers.where("kind = 1").agg(*(F.sum(F.col("sums")[k]).alias(str(k)) for k in range(n))).first()
    return [x or 0 for x in row]


def _tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of the exchanges that are done."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 10, order: int = 3) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score
    and score; ids whose crc32 is a multiple of ``modulus`` are not learned from."""
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = docs.sparkSession
    top = f"{shared_dir(spark)}/lumenark/katz-{np.random.default_rng().integers(1 << 62):x}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{top}/{name}")
        return spark.read.schema(df.schema).parquet(f"{top}/{name}")

    made = stored(chunks(docs.select(F.col(id_col).cast("long"), text_col), modulus), "chunks")
    own = made.drop("words")
    size = own.agg(F.sum("n_tokens").alias("tokens"), F.sum("n_words").alias("words")).first()
    word_buckets = max(1, -(-(size["words"] or 0) // BUCKET_ENTRIES))
    pair_buckets = max(1, -(-(size["tokens"] or 0) // BUCKET_ENTRIES))
    asked = made.mapInArrow(_word_requests(word_buckets), "bucket long, chunk long, words binary, counts binary")
    words = stored(asked.groupBy("bucket").applyInPandas(_count_words(word_buckets), _ANSWER), "words")
    types, tokens, *n = _totals(words, DISCOUNTED + 3)
    unigrams = Unigrams.fit(tokens, types, n)
    plan = Plan(order, pair_buckets, _training_texts(docs, id_col, modulus), max(1, BUCKET_ENTRIES // 4))
    _tidy(spark)
    told = words.where("kind = 0").select("chunk", "bucket", "one", "two")
    asked = own.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(_pair_requests(plan), _REQUEST)
    pairs = stored(asked.groupBy("bucket").applyInPandas(_count_pairs, _ANSWER), "ngrams")
    n = _totals(pairs, 2 * (DISCOUNTED + 3))
    bigrams, trigrams = Discounts.fit(n[2 : DISCOUNTED + 3]), Discounts.fit(n[DISCOUNTED + 5 :])
    _tidy(spark)
    columns = ["chunk", "bucket", "one", "two", "three", "four"]
    told = words.where("kind = 0").select(F.lit(0).alias("table"), *columns).union(pairs.where("kind = 0").select(F.lit(1), *columns))
    out = own.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(_score(plan, unigrams, bigrams, trigrams), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("doc_id", id_col)


def _training_texts(docs: DataFrame, id_col: str, modulus: int) -> int:
    held = F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string")) % modulus == 0, F.lit(False))
    return docs.where(~held).count()

