"""Packing by vector bin packing.

A sequence holds pieces of examples under three limits at once: tokens, segments
(pieces) and loss-bearing tokens. Each task packs the rows of its own partition, so
nothing is shuffled: tokens stay where they were read, and a hot source or a very
long text only means more pieces in the tasks that hold it.

Within a task a window of pieces is kept, by their demands: pieces of the same length,
loss-bearing tokens and kind of start are one class, so however many short or empty rows
wait, a placement looks at each demand once. A sequence is opened and filled by the
dot-product heuristic: of the demands that fit, take the one whose vector has the largest
weighted dot product with what the sequence still has free (weights are one over the mean
demand of the window); ties go to the demand that came first, and within it to the piece
that came last. If nothing fits, a piece is cut so that the sequence becomes full. What is
left at the end of a partition, or where the segment or loss limit closed a sequence
early, is cut into runs whose lengths are powers of two, which need no padding.

Loss: the ids of a prompt bear none; with ``bare_ends`` an example's first id, which
nothing predicts, and its end id bear none either.

Defined results: a null text packs as an empty one (its end id only); a row is
packed by itself even if its id repeats or is null; very long texts are encoded whole and
cut into pieces; an empty table gives no rows; columns beyond those named are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.llm.bpe import ChunkedBpe
from lumenark.llm.common import kept, parts, returning

#: Appended to every example.
END_ID = 1


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 128
    loss_tokens: int = 2048
    #: Sequences' worth of tokens that wait for a place in each task.
    window: int = 64


@dataclass
class Piece:
    ids: np.ndarray  # the whole example's
    lead: int  # so many ids at the example's start bear no loss
    tail: int  # and so many at its end
    key: object
    start: int
    length: int

    def losses(self) -> int:
        end = len(self.ids) - self.tail
        return max(0, min(self.start + self.length, end) - max(self.start, self.lead))

    def fitting(self, tokens: int, loss: int) -> int:
        """The longest prefix within both limits."""
        end = len(self.ids) - self.tail
        n = max(self.lead - self.start, 0) + loss
        if self.start + n >= end:  # all that bears loss fits
            n = self.length
        return min(self.length, tokens, n)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return replace(self, length=n), replace(self, start=self.start + n, length=self.length - n)


class Packer:
    """Pieces in, sequences (lists of pieces) out."""

    def __init__(self, limits: Limits):
        if min(limits.tokens, limits.segments, limits.loss_tokens) < 1:
            raise ValueError("every limit must be at least 1")
        self.limits, self.waiting = limits, 0
        #: The waiting pieces by (length, loss-bearing ids, ids at the start without loss).
        self.pool: dict[tuple[int, int, int], list[Piece]] = {}

    def _wait(self, piece: Piece) -> tuple[int, int, int]:
        demand = piece.length, piece.losses(), min(max(piece.lead - piece.start, 0), piece.length)
        self.pool.setdefault(demand, []).append(piece)
        return demand

    def add(self, ids: np.ndarray, lead: int, tail: int, key: object) -> Iterator[list[Piece]]:
        rest, lim = Piece(ids, lead, tail, key, 0, len(ids)), self.limits
        while rest.length:
            piece, rest = rest.cut(rest.fitting(lim.tokens, lim.loss_tokens))
            if piece.length == lim.tokens:
                yield [piece]
            else:
                self._wait(piece)
                self.waiting += piece.length
        if self.waiting > lim.window * lim.tokens:
            yield from self.drain(lim.window * lim.tokens // 2)

    def drain(self, keep: int = 0) -> Iterator[list[Piece]]:
        """Fill sequences until at most ``keep`` tokens wait."""
        lim, pool = self.limits, self.pool
        demands = list(pool)
        place = {d: k for k, d in enumerate(demands)}
        many = np.array([len(pool[d]) for d in demands], np.int64)
        tok, loss = (np.array([d[k] for d in demands], float) for k in (0, 1))
        size = np.array([lim.tokens, lim.segments, lim.loss_tokens], float)
        pieces = max(int(many.sum()), 1)
        weight = 1.0 / (np.array([max(tok @ many / pieces, 1e-9), 1.0, max(loss @ many / pieces, 1e-9)]) * size)
        while self.waiting > keep:
            free, bin_ = size.copy(), []
            while free[0] >= 1 and free[1] >= 1 and many.any():
                fits = (many > 0) & (tok <= free[0]) & (loss <= free[2])
                if fits.any():
                    score = np.where(fits, tok * (weight[0] * free[0]) + weight[1] * free[1] + loss * (weight[2] * free[2]), -1.0)
                    i = int(score.argmax())
                    piece = pool[demands[i]].pop()
                else:
                    # cut the demand of which most fits
                    best, i = 0, -1
                    for j in np.flatnonzero(many):
                        n = pool[demands[j]][-1].fitting(int(free[0]), int(free[2]))
                        if n > best:
                            best, i = n, int(j)
                        if best == free[0]:
                            break
                    if not best:
                        break
                    piece, rest = pool[demands[i]].pop().cut(best)
                    demand = self._wait(rest)
                    if demand in place:
                        many[place[demand]] += 1
                    else:
                        place[demand] = len(demands)
                        demands.append(demand)
                        many, tok, loss = np.append(many, 1), np.append(tok, float(demand[0])), np.append(loss, float(demand[1]))
                many[i] -= 1
                bin_.append(piece)
                self.waiting -= piece.length
                free -= (piece.length, 1, piece.losses())
            yield from [bin_] if free[0] < 1 else powers_of_two(bin_)
        self.pool = {d: p for d, p in pool.items() if p}


def powers_of_two(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """The same ids as runs whose lengths are powers of two, longest first."""
    left = sum(p.length for p in pieces)
    todo = pieces[::-1]
    while left:
        want = 1 << (left.bit_length() - 1)
        left -= want
        run = []
        while want:
            p = todo.pop()
            n = min(p.length, want)
            first, rest = p.cut(n)
            run.append(first)
            if rest.length:
                todo.append(rest)
            want -= n
        yield run


_ENCODERS: dict[tuple[str, bool], ChunkedBpe] = kept("encoders")


def _encoder(path: str, specials: bool) -> ChunkedBpe:
    if (path, specials) not in _ENCODERS:
        _ENCODERS[path, specials] = ChunkedBpe(path, specials)
    return _ENCODERS[path, specials]


def pack(examples: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, limits: Limits = Limits(), keep_ids: bool = False, bare_ends: bool = False, specials: bool = True) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``, ``loss_tokens`` and, with ``keep_ids``, the ids.

    ``prompt_col``: text before ``text_col`` whose tokens bear no loss (instruction
    data); both null-safe. ``specials``: the tokenizer's special tokens written out in a
    text are those tokens (the library's default), else ordinary text. Sequence ids are unique over the table: the task's
    partition in the upper bits, a counter in the lower 33."""
    source = examples.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), (F.col(prompt_col) if prompt_col else F.lit(None).cast("string")).alias("prompt"))
    key_type = source.schema["key"].dataType.simpleString()
    fields = f"{id_col} {key_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long" + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = _encoder(tokenizer, specials), Packer(limits)
        base, made, key_of = TaskContext.get().partitionId() << 33, 0, None
        out: list[tuple] = []

        def emit(sequences):
            nonlocal made
            for pieces in sequences:
                offset = 0
                for p in pieces:
                    ids = p.ids[p.start : p.start + p.length]
                    out.append((p.key, p.start, p.length, zlib.crc32(ids.tobytes()), len(p.ids), base + made, offset, p.losses(), *([ids.astype("int32")] if keep_ids else [])))
                    offset += p.length
                made += 1

        def flush():
            columns = list(zip(*out)) if out else [[]] * (9 if keep_ids else 8)
            arrays = [pa.array(columns[0], type=key_of), *(pa.array(c, type=pa.int64()) for c in columns[1:8])]
            if keep_ids:
                arrays.append(pa.array(columns[8], type=pa.list_(pa.int32())))
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", *(["ids"] if keep_ids else [])])

        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            key_of = batch.column(0).type
            keys, texts, prompts = (batch.column(i).to_pylist() for i in range(3))
            for lo, hi in parts(texts, 250, 4 << 20):
                before = encoder.encode(prompts[lo:hi]) if prompt_col else [b""] * (hi - lo)
                for key, body, lead in zip(keys[lo:hi], encoder.encode(texts[lo:hi]), before):
                    ids = np.frombuffer(lead + body + end, "<u4")
                    bare = max(len(lead) // 4, int(bare_ends))
                    emit(packer.add(ids, min(bare, len(ids)), int(bare_ends and bare < len(ids)), key))
            if len(out) >= 4096:
                yield flush()
        emit(packer.drain())
        if out:
            yield flush()

    return source.mapInArrow(returning(run, keeps="encoders"), fields)
