"""SentencePiece encoding and decoding by streaming Viterbi.

The pieces and scores of a SentencePiece model file make a lattice over the escaped
text (a space before it, spaces as U+2581); the best path is the one of the largest
sum of scores, ties going to the longer last piece. A character without a piece costs
10 less than the lowest score and is written as its bytes' pieces; a U+2581 of the
text itself is treated so too, so that decoding gives back every text exactly. (The
file's own scores are used even where its trainer merged pairs instead: such a model
has merge ranks as scores, and this encoder's paths are the best by those, not a
replay of the merges.)

``StreamingViterbi`` takes a text in parts, and every ``longest`` characters (no piece is
longer) looks at the paths of all states that a later piece can still start from: once
they run through one boundary, the ids up to it are committed and forgotten. All texts
go through it. Where no piece can cross a boundary (before U+2581 after another
character), a single state survives and all is committed; what lies between two such
boundaries depends on nothing before it, so the ids committed for it are remembered, in a
bounded memory, since words repeat.

Rows are independent: nothing is shuffled. Defined results: null or empty text has
no ids, which decode to the empty text; very long texts without spaces stream through
the same window; unknown ids raise ValueError; repeated rows
stay; other columns pass through.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumenark.llm.common import others

SPACE = "▁"
#: Stands for a U+2581 of the text itself: no valid text and no piece holds it.
LITERAL = "\ud800"
UNKNOWN_PENALTY = 10.0
#: Never chosen where another path exists: pieces below this are no measure of the lowest score.
_FLOOR = -1e8
_SPANS = re.compile(f"{SPACE}+[^{SPACE}]*")


class PieceModel:
    #: Spans remembered since the last turnover (those asked for since the one before
    #: stay for another), and the longest remembered.
    REMEMBER, LONG = 250_000, 64
    #: Characters that a stream is fed at once.
    PART = 1024

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.texts = [p.piece for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        self.pieces = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type in (1, 4)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.special = {i for i, k in enumerate(kinds) if k in (2, 3, 5)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces")
        self.longest = max(map(len, self.pieces))
        #: The pieces as a tree: next characters, id (-1: only a prefix), score.
        self.tree: list = [{}, -1, 0.0]
        for p, (k, score) in self.pieces.items():
            node = self.tree
            for c in p:
                node = node[0].setdefault(c, [{}, -1, 0.0])
            node[1], node[2] = k, score
        self.written = [bytes([self.byte_of[k]]) if k in self.byte_of else None if k in self.special else p.replace(SPACE, " ").encode("utf-8") for k, p in enumerate(self.texts)]
        self.unknown = min(s for _, s in self.pieces.values() if s > _FLOOR) - UNKNOWN_PENALTY
        #: Whether paths always converge before U+2581 after another character.
        self.closed = all(set(p) == {SPACE} for p in self.pieces if SPACE in p[1:])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def span(self, text: str, stream: StreamingViterbi) -> bytes:
        """The ids of an escaped span between boundaries that no piece crosses,
        little-endian unsigned 32-bit."""
        out = array("I")
        for at in range(0, len(text), self.PART):
            out.extend(stream.feed(text[at : at + self.PART]))
        out.extend(stream.settle())
        return out.tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        text = text.replace(SPACE, LITERAL)
        stream = StreamingViterbi(self)
        if not self.closed:
            return self.span(SPACE + text.replace(" ", SPACE), stream)
        if "  " in text or text[0] == " ":
            spans = _SPANS.findall(SPACE + text.replace(" ", SPACE))
        else:
            spans = [SPACE + w for w in text.split(" ")]
        known = self.known
        if len(known) > self.REMEMBER:
            self.older, self.known = known, {}
            known = self.known
        out = []
        for s in spans:
            ids = known.get(s)
            if ids is None:
                ids = self.older.get(s)
                if ids is None:
                    ids = self.span(s, stream)
                if len(s) <= self.LONG:
                    known[s] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids) -> str:
        if len(ids) and min(ids) < 0:
            raise ValueError("no text has such an id")
        try:
            # joining fails on the id of a control or unknown piece (None)
            return b"".join(map(self.written.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]
        except (IndexError, TypeError):
            raise ValueError("no text has such an id") from None


class StreamingViterbi:
    def __init__(self, model: PieceModel):
        self.model = model
        self.text = ""  # not committed yet
        self.best: list[float] = [0.0]  # by position in text
        self.back: list[tuple[int, int]] = [(0, -1)]  # start of the last piece and its id (-1: unknown)
        self.at = 0  # positions before it have sent out all their pieces
        self.commits = 0

    def feed(self, text: str) -> list[int]:
        """Take a part of the text; ids committed so far."""
        self.text += text
        out: list[int] = []
        step = self.model.longest
        # a start needs the next ``longest`` characters
        while len(self.text) - self.at > 2 * step:
            self._advance(self.at + step)
            out += self._commit()
        return out

    def settle(self) -> list[int]:
        """The rest of the ids of what was fed; no piece may cross its end, so one
        state survives there."""
        self._advance(len(self.text))
        return self._commit()

    def _advance(self, to: int) -> None:
        s, best, back, tree = self.text, self.best, self.back, self.model.tree[0]
        n, lowest, unknown = len(s), float("-inf"), self.model.unknown
        need = min(n, to + self.model.longest) + 1
        best.extend([lowest] * (need - len(best)))
        back.extend([(0, -1)] * (need - len(back)))
        for i in range(self.at, to):
            score = best[i]
            if score == lowest:
                continue
            j, node = i, tree.get(s[i])
            if node is None or node[1] < 0:
                x = score + unknown
                if x > best[i + 1]:
                    best[i + 1], back[i + 1] = x, (i, -1)
            while node is not None:
                j += 1
                following, k, gain = node
                if k >= 0:
                    x = score + gain
                    if x > best[j]:
                        best[j], back[j] = x, (i, k)
                node = following.get(s[j]) if j < n else None
        self.at = to

    def _commit(self) -> list[int]:
        """Ids up to the last boundary that all surviving paths share."""
        self.commits += 1
        states = {j for j in range(self.at, min(len(self.best), self.at + self.model.longest + 1)) if self.best[j] > float("-inf")}
        while len(states) > 1:
            j = max(states)
            states.remove(j)
            states.add(self.back[j][0])
        cut = states.pop()
        if not cut:
            return []
        out = self._path(cut)
        self.text, self.at, low = self.text[cut:], self.at - cut, self.best[cut]
        self.best = [x - low for x in self.best[cut:]]
        self.back = [(max(i - cut, 0), p) for i, p in self.back[cut:]]
        return out

    def _path(self, j: int) -> list[int]:
        parts = []
        while j:
            i, p = self.back[j]
            if p >= 0:
                parts.append((p,))
            else:
                c = self.text[i]
                c = SPACE if c == LITERAL else c
                parts.append(tuple(self.model.bytes[b] for b in c.encode("utf-8", "surrogatepass")))
            j = i
        return [x for p in reversed(parts) for x in p]


_MODELS: dict[str, PieceModel] = {}


def model_of(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ids (array of int) and ids_crc32 (of the little-endian unsigned
    32-bit ids)."""
    names = others(docs.columns, "ids", "ids_crc32")
    fields = docs.select(*names).schema.add("ids", T.ArrayType(T.IntegerType())).add("ids_crc32", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 250):
                part = batch.slice(lo, 250)
                found = [m.encode(t) for t in part.column(text_col).to_pylist()]
                offsets = array("i", [0])
                for f in found:
                    offsets.append(offsets[-1] + len(f) // 4)
                ids = pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(offsets), [None, pa.py_buffer(offsets)]), pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(found))]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), ids, pa.array([zlib.crc32(f) for f in found], pa.int64())], names=[*names, "ids", "ids_crc32"])

    return docs.select(*names).mapInArrow(run, fields)


def decode(encoded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the column decoded."""
    names = others(encoded.columns, "decoded")
    fields = encoded.select(*names).schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(model)
        for batch in batches:
            column = batch.column(ids_col)
            ends, flat = column.offsets.to_pylist(), column.values.to_numpy().tolist()
            texts = [m.decode(flat[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, "decoded"])

    return encoded.select(*names).mapInArrow(run, fields)
