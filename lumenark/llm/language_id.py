"""Language identification by error-correcting output codes.

Every language has a codeword of +1/-1 bits. For each bit a binary classifier over
hashed byte n-grams (2 and 3, of the lower-cased text, ASCII non-letters as spaces)
predicts its sign. Decoding is loss-weighted: a codeword's distance is the logistic
loss of the classifiers' margins against its bits, weighted by how well each
classifier did on that language when it was fitted; the nearest codeword wins, and a
text whose two nearest codewords are within ``AMBIGUOUS`` is flagged.

The classifiers are fitted on the driver on a bounded sample: about ``Fit.rows``
labelled rows over all languages (chosen by hash of the id, as many of each language) and
never more than ``Fit.most``, whose whole texts are reduced to n-gram counts where they
are read; only counts reach the driver. Of more than ``Fit.labels`` labels the most
frequent are learned (of equally frequent ones the first in alphabetic order), as the
sample would hold too few rows of each. Prediction reads whole texts, in slices, and
needs no shuffle.

Defined results: null text or one without a letter is ``und`` with score 0; with no
labelled row every text is ``und``; with one language every text with a letter is in
it; very long texts are read whole; of languages at the same distance the first in
alphabetic order is taken, and flagged; repeated rows and null ids are predicted like others (a null id is not held out
and never learned from); other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.llm.common import others, returning

UNKNOWN = "und"
DIM = 8192
SLICE = 1 << 20
AMBIGUOUS = 0.05
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = [c if 97 <= c <= 122 else 32 for c in range(128)]


@dataclass(frozen=True)
class Fit:
    #: Labelled rows that are sampled, over all languages: so many are aimed at, and
    #: the bound (ids that repeat share a hash).
    rows: int = 2400
    most: int = 4800
    #: The most labels that are learned.
    labels: int = 400
    steps: int = 150
    rate: float = 4.0
    decay: float = 1e-4


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of a whole text."""
    data = _FOLD[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]
    total = np.zeros(DIM)
    half = np.uint32(DIM // 2 - 1)
    for at in range(0, max(len(data), 1), SLICE):
        a = np.concatenate([[32] * (at == 0), data[max(at - 2, 0) : at + SLICE], [32] * (at + SLICE >= len(data))]).astype(np.uint32)
        two = (a[:-1] << np.uint32(8)) | a[1:]
        three = (two[:-1] << np.uint32(8)) | a[2:]
        if at:
            two = two[1:]  # seen at the end of the last slice
        g2 = (two * np.uint32(2654435761) >> np.uint32(15)) & half
        g3 = ((three * np.uint32(2246822519) >> np.uint32(13)) & half) + np.uint32(DIM // 2)
        total += np.bincount(g2[two != 0x2020], minlength=DIM) + np.bincount(g3[three != 0x202020], minlength=DIM)
    return total


def features(text: str) -> np.ndarray:
    x = np.sqrt(counts(text))
    n = np.linalg.norm(x)
    return (x / n if n else x).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """A row of +1/-1 for each of n languages: all splits in two for up to 6
    languages, else the best of 50 random codes of 10 log2(n) bits by least distance."""
    if n < 2:
        return np.ones((n, 0), np.float32)
    if n <= 6:
        splits = [[(s >> i) & 1 for i in range(n)] for s in range(1, 2 ** (n - 1))]
        return np.array(splits, np.float32).T * 2 - 1
    rng, bits, best = np.random.default_rng(7), int(np.ceil(10 * np.log2(n))), None
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, bits)).astype(np.float32)
        apart = (bits - code @ code.T) / 2 + np.eye(n) * bits
        if best is None or apart.min() > best[0]:
            best = apart.min(), code
    return best[1]


class Model:
    def __init__(self, languages: list[str]):
        self.languages, self.code = languages, codewords(len(languages))
        self.weights = np.zeros((DIM, self.code.shape[1]), np.float32)
        self.bias = np.zeros(self.code.shape[1], np.float32)
        self.trust = np.full(self.code.shape, 1 / max(self.code.shape[1], 1), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, how: Fit) -> Model:
        """Logistic classifiers for all bits at once, by Nesterov's gradient method;
        rows are weighted so that languages count alike."""
        target = self.code[y]
        each = (len(y) / (len(self.languages) * np.bincount(y, minlength=len(self.languages))))[y][:, None].astype(np.float32) / len(y)
        w, b = self.weights, self.bias
        vw, vb = np.zeros_like(w), np.zeros_like(b)
        for step in range(how.steps):
            m = step / (step + 3)
            aw, ab = w + m * vw, b + m * vb
            margin = x @ aw + ab
            slope = -target / (1 + np.exp(np.clip(target * margin, -30, 30))) * each
            nw, nb = aw - how.rate * (x.T @ slope + how.decay * aw), ab - how.rate * slope.sum(0)
            vw, vb, w, b = nw - w, nb - b, nw, nb
        self.weights, self.bias = w.astype(np.float32), b.astype(np.float32)
        right = (np.sign(x @ w + b) == target).astype(np.float64)
        trust = np.stack([right[y == k].mean(0) if (y == k).any() else np.ones(right.shape[1]) for k in range(len(self.languages))])
        self.trust = trust / np.maximum(trust.sum(1, keepdims=True), 1e-9)
        return self

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest language, score in 0..1 and whether the choice is ambiguous."""
        if not self.languages:
            n = len(x)
            return np.zeros(n, np.int64), np.zeros(n), np.ones(n, bool)
        margin = np.clip(x @ self.weights + self.bias, -30, 30).astype(np.float64)
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None])
        far = (loss * self.trust[None]).sum(2)
        best = far.argmin(1)
        share = np.exp(-(far - far.min(1, keepdims=True)) * max(self.code.shape[1], 1))
        near = np.sort(far, 1)
        close = near[:, 1] - near[:, 0] < AMBIGUOUS if len(self.languages) > 1 else np.zeros(len(x), bool)
        return best, share.max(1) / share.sum(1), close


def fold_of(id_col: str, folds: int):
    return F.crc32(F.col(id_col).cast("string")) % folds


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", how: Fit = Fit(), held_out: tuple[int, int] = (3, 1)) -> Model:
    """Fit on labelled rows outside the held-out fold (modulus, remainder)."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("text").isNotNull() & (fold_of("id", held_out[0]) != held_out[1]))
    per = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(how.labels).collect()}
    languages = sorted(per)
    model = Model(languages)
    if len(languages) < 2:
        return model
    each = max(1, how.rows // len(languages))
    shares = F.create_map(*(x for k in languages for x in (F.lit(k), F.lit(int(min(1.0, each / per[k]) * 2**31)))))
    chosen = labelled.where(F.pmod(F.xxhash64("id"), F.lit(2**31)) < shares[F.col("lang")])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = how.most  # of a task's rows (of one repeated id) no more can be taken
        for batch in batches:
            batch, room = batch.slice(0, room), max(room - len(batch), 0)
            every = [counts(t) for t in batch.column(1).to_pylist()]
            found = [np.flatnonzero(c) for c in every]
            rows = [c[at] for c, at in zip(every, found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([a.astype("<u2").tobytes() for a in found], pa.binary()), pa.array([r.astype("<f4").tobytes() for r in rows], pa.binary())], names=["id", "lang", "at", "n"])

    id_type = labelled.schema["id"].dataType.simpleString()
    reduced = chosen.mapInArrow(returning(reduce), f"id {id_type}, lang string, at binary, n binary")
    sample = reduced.orderBy(F.xxhash64("id"), "lang", F.xxhash64("at", "n")).limit(how.most).collect()
    sample.sort(key=lambda r: (r["lang"], str(r["id"]), bytes(r["at"]), bytes(r["n"])))
    x = np.zeros((len(sample), DIM), np.float32)
    for i, r in enumerate(sample):
        x[i, np.frombuffer(r["at"], "<u2")] = np.sqrt(np.frombuffer(r["n"], "<f4"))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return model.fit(x, np.array([languages.index(r["lang"]) for r in sample]), how)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous."""
    names = others(docs.columns, "lang_pred", "score", "ambiguous")
    fields = docs.select(*names).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            lang, score, close = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            some = [i for i, t in enumerate(texts) if model.languages and t and _LETTER.search(t)]
            for lo in range(0, len(some), 250):
                part = some[lo : lo + 250]
                best, s, c = model.decode(np.stack([features(texts[i]) for i in part]))
                for i, k in zip(part, best):
                    lang[i] = model.languages[k]
                score[part], close[part] = s, c
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(lang), pa.array(score), pa.array(close)], names=[*names, "lang_pred", "score", "ambiguous"])

    return docs.select(*names).mapInArrow(returning(run), fields)
