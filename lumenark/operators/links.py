"""Discovery of link opportunities in prose, and writing them in.

The index of names (paths' stems and aliases) is small text per note; it is broadcast
while it is within ``BROADCAST_NAMES`` names. Beyond it, the distinct windows of all notes
say by equi joins which names any of them equals or resembles; if those are so few, they
are broadcast instead, else each note gets its own by joins. The result is the same. Resemblance is found exactly, either way: a name that k edits can reach
is cut into k + 1 segments, one of which a window within k edits holds near its place, so
a window meets only names that share a segment with it.

Names of one word resemble nothing unless they are of the people's folder, and first names
are those of its notes only; each name is found by resemblance once in a note."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.operators.markdown import prose_lines, split_frontmatter
from lumenark.session import shared_dir

BROADCAST_NAMES = 200_000
#: Windows whose resemblances an index remembers at most.
REMEMBERED = 100_000
FUZZY = 0.92
#: The folder of notes on people.
PEOPLE = "People"
_PROTECTED = re.compile(r"`[^`\n]*`|!?\[\[(?:(?!\]\])[^\n])+\]\]|\[[^\]\n]*\]\([^)\n]*\)|https?://\S+")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


@dataclass(frozen=True)
class Found:
    start: int
    end: int
    text: str
    target: str
    kind: str  # exact, alias, fuzzy or first-name


def similarity(a: str, b: str) -> float:
    """1 - Levenshtein distance / the longer length."""
    if a == b:
        return 1.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b), 1)


def fold(name: str) -> str:
    """Names compare without case; hyphens and underscores are spaces."""
    return re.sub(r"[\s_-]+", " ", name).strip().lower()


def is_name(name: str) -> bool:
    return len(name.strip()) >= 3 and not re.fullmatch(r"\d{4} \d{2} \d{2}", fold(name))


def of_people(target: str, people: str | None) -> bool:
    return people is not None and target.startswith(people.rstrip("/") + "/")


class NameIndex:
    """Names by fold, and by segments for windows that resemble them."""

    def __init__(self, names: list[tuple[str, str, str]], people: str | None = PEOPLE):
        """(name, target path, kind: exact or alias)."""
        self.by_fold: dict[str, tuple[str, str]] = {}
        self.people = people
        for name, target, kind in sorted(names, key=lambda n: (n[2] != "exact", n[1])):
            if is_name(name):
                self.by_fold.setdefault(fold(name), (target, kind))
        firsts: dict[str, list[str]] = {}
        self.longest = 0
        for key, (target, _) in self.by_fold.items():
            words = key.split()
            self.longest = max(self.longest, len(words))
            if len(words) > 1 and of_people(target, people):
                firsts.setdefault(words[0], []).append(target)
        self.firsts = {w: t[0] for w, t in firsts.items() if len(t) == 1}
        self._cut()

    def _cut(self) -> None:
        self._met: dict[tuple[str, int], set[str]] = {}
        self.by_segment: dict[tuple[int, int, int, str], list[str]] = {}
        for key, (target, _) in self.by_fold.items():
            words = len(key.split())
            if words > 1 or of_people(target, self.people):
                for i, (lo, hi) in enumerate(segments(len(key))):
                    self.by_segment.setdefault((words, len(key), i, key[lo:hi]), []).append(key)

    @classmethod
    def part(cls, folds: dict[str, tuple[str, str]], firsts: dict[str, str], longest: int, people: str | None) -> NameIndex:
        """What one note needs of an index of many names."""
        index = cls([], people)
        index.by_fold, index.firsts, index.longest = folds, firsts, longest
        index._cut()
        return index

    def near(self, text: str, words: int) -> set[str]:
        """The names of as many words that resemble a folded window."""
        if (text, words) not in self._met:
            if len(self._met) >= REMEMBERED:
                self._met.clear()
            met = {key for probe in probes(text) for key in self.by_segment.get((words, *probe), ())}
            self._met[text, words] = {key for key in met if similarity(key, text) >= FUZZY}
        return self._met[text, words]


def free_spans(content: str) -> list[tuple[int, int]]:
    """Stretches outside frontmatter, fences, code, links and addresses."""
    _, body = split_frontmatter(content)
    at, out = len(content) - len(body), []
    for _, line, fenced in prose_lines(body):
        if not fenced and not line.startswith("#"):
            lo = 0
            for m in _PROTECTED.finditer(line):
                out.append((at + lo, at + m.start()))
                lo = m.end()
            out.append((at + lo, at + len(line)))
        at += len(line) + 1
    return [(a, b) for a, b in out if b > a]


def windows_of(content: str, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, words) of all runs of up to ``longest`` words."""
    windows = []
    for lo, hi in free_spans(content):
        # a possessive's ending is not of the word
        words = [(lo + m.start(), lo + m.end() - 2 * (m[0][-2:-1] in ("'", "’") and m[0][-1:] in "sS")) for m in _WORD.finditer(content[lo:hi])]
        windows += [(words[i][0], words[i + n - 1][1], n) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return windows


def discover(content: str, own: str, index: NameIndex) -> list[Found]:
    """Mentions of other notes: exact names and aliases, longest first; then similar
    windows of as many words, each name once; then first names that only one person has.
    No two overlap, a note is never its own target, nor is a name before a file ending."""
    found: list[Found] = []
    taken: list[tuple[int, int]] = []
    free = lambda a, b: all(b <= x or a >= y for x, y in taken)
    windows = windows_of(content, index.longest)
    windows.sort(key=lambda w: (-(w[1] - w[0]), w[0]))

    def claim(a: int, b: int, target: str, kind: str) -> None:
        if target != own and free(a, b) and not re.match(r"\.[A-Za-z0-9]{1,4}\b", content[b : b + 5]):
            taken.append((a, b))
            found.append(Found(a, b, content[a:b], target, kind))

    for a, b, _ in windows:
        hit = index.by_fold.get(fold(content[a:b]))
        if hit:
            claim(a, b, *hit)
    known: dict[tuple[str, int], set[str]] = {}
    alike: dict[str, list[tuple[int, int]]] = {}
    for a, b, n in windows:
        text = fold(content[a:b])
        if (text, n) not in known:
            known[text, n] = index.near(text, n)
        for key in known[text, n]:
            alike.setdefault(key, []).append((a, b))
    for key in sorted(alike, key=lambda k: (-len(k), k)):
        where = next(((a, b) for a, b in sorted(alike[key]) if free(a, b)), None)
        if where:
            claim(*where, index.by_fold[key][0], "fuzzy")
    for a, b, n in windows:
        if n == 1 and content[a:b].lower() in index.firsts:
            claim(a, b, index.firsts[content[a:b].lower()], "first-name")
    return sorted(found, key=lambda f: f.start)


def apply_links(content: str, found: list[Found]) -> str:
    """The first mention of each target as a link that reads as before."""
    first: dict[str, Found] = {}
    for f in found:
        first.setdefault(f.target, f)
    for f in sorted(first.values(), key=lambda f: -f.start):
        stem = re.sub(r"\.md$", "", f.target).rsplit("/", 1)[-1]
        link = f"[[{stem}]]" if stem == f.text else f"[[{stem}|{f.text}]]"
        content = content[: f.start] + link + content[f.end :]
    return content


def discover_links(notes: DataFrame, aliases: DataFrame | None = None, people: str | None = PEOPLE) -> DataFrame:
    """(path, start, text, target, kind) over notes (path, content); ``people``: the
    folder of notes on people."""
    stems = notes.select(F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "").alias("name"), F.col("path").alias("target"), F.lit("exact").alias("kind"))
    names = stems if aliases is None else stems.unionByName(aliases.select(F.col("alias").alias("name"), F.col("path").alias("target"), F.lit("alias").alias("kind")))
    fields = "path string, start long, text string, target string, kind string"

    def rows(batch: pa.RecordBatch, index_of) -> pa.RecordBatch:
        out = [(p, f.start, f.text, f.target, f.kind) for k, (p, c) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())) for f in discover(c or "", p, index_of(k))]
        columns = list(zip(*out)) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 1 else pa.string()) for i, c in enumerate(columns)], names=["path", "start", "text", "target", "kind"])

    if names.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES:
        sent = notes.sparkSession.sparkContext.broadcast([tuple(r) for r in names.collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = NameIndex(sent.value, people)
            for b in batches:
                yield rows(b, lambda _: index)

        return notes.select("path", "content").mapInArrow(run, fields)
    keyed = names.mapInArrow(_keyed, "key string, words int, target string, kind string")
    best = _stored(keyed.groupBy("key", "words").agg(F.min(F.struct((F.col("kind") != "exact").alias("o"), "target", "kind")).alias("m")).select("key", "words", "m.target", "m.kind"))
    longest = best.agg(F.max("words")).first()[0] or 0
    person = F.lit(False) if people is None else F.col("target").startswith(people.rstrip("/") + "/")
    two = best.where((F.col("words") > 1) & person).groupBy(F.split("key", " ")[0].alias("text")).agg(F.min("target").alias("first"), F.count(F.lit(1)).alias("n"))

    def spoken(of_notes: bool):
        """The windows of each note, or of a batch of notes together."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = dict.fromkeys((p if of_notes else None, fold(c[x:y]), n) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if c for x, y, n in windows_of(c, longest))
                columns = list(zip(*found)) if found else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32())], names=["path", "text", "words"])

        return run

    said = notes.select("path", "content").mapInArrow(spoken(False), "path string, text string, words int")
    texts = _stored(said.select("text", "words").distinct())
    probed = texts.mapInArrow(_pieces(False), "text string, words int, size int, i int, piece string")
    cuts = best.where((F.col("words") > 1) | person).select("key", "words").mapInArrow(_pieces(True), "key string, words int, size int, i int, piece string")
    longer = F.greatest(F.length("key"), F.length("text"))
    alike = probed.join(cuts, ["words", "size", "i", "piece"]).where((F.abs(F.length("key") - F.length("text")) <= 0.08 * longer) & (1 - F.levenshtein("key", "text") / longer >= FUZZY)).select("text", "words", "key")
    pairs = alike.unionByName(texts.select("text", "words", F.col("text").alias("key"))).distinct()
    pairs = _stored(pairs.join(best.select("key", "target", "kind"), "key"))
    firsts = _stored(two.where("n = 1").drop("n").join(texts.where("words = 1").select("text"), "text", "left_semi"))
    met = pairs.select("key", "target", "kind").distinct()
    if met.limit(BROADCAST_NAMES + 1).count() + firsts.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES:
        known = {r["key"]: (r["target"], r["kind"]) for r in met.collect()}, {r["text"]: r["first"] for r in firsts.collect()}
        sent = notes.sparkSession.sparkContext.broadcast(known)

        def those(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = NameIndex.part(*sent.value, longest, people)
            for b in batches:
                yield rows(b, lambda _: index)

        return notes.select("path", "content").mapInArrow(those, fields)
    windows = notes.select("path", "content").mapInArrow(spoken(True), "path string, text string, words int")
    near = windows.join(pairs, ["text", "words"]).select("path", "key", "target", "kind").distinct().groupBy("path").agg(F.collect_set(F.struct("key", "target", "kind")).alias("names"))
    named = windows.where("words = 1").join(firsts, "text").groupBy("path").agg(F.collect_set(F.struct("text", "first")).alias("firsts"))

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, first = b.column(2).to_pylist(), b.column(3).to_pylist()
            yield rows(b, lambda k: NameIndex.part({n["key"]: (n["target"], n["kind"]) for n in own[k] or []}, {f["text"]: f["first"] for f in first[k] or []}, longest, people))

    return notes.join(near, "path", "left").join(named, "path", "left").select("path", "content", "names", "firsts").mapInArrow(few, fields)


def _stored(df: DataFrame) -> DataFrame:
    """``df`` read back from the shared folder: made once, however often it is read."""
    path = f"{shared_dir(df.sparkSession)}/lumenark/names-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, words, target, kind) of (name, target, kind)."""
    for b in batches:
        kept = b.filter(pa.array([is_name(n) for n in b.column(0).to_pylist()], pa.bool_()))
        keys = [fold(n) for n in kept.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([len(k.split()) for k in keys], pa.int32()), kept.column(1), kept.column(2)], names=["key", "words", "target", "kind"])


def edits_of(size: int) -> int:
    """Edits within which a text can resemble a name of ``size`` characters: the longer
    of the two has at most size / FUZZY."""
    return int((1 - FUZZY) * size / FUZZY + 1e-6)


def segments(size: int) -> list[tuple[int, int]]:
    """(start, end) of the edits + 1 even segments of a name."""
    k = edits_of(size) + 1
    return [(i * size // k, (i + 1) * size // k) for i in range(k)]


def probes(text: str) -> Iterator[tuple[int, int, str]]:
    """(size, i, piece): what segment i of a name of that size is if the name resembles
    ``text``. Segment i moves by at most i before it, and what follows it by at most the
    edits that are left."""
    n = len(text)
    for size in range(int(n * FUZZY), int(n / FUZZY) + 2):
        k, more = edits_of(size), n - size
        if abs(more) <= k:
            for i, (lo, hi) in enumerate(segments(size)):
                for move in range(max(-i, more - (k - i), -lo), min(i, more + (k - i), n - hi) + 1):
                    yield size, i, text[lo + move : hi + move]


def _pieces(of_names: bool):
    """Segments of names, or the probes for them, of (text, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = [(len(t), i, t[x:y]) for i, (x, y) in enumerate(segments(len(t)))] if of_names else list(dict.fromkeys(probes(t)))
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(found), pa.string()), pa.array([w] * len(found), pa.int32()), *(pa.array([f[k] for f in found], t_) for k, t_ in enumerate((pa.int32(), pa.int32(), pa.string())))], names=["key" if of_names else "text", "words", "size", "i", "piece"])

    return run
