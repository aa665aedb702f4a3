"""Token ids as files of directly addressable codes.

An id is split into chunks of eight bits. Level 0 holds the lowest chunk of every id, level
1 the second chunk of the ids that have one, and so on; a bitmap beside each level says
which ids go on to the next, and a rank directory counts the set bits before every block
of 512. The id at a position is found by reading one chunk and one bit of each of its
levels: the position in the next level is the rank of the bit. No block is decoded, and a
range of ids is one contiguous range of each level.

A file (all numbers little-endian):

    "LDAC", levels u32, task u64, nth u64, documents u64, ids u64, entries of each level u64
    documents: present bits (1 bit each, whole bytes), ids i64, ends u64 (ids up to and with it)
    each level: chunks (1 byte each), bitmap (whole blocks of 64 bytes), ranks u32 (one a block)

Writing: texts are dealt by ranges of document id and sorted, and each task encodes its
own and writes files of about ``FILE_IDS`` ids, one row of bytes each, through Spark's
text writer. It writes a row's bytes as they are (and a last byte, the line's end), to any
file system, and its committer keeps only what successful tasks wrote, so lost executors
leave no half files. Many rows of one id are dealt to several tasks.
The folder ``index`` beside the files is made by reading them back: for each document its
file, place, number of ids and checksum; ``files`` has each file's first position. Of
counts only one a task goes through the driver.

Defined results: a null text is an empty one (its end id only); documents of a null id come
first; equal ids are ordered by their texts' hash (xxhash64), then as read; one document
is never cut over two files, so a very long one makes a long file; an empty table gives no
file and an empty index; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenark.llm.bpe import ChunkedBpe
from lumenark.llm.common import cut, kept, parts, returning, shared_dir

#: Appended to every document.
END_ID = 2
#: Ids after which a file is closed.
FILE_IDS = 1 << 21
#: Chunks of text that a worker remembers with their ids (about 200 bytes each).
REMEMBER = 900_000
MAGIC = b"LDAC"
BLOCK = 512
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


# --- one file ----------------------------------------------------------------


def pack_file(task: int, nth: int, keys: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The bytes of a file of documents, ``lengths`` ids each."""
    levels, left = [], ids.astype(np.uint32)  # ids below 2^32
    while len(left) or not levels:
        on = left > 255
        blocks = -(-len(left) // BLOCK)
        bits = np.zeros(blocks * BLOCK // 8, np.uint8)
        bits[: -(-len(left) // 8)] = np.packbits(on, bitorder="little")
        ones = _ONES[bits].reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
        ranks = np.cumsum(ones, dtype=np.uint32) - ones
        levels.append((left.astype(np.uint8), bits, ranks))
        left = left[on] >> 8
    head = np.array([len(keys), len(ids), *(len(c) for c, _, _ in levels)], "<u8").tobytes()
    docs = [np.packbits(np.array([k is not None for k in keys], bool), bitorder="little").tobytes(), np.array([k or 0 for k in keys], "<i8").tobytes(), np.cumsum(lengths, dtype="<u8").tobytes()]
    parts_ = [x for c, bits, ranks in levels for x in (c.tobytes(), bits.tobytes(), ranks.astype("<u4").tobytes())]
    return b"".join([MAGIC, np.array([len(levels)], "<u4").tobytes(), np.array([task, nth], "<u8").tobytes(), head, *docs, *parts_])


class TokenFile:
    """Reads a file through ``read(at, n)``, which gives n bytes from a place: nothing but
    the head, the chunks, bits and ranks that an answer needs is asked for."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        if read(0, 4) != MAGIC:
            raise ValueError("not a token file")
        n_levels = int(self._numbers(4, "<u4", 1)[0])
        numbers = self._numbers(8, "<u8", 4 + n_levels).tolist()
        self.task, self.nth, self.documents, self.size = numbers[:4]
        self.present = 40 + 8 * n_levels
        self.keys_at = self.present + -(-self.documents // 8)
        self.ends_at = self.keys_at + 8 * self.documents
        at, self.levels = self.ends_at + 8 * self.documents, []
        for n in numbers[4:]:
            blocks = -(-n // BLOCK)
            bits, ranks = at + n, at + n + blocks * BLOCK // 8
            self.levels.append((at, bits, ranks))
            at = ranks + 4 * blocks
        self.length = at

    def _numbers(self, at: int, kind: str, n: int) -> np.ndarray:
        return np.frombuffer(self.read(at, n * int(kind[2])), kind)

    def _rank(self, level: int, i: int) -> tuple[int, bool]:
        """Set bits before ``i``, and whether bit ``i`` is set."""
        _, bits, ranks = self.levels[level]
        block, within = divmod(i, BLOCK)
        raw = self.read(bits + block * BLOCK // 8, within // 8 + 1)
        word = int.from_bytes(raw, "little")
        before = int(self._numbers(ranks + 4 * block, "<u4", 1)[0])
        return before + (word & ((1 << within) - 1)).bit_count(), bool(word >> within & 1)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.size:
            raise IndexError(i)
        value, shift = 0, 0
        for level, (chunks, _, _) in enumerate(self.levels):
            value |= self.read(chunks + i, 1)[0] << shift
            i, more = self._rank(level, i)
            if not more:
                break
            shift += 8
        return value

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The ids at positions lo to hi: one range of each level."""
        hi = self.size if hi is None else hi
        return self._level(0, lo, hi)

    def _level(self, level: int, lo: int, hi: int) -> np.ndarray:
        chunks, bits, _ = self.levels[level]
        values = np.frombuffer(self.read(chunks + lo, hi - lo), np.uint8).astype(np.uint32)
        if level + 1 == len(self.levels) or hi <= lo:
            return values
        on = np.unpackbits(np.frombuffer(self.read(bits + lo // 8, -(-hi // 8) - lo // 8), np.uint8), bitorder="little")[lo % 8 : lo % 8 + hi - lo].astype(bool)
        first = self._rank(level, lo)[0]
        values[on] |= self._level(level + 1, first, first + int(on.sum())) << np.uint32(8)
        return values

    def keys(self) -> list[int | None]:
        there = np.unpackbits(np.frombuffer(self.read(self.present, -(-self.documents // 8)), np.uint8), bitorder="little")
        return [k if there[i] else None for i, k in enumerate(self._numbers(self.keys_at, "<i8", self.documents).tolist())]

    def ends(self) -> np.ndarray:
        return self._numbers(self.ends_at, "<u8", self.documents).astype(np.int64)


def held(content: bytes) -> TokenFile:
    return TokenFile(lambda at, n: content[at : at + n])


# --- many files, by Spark ----------------------------------------------------

_ENCODERS: dict[str, ChunkedBpe] = kept("token files")
_READ = "file string, task long, nth long, place long, doc_id long, first long, n_tokens long, ids_crc32 long"


def _files(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, most: int) -> Iterator[pa.RecordBatch]:
    """A task's documents, in order, as rows of a file's bytes."""
    if tokenizer not in _ENCODERS:
        _ENCODERS[tokenizer] = ChunkedBpe(tokenizer, remember=REMEMBER)
    encoder, end = _ENCODERS[tokenizer], np.array([end_id], "<u4").tobytes()
    task, nth, size = TaskContext.get().partitionId(), 0, 0
    keys, lengths, ids = [], [], []

    def close() -> pa.RecordBatch:
        nonlocal nth, size
        row = pack_file(task, nth, keys, lengths, np.concatenate(ids))
        nth, size = nth + 1, 0
        for x in (keys, lengths, ids):
            x.clear()
        return pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], names=["value"])

    for batch in batches:
        own, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi in parts(texts, 250, 4 << 20):
            for key, raw in zip(own[lo:hi], encoder.encode(texts[lo:hi])):
                keys.append(key)
                ids.append(np.frombuffer(raw + end, "<u4"))
                lengths.append(len(ids[-1]))
                size += lengths[-1]
                if size >= most:
                    yield close()
    if keys:
        yield close()


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            file = held(memoryview(content.as_buffer()))
            ids, ends = file.ids().astype("<u4"), file.ends()
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
            n = file.documents
            columns = [pa.array([path] * n, pa.string()), pa.array(np.full(n, file.task)), pa.array(np.full(n, file.nth)), pa.array(np.arange(n)), pa.array(file.keys(), pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(pa.int64()) if i else c for i, c in enumerate(columns)], names=[f.split()[0] for f in _READ.split(", ")])


def _contents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{root}/ids").select("path", "content")


def write(docs: DataFrame, tokenizer: str, root: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, file_ids: int = FILE_IDS) -> str:
    """Encode every text, append ``end_id`` and write the ids in order of ``id_col`` below
    ``root`` (default: a new folder in the shared one); returns the folder, in which
    ``ids`` holds the files, ``index`` and ``files`` the tables about them."""
    spark = docs.sparkSession
    root = root or f"{shared_dir(spark)}/lumenark/token-files-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = ["doc_id", "tie", "row"]
    rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)
    files = rows.select("doc_id", "text").mapInArrow(returning(lambda b: _files(b, tokenizer, end_id, file_ids), keeps="token files"), "value binary")
    files.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(f"{root}/ids")
    back = cut(_contents(spark, root).mapInArrow(returning(_read_back), _READ), "token-places")
    files = cut(back.groupBy("file", "task", "nth").agg(F.sum("n_tokens").alias("ids")), "token-file-sizes")
    first, before = [], 0  # one number for each task that wrote
    for r in files.groupBy("task").agg(F.sum("ids").alias("ids")).orderBy("task").collect():
        first.append((r["task"], before))
        before += r["ids"]
    lead = F.sum("ids").over(Window.partitionBy("task").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
    tasks = spark.createDataFrame(first, "task long, before long")
    files.withColumn("lead", F.coalesce(lead, F.lit(0))).join(tasks, "task").select("file", "task", "nth", (F.col("before") + F.col("lead")).alias("start"), "ids").write.parquet(f"{root}/files")
    starts = spark.read.parquet(f"{root}/files").select("task", "nth", F.col("start").alias("base"))
    found = back.join(starts, ["task", "nth"]).select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "file", "place", "first")
    found.write.parquet(f"{root}/index")
    return root


def index(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file, place, first): from the files."""
    return spark.read.parquet(f"{root}/index")


def read(spark: SparkSession, root: str) -> DataFrame:
    """(file, place, doc_id, ids): every document's ids, in tasks of some files each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                file = held(memoryview(content.as_buffer()))
                ends, n = file.ends(), file.documents
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(file.ids().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(np.arange(n)), pa.array(file.keys(), pa.int64()), ids], names=["file", "place", "doc_id", "ids"])

    return _contents(spark, root).mapInArrow(returning(run), "file string, place long, doc_id long, ids array<int>")


def open_file(spark: SparkSession, path: str) -> TokenFile:
    """A file read by seeks, on any file system that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)

    def at(place: int, n: int) -> bytes:
        stream.seek(place)
        return bytes(stream.readNBytes(n))

    return TokenFile(at)


def token(spark: SparkSession, root: str, position: int) -> int:
    """The id at a position of the whole sequence: one row of ``files`` and a few bytes."""
    row = spark.read.parquet(f"{root}/files").where((F.col("start") <= position) & (F.col("start") + F.col("ids") > position)).first()
    if row is None:
        raise IndexError(position)
    return open_file(spark, row["file"])[position - row["start"]]
