"""What the operators share: the cluster's shared folder, batches, word hashing."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts: space, \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the
    session. Only on one machine (a local master, as in tests) a temporary one may be
    made; on a cluster an unset folder is an error."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not at:
        at = sc.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='lumenark-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def unused(columns: list[str], name: str) -> str:
    """``name``, or that with underscores before it, that is none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def others(columns: list[str], *made: str) -> list[str]:
    """``columns`` without those that bear a name that an operator makes, in any case, as
    Spark compares names."""
    taken = {m.lower() for m in made}
    return [c for c in columns if c.lower() not in taken]


def write_shared(df: DataFrame, name: str, partition_by: str | None = None) -> str:
    """Write ``df`` as a Parquet table in the shared folder; returns its path.
    Cuts lineage: a lost executor costs only the tasks that read the table."""
    path = f"{shared_dir(df.sparkSession)}/lumenark/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` read back from a table in the shared folder."""
    path = write_shared(df, name)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Ids (8 bytes each) up to which a counted set of them is broadcast.
BROADCAST_IDS = 2_000_000


def few(ids: DataFrame, bound: int = BROADCAST_IDS) -> DataFrame:
    """``ids``, a stored table, marked for broadcast if it has at most ``bound`` rows;
    beyond that Spark joins it by shuffle."""
    return F.broadcast(ids) if ids.limit(bound + 1).count() <= bound else ids


def remove_shared(spark: SparkSession, path: str) -> None:
    """Delete a table of ``write_shared`` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_KEPT: dict[str, dict] = {}


def kept(name: str) -> dict:
    """What a Python worker keeps from task to task, until another operator's task."""
    return _KEPT.setdefault(name, {})


def drop_kept(but: str | None = None) -> None:
    for name, what in _KEPT.items():
        if name != but:
            what.clear()


def give_back() -> None:
    """Return this process's free memory to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def returning(run: Callable[[Iterator], Iterator], keeps: str | None = None) -> Callable[[Iterator], Iterator]:
    """``run``, for mapInArrow, in a worker that first drops what other operators keep
    there (all but ``keeps``) and at the end of the task gives free memory back. Spark
    uses a worker again for the next stages; else each adds what it leaves to the last."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        drop_kept(keeps)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def parts(texts: list, rows: int, characters: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of at most ``rows`` texts that end once they hold ``characters``."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if i + 1 - lo >= rows or size >= characters:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


# --- vectorised word hashing -------------------------------------------------

_RNG = np.random.default_rng(20240917)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_CLASS = np.zeros(256, dtype=bool)
_CLASS[[ord(c) for c in SPACES]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCK = 4096


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_BASE, _BLOCK), _powers(_BASE_INV, _BLOCK)
_STEP, _STEP_INV = pow(_BASE, _BLOCK, 2**64), pow(_BASE_INV, _BLOCK, 2**64)


def _long_powers(table: np.ndarray, step: int, n: int) -> np.ndarray:
    blocks = -(-n // _BLOCK)
    return (_powers(step, max(blocks, 1))[:, None] * table[None, :]).ravel()[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


#: Bytes between words where only letters, digits and non-ASCII characters are kept.
_PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_hashes(parts: list[bytes], lower: bool = True, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the maximal runs of non-space bytes of all parts, in order,
    and for each part the number of its words. ``plain``: all ASCII but letters and
    digits counts as space. A polynomial over random odd byte
    values, differenced from one prefix sum, so that all words of a batch cost a
    few passes over its bytes whatever their lengths."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blob = b"\n".join(parts) + b"\n"
    a = np.frombuffer(blob, dtype=np.uint8)
    space = (_PUNCTUATION if plain else _CLASS)[a]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(parts), np.int64)
    ends = np.cumsum([len(p) + 1 for p in parts])
    count = np.diff(np.searchsorted(start, ends, side="left"), prepend=0)
    values = _BYTE[_LOWER[a]] if lower else _BYTE[a]
    values *= _long_powers(_POW, _STEP, len(a))
    np.cumsum(values, out=values)
    at = np.empty(len(start), np.uint64)
    nz = start > 0
    at[nz] = values[start[nz] - 1]
    at[~nz] = 0
    h = values[end - 1] - at
    # undo the position: multiply by the inverse power of the start
    inv = _INV[start % _BLOCK] * _powers(_STEP_INV, int(len(a) // _BLOCK) + 1)[start // _BLOCK]
    return mix64(h * inv), count.astype(np.int64)
