"""Shared helpers of the training-data operators: shared-folder staging, Arrow text access, word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: White space between words: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


# --------------------------------------------------------------------------- staging


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session may leave it unset; it gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="larkspur-"))
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/larkspur/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which the shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``stage``, and the folder, for what is dropped (``drop_path``) once its only reader is staged itself."""
    spark = df.sparkSession
    path, was = fresh_path(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors. The shuffle files of the writing go at once."""
    return staged(df, name)[0]


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a staged folder through Hadoop's file system, whichever store it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --------------------------------------------------------------------------- expressions


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast built-in; it changes the same letters there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------------- Python workers


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same batch function, which gives freed memory back to the system when its task ends; idle workers stay small."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # another C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


# --------------------------------------------------------------------------- Arrow text


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with about ``limit`` bytes; a null text is empty.

    Rows are never cut: one long text is a run of its own.
    """
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    n = len(col)
    if n == 0:
        return
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _random_table(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE = _random_table(256, 20240)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_POW: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["p"]) < n:
        size = max(n, (1 << 19) + 1)
        for key, base in (("p", _BASE), ("i", _INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POW[key] = np.cumprod(steps)
    return _POW["p"][:n], _POW["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of every word of a run of texts."""
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~_SPACE[buf]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    full = np.flatnonzero(np.diff(offs))
    before[offs[full]] = False
    after[offs[full + 1] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit polynomial hash of each word's bytes."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    p, inv = _powers(len(buf) + 1)
    acc = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[buf] if lower else buf] * p[:-1], out=acc[1:])
    return mix((acc[ends] - acc[starts]) * inv[starts])


def window_hashes(words: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words of one row, and the index of each window's first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = np.uint64(0xD6E8FEB86659FD93)
    h = words[:n].copy()
    for j in range(1, k):
        h = h * m + words[j : j + n]
    first = np.flatnonzero(row[:n] == row[k - 1 : k - 1 + n])
    return mix(h[first]), first


def span_hashes(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of each run of words[a:b], however long it is."""
    p, inv = _powers(len(words) + 1)
    acc = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * p[:-1], out=acc[1:])
    return mix((acc[b] - acc[a]) * inv[a])


def crc_key(value: object) -> int:
    """Unsigned CRC-32 of a value written as text."""
    return zlib.crc32(str(value).encode())
