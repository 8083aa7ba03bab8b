"""Token ids on disk as wavelet matrices, one per shard.

A wavelet matrix holds an id in ``bits`` bit-planes, the highest first; each plane is stored in the order
that a stable sort by the bits of the planes above gives. With a count of ones for every 4096 bits, a
position is followed from plane to plane by rank, and back by select. One compressed row holds a shard:
planes, counts, document identifiers and lengths. It gives the id at a position, how often an id occurs
before a position, and where its k-th occurrence is, without decoding the shard.

``write_shards`` deals documents out to ranges of identifiers from sampled splitters, sorts each range and
writes its shards of about ``shard_tokens`` ids as it goes; a task holds one shard at a time. Shards are
Parquet rows, so Spark's committer leaves the files of successful attempts only.

Defined results: documents stand in ascending order of identifier, null first, ties by text; a null or
empty text has its end id only; a document is never cut across shards; an empty table gives no shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import partitions, tidy
from larkspur.llm.tokens import encode_batches, encoder

SHARD_TOKENS = 1 << 19
BLOCK = 4096
SCHEMA = "part int, shard int, base long, n_tokens long, bits int, doc_ids array<long>, lengths array<int>, zeros array<int>, ones array<binary>, planes array<binary>"


class WaveletMatrix:
    """n ids of ``bits`` bits; planes are packed bits, zeros the count of 0 bits of each."""

    def __init__(self, n: int, planes: list[bytes], zeros: list[int], ones: list[bytes] | None = None):
        self.n, self.planes, self.zeros = n, [np.frombuffer(p, np.uint8) for p in planes], zeros
        self.ones = [np.frombuffer(o, "<u4") for o in ones] if ones is not None else [self._count(p) for p in self.planes]

    @staticmethod
    def _count(plane: np.ndarray) -> np.ndarray:
        """Ones before each block."""
        step = BLOCK // 8
        padded = np.zeros(-(-len(plane) // step) * step, np.uint8)
        padded[: len(plane)] = np.bitwise_count(plane)
        return np.concatenate([[0], np.cumsum(padded.reshape(-1, step).sum(1, dtype=np.int64))]).astype("<u4")

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        order, planes, zeros = np.ascontiguousarray(ids, np.uint32 if bits > 16 else np.uint16), [], []
        for b in range(bits - 1, -1, -1):
            bit = (order >> b) & 1 != 0
            planes.append(np.packbits(bit).tobytes())
            low = np.flatnonzero(~bit)
            zeros.append(len(low))
            order = np.concatenate([order[low], order[np.flatnonzero(bit)]])
        return cls(len(ids), planes, zeros)

    def decode(self) -> np.ndarray:
        """All ids, by undoing the stable sorts from the lowest plane up."""
        out = np.zeros(self.n, np.uint32 if len(self.planes) > 16 else np.uint16)
        for b, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            bit = np.unpackbits(plane, count=self.n).view(bool)
            up = np.empty_like(out)
            up[np.flatnonzero(~bit)] = out[:zeros]
            up[np.flatnonzero(bit)] = out[zeros:] | (1 << b)
            out = up
        return out

    def _rank1(self, level: int, i: int) -> int:
        block, plane = i // BLOCK, self.planes[level]
        at = block * (BLOCK // 8)
        total = int(self.ones[level][block]) + int(np.bitwise_count(plane[at : i // 8]).sum())
        return total + (int(plane[i // 8]) >> (8 - i % 8)).bit_count() if i % 8 else total

    def access(self, i: int) -> int:
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit = int(self.planes[level][i // 8]) >> (7 - i % 8) & 1
            r = self._rank1(level, i)
            i, value = (zeros + r, value * 2 + 1) if bit else (i - r, value * 2)
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the occurrences of an id before position ``end`` stand below the last plane."""
        lo, hi, bits = 0, end, len(self.planes)
        for level, zeros in enumerate(self.zeros):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (zeros + a, zeros + b) if token >> (bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, end: int | None = None) -> int:
        """Occurrences of an id before position ``end``."""
        if token >> len(self.planes):
            return 0
        lo, hi = self._range(token, self.n if end is None else end)
        return hi - lo

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of this value."""
        ones = self.ones[level].astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(before, k, "right")) - 1
        at = block * (BLOCK // 8)
        bits = np.unpackbits(self.planes[level][at : at + BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i, bits = lo + k, len(self.planes)
        for level in range(bits - 1, -1, -1):
            bit = token >> (bits - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i


def write_shards(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode all documents and write their shards as one compressed file for each range of identifiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, base = TaskContext.get().partitionId(), 0, 0
        bits = (encoder(tokenizer).vocab_size - 1).bit_length()
        ids, lengths, codes, have = [], [], [], 0

        def flush() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.concatenate(codes), bits)
            row = {
                "part": part, "shard": shard, "base": base, "n_tokens": matrix.n, "bits": bits, "doc_ids": list(ids), "lengths": list(lengths),
                "zeros": matrix.zeros, "ones": [o.tobytes() for o in matrix.ones], "planes": [p.tobytes() for p in matrix.planes],
            }
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo, found, counts in encode_batches(batch, "text", tokenizer):
                at, ends = 0, np.cumsum(counts)
                while at < len(counts):
                    # As many documents as reach the size of a shard, at least one.
                    begin = ends[at] - counts[at]
                    to = min(len(counts), max(at + 1, int(np.searchsorted(ends, begin + shard_tokens - have, "left")) + 1))
                    ids += keys[lo + at : lo + to]
                    lengths += counts[at:to].tolist()
                    codes.append(found[begin : ends[to - 1]])
                    have += int(ends[to - 1] - begin)
                    at = to
                    if have >= shard_tokens:
                        yield flush()
                        shard, base = shard + 1, base + have
                        ids, lengths, codes, have = [], [], [], 0
        if ids:
            yield flush()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), F.col("id").asc_nulls_first(), "_h").sortWithinPartitions(F.col("id").asc_nulls_first(), "_h", "text")
    dealt.select("id", "text").mapInArrow(tidy(run), SCHEMA).write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Shards, each with the count of ids before it in the whole corpus.

    Totals are summed per file first; the running sum is over as many lines as there are files.
    """
    shards = spark.read.parquet(path)
    sums = shards.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    starts = sums.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_start"))
    return shards.join(F.broadcast(starts), "part").withColumn("base", F.col("base") + F.col("_start")).drop("_start")


def documents_of(spark: SparkSession, path: str) -> DataFrame:
    """A row per document, from its decoded shard: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                code = WaveletMatrix(row["n_tokens"], row["planes"], row["zeros"], row["ones"]).decode().astype("<u4").tobytes()
                ends = np.cumsum(np.asarray(row["lengths"], np.int64))
                begins = ends - np.asarray(row["lengths"], np.int64)
                crc = [zlib.crc32(code[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(begins + row["base"]), pa.array(ends - begins), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_shards(spark, path).mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def occurrences(spark: SparkSession, path: str, token: int, most_per_shard: int | None = None) -> DataFrame:
    """Per shard that holds an id: shard, count, and corpus positions (all, or the first few of each shard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix = WaveletMatrix(row["n_tokens"], row["planes"], row["zeros"], row["ones"])
                if count := matrix.rank(token):
                    places = [row["base"] + matrix.select(token, k) for k in range(count if most_per_shard is None else min(count, most_per_shard))]
                    columns = [pa.array([row["part"]], pa.int32()), pa.array([row["shard"]], pa.int32()), pa.array([count], pa.int64()), pa.array([places], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "shard", "n", "positions"])

    return read_shards(spark, path).mapInArrow(tidy(run), "part int, shard int, n long, positions array<long>")
