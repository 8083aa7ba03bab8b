"""Packing by power-of-two decomposition.

Each document's ids, ended by id 2, are cut into pieces whose lengths are powers of two, largest first
and ``longest`` at most; a piece is a sequence of its own. Sequences of one length form a bucket, so
batches need no padding, and no sequence crosses documents. Rows are independent of each other: there is no
shuffle, and any executor can repeat a task and get the same pieces and numbers.

Defined results: a null or empty text has the end id only, one piece of length 1; rows that share an
identifier are packed each on its own; null identifiers are kept; an empty table gives an empty table;
further columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import tidy
from larkspur.llm.tokens import encode_batches

LONGEST = 4096


def cuts(n: int, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    out, at = [], 0
    while at < n:
        size = min(longest, 1 << ((n - at).bit_length() - 1))
        out.append((at, size))
        at += size
    return out


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, with_ids: bool = False) -> DataFrame:
    """A row per piece: identifier, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``with_ids`` the ids in binary."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for lo, found, counts in encode_batches(batch, "text", tokenizer):
                code, at_doc = found.astype("<u4").tobytes(), 0
                row, start, length, crc, total, ids = [], [], [], [], [], []
                for i, n in enumerate(counts.tolist()):
                    for at, size in cuts(n, longest):
                        piece = code[4 * (at_doc + at) : 4 * (at_doc + at + size)]
                        row.append(lo + i)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        if with_ids:
                            ids.append(piece)
                    at_doc += n
                numbers = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                columns = [keys.take(pa.array(row, pa.int64())), *numbers, *([pa.array(ids, pa.binary())] if with_ids else [])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    pieces = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(tidy(run), schema)
    return pieces.select(
        F.col("id").alias(id_col),
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        *["ids"] * with_ids,
    )


def write_buckets(docs: DataFrame, path: str, **options) -> None:
    """Sequences with their ids as Parquet, a folder for each length."""
    pack(docs, with_ids=True, **options).withColumnRenamed("length", "bucket").write.partitionBy("bucket").parquet(path)
