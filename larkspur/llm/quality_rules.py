"""Quality rules: fixed counts of each text, and a calibrated logistic regression on hashed n-grams.

Counts: words, code points in words, symbols, repeated lines, and words inside 8-word windows that occur twice
or more. A text fails the base rule with fewer than 20 words or more than 30% of its words in repeated windows.

The model hashes word 1- and 2-grams (a word that repeats the one before it counts as "repeat") and code point 3-grams
into ``BUCKETS`` weights each, by frequency in the text. It is trained on at most ``sample_rows`` labelled rows
outside the held-out fold, the share ``CALIBRATE`` of which is kept for calibrating its margin to a probability.
Texts are scored whole, in Arrow batches, and kept from a fixed probability on.

Defined results: a null or empty text has counts of 0 and fails; rows that share an identifier are judged each
on its own; without any usable label the base rule decides alone; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import mix, _SPACE, text_chunks, tidy, window_hashes, word_hashes, word_spans
from larkspur.llm.labelled import labelled_sample, platt, sigmoid

BUCKETS = 1 << 17
SAMPLE_ROWS = 4000
CALIBRATE = 5
KEEP_FROM = 0.3
WINDOW = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_HEAD = np.ones(256, bool)  # bytes that begin a code point
_HEAD[0x80:0xC0] = False
_IN_WORD = _HEAD & ~_SPACE
_REPEAT = np.uint64(0x5DEECE66D)


def _per_row(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    acc = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=acc[1:])
    return acc[offs[1:]] - acc[offs[:-1]]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: keys that occur twice or more, and keys that have occurred earlier."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    eq = s[1:] == s[:-1]
    later = np.zeros(len(keys), bool)
    later[order[1:][eq]] = True
    twice = later.copy()
    twice[order[:-1][eq]] = True
    return twice, later


def counts(buf: np.ndarray, offs: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The fixed counts per row, and each word's hash and row."""
    n = len(offs) - 1
    starts, ends, row = word_spans(buf, offs)
    h = word_hashes(buf, starts, ends, lower=False)
    out = {"n_words": np.bincount(row, minlength=n), "word_chars": _per_row(_IN_WORD[buf], offs), "n_symbols": _per_row(_SYMBOL[buf], offs)}
    bounds = np.union1d(offs[:-1], np.flatnonzero(buf == 10) + 1)
    bounds = bounds[bounds < len(buf)]
    stop = np.append(bounds[1:], len(buf))
    inner = np.append(np.searchsorted(offs, bounds[1:], "left") < len(offs), False)
    inner[:-1] &= offs[np.searchsorted(offs, bounds[1:], "left").clip(0, n)] != bounds[1:]
    stop = stop - (inner | ((stop == len(buf)) & (len(buf) > 0) & (buf[-1:] == 10).any())).astype(np.int64)  # without the line's end
    k = np.searchsorted(bounds, starts, "right") - 1
    full = np.unique(k)
    line_row = np.searchsorted(offs, bounds[full], "right") - 1
    line = word_hashes(buf, bounds[full], stop[full], lower=False) if len(full) else np.zeros(0, np.uint64)
    _, later = repeated(mix(line + line_row.astype(np.uint64) * _REPEAT))
    out["n_dup_lines"] = np.bincount(line_row[later], minlength=n)
    windows, first = window_hashes(h, row, WINDOW)
    twice, _ = repeated(mix(windows + row[first].astype(np.uint64) * _REPEAT)) if len(first) else (np.zeros(0, bool), None)
    step = np.zeros(len(h) + 1, np.int32)
    np.add.at(step, first[twice], 1)
    np.add.at(step, first[twice] + WINDOW, -1)
    covered = np.cumsum(step[:-1]) > 0
    out["n_repeat_words"] = np.bincount(row[covered], minlength=n)
    return {k: v.astype(np.int64) for k, v in out.items()}, h, row


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])


def gram_buckets(buf: np.ndarray, offs: np.ndarray, h: np.ndarray, row: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of word grams, then of code point grams."""
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    pair = mix(h[1:] + h[:-1] * np.uint64(0x9E3779B97F4A7C15))
    pair[h[1:] == h[:-1]] = _REPEAT << np.uint64(20)
    joined = row[1:] == row[:-1]
    words = (np.concatenate([h, pair[joined]]) >> shift).astype(np.int32)
    rows = np.concatenate([row, row[1:][joined]])
    head = np.flatnonzero(_HEAD[buf])
    point = buf[head].astype(np.uint32)
    length = np.diff(np.append(head, len(buf)))
    for k in range(1, 4):  # the bytes of a code point after its first
        more = np.flatnonzero(length > k)
        point[more] |= buf[head[more] + k].astype(np.uint32) << np.uint32(8 * k)
    owner = np.searchsorted(offs, head, "right") - 1
    gram = ((point[:-2] * np.uint32(0x85EBCA6B) + point[1:-1]) * np.uint32(0xC2B2AE35) + point[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - (BUCKETS.bit_length() - 1))
    fits = owner[:-2] == owner[2:]
    return [(words, rows), (gram.astype(np.int32)[fits], owner[:-2][fits])]


@dataclass(frozen=True)
class Model:
    """Weights of word grams and of code point grams, and calibration."""

    weights: tuple[np.ndarray, np.ndarray]
    bias: float
    slope: float
    shift: float

    def probability(self, buf: np.ndarray, offs: np.ndarray, h: np.ndarray, row: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        margin = np.full(n, self.bias)
        for w, (bucket, owner) in zip(self.weights, gram_buckets(buf, offs, h, row), strict=True):
            margin += np.bincount(owner, w[bucket], n) / np.maximum(np.bincount(owner, minlength=n), 1)
        return sigmoid(self.slope * margin + self.shift)


def train(rows: list[tuple[list[tuple[np.ndarray, np.ndarray]], int]], epochs: int = 12, rate: float = 4.0, penalty: float = 1e-7) -> Model | None:
    """AdaGrad over single rows in a fixed random order. rows: per gram kind (buckets, frequencies), and the label."""
    labels = np.array([y for _, y in rows])
    if not len(labels) or not 0 < labels.mean() < 1:
        return None
    balance = {1: 0.5 / labels.mean(), 0: 0.5 / (1 - labels.mean())}
    fitted = [i for i in range(len(rows)) if i % CALIBRATE]
    w = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    g = [np.full(BUCKETS, 1e-4), np.full(BUCKETS, 1e-4)]
    bias, gb, rng = 0.0, 1.0, np.random.default_rng(5)
    for _ in range(epochs):
        for i in rng.permutation(fitted):
            grams, y = rows[i]
            off = (float(sigmoid(np.array(sum(float(wk[b] @ f) for wk, (b, f) in zip(w, grams, strict=True)) + bias))) - y) * balance[y]
            for wk, gk, (b, f) in zip(w, g, grams, strict=True):
                d = off * f + penalty * wk[b]
                gk[b] += d * d
                wk[b] -= rate * d / np.sqrt(gk[b])
            gb += off * off
            bias -= 0.1 * off / np.sqrt(gb)
    held = [i for i in range(len(rows)) if not i % CALIBRATE]
    margin = np.array([sum(float(wk[b] @ f) for wk, (b, f) in zip(w, rows[i][0], strict=True)) + bias for i in held])
    slope, shift = platt(margin, labels[held].astype(float))
    return Model((w[0].astype(np.float32), w[1].astype(np.float32)), bias, slope, shift)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fit on the driver; executors send the distinct grams of each sampled row, at most 2 * BUCKETS of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for lo, hi, buf, offs in text_chunks(batch, "text"):
                _, h, row = counts(buf, offs)
                columns: list[list] = [ids[lo:hi], marks[lo:hi]]
                for bucket, owner in gram_buckets(buf, offs, h, row):
                    order = np.argsort(owner, kind="stable")
                    bucket, cut = bucket[order], np.searchsorted(owner[order], np.arange(hi - lo + 1))
                    found = [np.unique(bucket[cut[i] : cut[i + 1]], return_counts=True) for i in range(hi - lo)]
                    columns += [[b.astype("<i4").tobytes() for b, _ in found], [(c / max(c.sum(), 1)).astype("<f4").tobytes() for _, c in found]]
                kinds = (pa.string(), pa.int32(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "label", "b0", "f0", "b1", "f1"])

    sample = labelled_sample(docs, labels, label_col, sample_rows, id_col, text_col).select(F.col("id").cast("string"), "text", "label")
    got = sorted(sample.mapInArrow(tidy(run), "id string, label int, b0 binary, f0 binary, b1 binary, f1 binary").collect())
    rows = [([(np.frombuffer(r["b0"], "<i4"), np.frombuffer(r["f0"], "<f4")), (np.frombuffer(r["b1"], "<i4"), np.frombuffer(r["f1"], "<f4"))], r["label"]) for r in got]
    return train(rows)


def judge(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """Identifier, the counts, base_failed, kept and the probability, for every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in text_chunks(batch, "text"):
                c, h, row = counts(buf, offs)
                failed = base_failed(c)
                p = model.probability(buf, offs, h, row) if model else np.ones(hi - lo)
                columns = [batch.column(0).slice(lo, hi - lo), *[pa.array(c[k]) for k in names], pa.array(failed), pa.array(~failed & (p >= keep_from)), pa.array(p)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", *names, "base_failed", "kept", "probability"])

    schema = f"id {kind}, {', '.join(f'{k} long' for k in names)}, base_failed boolean, kept boolean, probability double"
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)
