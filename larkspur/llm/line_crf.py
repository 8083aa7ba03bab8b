"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is labelled good or bad. A line's features are shares of symbols, pipes, exclamation
marks, capitals and digits, how many of its words repeat the word before, whether it repeats a line next to it,
its length, and the same of the lines before and after it. Weights and transitions are fitted to the conditional
likelihood of the lines of at most ``sample_rows`` labelled documents outside the held-out fold (lines carry their
document's label; of a sampled document at most ``sample_lines`` lines, evenly spaced, take part in fitting).
A document's quality is the mean of the forward-backward marginals of "good", weighted by line length, and
calibrated on the same sample. Scoring reads whole texts and all lines, in Arrow batches, without a shuffle.

Defined results: a text without words (null, empty, white space) scores the sample's share of good rows; rows
that share an identifier are scored each on its own; unless rows of both labels, with words, are in the sample
nothing can be learned and every text, also one without words, scores 0.5; empty tables give empty tables; labels, language, source and identifier are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import text_chunks, tidy, word_hashes, word_spans
from larkspur.llm.labelled import fold_of, labelled_sample, logit, platt, sigmoid

SAMPLE_ROWS = 4000
SAMPLE_LINES = 200
THRESHOLD = 0.3
_OWN = 9

_CLASSES = []
for _chars in (b"#*$%&<>", b"|", b"!", bytes(range(65, 91)), bytes(range(48, 58))):
    _t = np.zeros(256, np.uint8)
    _t[list(_chars)] = 1
    _CLASSES.append(_t)


def line_features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, row and byte length of every line that has a word."""
    starts, ends, row = word_spans(buf, offs)
    if len(starts) == 0:
        return np.zeros((0, 3 * _OWN)), np.zeros(0, np.int64), np.zeros(0)
    breaks = np.flatnonzero(buf == 10)
    bounds = np.union1d(offs[:-1], breaks + 1)  # where lines begin
    line_of_word = np.searchsorted(bounds, starts, "right") - 1
    first = np.flatnonzero(np.diff(line_of_word, prepend=-1))
    last = np.append(first[1:], len(starts)) - 1
    a, b, doc = starts[first], ends[last], row[first]
    words = (last - first + 1).astype(float)
    length = (b - a).astype(float)
    h = word_hashes(buf, starts, ends, lower=True)
    same = np.zeros(len(h) + 1)
    np.cumsum((h[1:] == h[:-1]) & (line_of_word[1:] == line_of_word[:-1]), out=same[2:])
    counts = []
    for table in _CLASSES:
        acc = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(table[buf], out=acc[1:], dtype=np.int32)
        counts.append((acc[b] - acc[a]).astype(float))
    whole = word_hashes(buf, a, b, lower=False)
    joined = doc[1:] == doc[:-1]
    again = np.zeros(len(a))
    again[1:] += (whole[1:] == whole[:-1]) & joined
    again[:-1] += (whole[1:] == whole[:-1]) & joined
    own = np.column_stack([
        np.minimum(counts[0] / words, 3), np.minimum(counts[1] / words, 1), np.minimum(counts[2] / words, 3), counts[3] / length, counts[4] / length,
        (same[last + 1] - same[first + 1]) / words, np.minimum(again, 1), np.log1p(words) / 5, (words < 3).astype(float),
    ])
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:][joined] = own[:-1][joined]
    after[:-1][joined] = own[1:][joined]
    return np.hstack([own, before, after]), doc, length


def marginals(score: np.ndarray, doc: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over the chains that ``doc`` marks off: P(good) of each line, expected transitions, log-partition.

    score: per line and label. Chains are stepped together, longest first, so each step is one array operation.
    """
    n = len(score)
    start = np.flatnonzero(np.diff(doc, prepend=doc[0] - 1))
    size = np.diff(np.append(start, n))
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    alpha, beta = np.empty((n, 2)), np.zeros((n, 2))
    alive = [len(start)]
    alpha[start] = score[start]
    for t in range(1, int(size[0])):
        k = int(np.searchsorted(-size, -t, "left"))  # chains with more than t lines
        at = start[:k] + t
        prev = alpha[at - 1]
        alpha[at] = score[at] + np.logaddexp(prev[:, :1] + trans[0], prev[:, 1:] + trans[1])
        alive.append(k)
    expected = np.zeros((2, 2))
    final = alpha[start + size - 1]
    z = np.logaddexp(final[:, 0], final[:, 1])
    for t in range(int(size[0]) - 1, 0, -1):
        k = alive[t]
        at = start[:k] + t
        ahead = score[at] + beta[at]
        beta[at - 1] = np.logaddexp(trans[:, 0] + ahead[:, :1], trans[:, 1] + ahead[:, 1:])
        pair = np.exp(alpha[at - 1][:, :, None] + trans + ahead[:, None, :] - z[:k, None, None])
        expected += pair.sum(0)
    both = alpha + beta
    return sigmoid(both[:, 1] - both[:, 0]), expected, float(z.sum())


def by_length(good: np.ndarray, doc: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Length-weighted mean per row; NaN for rows without lines."""
    total = np.bincount(doc, length, n)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.bincount(doc, good * length, n) / total


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    slope: float
    shift: float
    prior: float

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        features, doc, length = line_features(buf, offs)
        out = np.full(n, self.prior)
        if len(doc):
            margin = ((features - self.mean) / self.scale) @ self.weights + self.bias
            good, _, _ = marginals(np.column_stack([np.zeros(len(margin)), margin]), doc, self.trans)
            raw = by_length(good, doc, length, n)
            found = ~np.isnan(raw)
            out[found] = sigmoid(self.slope * logit(raw[found]) + self.shift)
        return out


NEUTRAL = Model(np.zeros(3 * _OWN), np.ones(3 * _OWN), np.zeros(3 * _OWN), 0.0, np.zeros((2, 2)), 1.0, 0.0, 0.5)


def train(features: np.ndarray, doc: np.ndarray, length: np.ndarray, labels: np.ndarray, steps: int = 200, penalty: float = 0.02) -> Model:
    """Adam on the penalised conditional likelihood. doc: ascending row numbers into ``labels``."""
    prior = float(labels.mean()) if len(labels) else 0.5
    if not len(doc) or not 0 < prior < 1:
        return NEUTRAL
    mean, scale = features.mean(0), features.std(0) + 1e-3
    x = (features - mean) / scale
    y = labels[doc].astype(float)
    stay = doc[1:] == doc[:-1]
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = (stay & (y[1:] == label)).sum()
    theta = np.zeros(x.shape[1] + 5)
    m, v, n = np.zeros_like(theta), np.zeros_like(theta), len(y)
    for t in range(1, steps + 1):
        trans = theta[-4:].reshape(2, 2)
        margin = x @ theta[:-5] + theta[-5]
        good, expected, _ = marginals(np.column_stack([np.zeros(n), margin]), doc, trans)
        off = good - y
        grad = np.concatenate([x.T @ off, [off.sum()], (expected - seen).ravel()]) / n + penalty * np.append(theta[:-5], [0, *theta[-4:]])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    trans = theta[-4:].reshape(2, 2)
    good, _, _ = marginals(np.column_stack([np.zeros(n), x @ theta[:-5] + theta[-5]]), doc, trans)
    raw = by_length(good, doc, length, len(labels))
    found = ~np.isnan(raw)
    slope, shift = platt(logit(raw[found]), labels[found].astype(float))
    return Model(mean, scale, theta[:-5], float(theta[-5]), trans, slope, shift, prior)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_lines: int = SAMPLE_LINES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the driver; executors send line features of the sampled rows, at most sample_rows * sample_lines lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for lo, hi, buf, offs in text_chunks(batch, "text"):
                features, doc, length = line_features(buf, offs)
                ends = np.searchsorted(doc, np.arange(hi - lo + 1))
                out = []
                for i in range(hi - lo):
                    a, b = int(ends[i]), int(ends[i + 1])
                    pick = np.arange(a, b) if b - a <= sample_lines else np.linspace(a, b - 1, sample_lines).astype(int)
                    out.append((ids[lo + i], marks[lo + i], features[pick].astype("<f4").tobytes(), length[pick].astype("<f4").tobytes()))
                names = ["id", "label", "features", "lengths"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=names)

    sample = labelled_sample(docs, labels, label_col, sample_rows, id_col, text_col).select(F.col("id").cast("string"), "text", "label")
    rows = sorted(sample.mapInArrow(tidy(run), "id string, label int, features binary, lengths binary").collect())
    width = 3 * _OWN
    parts = [np.frombuffer(r["features"], "<f4").reshape(-1, width).astype(float) for r in rows]
    if not parts:
        return NEUTRAL
    doc = np.repeat(np.arange(len(rows)), [len(p) for p in parts])
    lengths = np.concatenate([np.frombuffer(r["lengths"], "<f4") for r in rows]).astype(float)
    return train(np.vstack(parts), doc, lengths, np.array([r["label"] for r in rows]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """identifier, held_out, score, predicted for every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in text_chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(model.score(buf, offs))], names=["id", "score"])

    scored = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(tidy(run), f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), (fold_of(F.col("id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score ``threshold`` or more, all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in text_chunks(batch, text_col):
                yield batch.slice(lo, hi - lo).filter(pa.array(model.score(buf, offs) >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
