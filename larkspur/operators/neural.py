"""Neural rankers with hand-written gradients: a cross network trained on pairs, and a reranker that sees a whole shortlist.

They are fitted on the driver from a bounded sample of customers (``CUSTOMERS`` shortlists of ``SHORTLIST`` rows) and score in
Arrow batches on the executors, so only the sample has to fit in one place. Parameters are dictionaries of arrays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.folds import top_rank

CUSTOMERS, SHORTLIST = 4000, 100
Params = dict[str, np.ndarray]


# --------------------------------------------------------------------------- losses


def listnet(scores: np.ndarray, labels: np.ndarray, mask: np.ndarray) -> tuple[float, np.ndarray]:
    """Cross entropy of the labels' shares and the scores' softmax over each list's rows; (mean over lists with a positive, gradient).

    scores, labels, mask: (lists, rows). Masked rows and lists without a positive count for nothing.
    """
    target = np.where(mask, labels, 0.0)
    has = target.sum(1, keepdims=True) > 0
    target = np.divide(target, target.sum(1, keepdims=True), out=np.zeros_like(target), where=has)
    z = np.where(mask, scores, -np.inf)
    z = z - np.max(np.where(mask, scores, -1e300), axis=1, keepdims=True)
    e = np.where(mask, np.exp(np.where(mask, z, 0.0)), 0.0)
    total = e.sum(1, keepdims=True)
    p = np.divide(e, total, out=np.zeros_like(e), where=total > 0)
    n = max(1, int(has.sum()))
    loss = -(target * np.where(mask, np.log(np.maximum(p, 1e-300)), 0.0)).sum() / n
    return float(loss), np.where(has, p - target, 0.0) / n


def pair_loss(better: np.ndarray, worse: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean of -log sigmoid(better - worse), and its gradient by ``better``; by ``worse`` it is the negative."""
    d = better - worse
    return float(np.logaddexp(0.0, -d).mean()), -1.0 / (1.0 + np.exp(np.clip(d, -500, 500))) / len(d)


class Adam:
    """Adam with decoupled decay of the weights."""

    def __init__(self, params: Params, rate: float, decay: float = 0.0):
        self.rate, self.decay, self.step = rate, decay, 0
        self.mean = {k: np.zeros_like(v) for k, v in params.items()}
        self.square = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, params: Params, grads: Params) -> None:
        self.step += 1
        for k, g in grads.items():
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.001 * (g * g - self.square[k])
            m, v = self.mean[k] / (1 - 0.9**self.step), self.square[k] / (1 - 0.999**self.step)
            params[k] -= self.rate * (m / (np.sqrt(v) + 1e-8) + self.decay * params[k])


# --------------------------------------------------------------------------- networks


def cross_params(numeric: int, sizes: Sequence[int], rng: np.random.Generator, layers: int = 2, hidden: int = 32, width: int = 8) -> Params:
    """sizes: how many values each category has; the value 0 stands for unknown."""
    n = numeric + width * len(sizes)
    p = {f"table{i}": rng.normal(0, 0.05, (s, width)) for i, s in enumerate(sizes)}
    for i in range(layers):
        p[f"cross{i}"], p[f"shift{i}"] = rng.normal(0, 1 / np.sqrt(n), (n, n)), np.zeros(n)
    p["deep"], p["deep_shift"] = rng.normal(0, np.sqrt(2 / n), (n, hidden)), np.zeros(hidden)
    p["out"], p["out_shift"] = rng.normal(0, 1 / np.sqrt(n + hidden), n + hidden), np.zeros(1)
    return p


def cross_forward(p: Params, x: np.ndarray, categories: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Scores of rows and what the gradients need. Each cross layer is x0 * (x W + b) + x; a dense layer runs beside them."""
    tables = [p[f"table{i}"][categories[:, i]] for i in range(categories.shape[1])]
    first = np.concatenate([x, *tables], axis=1)
    steps, now = [], first
    for i in range(sum(k.startswith("cross") for k in p)):
        inner = now @ p[f"cross{i}"] + p[f"shift{i}"]
        steps.append((now, inner))
        now = first * inner + now
    deep = np.maximum(first @ p["deep"] + p["deep_shift"], 0.0)
    both = np.concatenate([now, deep], axis=1)
    return both @ p["out"] + p["out_shift"][0], (first, steps, deep, both)


def cross_backward(p: Params, kept: tuple, categories: np.ndarray, up: np.ndarray, numeric: int) -> Params:
    first, steps, deep, both = kept
    n = first.shape[1]
    g: Params = {"out": both.T @ up, "out_shift": np.array([up.sum()])}
    d_both = up[:, None] * p["out"]
    d_now, d_deep = d_both[:, :n], d_both[:, n:] * (deep > 0)
    g["deep"], g["deep_shift"] = first.T @ d_deep, d_deep.sum(0)
    d_first = d_deep @ p["deep"].T
    for i in reversed(range(len(steps))):
        now, inner = steps[i]
        d_inner = d_now * first
        g[f"cross{i}"], g[f"shift{i}"] = now.T @ d_inner, d_inner.sum(0)
        d_first = d_first + d_now * inner
        d_now = d_now + d_inner @ p[f"cross{i}"].T
    d_first = d_first + d_now
    for i in range(categories.shape[1]):
        table = g[f"table{i}"] = np.zeros_like(p[f"table{i}"])
        lo = numeric + i * table.shape[1]
        np.add.at(table, categories[:, i], d_first[:, lo : lo + table.shape[1]])
    return g


def list_params(numeric: int, rng: np.random.Generator, hidden: int = 32) -> Params:
    s = 1 / np.sqrt(hidden)
    p = {k: rng.normal(0, s, (hidden, hidden)) for k in ("ask", "key", "value", "mix")}
    return {**p, "in": rng.normal(0, np.sqrt(2 / numeric), (numeric, hidden)), "in_shift": np.zeros(hidden), "out": rng.normal(0, s, hidden)}


def list_forward(p: Params, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Scores of (lists, rows, features): a dense layer, attention of each row over its list, and their sum to one number."""
    h = np.maximum(x @ p["in"] + p["in_shift"], 0.0)
    q, k, v = h @ p["ask"], h @ p["key"], h @ p["value"]
    z = np.where(mask[:, None, :], q @ k.transpose(0, 2, 1) / np.sqrt(h.shape[2]), -1e30)
    a = np.exp(z - z.max(2, keepdims=True))
    a /= a.sum(2, keepdims=True)
    c = a @ v
    top = h + c @ p["mix"]
    return top @ p["out"], (h, q, k, v, a, c, top)


def list_backward(p: Params, kept: tuple, x: np.ndarray, up: np.ndarray) -> Params:
    h, q, k, v, a, c, top = kept
    over = lambda left, right: np.einsum("blf,blg->fg", left, right)
    d_top = up[..., None] * p["out"]
    g: Params = {"out": np.einsum("blh,bl->h", top, up), "mix": over(c, d_top)}
    d_c = d_top @ p["mix"].T
    d_a, d_v = d_c @ v.transpose(0, 2, 1), a.transpose(0, 2, 1) @ d_c
    d_z = a * (d_a - (d_a * a).sum(2, keepdims=True)) / np.sqrt(h.shape[2])
    d_q, d_k = d_z @ k, d_z.transpose(0, 2, 1) @ q
    g["ask"], g["key"], g["value"] = over(h, d_q), over(h, d_k), over(h, d_v)
    d_h = (d_top + d_q @ p["ask"].T + d_k @ p["key"].T + d_v @ p["value"].T) * (h > 0)
    g["in"], g["in_shift"] = over(x, d_h), d_h.sum((0, 1))
    return g


# --------------------------------------------------------------------------- lists of a sample


@dataclass
class Lists:
    """Shortlists padded to one length. x: (lists, rows, features); categories: (lists, rows, fields); labels, mask: (lists, rows)."""

    x: np.ndarray
    categories: np.ndarray
    labels: np.ndarray
    mask: np.ndarray

    def part(self, at: np.ndarray) -> Lists:
        return Lists(self.x[at], self.categories[at], self.labels[at], self.mask[at])


def mean_ap(scores: np.ndarray, lists: Lists, k: int = 12) -> float:
    """Mean average precision of the first k, over lists with a positive; ties by place."""
    z = np.where(lists.mask, scores, -np.inf)
    order = np.argsort(-z, axis=1, kind="stable")[:, :k]
    hit = np.take_along_axis(np.where(lists.mask, lists.labels, 0.0), order, 1) > 0
    precision = np.cumsum(hit, axis=1) / np.arange(1, hit.shape[1] + 1)
    relevant = np.minimum((np.where(lists.mask, lists.labels, 0.0) > 0).sum(1), k)
    own = (precision * hit).sum(1)[relevant > 0] / relevant[relevant > 0]
    return float(own.mean()) if len(own) else 0.0


def _cell(name: str) -> Column:
    """A number in which null and NaN are told from 0 only where the column is a rank, as in the other rankers."""
    return F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(None)), F.lit(-1.0 if name.startswith("rank") else 0.0))


def _shortlists(features: DataFrame, columns: Sequence[str], categories: Sequence[str], first: Column, size: int, extra: Sequence[Column] = ()) -> DataFrame:
    """A row per customer: its best ``size`` pairs by ``first``, in that order."""
    near = top_rank(features.withColumn("_first", F.round(first, 9)), ["customer_id"], [F.col("_first").desc(), "article_id"], size, "_place")
    value = F.array(*[_cell(c) for c in columns])
    kind = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in categories]).cast("array<string>")
    row = F.struct("_place", "article_id", value.alias("x"), kind.alias("c"), *extra)
    return near.groupBy("customer_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))


@dataclass
class NeuralRanker:
    """kind: "cross" or "list". A customer's pairs beyond the shortlist stay behind it, in the order of ``first``."""

    kind: str
    columns: tuple[str, ...]
    categories: tuple[str, ...]
    first: Column | None
    size: int = SHORTLIST
    params: Params = field(default_factory=dict)
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    values: list[dict[str, int]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    epochs: int = 0

    def _forward(self, lists: Lists) -> tuple[np.ndarray, tuple]:
        if self.kind == "list":
            return list_forward(self.params, lists.x, lists.mask)
        scores, kept = cross_forward(self.params, lists.x.reshape(-1, lists.x.shape[2]), lists.categories.reshape(-1, lists.categories.shape[2]))
        return scores.reshape(lists.mask.shape), kept

    def predict(self, lists: Lists) -> np.ndarray:
        return self._forward(lists)[0]

    def lists(self, rows: Sequence[Sequence[dict]]) -> Lists:
        """Padded arrays of shortlists, scaled as in training."""
        n, m = len(rows), max((len(r) for r in rows), default=0)
        x, c = np.zeros((n, m, len(self.columns))), np.zeros((n, m, len(self.categories)), np.int64)
        y, mask = np.zeros((n, m)), np.zeros((n, m), bool)
        for i, r in enumerate(rows):
            mask[i, : len(r)] = True
            for j, cell in enumerate(r):
                x[i, j] = cell["x"]
                c[i, j] = [known.get(v, 0) for known, v in zip(self.values, cell["c"], strict=True)]
                y[i, j] = cell.get("label") or 0
        if self.centre is None:
            inside = x[mask]
            self.centre = inside.mean(0)
            deviation = inside.std(0)
            self.spread = np.where(deviation < 1e-6, 1.0, deviation)
        return Lists(np.where(mask[..., None], np.clip((x - self.centre) / self.spread, -10, 10), 0.0), c, y, mask)

    def train(self, lists: Lists, held: Lists | None = None, epochs: int = 30, batch: int = 64, rate: float = 1e-3, decay: float = 1e-4, patience: int = 6, per_positive: int = 20, hard: float = 0.5, seed: int = 7) -> NeuralRanker:
        """With ``held`` the epoch of its best mean average precision stays, and ``patience`` epochs without a better one end training;
        without it all ``epochs`` are run. Pairs set each positive against ``per_positive`` of its list's other rows, the share ``hard`` of them
        from the rows that the model now ranks highest, the rest from anywhere in the list."""
        rng = np.random.default_rng(seed)
        numeric = len(self.columns)
        self.params = list_params(numeric, rng) if self.kind == "list" else cross_params(numeric, [len(v) + 1 for v in self.values], rng)
        step = Adam(self.params, rate, decay)
        best, kept_params, self.losses, self.epochs = -1.0, None, [], epochs
        for epoch in range(epochs):
            total, order = 0.0, rng.permutation(len(lists.mask))
            parts = np.array_split(order, max(1, -(-len(order) // batch)))
            for at in parts:
                total += self._step(lists.part(at), step, per_positive, hard, rng)
            self.losses.append(total / len(parts))
            if held is None:
                continue
            now = mean_ap(self.predict(held), held)
            if now > best:
                best, kept_params, self.epochs = now, {k: v.copy() for k, v in self.params.items()}, epoch + 1
            elif epoch + 1 - self.epochs >= patience:
                break
        self.params = kept_params or self.params
        return self

    def _step(self, part: Lists, step: Adam, per_positive: int, hard: float, rng: np.random.Generator) -> float:
        scores, kept = self._forward(part)
        if self.kind == "list":
            loss, up = listnet(scores, part.labels, part.mask)
            step.update(self.params, list_backward(self.params, kept, part.x, up))
            return loss
        better, worse = _pairs(scores, part, per_positive, hard, rng)
        if not len(better):
            return 0.0
        flat = scores.ravel()
        loss, g = pair_loss(flat[better], flat[worse])
        up = np.bincount(better, g, len(flat)) - np.bincount(worse, g, len(flat))
        step.update(self.params, cross_backward(self.params, kept, part.categories.reshape(-1, part.categories.shape[2]), up, part.x.shape[2]))
        return loss

    def score(self, features: DataFrame) -> DataFrame:
        """``features`` with ranker_score: the network's on the shortlist, and lower than any of them behind it."""
        model = replace(self, first=None)  # a column can't be sent to the executors
        lists = _shortlists(features, self.columns, self.categories, self.first, self.size)
        kind = {c: features.schema[c].dataType.simpleString() for c in ("customer_id", "article_id")}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, len(batch), 256):
                    part = batch.slice(lo, 256)
                    rows = part.column(1).to_pylist()
                    scores = model.predict(model.lists(rows))
                    n = [len(r) for r in rows]
                    who = part.column(0).take(pa.array(np.repeat(np.arange(len(rows)), n)))
                    what = pa.array([cell["article_id"] for r in rows for cell in r], part.schema.field(1).type.value_type.field("article_id").type)
                    yield pa.RecordBatch.from_arrays([who, what, pa.array(np.concatenate([s[:m] for s, m in zip(scores, n, strict=True)]))], names=["customer_id", "article_id", "_net"])

        got = lists.mapInArrow(run, f"customer_id {kind['customer_id']}, article_id {kind['article_id']}, _net double")
        behind = F.lit(-1e6) + F.tanh(self.first.cast("double"))
        return features.join(got, ["customer_id", "article_id"], "left").withColumn("ranker_score", F.coalesce("_net", behind)).drop("_net")


def _pairs(scores: np.ndarray, part: Lists, per_positive: int, hard: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Places, in the flattened lists, of positives and of the negatives set against them."""
    better, worse, m = [], [], scores.shape[1]
    for i in range(len(scores)):
        up, down = np.flatnonzero(part.mask[i] & (part.labels[i] > 0)), np.flatnonzero(part.mask[i] & (part.labels[i] <= 0))
        if not len(up) or not len(down):
            continue
        top = down[np.argsort(-scores[i, down], kind="stable")[: max(1, 3 * int(per_positive * hard))]]
        n = min(per_positive, len(down))
        n_hard = min(int(round(n * hard)), len(top))
        for u in up:
            drawn = np.concatenate([rng.choice(top, n_hard, replace=False), rng.choice(down, n - n_hard)])
            better.append(np.full(n, i * m + u))
            worse.append(i * m + drawn)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(better), np.concatenate(worse)) if better else (empty, empty)


def fit_neural(train: DataFrame, columns: Sequence[str], kind: str, first: Column | None = None, categories: Sequence[str] = (), size: int = SHORTLIST, customers: int = CUSTOMERS, held_share: float = 0.2, epochs: int = 30, patience: int = 6, fixed: bool = False, **options) -> NeuralRanker:
    """Fitted on at most ``customers`` customers with a positive in their shortlist, drawn by a hash of the identifier.

    A ``held_share`` of them tells when to stop; ``fixed`` trains on all of them for all ``epochs``, to refit for epochs chosen before.
    first: the order of the shortlist, the number of sources by default.
    """
    if kind not in ("cross", "list"):
        raise ValueError(f"unknown network {kind}")
    first = F.col("num_sources").cast("double") if first is None else first
    lists = _shortlists(train, columns, categories, first, size, [F.col("label").cast("double").alias("label")])
    drawn = lists.filter(F.exists("rows", lambda r: r["label"] > 0)).orderBy(F.xxhash64("customer_id"), "customer_id").limit(customers)
    rows = [[cell.asDict() for cell in r["rows"]] for r in drawn.select("rows").collect()]
    if not rows:
        raise ValueError("no customer has a positive in its shortlist")
    model = NeuralRanker(kind, tuple(columns), tuple(categories), first, size)
    model.values = [{v: i + 1 for i, v in enumerate(sorted({cell["c"][f] for r in rows for cell in r}))} for f in range(len(categories))]
    all_ = model.lists(rows)
    cut = 0 if fixed else int(len(rows) * held_share)
    at = np.arange(len(rows))
    return model.train(all_.part(at[cut:]), all_.part(at[:cut]) if cut else None, epochs=epochs, patience=patience, **options)


def memorises(kind: str, lists: Lists, columns: Sequence[str], values: Sequence[dict[str, int]] = (), epochs: int = 200, rate: float = 0.01) -> tuple[float, float]:
    """(first loss, last loss) of a network trained on a few lists alone; one that can learn ends far below where it began."""
    model = NeuralRanker(kind, tuple(columns), tuple(f"c{i}" for i in range(len(values))), first=None, values=list(values))
    model.train(lists, None, epochs=epochs, rate=rate, decay=0.0)
    return model.losses[0], model.losses[-1]

