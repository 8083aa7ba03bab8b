"""Connected components of a graph of any size, by minimum labels and pointer jumping.

Edges are first turned into stars inside each partition, then, dealt to as few partitions as ``TOGETHER`` edges
each allow, once more: what is left is an edge or a few for each node, however many a dense group had. Each round
then gives a node the least label among itself and its neighbours and replaces that label by its own label, so
distances halve; the rounds are written to the shared folder. A hub's edges are summed with partial aggregation,
and its joins can be split by Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import partitions, stage, tidy

TOGETHER = 400_000


class Forest:
    """Union-find whose roots are the least members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while x != root:
            up[x], x = root, up.get(x, root)
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        a, b = min(a, b), max(a, b)
        self.up[b] = a
        return True


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges to stars: each node with the least node that this task's edges lead it to. A million nodes at a time."""
    forest = Forest()

    def stars() -> Iterator[pa.RecordBatch]:
        found = [(forest.find(x), x) for x in list(forest.up)]
        for k in range(0, len(found), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found[k : k + 100_000], strict=True)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        if len(forest.up) > 1_000_000:
            yield from stars()
            forest = Forest()
    yield from stars()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the edges (a, b); the root is the least node. Staged."""
    thin = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(tidy(_thin), "a long, b long")
    thin = stage(thin.filter("a <> b"), "edges")
    few = math.ceil(thin.count() / TOGETHER)
    if few <= partitions(edges.sparkSession):
        thin = stage(thin.repartition(max(1, few)).mapInArrow(tidy(_thin), "a long, b long"), "edges")
    both = thin.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionAll(thin.select("b", "a"))
    label = stage(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("src"), F.min("dst")).alias("root")), "labels")
    for _ in range(most_rounds):
        near = both.join(label, both.dst == label.node).groupBy("src").agg(F.min("root").alias("near"))
        step = stage(label.join(near, label.node == near.src).select("node", F.col("root").alias("was"), F.least("root", "near").alias("low")), "labels")
        up = step.select(F.col("node").alias("at"), F.col("low").alias("lower"))
        new = stage(step.join(up, step.low == up.at).select("node", "was", F.least("low", "lower").alias("root")), "labels")
        label = new.select("node", "root")
        if new.filter("root <> was").isEmpty():
            return label
    raise RuntimeError(f"components have not settled in {most_rounds} rounds")
