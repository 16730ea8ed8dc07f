"""Connected components of an edge list, by rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import HOT_ROWS, hot_join, hot_keys, materialize


EDGES_A_TASK = 250_000


class Forest:
    """Union-find over ids; the root of a tree is its smallest id."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def edges(self) -> pa.RecordBatch:
        """(node, root) for all nodes but roots."""
        nodes = list(self.parent)
        pairs = [(x, r) for x in nodes if (r := self.find(x)) != x]
        flat = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["a", "b"])


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a partition's edges connect, as one edge for each node: to the smallest id it reaches there."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            forest.join(a, b)
    yield forest.edges()


def contracting(step):
    """A mapInArrow function whose edges are contracted in the same worker, so a task needs no second one."""
    return lambda batches: contract(step(batches))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, label): for each node of an edge, the smallest id that it reaches.
    Whatever makes the edges should contract() those of a partition.

    A round takes the smallest label of the neighbours, then the label's own label, so labels
    move along chains at doubling speed. Rounds end when no label changes. The root of a large
    component is the neighbour, and the label, of all its nodes, so both joins treat it as hot.
    """
    edges = materialize(edges.where("a <> b"), "edges")
    # these tables are small beside the documents: as many tasks as their rows take, not as the session's shuffles have
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, edges.count() // EDGES_A_TASK)
    # a node's edges of all partitions meet, so what is left is about one a node, however often a large group's nodes met
    edges = edges.repartition(tasks, "a").mapInArrow(contract, "a long, b long")
    both = edges.union(edges.select("b", "a")).distinct()
    both = materialize(both.coalesce(tasks), "edges-both")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")).coalesce(tasks), "labels")
    hot_neighbours, many = hot_keys(both, "b"), labels.count() > HOT_ROWS
    while True:
        near = hot_join(both, labels.withColumnRenamed("node", "b"), "b", hot_neighbours).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("lowest"))
        lower = materialize(lower.coalesce(tasks), "labels-lower") if many else lower
        jumped = hot_join(lower, up, "low", hot_keys(lower, "low") if many else None).select("node", F.least("low", "lowest").alias("label"), "was")
        after = materialize(jumped.coalesce(tasks), "labels")
        if after.where("label <> was").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
