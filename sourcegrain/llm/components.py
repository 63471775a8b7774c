"""Connected components of a graph held as a DataFrame of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


class UnionFind:
    """Sets of 0 .. n - 1; a set's root is its smallest member."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node that isn't the smallest of its component, and that smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    sets = UnionFind(len(nodes))
    for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        sets.union(i, j)
    root = np.array([sets.find(i) for i in range(len(nodes))], np.int64)
    low = root != np.arange(len(nodes))
    return nodes[low], nodes[root[low]]


#: Edges that one task joins at once: 32 MB of node pairs.
ONE_TASK = 2_000_000
_PAIR = "a long, b long"


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as a forest: every node once, with the smallest of its component."""
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if parts:
        a, b = forest(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of the component) for every node of edges (a, b).

    Every task first contracts its edges to a forest. If all forests together
    hold no more than ONE_TASK edges, one more task joins them. Otherwise large
    stars and small stars alternate until the edges no longer change; each
    round is written to the shared folder. There, groups are only aggregated
    and joined, so a node of any degree is split by the skew join.
    """
    edges = cut(edges.filter(F.col("a") != F.col("b")).select("a", "b").mapInArrow(_contract, _PAIR), "edges")
    if edges.count() <= ONE_TASK:
        edges = cut(edges.repartition(1).mapInArrow(_contract, _PAIR), "edges")
    else:
        edges = star_rounds(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def star_rounds(edges: DataFrame) -> DataFrame:
    """Edges from every node to the smallest of its component, by alternating stars."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = cut(edges, "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter(F.col("a") != F.col("b"))
        edges = cut(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "edges")
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    return edges
