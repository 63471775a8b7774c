"""Exact top-k search by inner product with a KD-tree per shard.

Rows are dealt to shards by hash. A shard's task builds a KD-tree (median
splits, points in the order of the leaves, a tight box and a ball around each)
and streams the queries through it in batches, best-first: each query visits
leaves by the largest inner product that box and ball allow, until no leaf can
beat its k-th score. The queries of a batch that visit one leaf are scored
there by one matrix product. Each query searches a home shard first; its k-th
score there is carried to the other shards, where it prunes from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

LEAF = 256
#: Vectors of one shard's tree: 64 dimensions make 33 MB, and up to as much again as floats.
SHARD_ROWS = 65_536
MIN_SHARDS = 8
QUERY_BATCH = 512
#: Scores of a batch that are held until the best of them are chosen.
HELD_SCORES = 1 << 17
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def norms(points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(points.astype(np.float64)).sum(axis=1))


class KDTree:
    def __init__(self, ids: np.ndarray, points: np.ndarray):
        leaves = self._leaves(points)
        order = np.concatenate(leaves)
        self.ids, self.points = ids[order], points[order]
        self.edges = np.cumsum([0, *map(len, leaves)])
        parts = np.split(self.points.astype(np.float64), self.edges[1:-1])
        self.low, self.high = np.array([p.min(axis=0) for p in parts]), np.array([p.max(axis=0) for p in parts])
        self.middle = np.array([p.mean(axis=0) for p in parts])
        self.radius = np.array([norms(p - m).max() for p, m in zip(parts, self.middle, strict=True)])
        self.longest = norms(points).max()
        self.typed = {np.int64: self.points}

    @staticmethod
    def _leaves(points: np.ndarray) -> list[np.ndarray]:
        """The rows of each leaf; where all points are equal, any cut is as good."""
        leaves, nodes = [], [np.arange(len(points))]
        while nodes:
            rows = nodes.pop()
            part = points[rows]
            low, high = part.min(axis=0), part.max(axis=0)
            if len(rows) > LEAF and (high > low).any():
                axis = int((high.astype(np.float64) - low).argmax())
                order = np.argpartition(part[:, axis], len(rows) // 2)
                nodes += [rows[order[len(rows) // 2 :]], rows[order[: len(rows) // 2]]]
            else:
                leaves += [rows[i : i + LEAF] for i in range(0, len(rows), LEAF)]
        return leaves

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product of each query with a point in each leaf (rounded up)."""
        q, length = queries.astype(np.float64), norms(queries)
        box = np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
        ball = q @ self.middle.T + np.outer(length, self.radius)
        return np.minimum(box, ball) + 1 + length[:, None] * self.longest * 1e-9

    def exact(self, queries: np.ndarray) -> type:
        """The fastest type in which the inner products, and all sums on the way to them, are exact."""
        most = norms(queries).max() * self.longest
        kind = np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64
        if kind not in self.typed:
            self.typed[kind] = self.points.astype(kind)
        return kind

    def top(self, own: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query (its place), vec_id and score of each query's k best that reach its `floor`; ties to the smaller id."""
        bounds, kind = self.bounds(queries), self.exact(queries)
        visits = np.argsort(-bounds, axis=1)
        points, q = self.typed[kind], queries.astype(kind)
        # The score and id of the k-th best so far; the floor before there are k.
        least, last = floor.copy(), np.full(len(q), HIGHEST)
        found, held = [(np.zeros(0, np.int64),) * 3], 0

        def choose() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            who, vec_id, score = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((vec_id, ~score, who))
            many = np.bincount(who, minlength=len(q))
            rank = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
            who, vec_id, score, rank = who[order][rank < k], vec_id[order][rank < k], score[order][rank < k], rank[rank < k]
            full = rank == k - 1
            least[who[full]], last[who[full]] = score[full], vec_id[full]
            return [(who, vec_id, score)]

        going, at, step = np.arange(len(q)), 0, 1
        while len(going):
            leaves = visits[going, at : at + step]
            row, column = np.nonzero(bounds[going[:, None], leaves] >= least[going, None])
            who, leaves = going[row], leaves[row, column]
            by_leaf = np.argsort(leaves, kind="stable")
            for some in np.split(by_leaf, np.flatnonzero(np.diff(leaves[by_leaf])) + 1):
                start, end = self.edges[leaves[some[0]]], self.edges[leaves[some[0]] + 1]
                asks = who[some]
                scores = q[asks] @ points[start:end].T
                i, j = np.nonzero(scores >= least[asks].astype(kind)[:, None])
                asks, vec_id, score = asks[i], self.ids[start + j], scores[i, j].astype(np.int64)
                good = (vec_id != own[asks]) & ((score > least[asks]) | (score == least[asks]) & (vec_id <= last[asks]))
                found.append((asks[good], vec_id[good], score[good]))
                held += int(good.sum())
                if held > HELD_SCORES:
                    found, held = choose(), 0
            found, held = choose(), 0
            at, step = at + step, step * 2
            going = going[bounds[going, visits[going, at]] >= least[going]] if at < visits.shape[1] else going[:0]
        return found[0]


def integers(embedding: Column, scale: int) -> Column:
    return F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def _search(rows: DataFrame, k: int) -> DataFrame:
    """q, query_id, vec_id, score of the best in each shard. rows: shard, dim, is_query, q, vec_id, v, floor; q names a query. Data rows of a shard come first."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, ids, points = None, None, [], []
        for batch in batches:
            shards, dims, kinds, names, vec_ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "dim", "is_query", "q", "vec_id"))
            floors = batch.column("floor").fill_null(LOWEST).to_numpy(zero_copy_only=False)
            offsets = batch.column("v").offsets.to_numpy()
            flat = batch.column("v").values.to_numpy(zero_copy_only=False)
            out = [(np.zeros(0, np.int64),) * 4]
            edges = np.flatnonzero((np.diff(shards) != 0) | (np.diff(dims) != 0) | (kinds[1:] != kinds[:-1])) + 1
            for first, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if first == end:
                    continue
                if key != (shards[first], dims[first]):
                    key, tree, ids, points = (shards[first], dims[first]), None, [], []
                block = flat[offsets[first] : offsets[end]].reshape(end - first, dims[first])
                if not kinds[first]:
                    ids.append(vec_ids[first:end])
                    points.append(block)
                    continue
                if ids:
                    tree, ids, points = KDTree(np.concatenate(ids), np.concatenate(points)), [], []
                if tree:
                    for a in range(first, end, QUERY_BATCH):
                        z = min(a + QUERY_BATCH, end)
                        who, vec_id, score = tree.top(vec_ids[a:z], block[a - first : z - first], k, floors[a:z])
                        out.append((names[a:z][who], vec_ids[a:z][who], vec_id, score))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["q", "query_id", "vec_id", "score"])

    shards = max(MIN_SHARDS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(shards, "shard", "dim").sortWithinPartitions("shard", "dim", "is_query", "vec_id")
    return dealt.select("shard", "dim", "is_query", "q", "vec_id", "v", "floor").mapInArrow(search, "q long, query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query.

    Components count as floor(scale * x). Queries are the rows for which
    is_query holds; candidates are all rows but those with the query's vec_id.
    Rows with a null vec_id or vector, or a null or non-finite component, take
    no part. Vectors of different lengths are not compared. Every row counts,
    also where it repeats another: a candidate that is there twice takes two
    ranks, and each of the rows that ask under one vec_id has ranks of its
    own, so that a query_id has them twice. With fewer than k candidates all are returned; empty input: no
    rows. Scores must fit a long.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    # A row's number stands once it is written.
    rows = cut(rows.withColumns({"dim": F.size("v"), "q": F.monotonically_increasing_id()}), "vectors")
    n = max(MIN_SHARDS, -(-rows.count() // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("vec_id", "q"), F.lit(n)).cast("int")
    data = rows.select(shard.alias("shard"), "dim", F.lit(False).alias("is_query"), "q", "vec_id", "v", F.lit(None).cast("long").alias("floor"))
    asked = rows.filter("asks")
    home = asked.select(shard.alias("shard"), "dim", F.lit(True).alias("is_query"), "q", "vec_id", "v", F.lit(None).cast("long").alias("floor"))
    first = cut(_search(data.unionByName(home), k), "nearest")
    floor = first.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    away = asked.join(floor, "q", "left").withColumn("home", shard)
    away = away.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).filter(F.col("shard") != F.col("home"))
    rest = _search(data.unionByName(away.select("shard", "dim", F.lit(True).alias("is_query"), "q", "vec_id", "v", "floor")), k)
    return _ranked(first.unionByName(rest), k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS q, vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.q, q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
