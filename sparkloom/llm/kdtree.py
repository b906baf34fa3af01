"""Exact top-k by inner product with a KD-tree per shard.

A tree turns its points to their principal axes, where boxes are tightest, and splits them at the median of the widest side of
their tight bounding box. No point of a box scores more than sum(max(q * low, q * high)); children get their bounds when their parent is
opened, boxes are taken best first, and the search ends at the first bound below the kth score so far. Scores are always those of the original
integers; turning only serves the bounds, which have room for its rounding.

A block of queries first visits one shard; the kth score found there is a lower bound on the answer's and
goes with the query to all other shards, where it cuts the search from the start; there it rises from shard to shard.

What the boxes save depends on the data: see ``share_scored``. Vectors of 64 dimensions without structure can't be told apart by
any box, and nearly all points are scored.
"""

from __future__ import annotations

import heapq
import sys

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import at_most, best, build_shards, lengths_of, put_queries, query_rows, search, top_of, usable

LEAF = 128
SHARD_ROWS = 16_384
SCALE = 256
#: Doubles hold integers below this exactly.
EXACT = 2.0**53
_LONG = np.iinfo(np.int64)


def principal_axes(points: np.ndarray) -> np.ndarray:
    """An orthogonal matrix whose columns are the points' principal axes, widest first."""
    largest = np.abs(points).max(initial=0)
    if len(points) < 2 or not largest:
        return np.eye(points.shape[1])
    return np.linalg.eigh(np.cov((points / largest).T).reshape(points.shape[1], -1))[1][:, ::-1]


def build_tree(ids: np.ndarray, points: np.ndarray) -> dict[str, np.ndarray]:
    """Points in leaf order; for each node its box, its first child (0: a leaf; the second one follows) and its range of points."""
    axes = principal_axes(points)
    with np.errstate(over="ignore", invalid="ignore"):
        turned = points @ axes
    order, low, high, child, first, last = np.arange(len(ids)), [], [], [], [], []

    def node(a: int, b: int) -> int:
        own = turned[order[a:b]]
        low.append(own.min(0) if b > a else np.zeros(points.shape[1]))
        high.append(own.max(0) if b > a else np.zeros(points.shape[1]))
        child.append(0), first.append(a), last.append(b)
        return len(low) - 1

    todo = [node(0, len(ids))]
    while todo:
        k = todo.pop()
        a, b, wide = first[k], last[k], high[k] - low[k]
        if b - a > LEAF and (wide > 0).any():  # equal points stay one leaf
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(turned[order[a:b], int(wide.argmax())], mid)]
            child[k] = node(a, a + mid)
            todo += [child[k], node(a + mid, b)]
    return {"ids": ids[order], "points": points[order], "axes": axes, "low": np.array(low), "high": np.array(high), "child": np.array(child), "first": np.array(first), "last": np.array(last)}


class Tree:
    """Best-first search of one shard; ``scored`` counts the points that had to be scored."""

    def __init__(self, arrays: dict[str, np.ndarray], k: int):
        self.__dict__.update(arrays)
        self.k, self.scored = k, 0
        self.largest = np.abs(self.points).max(1, initial=0)
        self.longest = float(lengths_of(self.points).max(initial=0))

    def scores(self, a: int, b: int, q: np.ndarray) -> np.ndarray:
        """Exact inner products, at the ends of a long where they lie beyond it."""
        self.scored += b - a
        with np.errstate(over="ignore", invalid="ignore"):
            found = self.points[a:b] @ q
            large = ~(self.largest[a:b] * (float(np.abs(q).max(initial=0)) * len(q)) < EXACT)
        if not large.any():
            return found.astype(np.int64)
        out = np.where(large, 0, found).astype(np.int64)
        whole = [int(x) for x in q.tolist()]
        for i in np.flatnonzero(large).tolist():
            out[i] = min(max(sum(x * int(y) for x, y in zip(whole, self.points[a + i].tolist(), strict=True)), _LONG.min), _LONG.max)
        return out

    def bounds(self, a: int, b: int, turned: np.ndarray, slack: float) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            found = np.maximum(turned * self.low[a:b], turned * self.high[a:b]).sum(1) + slack
        return np.where(np.isfinite(found), found, np.inf)

    def __call__(self, query_id: int, q: np.ndarray, bound: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best, of those that reach the bound; ties to the smaller id."""
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        if not len(self.ids):
            return ids, scores
        kth = -np.inf if bound is None else bound
        with np.errstate(over="ignore", invalid="ignore"):
            turned = q @ self.axes
            slack = 0.5 + 1e-10 * float(lengths_of(q[None, :])[0]) * self.longest  # of turning and of sums, with much to spare
        heap = [(-float(self.bounds(0, 1, turned, slack)[0]), 0)]
        while heap and -heap[0][0] >= kth:
            node = heapq.heappop(heap)[1]
            if child := int(self.child[node]):
                for k, most in enumerate(self.bounds(child, child + 2, turned, slack).tolist()):
                    if most >= kth:
                        heapq.heappush(heap, (-most, child + k))
                continue
            a, b = int(self.first[node]), int(self.last[node])
            found = self.scores(a, b, q)
            good = np.flatnonzero((found >= kth) & (self.ids[a:b] != query_id))
            if len(good):
                ids, scores = top_of(np.concatenate([ids, self.ids[a:b][good]]), np.concatenate([scores, found[good]]), self.k)
                if len(ids) == self.k:
                    kth = max(kth, int(scores[-1]))
        return ids, scores


def share_scored(points: np.ndarray, queries: np.ndarray, k: int) -> float:
    """The share of a shard's points that have to be scored, on average: what the boxes leave of the work."""
    tree = Tree(build_tree(np.arange(len(points)), points), k)
    for q in queries:
        tree(-1, q, None)
    return tree.scored / max(1, len(points) * len(queries))


def quantise(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """Components x as floor(scale * x), in doubles, which hold them exactly; what leaves the doubles counts as the largest one."""

    def one(x):
        y = F.greatest(F.least(x * scale, F.lit(sys.float_info.max)), F.lit(-sys.float_info.max))
        return F.when(F.abs(y) < EXACT / 2, F.floor(y).cast("double")).otherwise(y)

    return rows.withColumn("v", F.transform("v", one))


def exact_top_k(vectors: DataFrame, every: int, k: int, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every`` against all other rows.

    See ``vectors.usable`` for the rows that take no part. Rows that repeat an id are each a candidate, for other ids
    only. Scores beyond a long are given as its end, where they tie. ``shard_rows`` bounds a task's points.
    """
    rows = at_most(quantise(usable(vectors, id_col, vec_col)), k)
    spark, lowest = vectors.sparkSession, int(_LONG.min)
    index = build_shards(rows, shard_rows, build_tree, "kd-trees")
    queries = materialize(query_rows(rows, every), "queries")
    opened = lambda arrays: Tree(arrays, k)
    home = materialize(search(spark, put_queries(queries, lowest), index, opened, k, True, True), "home")
    kth = home.groupBy("query_id").agg(F.min("score").alias("bound"), F.count("*").alias("n")).where(F.col("n") >= k).select("query_id", "bound")
    # dealt by the same hash, a query is in the same block again and the block's home the same
    bounded = put_queries(queries.join(kth, "query_id", "left"), lowest)
    return best(home.union(search(spark, bounded, index, opened, k, True, False)), k)


def op5_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50, k=5)


ORACLE_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""
