"""Approximate nearest neighbours with a permutation index.

Pivots are rows drawn by a hash. A vector is represented by its ``prefix`` nearest
pivots in order, and posted in the inverted file of each of them with the
pivot's place. A query reads the files of its own nearest pivots and adds up the footrule
distance: the differences in place, with ``prefix`` for a pivot that is not among a vector's.
Footrule speaks of direction only, so a shard also keeps the length of each vector and the
mean cosine at each distance, measured with some pivots as queries. Those with the largest expected
inner product (mean cosine x length) are reranked first. Their kth score s tells which
cosine another vector x needs to get into the answer, s / (|q| |x|); the rest of the share goes to the vectors whose
expected cosine exceeds that by the most, and those that would need more than 1 can't be in the answer.
Where all lengths are equal this is the order of the footrule distance.

Every row is indexed; only the pivots (``pivots`` rows) are a sample. Recall against
brute force is measured in the tests and given in the README.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import at_most, best, build_shards, lengths_of, put_queries, query_rows, search, top_of, usable

PIVOTS = 512
PREFIX = 48
#: Reranked of each shard: this share at any size, but for shards of so few rows that it would be less than so many for each one wanted.
SHARE = 0.25
EACH = 8
#: Of the reranked, the first part: one in so many.
FIRST = 4
#: Pivots that the mean cosine is measured with, and distances that it is kept for.
MEASURED = 32
LEVELS = 64
SHARD_ROWS = 16_384


def nearest_pivots(rows: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The pivots of largest cosine, in order, for each row."""
    score = rows @ pivots.T
    prefix = min(prefix, len(pivots))
    part = np.argpartition(-score, prefix - 1, 1)[:, :prefix]
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(score, part, 1), 1, kind="stable"), 1)


def build_index(ids: np.ndarray, rows: np.ndarray, pivots: np.ndarray, prefix: int) -> dict[str, np.ndarray]:
    """Rows, pivots and inverted files: for each pivot the rows posted and the pivot's place in them."""
    if not len(ids):
        none = np.empty(0, np.int64)
        return {"ids": ids, "rows": rows, "pivots": pivots, "starts": np.zeros(len(pivots) + 1, np.int64), "posted": none, "places": none, "lengths": np.empty(0), "cosines": np.zeros(LEVELS + 1)}
    order = np.concatenate([nearest_pivots(rows[i : i + 2048], pivots, prefix) for i in range(0, len(ids), 2048)])
    posted, places = (x.ravel() for x in np.indices(order.shape))
    by_pivot = np.argsort(order.ravel(), kind="stable")
    starts = np.searchsorted(order.ravel()[by_pivot], np.arange(len(pivots) + 1))
    index = {"ids": ids, "rows": rows, "pivots": pivots, "starts": starts, "posted": posted[by_pivot].astype(np.int32), "places": places[by_pivot].astype(np.int32), "lengths": lengths_of(rows)}
    return index | {"cosines": mean_cosines(index, order.shape[1])}


def footrule(index: dict[str, np.ndarray], q: np.ndarray, prefix: int) -> np.ndarray:
    """Each row's footrule distance from q, less that of rows without a common pivot."""
    distance = np.zeros(len(index["ids"]), np.int32)
    for place, pivot in enumerate(nearest_pivots(q[None, :], index["pivots"], prefix)[0].tolist()):
        a, b = index["starts"][pivot], index["starts"][pivot + 1]
        distance[index["posted"][a:b]] += np.abs(index["places"][a:b] - place) - prefix
    return distance


def mean_cosines(index: dict[str, np.ndarray], prefix: int) -> np.ndarray:
    """The mean cosine at ``LEVELS`` + 1 footrule distances, from no common pivot to equal orders; never falling."""
    total, n = np.zeros(LEVELS + 1), np.zeros(LEVELS + 1, np.int64)
    lengths = np.where(index["lengths"] > 0, index["lengths"], 1)
    for pivot in index["pivots"][:: max(1, len(index["pivots"]) // MEASURED)]:
        level = np.rint(-footrule(index, pivot, prefix) * (LEVELS / prefix**2)).astype(np.int64)
        total += np.bincount(level, index["rows"] @ pivot / lengths, LEVELS + 1)
        n += np.bincount(level, minlength=LEVELS + 1)
    known = np.flatnonzero(n >= min(20, n.max()))
    return np.maximum.accumulate(np.interp(np.arange(LEVELS + 1), known, total[known] / n[known]))


class Shard:
    """Searches one shard's inverted files."""

    def __init__(self, arrays: dict[str, np.ndarray], k: int, prefix: int, share: float, each: int):
        self.__dict__.update(arrays)
        self.k, self.prefix = k, min(prefix, len(self.pivots))
        self.n_rerank = max(each * k, int(share * len(self.ids)))

    def __call__(self, query_id: int, q: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.ids):
            return np.empty(0, np.int64), np.empty(0)
        near = self.candidates(query_id, q) if self.n_rerank < len(self.ids) else np.arange(len(self.ids))
        near = near[self.ids[near] != query_id]
        return top_of(self.ids[near], self.rows[near] @ q, self.k)

    def candidates(self, query_id: int, q: np.ndarray) -> np.ndarray:
        """The ``n_rerank`` rows that are most likely in the answer."""
        cosine = np.interp(-footrule(self.__dict__, q, self.prefix) * (LEVELS / self.prefix**2), np.arange(LEVELS + 1), self.cosines)
        n = min(self.n_rerank, max(self.n_rerank // FIRST, self.k + 1))
        first = np.argpartition(-cosine * self.lengths, n)[:n]
        scores = self.rows[first[self.ids[first] != query_id]] @ q
        if n == self.n_rerank or len(scores) < self.k:
            return np.argpartition(-cosine * self.lengths, self.n_rerank)[: self.n_rerank]
        kth = np.partition(scores, -self.k)[-self.k]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            needed = kth / lengths_of(q[None, :])[0] / self.lengths
        short = np.where(needed > 1 + 1e-9, np.inf, needed - cosine)
        short[first] = -np.inf
        return np.argpartition(short, self.n_rerank)[: self.n_rerank]


def nearest(vectors: DataFrame, every: int, k: int, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, each: int = EACH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every`` against all other rows.

    See ``vectors.usable`` for the rows that take no part; neither do zero vectors.
    Rows that repeat an id are each a candidate, for other ids only. Equal scores are ranked by the smaller id; which of equally
    likely rows are reranked at the edge of the share follows their order by id in the shard.
    """
    rows = at_most(usable(vectors, id_col, vec_col, "exists(v, x -> x != 0)"), k)
    drawn = rows.orderBy(F.xxhash64("vec_id", F.lit("pivot")), "vec_id", "v").limit(pivots).collect()  # bounded by ``pivots``
    chosen = np.unique(np.array([r["v"] for r in drawn], np.float64), axis=0) if drawn else np.empty((0, 0))
    chosen = chosen / lengths_of(chosen)[:, None] if len(chosen) else chosen
    index = build_shards(rows, shard_rows, lambda ids, x: build_index(ids, x, chosen, prefix), "permutation-index")
    asked = put_queries(query_rows(rows, every), float("-inf"))
    return best(search(vectors.sparkSession, asked, index, lambda arrays: Shard(arrays, k, prefix, share, each), k, False), k)


def op10_permutation_index(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=20, k=20)
