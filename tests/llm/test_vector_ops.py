"""Exact top-k and the permutation index, against brute force."""

import numpy as np
import pytest

from sparkloom.llm import kdtree, permutation, vectors

SCHEMA = "vec_id long, embedding array<float>, score double, shard string, v int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0.0, "x", 1) for i, v in rows], SCHEMA)


def brute(rows, every, k, exact):
    """rows: (id, float64 vector) of the rows that take part."""
    out = {}
    for q, x in {q: min(tuple(v) for i, v in rows if i == q) for q, _ in rows if q % every == 0}.items():
        scores = sorted(((-float(np.dot(x, v)), i) for i, v in rows if i != q))[:k]
        out[q] = [(i, int(-s) if exact else -s) for s, i in scores]
    return {q: r for q, r in out.items() if r}


def got(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def random_rows(n, d, seed, repeat=0):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=d).astype(np.float32).astype(np.float64) / 4) for i in range(n)]
    return rows + [(n + i, rows[3][1]) for i in range(repeat)]


@pytest.mark.parametrize("n, d, every, k, shard_rows, repeat", [(300, 8, 10, 5, 64, 0), (200, 3, 7, 4, 50, 150), (400, 4, 1, 3, 20, 30), (3, 2, 1, 5, 10, 0), (1, 2, 1, 5, 10, 0)])
def test_exact_top_k(spark, n, d, every, k, shard_rows, repeat):
    rows = random_rows(n, d, n, repeat)
    found = kdtree.exact_top_k(frame(spark, rows), every, k, shard_rows=shard_rows)
    assert got(found) == brute([(i, np.floor(v * 256)) for i, v in rows], every, k, True)


def test_tree_bounds_prune():
    rng = np.random.default_rng(1)
    points = np.floor(rng.normal(size=(5000, 2)) * 256)
    tree = kdtree.Tree(kdtree.build_tree(np.arange(5000), points), 3)
    seen, scores = [], tree.scores
    tree.scores = lambda a, b, q: seen.append(b - a) or scores(a, b, q)
    ids, best = tree(-1, np.array([100.0, 50.0]), None)
    order = np.lexsort((np.arange(5000), -(points @ [100, 50])))[:3]
    assert ids.tolist() == order.tolist() and sum(seen) < 2000


def test_boxes_prune_what_has_structure():
    """Points near a few directions of 64 dimensions, whatever their axes; without structure nothing can be pruned."""
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    near_plane = (rng.normal(size=(4000, 64)) * np.where(np.arange(64) < 3, 1, 0.02)) @ turn
    points = np.floor(near_plane * 256)
    assert kdtree.share_scored(points, points[:40], 5) < 0.5
    free = np.floor(rng.normal(size=(1000, 64)) * 256)
    assert 0.9 < kdtree.share_scored(free, free[:10], 5) <= 1.0


def test_large_components_stay_exact(spark):
    rows = [(i, np.array([1_000_000.0 + i, 2.0])) for i in range(8)]
    assert got(kdtree.exact_top_k(frame(spark, rows), 4, 2)) == brute([(i, np.floor(np.float32(v).astype(np.float64) * 256)) for i, v in rows], 4, 2, True)
    small = [(i, np.array([float(i % 7), 1.0])) for i in range(30)]
    rows = [(50, np.array([1.0, 1.0])), *small[1:], (31, np.array([2.0**21, 1.0])), (33, np.array([-(2.0**30), 3.0])), (34, np.array([3e38, -3e38])), (100, np.array([2.0**40, -1.0]))]
    found = got(kdtree.exact_top_k(frame(spark, rows), 50, 40, shard_rows=10))
    quantised = {i: [int(np.float32(x)) * 256 for x in v] for i, v in rows}
    exact = lambda q, i: min(max(sum(a * b for a, b in zip(quantised[q], quantised[i], strict=True)), -(2**63)), 2**63 - 1)
    for q in (50, 100):
        assert found[q] == sorted(((i, exact(q, i)) for i in quantised if i != q), key=lambda x: (-x[1], x[0]))[:40]
    assert found[50][0][0] == 100 and found[50][1][0] == 31


@pytest.mark.parametrize("search", ["exact", "index"])
def test_a_row_that_is_most_of_the_table(spark, search):
    rows = [(7, np.array([3.0, 1.0]))] * 300 + [(7, np.array([1.0, 1.0]))] * 3 + [(i, np.array([1.0, i])) for i in range(10, 40)]
    run = (lambda f: kdtree.exact_top_k(f, 10, 4, shard_rows=20)) if search == "exact" else (lambda f: permutation.nearest(f, 10, 4, shard_rows=20))
    wanted = brute([(i, np.floor(v * 256)) for i, v in rows] if search == "exact" else rows, 10, 4, search == "exact")
    assert got(run(frame(spark, rows))) == wanted


BAD = [(20, None), (40, [1.0, None]), (60, [1.0, float("nan")]), (80, [float("inf"), 1.0]), (100, [1.0, 2.0, 3.0]), (120, [])]


@pytest.mark.parametrize("search", ["exact", "index"])
def test_odd_rows(spark, search):
    rows = [(i, np.array([i % 5 - 2.0, 1.0])) for i in range(0, 60, 3)] + [(0, np.array([1.0, 1.0])), (None, np.array([1.0, 1.0]))]
    all_rows = frame(spark, rows + BAD + [(140, [0.0, 0.0])])
    none = frame(spark, []).where("false")
    if search == "exact":
        run = lambda f: kdtree.exact_top_k(f, 20, 3, shard_rows=8)
        good = [(i, np.floor(np.asarray(v) * 256)) for i, v in [*rows, (140, [0.0, 0.0])] if i is not None]
    else:
        run = lambda f: permutation.nearest(f, 20, 3, shard_rows=8)
        good = [(i, v) for i, v in rows if i is not None]
    assert got(run(all_rows)) == brute(good, 20, 3, search == "exact")
    assert run(none).count() == 0


def test_permutation_recall(spark):
    """Fewer candidates than the query's parameters, on data without structure: the hard case."""
    rows = random_rows(3000, 24, 5)
    found = got(permutation.nearest(frame(spark, rows), 30, 10, pivots=256, prefix=32, share=0.3, each=10, shard_rows=1500))
    wanted = brute(rows, 30, 10, False)
    recall = np.mean([len({i for i, _ in found[q]} & {i for i, _ in w}) / len(w) for q, w in wanted.items()])
    assert recall >= 0.9
    x = dict(rows)
    assert all(s == pytest.approx(float(x[q] @ x[i]), rel=1e-12) for q, r in found.items() for i, s in r)


@pytest.mark.parametrize("lengths", ["lognormal", "few long", "equal"])
def test_permutation_recall_with_unequal_lengths(spark, lengths):
    """The query's share and pivots."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= {"lognormal": rng.lognormal(0, 1, 4000), "few long": np.where(rng.random(4000) < 0.02, 5, 1), "equal": np.ones(4000)}[lengths][:, None]
    rows = list(enumerate(x.astype(np.float32).astype(np.float64)))
    found, wanted = got(permutation.nearest(frame(spark, rows), 80, 20)), brute(rows, 80, 20, False)
    assert np.mean([len({i for i, _ in found[q]} & {i for i, _ in w}) / len(w) for q, w in wanted.items()]) >= 0.9


def test_inverted_files_hold_every_row():
    rng = np.random.default_rng(2)
    rows, pivots = rng.normal(size=(70, 6)), rng.normal(size=(12, 6))
    index = permutation.build_index(np.arange(70), rows, pivots, 5)
    assert np.bincount(index["posted"], minlength=70).tolist() == [5] * 70
    order = permutation.nearest_pivots(rows, pivots, 5)
    for p in range(12):
        a, b = index["starts"][p : p + 2]
        assert all(order[r, k] == p for r, k in zip(index["posted"][a:b], index["places"][a:b], strict=True))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_queries_over_the_tables(spark, sf):
    """The index reranks a part of each: 160 of 500 rows, a quarter of 2000."""
    sf = f"/root/testdata/{sf}"
    rows = [(r["vec_id"], np.array(r["embedding"], np.float64)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert permutation.Shard({"ids": np.arange(len(rows)), "pivots": np.zeros((512, 64))}, 20, permutation.PREFIX, permutation.SHARE, permutation.EACH).n_rerank < len(rows) / 2
    assert got(kdtree.op5_exact_top_k(spark, sf)) == brute([(i, np.floor(v * 256)) for i, v in rows], 50, 5, True)
    found, wanted = got(permutation.op10_permutation_index(spark, sf)), brute(rows, 20, 20, False)
    recall = np.mean([len({i for i, _ in found[q]} & {i for i, _ in w}) / len(w) for q, w in wanted.items()])
    assert recall >= 0.9, recall
    assert vectors.top_of(np.array([3, 1, 2]), np.array([5, 5, 6]), 2)[0].tolist() == [2, 1]
