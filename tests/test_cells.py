"""The pivot tree and the routes taken from it, against plain comparison with all vectors."""

import numpy as np
import pytest

from relish.operators import cells as ops
from relish.operators.cluster import dbscan
from relish.operators.retrieval import top_k


def clustered(n, dim, far, seed=3):
    rng = np.random.default_rng(seed)
    return far + rng.normal(size=(40, dim))[rng.integers(0, 40, n)] * 20 + rng.normal(size=(n, dim))


def cells_of(x, n_pivots):
    pivots = np.unique(x[:n_pivots], axis=0)
    cell, dist, off = ops.PivotTree(pivots).nearest(x)
    radius = np.full(len(pivots), -np.inf)
    np.maximum.at(radius, cell, dist + off)
    return cell, ops.Cells(pivots, radius, np.bincount(cell, minlength=len(pivots)), 2 * off.max())


@pytest.mark.parametrize("far", [0.0, 1e6])
def test_nearest_pivot_and_skipped_groups(far, monkeypatch):
    x = clustered(3000, 16, far)
    pivots = np.unique(x[:400], axis=0)
    whole = ops.PivotTree(pivots)
    cell, dist, off = whole.nearest(x)
    true = np.sqrt(((x[:, None, :] - pivots[None, :, :]) ** 2).sum(2))
    assert np.allclose(true.min(1), true[np.arange(len(x)), cell], atol=1e-6)
    assert (np.abs(dist - true[np.arange(len(x)), cell]) <= off + 1e-9).all()
    assert whole.looked < 0.5 * true.size
    monkeypatch.setattr(ops, "TILE_BYTES", 8 * 400 * 7)  # tiles of a few rows
    small = ops.PivotTree(pivots)
    assert max(len(t) for _, t in small.tiles(x)) < 300
    assert np.allclose(small.nearest(x)[1], dist, atol=1e-5)


@pytest.mark.parametrize("far", [0.0, 1e6])
def test_no_close_pair_and_no_high_score_is_skipped(far):
    x = clustered(1500, 8, far)
    cell, cells = cells_of(x, 120)
    true = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    tree = ops.PivotTree(cells.pivots)
    visits = [set(v) for v in cells.cells_within(x, 1.5, tree)]
    assert all(cell[j] in visits[i] for i, j in zip(*np.nonzero(true <= 1.5), strict=True))
    assert sum(map(len, visits)) < 0.5 * len(x) * len(cells.pivots)
    scores = x @ x.T
    low = np.sort(scores, axis=1)[:, -5]
    visits = [set(v) for v in cells.cells_scoring(x, low)]
    assert all(cell[j] in visits[i] for i, j in zip(*np.nonzero(scores >= low[:, None]), strict=True))


@pytest.mark.parametrize("far", [0.0, 1e6])
def test_search_and_density_clusters_over_many_buckets(spark, far):
    x = clustered(1600, 6, far)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(4)
    items, queries = df.withColumnRenamed("id", "doc_id"), df.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    got = {}
    for r in top_k(queries, items, 5, item_rows=80).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["doc_id"]
    scores = x @ x.T
    for q, ranks in got.items():
        assert np.allclose([scores[q, ranks[i]] for i in range(1, 6)], np.sort(scores[q])[::-1][:5], rtol=1e-13)
    assert len(got) == 80
    clusters = {r["id"]: r["cluster"] for r in dbscan(df, "id", "vec", 2.0, 4, rows_per_bucket=80).collect()}
    near = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2)) <= 2.0
    core = near.sum(1) >= 4
    root = np.arange(len(x))
    while True:
        low = np.array([root[near[i] & core].min() if core[i] else root[i] for i in range(len(x))])
        if (low == root).all():
            break
        root = low
    number = {r: n for n, r in enumerate(sorted({root[i] for i in range(len(x)) if core[i]}))}
    want = {i: min((number[root[j]] for j in np.flatnonzero(near[i] & core)), default=-1) for i in range(len(x))}
    assert clusters == want
