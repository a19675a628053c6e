"""Rows that have to visit every bucket are sent to few spans of buckets, and results stay those of plain implementations."""

import numpy as np
import pytest

from relish.operators import cells, cluster, retrieval
from test_dedup_and_cluster import plain_dbscan


def frame(spark, x, **more):
    names = ["id long", "vec array<double>", *more]
    return spark.createDataFrame([(i, [float(a) for a in r], *[c[i] for c in more.values()]) for i, r in enumerate(x)], ", ".join(names))


@pytest.fixture
def small_spans(monkeypatch):
    monkeypatch.setattr(cells, "LEAST_SPAN", 16)


def test_a_row_visits_at_most_as_many_spans_as_there_are(spark, small_spans):
    df = frame(spark, np.random.default_rng(2).normal(size=(600, 24)))
    home, found = cells.partition_vectors(df, "id", "vec", 8, 600)
    size = cells.span_rows(600)
    rows = cells.visiting(cells.marked_within(df, "vec", found, 9.0, size))
    assert home.select("bucket").distinct().count() > 70
    assert rows.count() <= (cells.SPANS + 1) * 600
    placed = {(r["span"], r["place"]): r["bucket"] for r in cells.in_spans(home, found, size).collect()}
    assert len(placed) == len(set(placed.values())) == home.select("bucket").distinct().count()


@pytest.mark.parametrize("rows", [4096, 8])
def test_clusters_over_several_spans(spark, small_spans, rows):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(90, 2)) * .3, rng.normal(size=(80, 2)) * .3 + 3, rng.uniform(-3, 6, size=(60, 2))])
    x = x[rng.permutation(len(x))]
    got = cluster.dbscan_many(frame(spark, x), "id", "vec", [(0, .35, 5), (1, .5, 4), (2, .35, 3)], rows_per_bucket=rows)
    found = {(r["setting"], r["id"]): r["cluster"] for r in got.collect()}
    for g, eps, m in ((0, .35, 5), (1, .5, 4), (2, .35, 3)):
        assert [found[g, i] for i in range(len(x))] == plain_dbscan(x, eps, m).tolist()


def test_search_over_several_spans(spark, small_spans):
    x = np.round(np.random.default_rng(6).normal(size=(300, 6)), 1)
    df = frame(spark, x)
    got = retrieval.top_k(df.selectExpr("id AS query_id", "vec"), df.selectExpr("'d' || (1000 + id) AS doc_id", "vec"), 4, item_rows=9, query_rows=20)
    scores = np.round(x @ x.T, 12)
    want = {(i, r + 1): f"d{1000 + j}" for i in range(300) for r, j in enumerate(np.lexsort((np.arange(300), -scores[i]))[:4].tolist())}
    assert {(r["query_id"], r["rank"]): r["doc_id"] for r in got.collect()} == want


def test_silhouette_has_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(cells, "LEAST_SPAN", 16)
    x = np.random.default_rng(8).normal(size=(200, 3))
    label = [i % 3 for i in range(200)]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    means = np.stack([d[:, [j for j in range(200) if j % 3 == c]].sum(1) for c in range(3)], axis=1)
    size = np.bincount(label)
    own = np.array([means[i, label[i]] / (size[label[i]] - 1) for i in range(200)])
    other = np.array([min(means[i, c] / size[c] for c in range(3) if c != label[i]) for i in range(200)])
    df = frame(spark, x, **{"cluster int": label})
    got = {r["id"]: r["silhouette"] for r in cluster.silhouette_points(df, "id", "vec").collect()}
    assert np.allclose([got[i] for i in range(200)], (other - own) / np.maximum(own, other), atol=1e-9)


def test_few_pairs_of_rows_and_cells_are_listed_at_once(spark, small_spans, monkeypatch):
    x = np.random.default_rng(3).normal(size=(500, 24))
    _, found = cells.partition_vectors(frame(spark, x), "id", "vec", 8, 500)
    spans, tree = cells.Spans(found, cells.span_rows(500)), cells.PivotTree(found.pivots)
    want, listed = spans.marks(found.cells_within(x, 9.0)), []
    reached = cells.PivotTree.reached
    monkeypatch.setattr(cells.PivotTree, "reached", lambda self, vecs, *x: listed.append(reached(self, vecs, *x)) or listed[-1])
    monkeypatch.setattr(cells, "REACHED", 1000)
    got = cells._marked(spans, found, tree, cells.pd.Series(list(x)), None, 9.0)
    assert got["wanted"].tolist() == want["wanted"].tolist() and [s.tolist() for s in got["span"]] == [s.tolist() for s in want["span"]]
    assert max(sum(map(len, r)) for r in listed) <= 1000 and sum(map(len, listed)) == 500
    assert [len(m) for m in cells._marked(spans, found, tree, cells.pd.Series(list(x[:3])), np.full(3, -1e9), None)["wanted"]]


def test_only_scores_that_reach_the_floor_are_sorted(monkeypatch):
    rng = np.random.default_rng(6)
    q, d = rng.normal(size=(40, 8)), rng.normal(size=(400, 8))
    d[7] = d[3]
    q_ids, d_ids = np.arange(40), np.arange(400)[::-1]
    want = retrieval._best(5, True, q_ids, q, d_ids, d)
    low = want.groupby("query_id")["score"].min().to_numpy()
    best, sorted_whole = retrieval._best, []
    monkeypatch.setattr(retrieval, "_best", lambda k, skip, ids, *x: sorted_whole.extend(ids) or best(k, skip, ids, *x))
    floor = np.where(q_ids == 0, -np.inf, low)
    for factor in (1.0, 1e20):
        queries = cells.pd.DataFrame({"query_id": q_ids, "vec": list(q * factor), "floor": floor * factor, "wanted": [b"\x80"] * 40})
        items = cells.pd.DataFrame({"doc_id": d_ids, "vec": list(d), "place": 0})
        got = retrieval._span_top_k(5, True)(queries, items).sort_values(["query_id", "score"], ascending=[True, False], kind="stable")
        assert got["query_id"].tolist() == want["query_id"].tolist() and got["doc_id"].tolist() == want["doc_id"].tolist()
        assert np.allclose(got["score"], want["score"] * factor, rtol=1e-11) and sorted_whole == [0]
        sorted_whole.clear()
