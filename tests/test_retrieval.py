import numpy as np
import pytest
from pyspark.sql import functions as F

from relish.functions.vectors import cosine, mean_pool, normalize
from relish.operators import retrieval


def brute(q, d, k, skip):
    out = set()
    for i, x in q:
        scored = sorted(((-round(float(np.dot(x, y)), 12) + 0.0, j) for j, y in d if not (skip and i == j)))[:k]
        out |= {(i, j, r + 1) for r, (_, j) in enumerate(scored)}
    return out


def clustered(n, dim=8, seed=0):
    """Groups of vectors; a third of all rows are copies of one vector."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim)) * 3
    rows = [centres[i % 6] + rng.normal(size=dim) * .2 for i in range(n)]
    for i in range(0, n, 3):
        rows[i] = rows[0]
    return [(i, [float(v) for v in r]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("rows", [10_000, 40])
def test_top_k_matches_brute_force(spark, rows):
    data = clustered(300)
    d = spark.createDataFrame(data, "doc_id long, vec array<double>")
    q = d.filter("doc_id % 2 = 0").withColumnRenamed("doc_id", "query_id")
    got = retrieval.top_k(q, d, 7, skip_same_id=True, item_rows=rows, query_rows=rows)
    want = brute([r for r in data if r[0] % 2 == 0], data, 7, True)
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in got.collect()} == want


def test_k_larger_than_catalogue_and_zero_vectors(spark):
    d = spark.createDataFrame([("b", [0.0, 0.0]), ("a", [0.0, 0.0]), ("c", [1.0, 0.0])], "doc_id string, vec array<double>")
    q = spark.createDataFrame([(1, [-1.0, 0.0])], "query_id long, vec array<double>")
    rows = retrieval.top_k(q, d, 10).orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == ["a", "b", "c"]


def test_late_fusion_sums_items_found_by_either_side(spark):
    items = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [.6, .8]), ("z", [0.0, 1.0])], "doc_id string, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vec array<double>")
    image = spark.createDataFrame([(1, [0.0, 1.0])], "query_id long, vec array<double>")
    rows = retrieval.fused_top_k(q, image, items, items, 2).orderBy("rank").collect()
    # text finds x, y; image finds z, y: y has .6 + .8
    assert [(r["doc_id"], round(r["score"], 6)) for r in rows] == [("y", 1.4), ("x", 1.0)]


def test_catalogue_takes_first_row_and_skips_empty(spark):
    rows = [(0, "a", None, "i.jpg", None, [0.0, 2.0]), (1, "a", "t", None, [3.0, 4.0], None), (2, "b", " ", None, None, None)]
    df = spark.createDataFrame(rows, "r long, dish string, text string, image string, text_vec array<double>, image_vec array<double>")
    got = retrieval.build_catalogue(df, "dish", "r", 2).collect()
    assert [(r["dish"], r["text_vec"], r["image_vec"]) for r in got] == [("a", [0.0, 0.0], [0.0, 1.0])]


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [[1.0, 0.0], [0.0, 5.0]], [0, 0])], "a array<float>, z array<float>, t array<array<float>>, m array<int>")
    r = df.select(normalize("a").alias("n"), normalize("z").alias("z"), cosine("a", "z").alias("c"), mean_pool("t", "m").alias("p"),
                  mean_pool("t", F.array(F.lit(1), F.lit(0))).alias("p1")).first()
    assert np.allclose(r["n"], [.6, .8]) and r["z"] == [0.0, 0.0] and r["c"] == 0.0 and r["p"] == [0.0, 0.0] and r["p1"] == [1.0, 0.0]


def test_encode_with_setup_per_task(spark):
    def factory(scale):
        return lambda texts: np.array([[len(t) * scale] for t in texts])

    df = spark.createDataFrame([("ab",), (None,)], "t string")
    assert [r["vec"] for r in retrieval.encode(df, "t", factory, setup=(2,)).collect()] == [[4.0], [0.0]]
