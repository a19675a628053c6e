"""Mini-batch k-means against full-batch fits, over partitions and several buckets."""

import numpy as np
import pytest

from relish.operators import cluster, minibatch


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((6, 5)) * 6
    rows = [(i, (centres[i % 6] + rng.standard_normal(5)).tolist()) for i in range(3000)] + [(5000, None)]
    return spark.createDataFrame(rows, "id long, v array<double>")


def test_inertia_is_near_a_full_batch_fit_for_any_partitioning(spark, points):
    found = []
    for partitions in (1, 8):
        df = points.repartition(partitions)
        found.append({r["k"]: (r["inertia"], r["silhouette"]) for r in minibatch.sweep(df, "id", "v", [3, 6], batch=200, bucket_rows=700, init_rows=500).collect()})
    assert found[0].keys() == found[1].keys() == {3, 6}
    for k in (3, 6):
        assert found[0][k][0] == pytest.approx(found[1][k][0], rel=1e-9) and found[0][k][1] == pytest.approx(found[1][k][1], rel=1e-9)
    full = {r["k"]: r["inertia"] for r in cluster.kmeans_sweep(points.filter("v IS NOT NULL"), "v", [3, 6]).collect()}
    assert all(found[0][k][0] <= 1.05 * full[k] for k in (3, 6))
    labelled = minibatch.assign(points, "v", minibatch.fit(points, "id", "v", [6], batch=200))
    assert labelled.count() == 3000 and labelled.selectExpr("count(distinct id % 6, cluster) as n").first()["n"] == 6


def test_empty_and_equal_points(spark):
    none = spark.createDataFrame([], "id long, v array<double>")
    assert minibatch.fit(none, "id", "v", [2]) == {}
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "id long, v array<double>")
    assert minibatch.assign(same, "v", minibatch.fit(same, "id", "v", [3])).selectExpr("max(distance2) as d").first()["d"] == 0.0
