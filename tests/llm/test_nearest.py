"""Every query gets as many neighbours as there are, up to k."""

from collections import Counter

import numpy as np
import pytest

from relish.llm import nearest


def clustered(rng):
    centres = rng.standard_normal((100, 16)) * 5
    return centres[np.arange(2000) % 100] + 0.05 * rng.standard_normal((2000, 16))


def one_long(rng):
    vectors = rng.standard_normal((2000, 16))
    vectors[1] *= 30
    return vectors


@pytest.mark.parametrize("made, confidence", [(clustered, 0.97), (one_long, 0.97), (one_long, 0.05)])  # the last makes radii too small for many queries
def test_all_queries_get_k_rows(spark, made, confidence):
    vectors = made(np.random.default_rng(5))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    got = Counter(r["query_id"] for r in nearest.search(table, lambda i: i % 5 == 0, k=20, confidence=confidence).collect())
    assert got == {i: 20 for i in range(0, 2000, 5)}
