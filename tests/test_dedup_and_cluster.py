import random

import numpy as np
import pytest

from relish.functions.text import word_set
from relish.operators import cluster, dedup
from relish.operators.graph import components
from relish.operators.lsh import Bands
from relish.session import stage


def greedy(rows, alike):
    """Each removed row with the lowest kept row it is similar to."""
    kept, gone = [], {}
    for i, block, x in rows:
        if not any(b == block and alike(x, y) for _, b, y in kept):
            kept.append((i, block, x))
    chosen = {i for i, _, _ in kept}
    for i, block, x in rows:
        if i not in chosen:
            gone[i] = min(k for k, b, y in kept if b == block and alike(x, y))
    return gone


def decisions(got):
    return {r["id"]: r["kept_id"] for r in got.filter("kept_id IS NOT NULL").collect()}


def jaccard(t):
    def f(x, y):
        a, b = set(x.split()), set(y.split())
        return a == b or (a | b and len(a & b) / len(a | b) >= t - 1e-9)
    return f


def texts(n, seed):
    """A third of the rows are copies and near copies of one text, in one block."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(12)]
    out = []
    for i in range(n):
        if i % 3 == 0:
            words = base[:]
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(12)] = f"x{rng.randrange(5)}"
            out.append((i, "hot", " ".join(words)))
        else:
            out.append((i, rng.choice("ab"), " ".join(rng.choice(base + [f"r{k}" for k in range(8)]) for _ in range(rng.randrange(1, 9)))))
    return out


@pytest.mark.parametrize("leaders", [6, 32])
@pytest.mark.parametrize("within", [(), ("block",)])
def test_text_decisions_match_going_in_order(spark, leaders, within):
    rows = texts(66, 5)
    df = spark.createDataFrame(rows, "id long, block string, text string")
    got = dedup.resolve_text(df, "id", word_set("text"), .6, within, leaders=leaders)
    assert decisions(got) == greedy([(i, b if within else "", t) for i, b, t in rows], jaccard(.6))
    assert got.count() == len(rows)


@pytest.mark.parametrize("leaders", [1, 2, 32])
def test_kept_id_does_not_depend_on_leaders(spark, leaders):
    rows = [(1, "a b p"), (2, "a b c d"), (3, "e f g h"), (4, "a b c d e f g h"), (5, "e f g h")]
    df = spark.createDataFrame(rows, "id long, text string")
    links = dedup.removed_links(df, "id", "text", .5, leaders=leaders)
    assert {(r["id"], r["kept_id"]) for r in links.collect()} == {(4, 2), (5, 3)}


def test_chain_depends_on_order(spark):
    a, b, c = "1 2 3 4 5 6", "1 2 3 4 5 7", "1 2 3 4 8 7"
    for order, gone in (((a, b, c), {1}), ((b, a, c), {1, 2})):
        df = spark.createDataFrame(list(enumerate(order)), "id long, text string")
        _, removed = dedup.deduplicate(df, "id", text="text", threshold=.7)
        assert {r["id"] for r in removed.collect()} == gone


@pytest.mark.parametrize("leaders,rows", [(512, 16384), (16, 40)])
def test_vector_decisions_match_going_in_order(spark, leaders, rows):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 6))
    data = [(i, "hot" if i % 3 == 0 else "b", [float(v) for v in (centres[0] if i % 3 == 0 else centres[i % 8]) + rng.normal(size=6) * .15]) for i in range(120)]
    df = spark.createDataFrame(data, "id long, block string, vec array<double>")
    got = dedup.resolve_vectors(df, "id", "vec", .97, ("block",), leaders=leaders, rows_per_bucket=rows)
    unit = [(i, b, np.array(v) / np.linalg.norm(v)) for i, b, v in data]
    assert decisions(got) == greedy(unit, lambda x, y: float(x @ y) >= .97)


def test_components_of_a_long_path_and_a_star(spark):
    n = 60
    edges = [(0, i, i + 1) for i in range(n - 1)] + [(1, 100, 100 + i) for i in range(1, 30)] + [(1, 7, 8)]
    nodes = {(g, v) for g, a, b in edges for v in (a, b)} | {(1, 999)}
    got = {(r["g"], r["v"]): r["root"] for r in components(
        spark.createDataFrame(sorted(nodes), "g int, v long"), spark.createDataFrame(edges, "g int, a long, b long")).collect()}
    assert all(got[0, i] == 0 for i in range(n)) and all(got[1, 100 + i] == 100 for i in range(30))
    assert got[1, 8] == 7 and got[1, 999] == 999 and len(got) == len(nodes)


def plain_dbscan(x, eps, m):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = d <= eps
    core = near.sum(1) >= m
    label, k = np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] == -1:
            todo = [i]
            while todo:
                p = todo.pop()
                if label[p] == -1:
                    label[p] = k
                    if core[p]:
                        todo.extend(np.nonzero(near[p])[0])
            k += 1
    return label


@pytest.mark.parametrize("rows", [4096, 32])
def test_dbscan_matches_plain_implementation(spark, rows):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(70, 2)) * .3, rng.normal(size=(60, 2)) * .3 + 3, rng.uniform(-3, 6, size=(40, 2))])
    x = x[rng.permutation(len(x))]
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    got = {r["id"]: r["cluster"] for r in cluster.dbscan(df, "id", "vec", .35, 5, rows_per_bucket=rows).collect()}
    assert [got[i] for i in range(len(x))] == plain_dbscan(x, .35, 5).tolist()


def test_silhouette_of_two_pairs(spark):
    df = spark.createDataFrame([(0, [0.0], 0), (1, [1.0], 0), (2, [10.0], 1), (3, [11.0], 1), (4, [50.0], -1)], "id long, vec array<double>, cluster int")
    a = [1 - 1 / 10.5, 1 - 1 / 9.5, 1 - 1 / 9.5, 1 - 1 / 10.5]
    got = cluster.silhouette(df, "id", "vec", exclude_noise=True).first()["silhouette"]
    assert abs(got - np.mean(a)) < 1e-9


def test_best_setting_falls_back(spark):
    sweep = spark.createDataFrame([(0, .1, 3, 2, 1, .1, .9)], "setting int, eps double, min_samples int, n_clusters long, n_noise long, noise_ratio double, silhouette_score double")
    assert cluster.best_setting(sweep, .2).first().asDict() == {"eps": .2, "min_samples": 5, "found": False}


@pytest.mark.parametrize("scale", [3.0, 0.01])
def test_neighbour_distances_far_from_the_origin(spark, scale):
    rng = np.random.default_rng(9)
    points = np.array([5.0e5, 5.5e6]) + rng.random((300, 2)) * scale
    points[40:43] = points[3]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vec array<double>")
    want = np.sort(np.sqrt(((points[:, None] - points[None]) ** 2).sum(2)), axis=1)[:, 4]
    got = {r["id"]: r["k_distance"] for r in cluster.k_distances(df, "id", "vec", 5).collect()}
    assert np.allclose([got[i] for i in range(300)], want, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("bands", [None, Bands(60, 2)])
def test_vectors_are_not_repeated_for_buckets_or_bands(spark, monkeypatch, bands):
    rng = np.random.default_rng(5)
    data = [(i, "b" if i % 5 else "c", [float(v) for v in rng.normal(size=6)]) for i in range(240)]
    df = spark.createDataFrame(data, "id long, block string, vec array<double>")
    written = []

    def counting(frame):
        out = stage(frame)
        written.append(out.count())
        return out

    monkeypatch.setattr(dedup, "stage", counting)
    got = decisions(dedup.resolve_vectors(df, "id", "vec", .9, ("block",), leaders=4, rows_per_bucket=8, bands=bands))
    unit = [(i, b, np.array(v) / np.linalg.norm(v)) for i, b, v in data]
    assert got == greedy(unit, lambda x, y: float(x @ y) >= .9)
    assert sum(written) <= 6 * len(data)
