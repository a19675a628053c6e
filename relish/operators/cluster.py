"""Cluster summaries, density clusters, silhouettes, k-means and projection."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relish.functions.vectors import dot
from relish.operators.cells import in_spans, marked_within, pair_up, partition_vectors, span_rows, squared_distances, tiles, visiting
from relish.operators.filters import acceptable_clusterings
from relish.operators.graph import components
from relish.operators.ordering import with_position
from relish.operators.retrieval import top_k
from relish.operators.windows import elbow, first_rows, top_categories, top_category
from relish.session import stage


def cluster_summary(df: DataFrame, cluster: str, category: str, name: str, order: str, samples: int = 3) -> DataFrame:
    """Per cluster, its size, most frequent category with count and the first sample names."""
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    names = first_rows(df.filter(F.col(name).isNotNull()), cluster, order, samples).groupBy(cluster).agg(
        F.sort_array(F.collect_list(F.struct("rank", name))).alias("s"))
    return (
        sizes.join(top_category(df, cluster, category), cluster, "left").join(names, cluster, "left")
        .select(
            F.col(cluster).alias("cluster_id"), "size",
            F.coalesce("top_category", F.lit("Unknown")).alias("top_food_type"),
            F.coalesce("top_count", F.lit(0)).alias("top_food_type_count"),
            F.coalesce(F.array_join(F.transform("s", lambda x: x[name]), "; "), F.lit("")).alias("sample_dishes"))
    )


def representatives(df: DataFrame, cluster: str, category: str, name: str, order: str, types: int = 3,
                    samples: int = 5) -> DataFrame:
    """Per cluster, its most frequent categories with counts and its first names."""
    top = top_categories(df, cluster, category, types).groupBy(cluster).agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col(category).alias("category"), "n"))).alias("top_types"))
    first = first_rows(df, cluster, order, samples).groupBy(cluster).agg(
        F.sort_array(F.collect_list(F.struct("rank", F.coalesce(name, F.lit("Unknown")).alias("name")))).alias("s"))
    return top.join(first, cluster, "right").select(
        F.col(cluster).alias("cluster_id"), "top_types", F.transform("s", lambda x: x["name"]).alias("samples"))


# ------------------------------------------------------------------ neighbour distances

BLOCK_SUMS = 1 << 24  # sums of points and clusters that a block returns at most, where blocks can be that small
SPARE = 8  # further neighbours whose exact distances are compared, beyond the k asked for


def centred(df: DataFrame, vec: str) -> DataFrame:
    """``df`` with the mean vector subtracted from ``vec``, so that small distances are not lost among large coordinates."""
    v = F.col(vec).cast("array<double>")
    means = df.select(F.posexplode(v).alias("_at", "_x")).groupBy("_at").agg(F.avg("_x").alias("_m")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "_m"))), lambda s: s["_m"]).alias("m"))
    return df.withColumn("_mean", means.scalar()).withColumn(vec, F.zip_with(v, "_mean", lambda x, m: x - m)).drop("_mean")


def k_distances(df: DataFrame, id_col: str, vec: str, k: int = 5, **options) -> DataFrame:
    """Distance of each point to its ``k``-th nearest point, itself counted as the first.

    The nearest points by distance are the best ones by ``2x·y - |y|²``, so the
    inner-product search finds them, on centred vectors and a few more than
    ``k``; the distances that decide are those of true differences.
    """
    points = stage(centred(df.select(id_col, vec), vec))
    v = F.col(vec)
    items = points.select(F.col(id_col).alias("doc_id"), F.concat(v, F.array(dot(v, v))).alias("vec"))
    queries = points.select(
        F.col(id_col).alias("query_id"), F.concat(F.transform(v, lambda x: x * 2), F.array(F.lit(-1.0))).alias("vec"))
    near = top_k(queries, items, k + SPARE, **options).select("query_id", "doc_id")
    a = df.select(F.col(id_col).alias("query_id"), F.col(vec).cast("array<double>").alias("va"))
    b = df.select(F.col(id_col).alias("doc_id"), F.col(vec).cast("array<double>").alias("vb"))
    gap = F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y))
    true = near.join(a, "query_id").join(b, "doc_id").select("query_id", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x)).alias("d"))
    return true.groupBy("query_id").agg(F.array_sort(F.collect_list("d")).alias("d")).select(
        F.col("query_id").alias(id_col), F.try_element_at("d", F.lit(k)).alias("k_distance")).filter("k_distance IS NOT NULL")


def estimate_eps(df: DataFrame, id_col: str, vec: str, min_samples: int = 5, plotted: bool = True, **options) -> DataFrame:
    """Eps at the bend of the descending k-distance curve, one row ``(elbow_pos, eps)``."""
    return elbow(k_distances(df, id_col, vec, min_samples, **options), "k_distance", id_col, plotted)


# ------------------------------------------------------------------ density clusters

def _distances(x: np.ndarray, xi: np.ndarray, y: np.ndarray, yi: np.ndarray) -> np.ndarray:
    origin = y.mean(0)  # near the points of the block, products lose little
    d = np.sqrt(squared_distances(x - origin, y - origin))
    d[xi[:, None] == yi[None, :]] = 0.0
    return d


def _vectors(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.stack(pdf["vec"].to_numpy()).astype(np.float64, copy=False), pdf["v"].to_numpy()


def _near(visitors: pd.DataFrame, home: pd.DataFrame):
    """The distances of a block tile by tile: positions of visitors and home rows, and their distances."""
    x, xi = _vectors(visitors)
    y, yi = _vectors(home)
    for rows, cols in tiles(visitors, home):
        if len(cols):
            yield rows, cols, _distances(x[rows], xi[rows], y[cols], yi[cols])


def _count_neighbours(eps: Sequence[float]):
    def run(visitors: pd.DataFrame, home: pd.DataFrame) -> pd.DataFrame:
        if len(visitors) == 0 or len(home) == 0:
            return pd.DataFrame({"v": [], "n": []})
        counts = np.zeros((len(visitors), len(eps)), dtype=np.int64)
        for rows, _, d in _near(visitors, home):
            for i, e in enumerate(eps):
                counts[rows, i] = (d <= e).sum(1)
        seen = counts.any(1)
        return pd.DataFrame({"v": visitors["v"].to_numpy()[seen], "n": list(counts[seen])})

    return run


class _Forest:
    """Components of the members of a block, of which tiles tell the close pairs one after the other."""

    def __init__(self, rows: int, cols: int):
        self.row, self.col, self.up = np.full(rows, -1, dtype=np.int64), np.full(cols, -1, dtype=np.int64), []

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = k = self.up[self.up[k]]
        return k

    def add(self, tile: np.ndarray, r: np.ndarray, c: np.ndarray) -> None:
        """Close pairs by the row's place in ``tile``, rows ascending, and the column."""
        if len(r) == 0:
            return
        first = np.full(len(self.col), -1, dtype=np.int64)
        first[c[::-1]] = r[::-1]  # the first row near each column stands for all of them
        base = len(self.up)
        self.up.extend(range(base, base + len(tile)))
        meet = np.zeros((len(tile), len(tile)), dtype=bool)
        meet[r, first[c]] = True
        cols = np.flatnonzero(first >= 0)
        known = self.col[cols] >= 0
        links = np.unique(np.stack([first[cols[known]], self.col[cols[known]]], axis=1), axis=0)
        for a, b in [*np.argwhere(meet).tolist(), *((a, b - base) for a, b in links.tolist())]:
            a, b = self.root(base + a), self.root(base + b)
            if a != b:
                self.up[max(a, b)] = min(a, b)
        self.col[cols[~known]] = base + first[cols[~known]]
        near = np.unique(r)
        self.row[tile[near]] = base + near

    def edges(self, xi: np.ndarray, yi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges joining the members of each component, one per member instead of one per pair."""
        roots = np.fromiter((self.root(k) for k in range(len(self.up))), np.int64, len(self.up))
        here_x, here_y = self.row >= 0, self.col >= 0
        v, k = np.concatenate([xi[here_x], yi[here_y]]), np.concatenate([roots[self.row[here_x]], roots[self.col[here_y]]])
        pairs = np.unique(np.stack([k, v], axis=1), axis=0)
        k, v = pairs[:, 0], pairs[:, 1]
        lowest = v[np.searchsorted(k, k)]
        return lowest[lowest != v], v[lowest != v]


def _link_neighbours(settings: Sequence[tuple[int, float, int]]):
    def run(visitors: pd.DataFrame, home: pd.DataFrame) -> pd.DataFrame:
        columns = ["g", "kind", "a", "b"]
        if len(visitors) == 0 or len(home) == 0:
            return pd.DataFrame({c: [] for c in columns})
        xi, yi = visitors["v"].to_numpy(), home["v"].to_numpy()
        core = {g: [np.fromiter((g in c for c in side["core"]), bool, len(side)) for side in (visitors, home)] for g, _, _ in settings}
        forests = {g: _Forest(len(xi), len(yi)) for g, _, _ in settings}
        out = []
        for rows, cols, d in _near(visitors, home):
            for eps in sorted({e for _, e, _ in settings}):
                r, c = np.nonzero(d <= eps)
                c = cols[c]
                for g in (g for g, e, _ in settings if e == eps):
                    x_core, y_core = core[g][0][rows[r]], core[g][1][c]
                    forests[g].add(rows, r[x_core & y_core], c[x_core & y_core])
                    # a point that is not core has fewer than min_samples neighbours, so these stay few
                    edge = ~x_core & y_core
                    out.append((g, 1, xi[rows[r[edge]]], yi[c[edge]]))
        out.extend((g, 0, *forest.edges(xi, yi)) for g, forest in forests.items())
        return pd.concat([pd.DataFrame(dict(zip(columns, o))) for o in out if len(o[2])] or [pd.DataFrame({c: [] for c in columns})])

    return run


def dbscan_many(df: DataFrame, id_col: str, vec: str, settings: Sequence[tuple[int, float, int]],
                rows_per_bucket: int = 4096) -> DataFrame:
    """C6 for several ``(setting, eps, min_samples)`` at once: ``(setting, id, cluster)``, noise is -1.

    Points are compared only within buckets reachable at the largest eps, and
    sent once to every span of buckets, of which there are few.  A block of
    points returns neighbour counts, then for core points only the
    edges that join them (not every close pair), so dense regions stay linear.
    Clusters are numbered by their lowest core point; a border point joins the
    lowest cluster next to it.
    """
    eps_values = sorted({e for _, e, _ in settings})
    points = stage(df.select(F.col(id_col).cast("long").alias("v"), F.col(vec).cast("array<double>").alias("vec")))
    n = points.count()
    home, cells = partition_vectors(points, "v", "vec", rows_per_bucket, n)
    size = span_rows(n)
    home = in_spans(home, cells, size)
    marked = stage(marked_within(points, "vec", cells, max(eps_values) + 1e-9, size))
    keys = ["span", "part"]

    def grid(core: DataFrame | None):
        extra = [] if core is None else ["core"]

        def side(frame: DataFrame) -> DataFrame:
            return frame if core is None else frame.join(core, "v", "left").withColumn("core", F.coalesce("core", F.lit([]).cast("array<int>")))

        x, y = pair_up(visiting(side(marked)).select("v", "vec", "span", "wanted", *extra),
                       side(home).select("v", "vec", "span", "place", *extra), ["span"], "v", size)
        return x.groupBy(*keys).cogroup(y.groupBy(*keys))

    counts = grid(None).applyInPandas(_count_neighbours(eps_values), "v long, n array<long>")
    totals = counts.groupBy("v").agg(*[F.sum(F.get("n", F.lit(i))).alias(f"n{i}") for i in range(len(eps_values))])
    tested = F.array_compact(F.array(*[F.when(F.col(f"n{eps_values.index(e)}") >= m, F.lit(g)) for g, e, m in settings]))
    core = stage(totals.select("v", F.explode(tested).alias("g")))
    links = stage(grid(core.groupBy("v").agg(F.collect_list("g").alias("core"))).applyInPandas(
        _link_neighbours(settings), "g int, kind int, a long, b long"))
    rooted = stage(components(core.select("g", "v"), links.filter("kind = 0").select("g", "a", "b")))
    # clusters in order of their lowest core point, numbered from 0 within each setting
    placed = with_position(rooted.select("g", "root").distinct(), ["g", "root"], "pos")
    start = placed.groupBy("g").agg(F.min("pos").alias("p0"))
    numbers = stage(placed.join(start, "g").select("g", "root", (F.col("pos") - F.col("p0")).alias("cluster")))
    core_clusters = rooted.join(numbers, ["g", "root"]).select("g", "v", "cluster")
    border = links.filter("kind = 1").select("g", F.col("a").alias("p"), F.col("b").alias("v")).join(
        core_clusters, ["g", "v"]).groupBy("g", F.col("p").alias("v")).agg(F.min("cluster").alias("cluster"))
    found = core_clusters.unionByName(border)
    every = points.select("v", F.explode(F.array(*[F.lit(g) for g, _, _ in settings])).alias("g"))
    return every.join(found, ["g", "v"], "left").select(
        F.col("g").alias("setting"), F.col("v").alias(id_col), F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def dbscan(df: DataFrame, id_col: str, vec: str, eps: float, min_samples: int = 5, **options) -> DataFrame:
    """Density clusters ``(id, cluster)``; noise is -1."""
    return dbscan_many(df, id_col, vec, [(0, eps, min_samples)], **options).select(id_col, "cluster")


# ------------------------------------------------------------------ silhouette

def _cluster_sums(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
    if len(x) == 0 or len(y) == 0:
        return pd.DataFrame({"v": [], "own": [], "other": [], "total": []})
    xv, xi = _vectors(x)
    yv, yi = _vectors(y)
    names, codes = np.unique(y["cluster"].to_numpy(), return_inverse=True)
    order = np.argsort(codes, kind="stable")
    yv, yi, starts = yv[order], yi[order], np.searchsorted(codes[order], np.arange(len(names)))
    rows = max(1, (4 << 20) // len(yv))
    sums = np.concatenate([np.add.reduceat(_distances(xv[a:a + rows], xi[a:a + rows], yv, yi), starts, axis=1) for a in range(0, len(xv), rows)])
    n, k = sums.shape
    return pd.DataFrame({
        "v": np.repeat(xi, k), "own": np.repeat(x["cluster"].to_numpy(), k), "other": np.tile(np.asarray(names), n),
        "total": sums.ravel()})


def silhouette_points(df: DataFrame, id_col: str, vec: str, cluster: str = "cluster", group: str | None = None,
                      rows_per_block: int | None = None) -> DataFrame:
    """Exact Euclidean silhouette of every point, ``(g, id, silhouette)``.

    The mean distance to every cluster needs every pair of points; each pair of
    row blocks is one task-sized group that returns a sum per point and cluster.
    There are few blocks, so that points are repeated few times, unless so many
    clusters that a block's sums would be too large.
    """
    g = F.col(group) if group else F.lit(0)
    points = df.select(g.cast("int").alias("g"), F.col(id_col).cast("long").alias("v"), F.col(vec).cast("array<double>").alias("vec"),
                       F.col(cluster).cast("long").alias("cluster"))
    most = points.groupBy("g").agg(F.count(F.lit(1)).alias("c"), F.count_distinct("cluster").alias("k")).agg(F.max("c").alias("c"), F.max("k").alias("k")).first()
    largest = most["c"] or 1
    rows = rows_per_block or min(span_rows(largest), max(4096, BLOCK_SUMS // max(1, most["k"] or 1)))
    blocks = math.ceil(largest / rows)
    own = F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    named = [F.col(c).alias(c) for c in ("g", "v", "vec", "cluster")]
    x = points.select(*named, own.alias("i"), each.alias("j"))
    y = points.select(*[F.col(c).alias(c) for c in ("g", "v", "vec", "cluster")], each.alias("i"), own.alias("j"))
    keys = ["g", "i", "j"]

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _cluster_sums(a, b).assign(g=key[0] if key else 0)[["g", "v", "own", "other", "total"]]

    sums = x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInPandas(run, "g int, v long, own long, other long, total double")
    sizes = points.groupBy("g", F.col("cluster").alias("other")).agg(F.count(F.lit(1)).alias("size"))
    means = sums.groupBy("g", "v", "own", "other").agg(F.sum("total").alias("total")).join(sizes, ["g", "other"])
    mine = F.col("own") == F.col("other")
    scored = means.groupBy("g", "v").agg(
        F.max(F.when(mine, F.try_divide("total", F.nullif(F.col("size") - 1, F.lit(0))))).alias("a"),
        F.min(F.when(~mine, F.col("total") / F.col("size"))).alias("b"))
    value = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.nullif(F.greatest("a", "b"), F.lit(0.0))), F.lit(0.0))
    return scored.select("g", F.col("v").alias(id_col), value.alias("silhouette"))


def silhouette(df: DataFrame, id_col: str, vec: str, cluster: str = "cluster", exclude_noise: bool = False,
               method: str = "exact") -> DataFrame:
    """Mean silhouette, one row.

    ``exact`` uses Euclidean distances between all points; ``fast`` uses
    squared distances, which need the cluster centres only.
    """
    points = df.filter(F.col(cluster) != -1) if exclude_noise else df
    if method == "fast":
        ready = points.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"), F.col(cluster).cast("double").alias("prediction"))
        value = ClusteringEvaluator(featuresCol="features", predictionCol="prediction").evaluate(ready)
        return df.sparkSession.range(1).select(F.lit(float(value)).alias("silhouette"))
    if method != "exact":
        raise ValueError(f"unknown method {method}")
    return silhouette_points(points, id_col, vec, cluster).agg(F.avg("silhouette").alias("silhouette"))


# ------------------------------------------------------------------ parameter sweep

EPS_FACTORS = (0.7, 0.85, 1.0, 1.15, 1.3)
MIN_SAMPLES = (3, 5, 7, 10)


def dbscan_sweep(df: DataFrame, id_col: str, vec: str, eps: float, factors: Sequence[float] = EPS_FACTORS,
                 min_samples: Sequence[int] = MIN_SAMPLES, **options) -> DataFrame:
    """One row per setting with clusters, noise and the silhouette without noise (-1 if there is none)."""
    settings = [(i, eps * f, m) for i, (f, m) in enumerate((f, m) for f in factors for m in min_samples)]
    labelled = stage(dbscan_many(df, id_col, vec, settings, **options))
    sizes = labelled.groupBy("setting").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("n_clusters"),
        F.count_if(F.col("cluster") == -1).alias("n_noise"))
    several = sizes.filter("n_clusters > 1").select("setting")
    clustered = labelled.filter("cluster != -1").join(several, "setting", "left_semi").join(
        df.select(id_col, F.col(vec).alias("_vec")), id_col)
    scores = silhouette_points(clustered, id_col, "_vec", "cluster", "setting").groupBy(F.col("g").alias("setting")).agg(
        F.avg("silhouette").alias("silhouette_score"))
    table = df.sparkSession.createDataFrame([(g, float(e), m) for g, e, m in settings], "setting int, eps double, min_samples int")
    return table.join(sizes, "setting").join(scores, "setting", "left").select(
        "setting", "eps", "min_samples", "n_clusters", "n_noise", (F.col("n_noise") / F.col("n")).alias("noise_ratio"),
        F.coalesce("silhouette_score", F.lit(-1.0)).alias("silhouette_score"))


def best_setting(sweep: DataFrame, eps: float) -> DataFrame:
    """The acceptable setting with the best silhouette (the first of equals), else ``(eps, 5)``."""
    best = acceptable_clusterings(sweep).agg(
        F.max_by(F.struct("eps", "min_samples"), F.struct("silhouette_score", -F.col("setting"))).alias("b"))
    return best.select(
        F.coalesce("b.eps", F.lit(float(eps))).alias("eps"), F.coalesce("b.min_samples", F.lit(5)).alias("min_samples"),
        F.col("b").isNotNull().alias("found"))


def sweep_matrix(sweep: DataFrame, eps_values: Sequence[float]) -> DataFrame:
    """Silhouettes as a matrix of min_samples by eps (columns ``eps_0`` and so on)."""
    column = F.concat(F.lit("eps_"), (F.array_position(F.array(*[F.lit(float(e)) for e in eps_values]), F.col("eps")) - 1).cast("string"))
    return sweep.withColumn("_e", column).groupBy("min_samples").pivot(
        "_e", [f"eps_{i}" for i in range(len(eps_values))]).agg(F.first("silhouette_score"))


# ------------------------------------------------------------------ k-means and projection

def _features(df: DataFrame, vec: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vec).cast("array<double>")))


def kmeans_sweep(df: DataFrame, vec: str, ks: Sequence[int] = range(5, 21), seed: int = 42) -> DataFrame:
    """Inertia and (squared-distance) silhouette of a k-means fit for each k."""
    ready = _features(df, vec).select("features").persist()
    evaluator = ClusteringEvaluator(featuresCol="features", predictionCol="prediction")
    rows = []
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="features").fit(ready)
        rows.append((int(k), float(model.summary.trainingCost), float(evaluator.evaluate(model.transform(ready)))))
    ready.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def best_k(sweep: DataFrame) -> int:
    """K with the best silhouette, the lowest of equals."""
    return sweep.agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("k")).first()["k"]


def kmeans(df: DataFrame, vec: str, k: int, seed: int = 42, output: str = "cluster") -> DataFrame:
    """Rows with their k-means cluster."""
    ready = _features(df, vec).select("features").persist()
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol=output).fit(ready)
    ready.unpersist()
    return model.transform(_features(df, vec)).drop("features")


def pca_2d(df: DataFrame, vec: str) -> tuple[DataFrame, list[float]]:
    """C4: the two first principal components ``pc1, pc2`` of each row and their share of variance."""
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="centred").fit(_features(df, vec))
    ready = scaler.transform(_features(df, vec)).persist()
    model = PCA(k=2, inputCol="centred", outputCol="pc").fit(ready)
    ready.unpersist()
    out = model.transform(scaler.transform(_features(df, vec))).withColumn("_p", vector_to_array("pc"))
    return out.select(*df.columns, F.get("_p", F.lit(0)).alias("pc1"), F.get("_p", F.lit(1)).alias("pc2")), [
        float(x) for x in model.explainedVariance.toArray()]
