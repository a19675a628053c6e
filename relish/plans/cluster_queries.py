"""Clustering over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from relish.operators import cluster, filters, minibatch
from relish.plans.registry import Tables, query
from relish.session import stage

EPS, MIN_SAMPLES = 1.1, 5

POINTS = """pts AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
dist AS (SELECT a.id AS a, b.id AS b, a.label AS la, b.label AS lb, CASE WHEN a.id = b.id THEN 0 ELSE
  sqrt(greatest(0, list_inner_product(a.e, a.e) + list_inner_product(b.e, b.e) - 2 * list_inner_product(a.e, b.e))) END AS d FROM pts a CROSS JOIN pts b)"""


def density(eps: str, min_samples: str, suffix: str = "") -> str:
    """SQL of density clusters with noise -1, as ``clu(id, cluster)``."""
    return f"""
core AS (SELECT a AS id FROM dist WHERE d <= {eps} GROUP BY a HAVING count(*) >= {min_samples}),
edge AS (SELECT a, b FROM dist WHERE d <= {eps} AND a <> b AND a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach(id, root) AS (SELECT id, id FROM core UNION SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.id WHERE r.root < e.b),
root AS (SELECT id, min(root) AS root FROM reach GROUP BY 1),
num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM root)),
cc AS (SELECT id, cluster FROM root JOIN num USING (root)),
border AS (SELECT x.a AS id, min(cc.cluster) AS cluster FROM dist x JOIN cc ON cc.id = x.b WHERE x.d <= {eps} AND x.a NOT IN (SELECT id FROM core) GROUP BY 1),
clu AS (SELECT p.id, coalesce(cc.cluster, border.cluster, -1) AS cluster FROM pts p LEFT JOIN cc ON cc.id = p.id LEFT JOIN border ON border.id = p.id)"""


@query("W7_k_distances", f"""WITH {POINTS} SELECT a AS vec_id, round(d, 6) AS k_distance FROM (
SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM dist) WHERE r = 5""")
def w7(t: Tables):
    return cluster.k_distances(t.embeddings, "vec_id", "embedding", 5).withColumn("k_distance", F.round("k_distance", 6))


@query("C5_estimate_eps", f"""WITH {POINTS}, k AS (SELECT a, d AS v FROM (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM dist) WHERE r = 5),
o AS (SELECT v, row_number() OVER (ORDER BY v DESC, a) - 1 AS pos FROM k),
f AS (SELECT pos, abs((lead(v, 2) OVER w - lead(v) OVER w) - (lead(v) OVER w - v)) AS bend FROM o WINDOW w AS (ORDER BY pos)),
b AS (SELECT pos + 1 AS at FROM f WHERE bend IS NOT NULL ORDER BY bend DESC, pos LIMIT 1)
SELECT pos AS elbow_pos, round(v, 6) AS eps FROM o JOIN b ON b.at = o.pos""")
def c5(t: Tables):
    return cluster.estimate_eps(t.embeddings, "vec_id", "embedding").withColumn("eps", F.round("eps", 6))


@query("C6_dbscan", f"WITH RECURSIVE {POINTS}, {density(str(EPS), str(MIN_SAMPLES))} SELECT id AS vec_id, cluster FROM clu")
def c6(t: Tables):
    return cluster.dbscan(t.embeddings, "vec_id", "embedding", EPS, MIN_SAMPLES)


@query("C6_dbscan_small_blocks", f"WITH RECURSIVE {POINTS}, {density('1.05', '4')} SELECT id AS vec_id, cluster FROM clu")
def c6_small(t: Tables):
    # many cells and chunks, as at scale
    return cluster.dbscan(t.embeddings, "vec_id", "embedding", 1.05, 4, rows_per_bucket=64)


SILHOUETTE = """sums AS (SELECT a, la, lb, sum(d) AS s, count(*) AS n FROM dist GROUP BY 1, 2, 3),
ab AS (SELECT a, max(CASE WHEN la = lb THEN s / nullif(n - 1, 0) END) AS va, min(CASE WHEN la <> lb THEN s / n END) AS vb FROM sums GROUP BY 1)"""


@query("C3_silhouette", f"WITH {POINTS}, {SILHOUETTE} SELECT round(avg(coalesce((vb - va) / greatest(va, vb), 0)), 6) AS silhouette FROM ab")
def c3(t: Tables):
    return cluster.silhouette(t.embeddings, "vec_id", "embedding", "label").withColumn("silhouette", F.round("silhouette", 6))


@query("C3_silhouette_fast", f"""WITH {POINTS}, {SILHOUETTE.replace('sum(d)', 'sum(d * d)')} SELECT round(avg(coalesce((vb - va) / greatest(va, vb), 0)), 6) AS silhouette FROM ab""")
def c3_fast(t: Tables):
    return cluster.silhouette(t.embeddings, "vec_id", "embedding", "label", method="fast").withColumn("silhouette", F.round("silhouette", 6))


# points in separated groups: the label along one axis, the vector across it
SPREAD_EPS = 1.1
SPREAD = """pts AS (SELECT vec_id AS id, [label * 2.0::DOUBLE] || embedding::DOUBLE[] AS e FROM embeddings),
dist AS (SELECT a.id AS a, b.id AS b, CASE WHEN a.id = b.id THEN 0 ELSE list_distance(a.e, b.e) END AS d FROM pts a CROSS JOIN pts b),
setting AS (SELECT (row_number() OVER (ORDER BY f, m) - 1)::INT AS g, 1.1::DOUBLE * f AS eps, m FROM (SELECT unnest([0.7, 0.85, 1.0, 1.15, 1.3])::DOUBLE AS f), (SELECT unnest([3, 5, 7, 10]) AS m)),
near AS (SELECT g, a, b FROM dist JOIN setting ON d <= eps),
core AS (SELECT g, a AS id FROM near JOIN setting USING (g) GROUP BY g, a, m HAVING count(*) >= m),
edge AS (SELECT g, a, b FROM near WHERE a <> b AND (g, a) IN (SELECT g, id FROM core) AND (g, b) IN (SELECT g, id FROM core)),
reach(g, id, root) AS (SELECT g, id, id FROM core UNION SELECT e.g, e.b, r.root FROM reach r JOIN edge e ON e.g = r.g AND e.a = r.id WHERE r.root < e.b),
root AS (SELECT g, id, min(root) AS root FROM reach GROUP BY 1, 2),
border AS (SELECT x.g, x.a AS id, min(r.root) AS root FROM near x JOIN root r ON r.g = x.g AND r.id = x.b WHERE (x.g, x.a) NOT IN (SELECT g, id FROM core) GROUP BY 1, 2),
found AS (SELECT * FROM root UNION ALL SELECT * FROM border),
size AS (SELECT g, root, count(*) AS n FROM found GROUP BY 1, 2),
means AS (SELECT x.g, x.id, x.root AS own, y.root AS other, sum(d) AS s FROM found x JOIN found y ON y.g = x.g JOIN dist ON a = x.id AND b = y.id GROUP BY ALL),
ab AS (SELECT means.g, id, max(CASE WHEN own = other THEN s / nullif(n - 1, 0) END) AS va, min(CASE WHEN own <> other THEN s / n END) AS vb
       FROM means JOIN size ON size.g = means.g AND size.root = other GROUP BY 1, 2),
sil AS (SELECT g, avg(coalesce((vb - va) / nullif(greatest(va, vb), 0), 0)) AS v FROM ab GROUP BY 1),
sweep AS (SELECT g AS setting, eps, m AS min_samples, (SELECT count(*) FROM size WHERE size.g = setting.g) AS n_clusters,
  (SELECT count(*) FROM pts) - (SELECT count(*) FROM found WHERE found.g = setting.g) AS n_noise,
  ((SELECT count(*) FROM pts) - (SELECT count(*) FROM found WHERE found.g = setting.g)) / (SELECT count(*) FROM pts)::DOUBLE AS noise_ratio,
  CASE WHEN (SELECT count(*) FROM size WHERE size.g = setting.g) > 1 THEN (SELECT v FROM sil WHERE sil.g = setting.g) ELSE -1 END AS silhouette_score FROM setting)"""


def spread_points(t: Tables):
    return t.embeddings.select("vec_id", F.concat(
        F.array(F.col("label") * F.lit(2.0)), F.col("embedding").cast("array<double>")).alias("vec"))


def sweep(t: Tables):
    return cluster.dbscan_sweep(spread_points(t), "vec_id", "vec", SPREAD_EPS)


@query("C7_dbscan_sweep", f"WITH RECURSIVE {SPREAD} SELECT setting, round(eps, 6) AS eps, min_samples, n_clusters, n_noise, round(noise_ratio, 6) AS noise_ratio, round(silhouette_score, 6) AS silhouette_score FROM sweep")
def c7(t: Tables):
    return sweep(t).withColumns({c: F.round(c, 6) for c in ("eps", "noise_ratio", "silhouette_score")})


@query("C7_best_setting", f"""WITH RECURSIVE {SPREAD} SELECT round(eps, 6) AS eps, min_samples, true AS found FROM sweep
WHERE n_clusters BETWEEN 5 AND 50 AND noise_ratio BETWEEN 0.05 AND 0.30 AND silhouette_score > 0 ORDER BY silhouette_score DESC, setting LIMIT 1""")
def c7_best(t: Tables):
    return cluster.best_setting(stage(sweep(t)), SPREAD_EPS).withColumn("eps", F.round("eps", 6))


@query("P14_acceptable_clusterings", f"""WITH RECURSIVE {SPREAD} SELECT setting, min_samples, n_clusters, n_noise FROM sweep
WHERE n_clusters BETWEEN 5 AND 50 AND noise_ratio BETWEEN 0.05 AND 0.30 AND silhouette_score > 0""")
def p14(t: Tables):
    return filters.acceptable_clusterings(sweep(t)).select("setting", "min_samples", "n_clusters", "n_noise")


@query("C8_sweep_matrix", f"""WITH RECURSIVE {SPREAD} SELECT min_samples, round(max(silhouette_score) FILTER (setting // 4 = 0), 6) AS eps_0, round(max(silhouette_score) FILTER (setting // 4 = 1), 6) AS eps_1,
round(max(silhouette_score) FILTER (setting // 4 = 2), 6) AS eps_2, round(max(silhouette_score) FILTER (setting // 4 = 3), 6) AS eps_3, round(max(silhouette_score) FILTER (setting // 4 = 4), 6) AS eps_4 FROM sweep GROUP BY 1""")
def c8(t: Tables):
    matrix = cluster.sweep_matrix(sweep(t), [SPREAD_EPS * f for f in cluster.EPS_FACTORS])
    return matrix.withColumns({f"eps_{i}": F.round(f"eps_{i}", 6) for i in range(5)})


@query("C6_dbscan_separated", f"WITH RECURSIVE {SPREAD}, n AS (SELECT g, root, row_number() OVER (PARTITION BY g ORDER BY root) - 1 AS cluster FROM size) SELECT p.id AS vec_id, coalesce(n.cluster, -1) AS cluster FROM pts p LEFT JOIN found f ON f.id = p.id AND f.g = 13 LEFT JOIN n ON n.g = 13 AND n.root = f.root")
def c6_separated(t: Tables):
    return cluster.dbscan(spread_points(t), "vec_id", "vec", SPREAD_EPS * 1.15, 5, rows_per_bucket=64)


@query("C1_kmeans_sweep")
def c1(t: Tables):
    return cluster.kmeans_sweep(t.embeddings, "embedding")


@query("C2_kmeans")
def c2(t: Tables):
    k = cluster.best_k(cluster.kmeans_sweep(t.embeddings, "embedding"))
    return cluster.kmeans(t.embeddings, "embedding", k).select("vec_id", "cluster")


@query("C4_pca")
def c4(t: Tables):
    projected, shares = cluster.pca_2d(t.embeddings, "embedding")
    return projected.select("vec_id", "pc1", "pc2").withColumns({"share1": F.lit(shares[0]), "share2": F.lit(shares[1])})


# the same points set far apart by label, where k-means has one right answer
APART = """apart AS (SELECT vec_id, label, embedding::DOUBLE[] || list_transform(range(10), lambda i: CASE WHEN i = label THEN 100.0::DOUBLE ELSE 0 END) AS e FROM embeddings),
parts AS (SELECT vec_id, label, unnest(range(74)) AS pos, unnest(e) AS x FROM apart),
centre AS (SELECT label, pos, avg(x) AS m FROM parts GROUP BY label, pos)"""


def apart(t: Tables):
    axes = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == F.col("label"), 100.0).otherwise(0.0))
    return t.embeddings.select("vec_id", "label", F.concat(F.col("embedding").cast("array<double>"), axes).alias("vec"))


@query("C1_kmeans_separated", f"""WITH {APART} SELECT count(DISTINCT label)::INT AS k, round(sum((x - m) * (x - m)), 4) AS inertia FROM parts JOIN centre USING (label, pos)""")
def c1_separated(t: Tables):
    points = apart(t)
    groups = points.select("label").distinct().count()
    return cluster.kmeans_sweep(points, "vec", [groups]).select("k", F.round("inertia", 4).alias("inertia"))


@query("C2_kmeans_separated", "SELECT vec_id, min(vec_id) OVER (PARTITION BY label) AS first_of_cluster FROM embeddings")
def c2_separated(t: Tables):
    points = apart(t)
    found = cluster.kmeans(points, "vec", points.select("label").distinct().count())
    first = found.groupBy("cluster").agg(F.min("vec_id").alias("first_of_cluster"))
    return found.join(first, "cluster").select("vec_id", "first_of_cluster")


@query("C4_pca_two_sums", """WITH s AS (SELECT vec_id, list_sum(embedding[1:32]::DOUBLE[]) * 2 AS x, list_sum(embedding[33:64]::DOUBLE[]) + list_sum(embedding[1:32]::DOUBLE[]) AS y FROM embeddings),
c AS (SELECT covar_samp(x, x) AS a, covar_samp(x, y) AS b, covar_samp(y, y) AS d, avg(x) AS mx, avg(y) AS my FROM s),
v AS (SELECT *, (a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b) AS l1, (a + d) / 2 - sqrt(((a - d) / 2) ** 2 + b * b) AS l2 FROM c)
SELECT vec_id, round(abs(((x - mx) * b + (y - my) * (l1 - a)) / sqrt(b * b + (l1 - a) ** 2)), 5) AS pc1, round(abs(((x - mx) * b + (y - my) * (l2 - a)) / sqrt(b * b + (l2 - a) ** 2)), 5) AS pc2,
  round(l1 / (l1 + l2), 6) AS share1, round(l2 / (l1 + l2), 6) AS share2 FROM s, v""")
def c4_two_sums(t: Tables):
    """All components enter through two sums, of which the projection is known in closed form, up to sign."""
    def total(start):
        return F.aggregate(F.slice(F.col("embedding").cast("array<double>"), start, 32), F.lit(0.0), lambda a, x: a + x)
    sums = t.embeddings.select("vec_id", F.array(total(1) * 2, total(33) + total(1)).alias("sums"))
    projected, shares = cluster.pca_2d(sums, "sums")
    return projected.select("vec_id", F.round(F.abs("pc1"), 5).alias("pc1"), F.round(F.abs("pc2"), 5).alias("pc2"),
                            F.round(F.lit(shares[0]), 6).alias("share1"), F.round(F.lit(shares[1]), 6).alias("share2"))


@query("C1_minibatch_sweep", f"""WITH {APART},
fit AS (SELECT count(DISTINCT label)::INT AS k, round(sum((x - m) * (x - m)), 4) AS inertia FROM parts JOIN centre USING (label, pos)),
d AS (SELECT x.vec_id, x.label, y.label AS other, sum(list_distance(x.e, y.e)) AS s, count(*) AS n FROM apart x JOIN apart y ON true GROUP BY ALL),
p AS (SELECT vec_id, max(CASE WHEN label = other THEN s / (n - 1) END) AS a, min(CASE WHEN label <> other THEN s / n END) AS b FROM d GROUP BY vec_id)
SELECT k, inertia, round((SELECT avg((b - a) / greatest(a, b)) FROM p), 6) AS silhouette FROM fit""")
def c1_minibatch(t: Tables):
    points = apart(t)
    found = minibatch.sweep(points, "vec_id", "vec", [points.select("label").distinct().count()])
    return found.select("k", F.round("inertia", 4).alias("inertia"), F.round("silhouette", 6).alias("silhouette"))


@query("C2_minibatch", "SELECT vec_id, min(vec_id) OVER (PARTITION BY label) AS first_of_cluster FROM embeddings")
def c2_minibatch(t: Tables):
    points = apart(t)
    found = minibatch.assign(points, "vec", minibatch.fit(points, "vec_id", "vec", [points.select("label").distinct().count()]))
    first = found.groupBy("cluster").agg(F.min("vec_id").alias("first_of_cluster"))
    return found.join(first, "cluster").select("vec_id", "first_of_cluster")
