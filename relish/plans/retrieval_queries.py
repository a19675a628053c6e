"""Vector search and evaluation over ``embeddings`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from relish.functions.vectors import cosine, mean_pool, normalize, zero_fill
from relish.operators import joins, metrics, retrieval, setops, windows
from relish.plans.registry import Tables, query
from relish.session import stage

DIM = 64

# every vector is a query against all others; documents of the same label are relevant
VECTORS = """
vecs AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
unit AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS v FROM vecs),
scored AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_inner_product(a.v, b.v), 12) AS score,
                  CASE WHEN a.label = b.label AND a.vec_id // 50 = b.vec_id // 50 THEN 1 ELSE 0 END AS rel
           FROM unit a JOIN unit b ON a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
"""

# two modalities per row: the vector and a copy rotated by one; labels 7 and 3 lack one of them
TWO = """
vecs AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
base AS (SELECT vec_id, label, 'dish ' || label || '-' || (vec_id % 7) AS dish,
                CASE WHEN label <> 7 THEN e ELSE list_transform(e, lambda x: 0.0::DOUBLE) END AS t,
                CASE WHEN label <> 3 THEN e[2:64] || e[1:1] ELSE list_transform(e, lambda x: 0.0::DOUBLE) END AS i FROM vecs),
two AS (SELECT vec_id, label, dish,
               list_transform(t, lambda x: x / greatest(sqrt(list_inner_product(t, t)), 1e-300)) AS tv,
               list_transform(i, lambda x: x / greatest(sqrt(list_inner_product(i, i)), 1e-300)) AS iv,
               label <> 7 AS has_t, label <> 3 AS has_i FROM base)
"""

# one catalogue row per dish from its first row; all rows are queries
CATALOGUE = f"""{TWO},
cat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dish ORDER BY vec_id) AS r FROM two) WHERE r = 1),
full_scores AS (SELECT q.vec_id AS query_id, q.dish AS truth, c.dish AS doc_id,
                       round(list_inner_product(q.tv, c.tv) + list_inner_product(q.iv, c.iv), 12) AS score
                FROM two q CROSS JOIN cat c),
full_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM full_scores)
"""


def unit_vectors(t: Tables):
    return t.embeddings.select("vec_id", "label", normalize("embedding").alias("vec"))


def search(t: Tables, k: int, **options):
    v = unit_vectors(t)
    hits = retrieval.top_k(
        v.select(F.col("vec_id").alias("query_id"), "vec"), v.select(F.col("vec_id").alias("doc_id"), "vec"), k,
        skip_same_id=True, **options)
    return stage(hits)  # read several times by the measures


def judgements(t: Tables):
    """Relevant documents of every query, retrieved or not: those of its label among the fifty with neighbouring ids."""
    rows = t.embeddings.select("vec_id", "label", F.floor(F.col("vec_id") / 50).alias("block"))
    other = rows.select(F.col("vec_id").alias("doc_id"), "label", "block")
    return rows.withColumnRenamed("vec_id", "query_id").join(other, ["label", "block"]).filter("query_id <> doc_id").select(
        "query_id", "doc_id", F.lit(1).alias("rel"))


def two_modalities(t: Tables):
    e = F.col("embedding").cast("array<double>")
    rotated = F.concat(F.slice(e, 2, DIM - 1), F.slice(e, 1, 1))
    return t.embeddings.select(
        "vec_id", "label",
        F.concat(F.lit("dish "), F.col("label").cast("string"), F.lit("-"), (F.col("vec_id") % 7).cast("string")).alias("dish"),
        F.when(F.col("label") != 7, F.concat(F.lit("text "), F.col("vec_id").cast("string"))).alias("text"),
        F.when(F.col("label") != 3, F.concat(F.lit("image "), F.col("vec_id").cast("string"))).alias("image"),
        F.when(F.col("label") != 7, e).alias("text_vec"), F.when(F.col("label") != 3, rotated).alias("image_vec"),
    )


def dish_search(t: Tables, k: int = 5):
    rows = two_modalities(t)
    cat = retrieval.build_catalogue(rows, "dish", "vec_id", DIM)
    hits = retrieval.full_fusion_top_k(
        rows.select(F.col("vec_id").alias("query_id"), "text_vec", "image_vec"),
        cat.select(F.col("dish").alias("doc_id"), "text_vec", "image_vec"), k, DIM)
    truth = rows.select(F.col("vec_id").alias("query_id"), F.col("dish").alias("doc_id"))
    return stage(hits), truth, cat


@query("V1_normalize", f"""WITH {VECTORS}
SELECT vec_id, unnest(range(64)) AS pos, round(unnest(v), 6) AS value FROM unit""")
def v1(t: Tables):
    return t.embeddings.select("vec_id", F.posexplode(normalize("embedding")).alias("pos", "value")).select(
        "vec_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query("V2_cosine", f"""WITH {TWO}
SELECT vec_id, round(list_inner_product(tv, iv), 6) AS cosine FROM two""")
def v2(t: Tables):
    r = two_modalities(t)
    return r.select("vec_id", F.round(cosine(zero_fill("text_vec", DIM), zero_fill("image_vec", DIM)), 6).alias("cosine"))


@query("V3_mean_pool", """WITH vecs AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
pooled AS (SELECT vec_id, list_transform(range(8), lambda d: list_sum(list_transform(range(8),
   lambda i: CASE WHEN i < label THEN e[i * 8 + d + 1] ELSE 0 END)) / greatest(least(label, 8)::DOUBLE, 1e-9)) AS p FROM vecs)
SELECT vec_id, unnest(range(8)) AS pos,
       round(unnest(list_transform(p, lambda x: CASE WHEN list_inner_product(p, p) > 0 THEN x / sqrt(list_inner_product(p, p)) ELSE 0 END)), 6) AS value
FROM pooled""")
def v3(t: Tables):
    # the vector read as eight token vectors of width eight, the first `label` of them valid
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i < F.col("label")).cast("int"))
    pooled = t.embeddings.select("vec_id", tokens.alias("tokens"), mask.alias("mask"))
    return pooled.select("vec_id", F.posexplode(mean_pool("tokens", "mask")).alias("pos", "value")).select(
        "vec_id", F.col("pos").cast("long").alias("pos"), (F.round("value", 6) + 0.0).alias("value"))


@query("V4_zero_fill", f"""WITH {TWO}
SELECT vec_id, has_t, has_i, round(list_sum(tv), 6) AS text_sum, round(list_sum(iv), 6) AS image_sum FROM two""")
def v4(t: Tables):
    def total(c):
        return F.round(F.aggregate(normalize(zero_fill(c, DIM)), F.lit(0.0), lambda a, x: a + x), 6)
    return two_modalities(t).select(
        "vec_id", F.col("text_vec").isNotNull().alias("has_t"), F.col("image_vec").isNotNull().alias("has_i"),
        total("text_vec").alias("text_sum"), total("image_vec").alias("image_sum"))


@query("V5_build_catalogue", f"""WITH {CATALOGUE}
SELECT dish, unnest(range(64)) AS pos, round(unnest(tv), 6) AS text_value, round(unnest(iv), 6) AS image_value FROM cat""")
def v5(t: Tables):
    cat = retrieval.build_catalogue(two_modalities(t), "dish", "vec_id", DIM)
    return cat.select("dish", F.posexplode(F.arrays_zip("text_vec", "image_vec")).alias("pos", "z")).select(
        "dish", F.col("pos").cast("long").alias("pos"), F.round("z.text_vec", 6).alias("text_value"),
        F.round("z.image_vec", 6).alias("image_value"))


@query("V6_top_k", f"""WITH {VECTORS}
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 5""")
def v6(t: Tables):
    return search(t, 5).withColumn("score", F.round("score", 6))


@query("T3_top_k_default", f"""WITH {TWO}, s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_inner_product(a.iv, b.iv), 12) AS score
  FROM two a CROSS JOIN two b WHERE a.has_i)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5""")
def t3(t: Tables):
    rows = two_modalities(t)
    unit = normalize(zero_fill("image_vec", DIM)).alias("vec")
    q = rows.filter(F.col("image_vec").isNotNull()).select(F.col("vec_id").alias("query_id"), unit)
    return retrieval.top_k(q, rows.select(F.col("vec_id").alias("doc_id"), unit)).withColumn("score", F.round("score", 6))


@query("J11_query_by_catalogue", f"""WITH {VECTORS}
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 3""")
def j11(t: Tables):
    # small blocks, so that routing between several cells is exercised at any scale
    return search(t, 3, item_rows=128, query_rows=256).withColumn("score", F.round("score", 6))


@query("V7_late_fusion", f"""WITH {TWO}, ts AS (
  SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_inner_product(a.tv, b.tv), 12) AS score FROM two a CROSS JOIN two b WHERE a.has_t),
im AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_inner_product(a.iv, b.iv), 12) AS score FROM two a CROSS JOIN two b WHERE a.has_i),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM ts) WHERE r <= 5
  UNION ALL SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM im) WHERE r <= 5),
summed AS (SELECT query_id, doc_id, sum(score) AS score FROM hits GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM summed) WHERE rank <= 5""")
def v7(t: Tables):
    rows = two_modalities(t)

    def side(col, key, only=None):
        src = rows if only is None else rows.filter(F.col(only).isNotNull())
        return src.select(F.col("vec_id").alias(key), normalize(zero_fill(col, DIM)).alias("vec"))

    fused = retrieval.fused_top_k(
        side("text_vec", "query_id", "text_vec"), side("image_vec", "query_id", "image_vec"),
        side("text_vec", "doc_id"), side("image_vec", "doc_id"), 5)
    return fused.withColumn("score", F.round("score", 6))


@query("J15_sum_scores", f"""WITH {VECTORS}, h AS (
  SELECT query_id, doc_id, score FROM ranked WHERE rank <= 5 UNION ALL SELECT query_id, doc_id, score FROM ranked WHERE rank <= 3)
SELECT query_id, doc_id, round(sum(score), 6) AS score FROM h GROUP BY ALL""")
def j15(t: Tables):
    hits = search(t, 5)
    return joins.sum_scores(hits.drop("rank"), hits.filter("rank <= 3").drop("rank")).withColumn("score", F.round("score", 6))


@query("V8_full_fusion", f"""WITH {CATALOGUE}
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM full_ranked WHERE rank <= 5""")
def v8(t: Tables):
    return dish_search(t)[0].withColumn("score", F.round("score", 6))


@query("V9_hit_rate", f"""WITH {VECTORS}, first AS (
  SELECT query_id, min(rank) FILTER (rel > 0 AND rank <= 10) AS r FROM ranked GROUP BY query_id HAVING max(rel) = 1)
SELECT k, count(*) AS n_queries, round(avg(CASE WHEN r <= k THEN 1.0 ELSE 0.0 END), 6) AS recall
FROM first, (SELECT unnest([1, 5, 10]) AS k) GROUP BY k""")
def v9(t: Tables):
    hits = search(t, 10)
    return metrics.hit_rates(hits, judgements(t)).withColumn("recall", F.round("recall", 6))


@query("V10_true_label_recall", f"""WITH {CATALOGUE}, r AS (
  SELECT query_id, min(rank) FILTER (doc_id = truth AND rank <= 5) AS rank FROM full_ranked GROUP BY query_id)
SELECT count(*) AS n_queries, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1,
       round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5 FROM r""")
def v10(t: Tables):
    hits, truth, _ = dish_search(t)
    return metrics.true_label_rates(hits, truth).withColumns(
        {c: F.round(c, 6) for c in ("recall_1", "recall_5")})


@query("V11_ndcg", f"""WITH {VECTORS}, top AS (SELECT * FROM ranked WHERE rank <= 20),
d AS (SELECT query_id, sum(rel / log2(rank + 1)) AS dcg FROM top WHERE rank <= 10 GROUP BY 1),
i AS (SELECT query_id, sum(rel / log2(br + 1)) AS idcg FROM (
   SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC) AS br FROM ranked) WHERE br <= 10 GROUP BY 1 HAVING max(rel) = 1)
SELECT query_id, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg FROM d JOIN i USING (query_id)""")
def v11(t: Tables):
    # the ideal uses all judgements of a query, retrieved or not
    hits = search(t, 20)
    return metrics.ndcg_per_query(hits, judgements(t), 10).withColumn("ndcg", F.round("ndcg", 6))


@query("V12_truncated_ndcg", f"""WITH {CATALOGUE}, top AS (SELECT query_id, rank, CASE WHEN doc_id = truth THEN 1.0 ELSE 0.0 END AS rel FROM full_ranked WHERE rank <= 5),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC) AS br FROM top),
s AS (SELECT query_id, sum(rel / log2(rank + 1)) AS dcg, sum(rel / log2(br + 1)) AS idcg FROM b GROUP BY 1)
SELECT query_id, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg FROM s""")
def v12(t: Tables):
    hits, truth, _ = dish_search(t)
    return metrics.truncated_ndcg_per_query(hits, truth.withColumn("rel", F.lit(1)), 5).withColumn(
        "ndcg", F.round("ndcg", 6))


@query("V13_median_rank", f"""WITH {VECTORS}, r AS (
  SELECT query_id, min(rank) AS rank FROM ranked WHERE rel > 0 AND rank <= 20 GROUP BY 1)
SELECT coalesce(median(rank), 0)::DOUBLE AS median_rank FROM r""")
def v13(t: Tables):
    hits = search(t, 20)
    return metrics.median_rank(hits, judgements(t))


@query("W4_rank", f"""WITH {VECTORS}
SELECT query_id, doc_id, rank FROM ranked WHERE rank <= 10""")
def w4(t: Tables):
    return windows.rank_results(search(t, 10).drop("rank")).select("query_id", "doc_id", "rank")


@query("W5_first_relevant", f"""WITH {VECTORS}
SELECT query_id, min(rank) AS rank FROM ranked WHERE rel > 0 AND rank <= 10 GROUP BY 1""")
def w5(t: Tables):
    hits = search(t, 10)
    return windows.first_relevant_rank(hits, judgements(t))


@query("J14_judge_results", f"""WITH {VECTORS}
SELECT query_id, doc_id, rel FROM ranked WHERE rank <= 5""")
def j14(t: Tables):
    hits = search(t, 5)
    positive = judgements(t)
    return joins.judge_results(hits, positive).select("query_id", "doc_id", "rel")


@query("U3_names_in_any", f"""WITH {TWO} SELECT DISTINCT dish FROM two WHERE has_t OR has_i""")
def u3(t: Tables):
    rows = two_modalities(t)
    return retrieval.names_in_any(
        rows.filter(F.col("text_vec").isNotNull()), rows.filter(F.col("image_vec").isNotNull()), "dish")


@query("U5_overlap", f"""WITH {VECTORS}
SELECT query_id, count(*) FILTER (rank <= 5 AND rel = 1) AS n_overlap FROM ranked WHERE rank <= 10 GROUP BY 1""")
def u5(t: Tables):
    hits = search(t, 10)
    retrieved = hits.filter("rank <= 5").groupBy("query_id").agg(F.collect_list("doc_id").alias("retrieved"))
    relevant = judgements(t).groupBy("query_id").agg(F.collect_list("doc_id").alias("relevant"))
    lists = retrieved.join(relevant, "query_id", "left").withColumn("relevant", F.coalesce("relevant", F.array().cast("array<long>")))
    return lists.select("query_id", F.size(setops.overlap("relevant", "retrieved")).cast("long").alias("n_overlap"))


@query("V14_p95", """WITH s AS (SELECT list_sort(list(value)) AS v, count(*) AS n FROM events),
h AS (SELECT v, (n + 1) * 0.95::DOUBLE AS p, greatest(1, least(floor((n + 1) * 0.95::DOUBLE)::BIGINT, n - 1)) AS j FROM s)
SELECT round(v[j] * (1 - (p - j)) + v[j + 1] * (p - j), 6) AS p95_ms FROM h""")
def v14(t: Tables):
    return metrics.p95_latency(t.events, "value").withColumn("p95_ms", F.round("p95_ms", 6))


@query("V15_throughput", """SELECT count(*) AS n_calls, round(sum(value) / 1000.0, 6) AS seconds,
round(count(*) / (sum(value) / 1000.0), 4) AS qps FROM (SELECT * FROM events ORDER BY event_id OFFSET 3)""")
def v15(t: Tables):
    return metrics.throughput(t.events, "value", "event_id", warmup=3).withColumns(
        {"seconds": F.round("seconds", 6), "qps": F.round("qps", 4)})


@query("V16_leaderboard", """SELECT event_type AS dataset, 'user ' || user_id AS model, round(avg(value), 6) AS mean,
max(value) AS best, min(value) AS worst FROM events GROUP BY 1, 2""")
def v16(t: Tables):
    wide = t.events.groupBy("event_type", "user_id").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("best"), F.min("value").alias("worst"))
    long = wide.select(
        F.col("event_type").alias("dataset"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("model"),
        "mean", "best", "worst").unpivot(["dataset", "model"], ["mean", "best", "worst"], "metric", "value")
    return metrics.leaderboard(long, ["mean", "best", "worst"])


@query("V17_peek", f"""WITH {VECTORS}, top AS (SELECT * FROM ranked WHERE rank <= 10),
rel AS (SELECT query_id, count(*) AS n_relevant, array_to_string(list_sort(list(doc_id))[1:10], ',') AS relevant_ids FROM ranked WHERE rel = 1 GROUP BY 1),
hit AS (SELECT query_id, string_agg(doc_id, ',' ORDER BY rank) FILTER (rank <= 5) AS retrieved_ids,
        count(*) FILTER (rank <= 5 AND rel = 1) AS n_overlap FROM top GROUP BY 1)
SELECT query_id, n_relevant, relevant_ids, retrieved_ids, n_overlap FROM rel JOIN hit USING (query_id)""")
def v17(t: Tables):
    hits = search(t, 10)
    corpus = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("title"))
    seen = metrics.peek(hits, judgements(t), corpus, 5)
    return seen.select(
        "query_id", "n_relevant", F.array_join(F.col("relevant_ids").cast("array<string>"), ",").alias("relevant_ids"),
        F.array_join(F.transform("retrieved", lambda r: r["doc_id"].cast("string")), ",").alias("retrieved_ids"),
        F.size("overlap").cast("long").alias("n_overlap"))


@query("V18_evaluation_row", f"""WITH {CATALOGUE}, top AS (SELECT query_id, rank, CASE WHEN doc_id = truth THEN 1.0 ELSE 0.0 END AS rel FROM full_ranked WHERE rank <= 5),
r AS (SELECT query_id, max(rel) FILTER (rank = 1) AS h1, max(rel) AS h5,
      coalesce(max(CASE WHEN rel > 0 THEN 1 / log2(rank + 1) END), 0) AS g FROM top GROUP BY 1)
SELECT 'rotated' AS model_path, 'embeddings' AS benchmark, round(avg(h1), 6)::DOUBLE AS r_at_1, round(avg(h5), 6)::DOUBLE AS r_at_5,
       round(avg(g), 6) AS ndcg_at_5, count(*) AS total_queries, (SELECT count(*) FROM cat) AS total_dishes FROM r""")
def v18(t: Tables):
    hits, truth, cat = dish_search(t)
    row = metrics.evaluation_row(hits, truth, "rotated", "embeddings", cat)
    return row.withColumns({c: F.round(c, 6) for c in ("r_at_1", "r_at_5", "ndcg_at_5")})


def letter_counts(texts: list[str]):
    """A stand-in encoder: text length and number of letters e."""
    import numpy as np

    return np.array([[len(x), x.count("e")] for x in texts], dtype=np.float32)


@query("E1_encode", "SELECT doc_id, length(text) AS n_chars, length(text) - length(replace(text, 'e', '')) AS n_e FROM documents")
def e1(t: Tables):
    encoded = retrieval.encode(t.documents, "text", letter_counts)
    return encoded.select("doc_id", F.get("vec", F.lit(0)).cast("long").alias("n_chars"), F.get("vec", F.lit(1)).cast("long").alias("n_e"))
