"""Round trips through the readers and writers, and catalogue loading."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from relish.operators import aggregates, generation
from relish.operators.store import Store
from relish.plans.dedup_queries import greedy, vector_pairs
from relish.plans.generation_queries import members
from relish.plans.registry import Tables, query
from relish.plans.store_queries import at
from relish.plans.store_sql import store_ctes, store_of
from relish.session import shared_dir
from relish.sources import csv_ranges, intent_sets, readers, writers

W = "WITH " + store_ctes()


def out(t: Tables) -> str:
    return f"{shared_dir(t.spark)}/relish-out-{uuid.uuid4().hex}"


@query("S1_read_csv", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def s1(t: Tables):
    path = out(t)
    writers.write_csv(t.documents, path)
    return readers.read_csv(t.spark, path, t.documents.schema)


@query("S1_read_csv_ranges", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def s1_ranges(t: Tables):
    path = out(t)
    writers.write_csv(t.documents, path)
    return csv_ranges.read_csv_ranges(t.spark, path, t.documents.schema)


@query("S2_read_parquet", "SELECT p_partkey, p_name, p_retailprice FROM part")
def s2(t: Tables):
    return readers.read_parquet(t.spark, f"{t.folder}/part.parquet").select("p_partkey", "p_name", "p_retailprice")


@query("S3_read_delimited", "SELECT url AS query FROM pages")
def s3(t: Tables):
    path = out(t)
    t.pages.select("url").write.text(path)
    return readers.read_delimited(t.spark, path, ["query"])


@query("S4_get_table", f"{W} SELECT id, consumable_name FROM s_consumable WHERE consumable_type = 'SMALL' ORDER BY id DESC LIMIT 50")
def s4(t: Tables):
    return readers.get_table(store_of(t), "consumable", 50, "id, consumable_name", "consumable_type = 'SMALL'", "id DESC")


@query("S5_execute_query", f"{W} SELECT q.mlflow_run_id, count(*) AS n FROM s_example e JOIN s_query q ON q.id = e.query_id WHERE q.data_gen_hash = 'g4' GROUP BY 1")
def s5(t: Tables):
    return readers.execute_query(
        store_of(t), "SELECT q.mlflow_run_id, count(*) AS n FROM example e JOIN query q ON q.id = e.query_id WHERE q.data_gen_hash = :h GROUP BY 1", {"h": "g4"})


@query("S6_load_intent_sets", """WITH p AS (SELECT source || ' ' || doc_id AS intent, row_number() OVER (ORDER BY md5('42:' || doc_id)) - 1 AS pos, count(*) OVER () // 7 AS per FROM documents)
SELECT (least(pos // per, 6) + 1)::INT AS set_number, (pos - least(pos // per, 6) * per)::INT AS pos, intent FROM p""")
def s6(t: Tables):
    # write the sets in the one-file-per-set layout, then load that folder
    folder = out(t)
    intent_sets.export_intent_set_files(members(t), folder, "2025-01-01", 7)
    return readers.load_intent_sets(t.spark, folder)[0]


@query("S7_retrieval_data", """SELECT doc_id::VARCHAR AS doc_id, '' AS title, CASE WHEN lang = 'de' THEN '' ELSE text END AS text FROM documents""")
def s7(t: Tables):
    base = out(t)
    t.documents.select(F.col("doc_id").alias("_id"), F.when(F.col("lang") != "de", F.col("text")).alias("text")).write.parquet(base + "/corpus")
    t.benchmark.select(F.col("item_id").alias("_id"), "text").write.parquet(base + "/queries")
    t.labels.select(F.lit("q").alias("query_id"), F.col("doc_id").alias("corpus_id")).write.parquet(base + "/qrels")
    return readers.load_retrieval_data(t.spark, base + "/corpus", base + "/queries", base + "/qrels")[0]


@query("S7_qrels_default_score", "SELECT 'q' AS query_id, doc_id::VARCHAR AS doc_id, 1 AS rel FROM labels")
def s7_qrels(t: Tables):
    return readers.clean_qrels(t.labels.select(F.lit("q").alias("query_id"), F.col("doc_id").alias("corpus_id")))


@query("S8_table_counts", f"{W} SELECT 'query' AS table_name, count(*) AS row_count FROM s_query UNION ALL SELECT 'consumable', count(*) FROM s_consumable UNION ALL SELECT 'example', count(*) FROM s_example UNION ALL SELECT 'label', count(*) FROM s_label UNION ALL SELECT 'labeler', count(*) FROM s_labeler")
def s8(t: Tables):
    return aggregates.table_counts(**store_of(t).tables())


@query("S9_write_csv", "SELECT conv_id, turn, role, text FROM conversations")
def s9(t: Tables):
    path = out(t)
    writers.write_csv(t.conversations, path)
    return readers.read_csv(t.spark, path, t.conversations.schema)


@query("S10_write_parquet", "SELECT event_id, user_id, value, props FROM events")
def s10(t: Tables):
    path = out(t)
    writers.write_parquet(t.events.select("event_id", "user_id", "value", "props"), path)
    return readers.read_parquet(t.spark, path)


@query("S11_write_json_lines", "SELECT page_id, url, html FROM pages")
def s11(t: Tables):
    path = out(t)
    writers.write_json_lines(t.pages, path)
    return t.spark.read.schema(t.pages.schema).json(path)


@query("S11_write_tsv", "SELECT doc_id, quality, toxic FROM labels")
def s11_tsv(t: Tables):
    path = out(t)
    writers.write_tsv(t.labels, path)
    return t.spark.read.schema(t.labels.schema).option("header", True).option("sep", "\t").csv(path)


@query("S12_append_results", "SELECT lang, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT source, count(*) FROM documents GROUP BY 1")
def s12(t: Tables):
    path = out(t)
    for key in ("lang", "source"):
        writers.append_results(t.documents.groupBy(F.col(key).alias("lang")).agg(F.count(F.lit(1)).alias("n")), path)
    return readers.read_csv(t.spark, path, "lang STRING, n LONG")


@query("S15_export_intent_sets", """WITH p AS (SELECT lang AS theme, source || ' ' || doc_id AS intent, row_number() OVER (ORDER BY md5('42:' || doc_id)) - 1 AS pos, count(*) OVER () // 7 AS per FROM documents)
SELECT pos, intent, theme, (least(pos // per, 6) + 1)::INT AS set_number FROM p""")
def s15(t: Tables):
    folder, rows = out(t), members(t)
    writers.export_intent_sets(rows, generation.intent_set_metadata(rows, "2025-01-01"), folder, "2025-01-01")
    return readers.read_exported_intent_sets(t.spark, folder)


@query("S15_intent_set_files", """WITH p AS (SELECT lang AS theme, row_number() OVER (ORDER BY md5('42:' || doc_id)) - 1 AS pos, count(*) OVER () // 7 AS per FROM documents),
n AS (SELECT (least(pos // per, 6) + 1)::INT AS set_number, coalesce(theme, '') AS theme, count(*) AS n FROM p GROUP BY 1, 2)
SELECT set_number, '2025-01-01' AS creation_date, 42 AS seed, theme, n::INT AS n, (sum(n) OVER (PARTITION BY set_number))::BIGINT AS total_intents FROM n""")
def s15_files(t: Tables):
    folder = out(t)
    intent_sets.export_intent_set_files(members(t), folder, "2025-01-01", 7)
    about = readers.load_intent_sets(t.spark, folder)[1]
    return about.select("set_number", "creation_date", "seed", F.explode("theme_distribution").alias("theme", "n"), "total_intents")


@query("S16_export_matches", "SELECT conv_id AS consumable_id, text AS intent FROM conversations WHERE role = 'user'")
def s16(t: Tables):
    folder = out(t)
    m = t.conversations.filter("role = 'user'").select(F.col("conv_id").alias("consumable_id"), F.col("text").alias("intent"))
    writers.export_matches(m, m.withColumnRenamed("intent", "query"), folder)
    return t.spark.read.schema("consumable_id LONG, intent STRING").json(f"{folder}/matches_json")


# ------------------------------------------------------------------ catalogue loading

def raw_catalogue(t: Tables):
    """Documents as a raw catalogue: language and source as the dish, the text as its ingredients."""
    return t.documents.select(
        "doc_id", F.when(F.col("doc_id") % 29 != 7, F.concat(F.lit("http://img/"), F.col("doc_id").cast("string"))).alias("image_url"),
        F.when(F.col("source") != "src3", F.concat(F.lit(" "), "lang", F.lit(" "), "source")).alias("dish_name"),
        F.when(F.col("lang") == "es", F.lit("nan")).otherwise(F.col("lang")).alias("food_type"), F.col("text").alias("ingredients"),
        F.when(F.col("n_chars") % 2 == 0, F.lit('{"kcal": 1}')).otherwise("{").alias("nutritional_profile"), F.lit(" fried ").alias("cooking_method"))


PREPARED = """prep AS (SELECT doc_id, 'http://img/' || doc_id AS image_url, lang || ' ' || source AS consumable_name, CASE WHEN lang <> 'es' THEN lang END AS consumable_type,
  CASE WHEN n_chars % 2 = 0 THEN '{"kcal": 1}' END AS consumable_nutritional_profile, 'fried' AS consumable_cooking_method FROM documents WHERE doc_id % 29 <> 7 AND source <> 'src3')"""


@query("L14_prepare_consumables", f"WITH {PREPARED} SELECT * FROM prep")
def l14(t: Tables):
    return writers.prepare_consumables(raw_catalogue(t), ["doc_id"]).drop("consumable_ingredients")


def with_gaps(t: Tables):
    """Prepared rows of which some lack a name or an image."""
    return t.documents.select(
        "doc_id", F.when(F.col("doc_id") % 29 != 7, F.lit("http://img")).alias("image_url"),
        F.when(F.col("lang") != "es", F.col("source")).alias("consumable_name"))


GAPS = "g AS (SELECT doc_id, doc_id % 29 = 7 AS no_image, lang = 'es' AS no_name, (row_number() OVER (ORDER BY doc_id) - 1) AS pos FROM documents)"


@query("S13_insert_consumables", f"""WITH {GAPS} SELECT pos // 50 AS batch, count(*) AS records, count(*) FILTER (NOT no_image AND NOT no_name) AS inserted, count(*) FILTER (no_image OR no_name) AS rejected,
min(CASE WHEN no_image AND no_name THEN 'not_null consumable_name, not_null image_url' WHEN no_image THEN 'not_null image_url' WHEN no_name THEN 'not_null consumable_name' END) AS error FROM g GROUP BY 1""")
def s13(t: Tables):
    return writers.insert_consumables(store_of(t), with_gaps(t), "doc_id", at(), 50)[1]


@query("S13_insert_totals", f"""WITH {GAPS}, b AS (SELECT pos // 50 AS batch, count(*) AS n, count(*) FILTER (no_image OR no_name) AS r FROM g GROUP BY 1)
SELECT sum(n)::BIGINT AS total_records, count(*) FILTER (r = 0) AS successful_batches, count(*) FILTER (r > 0) AS failed_batches, sum(n - r)::BIGINT AS total_inserted FROM b""")
def s13_totals(t: Tables):
    return writers.insert_totals(writers.insert_consumables(store_of(t), with_gaps(t), "doc_id", at(), 50)[1])


@query("L15_load_catalogue", """WITH RECURSIVE rows AS (SELECT doc_id AS id, n_chars, lang || ' ' || source AS block,
 list_distinct(list_filter(regexp_split_to_array(lower(lang || ' ' || source || chr(10) || trim(text, ' ' || chr(10))), '\\s+'), lambda x: x <> '')) AS words FROM documents WHERE source <> 'src3'),
tok AS (SELECT id, block, unnest(words) AS word FROM rows),
shared AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM tok x JOIN tok y ON x.block = y.block AND x.word = y.word AND x.id < y.id GROUP BY 1, 2),
pairs AS (SELECT a, b FROM shared JOIN rows ra ON ra.id = a JOIN rows rb ON rb.id = b WHERE n / (len(ra.words) + len(rb.words) - n)::DOUBLE >= 0.6),
""" + greedy("rows", "pairs") + """, kept AS (SELECT id FROM decided WHERE kept_id IS NULL)
SELECT (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY id) AS id, 'http://img/' || id AS image_url, block AS consumable_name FROM kept JOIN rows USING (id) WHERE id % 29 <> 7""")
def l15(t: Tables):
    store: Store = store_of(t)
    loaded, _, _ = writers.load_catalogue(store, raw_catalogue(t), "doc_id", at(), 0.6)
    return loaded.consumable.filter("image_url NOT LIKE '%example%'").select("id", "image_url", "consumable_name")


@query("L15_load_catalogue_vectors", f"""WITH RECURSIVE {vector_pairs(0.25, 'label')}, {greedy('rows', 'pairs')}, kept AS (SELECT id FROM decided WHERE kept_id IS NULL)
SELECT (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY id) AS id, 'http://vec/' || id AS image_url, 'dish ' || block AS consumable_name
FROM kept JOIN rows USING (id)""")
def l15_vectors(t: Tables):
    # dishes of one name are compared by their vectors; these are far apart, so a low threshold is needed for links
    raw = t.embeddings.select(
        "vec_id", "embedding", F.concat(F.lit("http://vec/"), F.col("vec_id").cast("string")).alias("image_url"),
        F.concat(F.lit("dish "), F.col("label").cast("string")).alias("dish_name"), F.lit("[]").alias("ingredients"))
    loaded, _, _ = writers.load_catalogue(store_of(t), raw, "vec_id", at(), 0.25, vec="embedding")
    return loaded.consumable.filter("image_url LIKE 'http://vec/%'").select("id", "image_url", "consumable_name")
