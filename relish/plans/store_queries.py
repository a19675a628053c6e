"""The relevance store and its mutations over the store derived in ``store_sql``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relish.operators import aggregates, filters, joins, runs as run_ops, store as ops
from relish.operators.store import Store
from relish.plans.basic_queries import DIETS, diets
from relish.plans.registry import Tables, query
from relish.plans.store_sql import GENERATED_SQL, generated_rows, store_ctes, store_of
from relish.session import shared_dir
from relish.streaming import label_log

W = "WITH " + store_ctes()


def at():
    """The creation time given to new rows."""
    return F.to_timestamp(F.lit("2025-01-01 00:00:00"))
HUMAN = 1


def ids_of(store: Store, *tables: str) -> DataFrame:
    """Ids left in the named tables."""
    parts = [getattr(store, t).select(F.lit(t).alias("table_name"), "id") for t in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# the human label is the only one of labeler 1; the generator's is found by name
VIEW = f"""{W}, view AS (SELECT e.id AS example_id, e.query_id, e.consumable_id, e.example_gen_hash, q.query_content AS query, q.query_filters,
  c.consumable_name, c.consumable_ingredients, ai.esci_label AS ai_esci_label, ai.label_reason AS ai_label_reason,
  hu.esci_label AS human_esci_label, q.mlflow_run_id
FROM s_example e JOIN s_query q ON q.id = e.query_id JOIN s_consumable c ON c.id = e.consumable_id
LEFT JOIN s_labeler al ON al.name = e.example_gen_hash
LEFT JOIN s_label ai ON ai.example_id = e.id AND ai.labeler_id = al.id
LEFT JOIN s_label hu ON hu.example_id = e.id AND hu.labeler_id = 1)"""


@query("J1_annotation_view", f"""{VIEW} SELECT example_id, query_id, consumable_id, example_gen_hash, query, query_filters, consumable_name,
consumable_ingredients, ai_esci_label, ai_label_reason, human_esci_label FROM view WHERE mlflow_run_id = 'run_7'""")
def j1(t: Tables):
    return ops.annotation_view(store_of(t), HUMAN, "run_7", ordered=True).drop("created_at", "human_label_reason", "mlflow_run_id")


@query("J1_bulk_view", f"{VIEW} SELECT example_id, query_id, consumable_id, query, consumable_name, ai_esci_label, human_esci_label FROM view")
def j1_bulk(t: Tables):
    return ops.annotation_view(store_of(t), HUMAN, bulk=True, ordered=True)


@query("P6_reviewed_only", f"{VIEW} SELECT example_id, human_esci_label FROM view WHERE human_esci_label IS NOT NULL AND human_esci_label <> ''")
def p6(t: Tables):
    return filters.reviewed_only(ops.annotation_view(store_of(t), HUMAN, bulk=True)).select("example_id", "human_esci_label")


@query("P7_drop_trivial_matches", f"""{VIEW}, s AS (SELECT mlflow_run_id, count(*) FILTER (ai_esci_label = 'E') * 100.0 / nullif(count(ai_esci_label), 0) AS e FROM view GROUP BY 1)
SELECT example_id FROM view JOIN s USING (mlflow_run_id) WHERE NOT (coalesce(e, 0) > 70 AND coalesce(lower(query) = lower(consumable_name), false))""")
def p7(t: Tables):
    view = ops.annotation_view(store_of(t), HUMAN)
    return filters.drop_trivial_matches_by_run(view, "mlflow_run_id").select("example_id")


@query("P7_one_run", f"""{VIEW}, r AS (SELECT * FROM view WHERE mlflow_run_id = 'run_19')
SELECT example_id FROM r WHERE NOT ((SELECT count(*) FILTER (ai_esci_label = 'E') * 100.0 / count(ai_esci_label) FROM r) > 70 AND lower(query) = lower(consumable_name))""")
def p7_one(t: Tables):
    return filters.drop_trivial_matches(ops.annotation_view(store_of(t), HUMAN, "run_19")).select("example_id")


def broken_store(t: Tables) -> Store:
    """The store with wrong labels, repeated pairs, missing items and missing image addresses."""
    s = store_of(t, "query", "example", "label")
    extra = s.example.filter("example_gen_hash = 'g5'").withColumn("id", F.col("id") + 5000000)
    return s.replace(
        label=s.label.withColumn("esci_label", F.when(F.col("label_reason") == "qty 50", "X").otherwise(F.col("esci_label"))),
        example=s.example.unionByName(extra),
        consumable=s.consumable.filter("consumable_name NOT LIKE 'old%'").withColumn(
            "image_url", F.when(F.col("consumable_type") != "PROMO", F.col("image_url"))))


@query("P11_constraint_violations", f"""{W}, ex AS (SELECT * FROM s_example UNION ALL SELECT * REPLACE (id + 5000000 AS id) FROM s_example WHERE example_gen_hash = 'g5')
SELECT 'label' AS table_name, 'check' AS rule, 'esci_label' AS column_name, id FROM s_label WHERE label_reason = 'qty 50'
UNION ALL SELECT 'consumable', 'not_null', 'image_url', id FROM s_consumable WHERE consumable_type = 'PROMO' AND consumable_name NOT LIKE 'old%'
UNION ALL SELECT 'example', 'unique', 'query_id,consumable_id', id + 5000000 FROM s_example WHERE example_gen_hash = 'g5'
UNION ALL SELECT 'example', 'foreign_key', 'consumable_id', id FROM ex WHERE consumable_id IN (SELECT id FROM s_consumable WHERE consumable_name LIKE 'old%')
UNION ALL SELECT 'example', 'foreign_key', 'query_id', id FROM ex WHERE query_id NOT IN (SELECT id FROM s_query)""")
def p11(t: Tables):
    return ops.store_violations(broken_store(t))


@query("P17_labeler_id", f"{W} SELECT l.labeler_id, count(*) AS n FROM s_label l WHERE l.labeler_id = (SELECT min(id) FROM s_labeler WHERE name = 'g3') GROUP BY 1")
def p17(t: Tables):
    s = store_of(t)
    found = filters.labeler_id(s.labeler, "g3")
    return s.label.filter(F.col("labeler_id") == found).groupBy("labeler_id").agg(F.count(F.lit(1)).alias("n"))


@query("A15_label_coverage", f"{VIEW} SELECT count(ai_esci_label) AS ai_labels, count(human_esci_label) AS human_labels FROM view")
def a15(t: Tables):
    return aggregates.label_coverage(ops.annotation_view(store_of(t), HUMAN, bulk=True))


@query("J4_split_known", f"WITH {GENERATED_SQL} SELECT DISTINCT consumable_id, consumable_id IN (SELECT p_partkey FROM part) AS known FROM gen")
def j4(t: Tables):
    known, missing = joins.split_known(generated_rows(t), "consumable_id", t.part, "p_partkey")
    return known.withColumn("known", F.lit(True)).unionByName(missing.withColumn("known", F.lit(False)))


@query("J5_attach_labels", f"""WITH {GENERATED_SQL}, {DIETS}
SELECT row_id, coalesce(is_vegetarian::INT + is_vegan::INT + is_gluten_free::INT + is_dairy_free::INT + is_nut_free::INT + is_lacto_vegetarian::INT + is_pescetarian::INT + is_lacto_ovo_vegetarian::INT, 0) AS n_labels
FROM gen LEFT JOIN c ON c.p_partkey = gen.consumable_id""")
def j5(t: Tables):
    from relish.functions.dietary import diet_labels
    labels = diets(t).select(F.col("p_partkey").alias("consumable_id"), diet_labels().alias("labels"))
    return joins.attach_labels(generated_rows(t), labels).select("row_id", F.size("labels").alias("n_labels"))


@query("J6_attach_first", """WITH f AS (SELECT p_name, arg_min(p_brand, p_partkey) AS brand, arg_min(p_size, p_partkey) AS size FROM part WHERE p_type <> 'SMALL' GROUP BY 1)
SELECT p.p_partkey, f.brand, f.size FROM part p LEFT JOIN f USING (p_name)""")
def j6(t: Tables):
    items = t.part.filter("p_type <> 'SMALL'").select("p_partkey", "p_name", F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return joins.attach_first(t.part.select("p_partkey", "p_name"), items, "p_name", ["brand", "size"], "p_partkey").drop("p_name")


@query("J7_orphans", f"{W} SELECT count(*) AS orphaned_count FROM s_example WHERE query_id NOT IN (SELECT id FROM s_query WHERE mlflow_run_id <> 'run_3')")
def j7(t: Tables):
    s = store_of(t)
    return joins.orphan_count(s.example, "query_id", s.query.filter("mlflow_run_id <> 'run_3'"), "id")


REMAP = "m AS (SELECT p_partkey AS old, min(p_partkey) OVER (PARTITION BY p_name) AS new FROM part WHERE p_size < 25)"


def remapping(t: Tables) -> DataFrame:
    small = t.part.filter("p_size < 25")
    first = small.groupBy("p_name").agg(F.min("p_partkey").alias("new"))
    return small.join(first, "p_name").select(F.col("p_partkey").alias("old"), "new")


@query("J8_remap", f"WITH {REMAP} SELECT l_orderkey, l_linenumber, l_suppkey, coalesce(new, l_partkey) AS l_partkey FROM lineitem LEFT JOIN m ON old = l_partkey")
def j8(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return joins.remap(rows, "l_partkey", remapping(t), "old", "new")


@query("J8_remap_or_null", f"WITH {REMAP} SELECT l_orderkey, l_linenumber, l_suppkey, new AS l_partkey FROM lineitem LEFT JOIN m ON old = l_partkey")
def j8_null(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return joins.remap(rows, "l_partkey", remapping(t), "old", "new", keep_unmapped=False)


@query("J13_label_count", f"{W} SELECT count(*) AS n_labels FROM s_label l JOIN s_example e ON e.id = l.example_id WHERE e.example_gen_hash = 'g2'")
def j13(t: Tables):
    s = store_of(t)
    return joins.label_count(s.example, s.label, F.col("example_gen_hash") == "g2")


# ------------------------------------------------------------------ promotion

PROMOTED = f"""{W}, {GENERATED_SQL},
v AS (SELECT *, row_number() OVER (ORDER BY run_id, row_id) AS rn FROM gen WHERE query IS NOT NULL AND consumable_id IN (SELECT id FROM s_consumable)),
owners AS (SELECT query, min(rn) AS rn FROM v GROUP BY 1),
newq AS (SELECT o.query, v.run_id, CASE WHEN v.query_filters IN ('{{}}', '{{broken') THEN NULL ELSE v.query_filters END AS query_filters,
  (SELECT max(id) FROM s_query) + row_number() OVER (ORDER BY o.query) AS id
  FROM owners o JOIN v ON v.rn = o.rn WHERE o.query NOT IN (SELECT query_content FROM s_query)),
qids AS (SELECT query, id FROM newq UNION ALL SELECT query_content, min(id) FROM s_query GROUP BY 1),
pairs AS (SELECT q.id AS query_id, v.consumable_id, min(v.rn) AS rn FROM v JOIN qids q ON q.query = v.query GROUP BY 1, 2),
newe AS (SELECT p.query_id, p.consumable_id, v.run_id, v.reasoning, (SELECT max(id) FROM s_example) + row_number() OVER (ORDER BY p.query_id, p.consumable_id) AS id
  FROM pairs p JOIN v ON v.rn = p.rn WHERE NOT EXISTS (SELECT 1 FROM s_example e WHERE e.query_id = p.query_id AND e.consumable_id = p.consumable_id))"""


def three_runs(t: Tables) -> DataFrame:
    """The runs whose generated rows come from ``generated_rows``."""
    return t.orders.groupBy((F.col("o_custkey") % 3).alias("k")).agg(F.min("o_orderdate").alias("start_time")).select(
        F.concat(F.lit("new_"), F.col("k").cast("string")).alias("run_id"), F.lit("Initial_Generation").alias("experiment_name"),
        F.concat(F.lit("run "), F.col("k").cast("string")).alias("run_name"),
        F.create_map(F.lit("data_gen_hash"), F.concat(F.lit("h"), F.col("k").cast("string")),
                     F.lit("generation_approach"), F.when(F.col("k") == 2, "intent").otherwise("initial"),
                     F.lit("output_type"), F.lit("enhanced_json"), F.lit("esci_label"), F.lit("S")).alias("params"),
        F.create_map(F.lit("data_status"), F.lit("approved")).alias("tags"),
        F.create_map(F.lit("total_runtime_seconds"), F.lit(1.0)).alias("metrics"),
        F.to_timestamp(F.lit("2025-01-01 00:00:00")).alias("start_time"),
        F.to_timestamp(F.lit("2025-01-01 01:00:00")).alias("end_time"))


def promoted(t: Tables, bridged: bool = False):
    return run_ops.promote_runs(store_of(t, "query", "example", "label"), three_runs(t), generated_rows(t), at(), bridged=bridged, dry_run=False)


@query("M1_promoted_queries", f"{PROMOTED} SELECT id, query AS query_content, query_filters, 'h' || substr(run_id, 5) AS data_gen_hash, run_id AS mlflow_run_id FROM newq")
def m1_queries(t: Tables):
    out, _, _ = promoted(t)
    return out.query.filter(F.col("mlflow_run_id").startswith("new_")).drop("created_at")


@query("M1_promoted_examples", f"{PROMOTED} SELECT id, query_id, consumable_id, 'h' || substr(run_id, 5) AS example_gen_hash, run_id FROM newe")
def m1_examples(t: Tables):
    out, _, _ = promoted(t)
    return out.example.filter(F.col("run_id").startswith("new_")).drop("created_at")


@query("M1_promoted_labels", f"""{PROMOTED} SELECT (SELECT max(id) FROM s_label) + id - (SELECT max(id) FROM s_example) AS id, id AS example_id,
110 + substr(run_id, 5)::INT AS labeler_id, 'S' AS esci_label, reasoning AS label_reason, 1.0::DOUBLE AS auto_label_score FROM newe""")
def m1_labels(t: Tables):
    out, _, _ = promoted(t)
    return out.label.filter("labeler_id >= 110").drop("created_at").withColumn(
        "auto_label_score", F.col("auto_label_score").cast("double"))


@query("M2_ensure_labelers", f"""{W} SELECT id, name, role, type FROM s_labeler UNION ALL SELECT 109 + row_number() OVER (ORDER BY h, a), h, 'labeler', 'synthetic_data_generation_' || a
FROM (SELECT DISTINCT 'g' || (o_custkey % 10) AS h, CASE WHEN o_orderstatus = 'F' THEN 'intent' ELSE 'initial' END AS a FROM orders) WHERE a = 'intent'""")
def m2(t: Tables):
    wanted = t.orders.select(
        F.concat(F.lit("g"), (F.col("o_custkey") % 10).cast("string")).alias("data_gen_hash"),
        F.when(F.col("o_orderstatus") == "F", "intent").otherwise("initial").alias("generation_approach"))
    return ops.ensure_labelers(store_of(t), wanted, at()).labeler.drop("created_at")


@query("M4_promote_runs", f"""{PROMOTED}, n AS (SELECT run_id, count(*) AS n FROM gen GROUP BY 1)
SELECT run_id, 'success' AS status, n AS records_processed, (SELECT count(*) FROM newq q WHERE q.run_id = n.run_id) AS queries_inserted,
(SELECT count(*) FROM newe e WHERE e.run_id = n.run_id) AS examples_inserted, (SELECT count(*) FROM newe e WHERE e.run_id = n.run_id) AS labels_inserted FROM n""")
def m4(t: Tables):
    return promoted(t)[2].drop("error")


@query("M4_status_after_bridged", """SELECT DISTINCT 'new_' || (o_custkey % 3) AS run_id, 'migrated_partial' AS data_status, 'bridged_only' AS migration_type FROM orders""")
def m4_status(t: Tables):
    _, after, _ = promoted(t, bridged=True)
    return after.select("run_id", run_ops.tag("data_status").alias("data_status"), run_ops.tag("migration_type").alias("migration_type"))


@query("A19_promotion_totals", f"""{PROMOTED} SELECT 'success' AS status, count(DISTINCT run_id) AS n_runs, count(*) AS records_processed,
(SELECT count(*) FROM newq) AS queries_inserted, (SELECT count(*) FROM newe) AS examples_inserted, (SELECT count(*) FROM newe) AS labels_inserted FROM gen""")
def a19(t: Tables):
    return aggregates.promotion_totals(promoted(t)[2])


@query("M5_rollback", f"""{W} SELECT 'example' AS table_name, id FROM s_example WHERE query_id NOT IN (SELECT id FROM s_query WHERE mlflow_run_id = 'run_5')
UNION ALL SELECT 'query', id FROM s_query WHERE mlflow_run_id <> 'run_5'
UNION ALL SELECT 'label', id FROM s_label WHERE labeler_id <> 1 AND example_id NOT IN (SELECT id FROM s_example WHERE query_id IN (SELECT id FROM s_query WHERE mlflow_run_id = 'run_5'))
UNION ALL SELECT 'labeler', id FROM s_labeler""")
def m5(t: Tables):
    s = store_of(t)
    generated_only = s.replace(label=s.label.filter(F.col("labeler_id") != HUMAN))
    out, _, _ = ops.rollback(generated_only, "g5", "run_5", "initial")
    return ids_of(out, "example", "query", "label", "labeler")


@query("M5_blocked_by_humans", f"""{W} SELECT id, labeler_id, example_id FROM s_label WHERE labeler_id = 1
AND example_id IN (SELECT id FROM s_example WHERE query_id IN (SELECT id FROM s_query WHERE mlflow_run_id = 'run_5'))""")
def m5_blocked(t: Tables):
    return ops.rollback(store_of(t), "g5", "run_5", "initial")[2]


# ------------------------------------------------------------------ deletions

RED = "SELECT id FROM s_consumable WHERE consumable_name LIKE 'red%'"


def red_items(s: Store) -> DataFrame:
    return filters.find_by_pattern(s.consumable, "consumable_name", "red").filter("consumable_name LIKE 'red%'").select("id")


PREVIEW = f"""{W}, red AS ({RED}), span AS (SELECT query_id, count(DISTINCT consumable_id) AS n FROM s_example GROUP BY 1),
lab AS (SELECT example_id, count(*) AS n FROM s_label GROUP BY 1),
pre AS (SELECT r.id, count(e.id) AS examples, coalesce(sum(lab.n), 0)::BIGINT AS labels, count(DISTINCT e.query_id) AS queries, count(DISTINCT CASE WHEN span.n = 1 THEN e.query_id END) AS orphaned_queries
FROM red r LEFT JOIN s_example e ON e.consumable_id = r.id LEFT JOIN span ON span.query_id = e.query_id LEFT JOIN lab ON lab.example_id = e.id GROUP BY 1)"""


@query("M6_preview", f"{PREVIEW} SELECT * FROM pre")
def m6_preview(t: Tables):
    s = store_of(t)
    return ops.preview_consumable_deletion(s, red_items(s))


@query("A20_deletion_totals", f"""{PREVIEW} SELECT count(*) AS n_items, sum(examples)::BIGINT AS examples, sum(labels)::BIGINT AS labels, sum(queries)::BIGINT AS queries,
sum(orphaned_queries)::BIGINT AS orphaned_queries FROM pre""")
def a20(t: Tables):
    s = store_of(t)
    return aggregates.deletion_totals(ops.preview_consumable_deletion(s, red_items(s)))


@query("M6_delete_consumables", f"""{W}, gone AS (SELECT * FROM s_example WHERE consumable_id IN ({RED})), kept AS (SELECT * FROM s_example WHERE consumable_id NOT IN ({RED}))
SELECT 'consumable' AS table_name, id FROM s_consumable WHERE id NOT IN ({RED}) UNION ALL SELECT 'example', id FROM kept
UNION ALL SELECT 'label', id FROM s_label WHERE example_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'query', id FROM s_query WHERE id NOT IN (SELECT query_id FROM gone) OR id IN (SELECT query_id FROM kept)""")
def m6(t: Tables):
    s = store_of(t)
    return ids_of(ops.delete_consumables(s, red_items(s))[0], "consumable", "example", "label", "query")


@query("M6_delete_stats", f"""{W}, gone AS (SELECT * FROM s_example WHERE consumable_id IN ({RED})), kept AS (SELECT * FROM s_example WHERE consumable_id NOT IN ({RED}))
SELECT (SELECT count(*) FROM ({RED})) AS consumables, count(*) AS examples, (SELECT count(*) FROM s_label WHERE example_id IN (SELECT id FROM gone)) AS labels,
count(DISTINCT query_id) AS queries, count(DISTINCT query_id) FILTER (query_id NOT IN (SELECT query_id FROM kept)) AS orphaned_queries FROM gone""")
def m6_stats(t: Tables):
    s = store_of(t)
    return ops.delete_consumables(s, red_items(s))[1]


DROPQ = "SELECT id FROM s_query WHERE lower(query_content) LIKE '%red%'"


def red_queries(s: Store) -> DataFrame:
    return filters.find_by_pattern(s.query, "query_content", "RED").select("id")


@query("M7_preview", f"""{W}, d AS ({DROPQ}), lab AS (SELECT example_id, count(*) AS n FROM s_label GROUP BY 1)
SELECT d.id, count(e.id) AS examples, coalesce(sum(lab.n), 0)::BIGINT AS labels FROM d LEFT JOIN s_example e ON e.query_id = d.id LEFT JOIN lab ON lab.example_id = e.id GROUP BY 1""")
def m7_preview(t: Tables):
    s = store_of(t)
    return ops.preview_query_deletion(s, red_queries(s))


@query("M7_delete_queries", f"""{W}, d AS ({DROPQ}) SELECT 'query' AS table_name, id FROM s_query WHERE id NOT IN (SELECT id FROM d)
UNION ALL SELECT 'example', id FROM s_example WHERE query_id NOT IN (SELECT id FROM d)
UNION ALL SELECT 'label', id FROM s_label WHERE example_id NOT IN (SELECT id FROM s_example WHERE query_id IN (SELECT id FROM d))""")
def m7(t: Tables):
    s = store_of(t)
    return ids_of(ops.delete_queries(s, red_queries(s))[0], "query", "example", "label")


@query("M8_delete_examples", f"""{W}, d AS (SELECT id, query_id FROM s_example WHERE example_gen_hash <> 'g1'), kept AS (SELECT * FROM s_example WHERE id NOT IN (SELECT id FROM d))
SELECT 'example' AS table_name, id FROM kept UNION ALL SELECT 'label', id FROM s_label WHERE example_id NOT IN (SELECT id FROM d)
UNION ALL SELECT 'query', id FROM s_query WHERE id NOT IN (SELECT query_id FROM d) OR id IN (SELECT query_id FROM kept)""")
def m8(t: Tables):
    s = store_of(t)
    return ids_of(ops.delete_examples(s, s.example.filter("example_gen_hash <> 'g1'").select("id"))[0], "example", "label", "query")


# ------------------------------------------------------------------ label edits

# edits of the human labeler from the line items: repeated keys, unknown labels, new and existing examples
EDITS = """edits AS (SELECT l_orderkey * 10000000 + l_partkey AS example_id, 1 AS labeler_id,
  CASE WHEN l_returnflag = 'A' THEN 'S' WHEN l_returnflag = 'N' THEN 'C' ELSE 'X' END AS esci_label, l_shipdate AS edited_at,
  (l_linenumber * 10000 + l_suppkey)::BIGINT AS seq FROM lineitem WHERE l_quantity > 25)"""


def label_edits(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    return t.lineitem.filter("l_quantity > 25").select(
        (F.col("l_orderkey") * 10000000 + F.col("l_partkey")).alias("example_id"), F.lit(1).cast("long").alias("labeler_id"),
        F.when(flag == "A", "S").when(flag == "N", "C").otherwise("X").alias("esci_label"),
        F.col("l_shipdate").cast("timestamp").alias("edited_at"),
        (F.col("l_linenumber") * 10000 + F.col("l_suppkey")).cast("long").alias("seq"))


M9_SQL = f"""{W}, {EDITS}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY edited_at DESC, seq DESC) AS r FROM edits WHERE esci_label <> 'X') WHERE r = 1)
SELECT l.id, l.labeler_id, l.example_id, coalesce(e.esci_label, l.esci_label) AS esci_label, l.label_reason FROM s_label l LEFT JOIN last e ON e.example_id = l.example_id AND e.labeler_id = l.labeler_id
UNION ALL SELECT (SELECT max(id) FROM s_label) + row_number() OVER (ORDER BY e.example_id), 1, e.example_id, e.esci_label, NULL FROM last e WHERE e.example_id NOT IN (SELECT example_id FROM s_label WHERE labeler_id = 1)"""


@query("M9_upsert_labels", M9_SQL)
def m9(t: Tables):
    return ops.upsert_labels(store_of(t, "label"), label_edits(t))[0].label.drop("created_at", "auto_label_score")


@query("M9_label_log", M9_SQL)
def m9_log(t: Tables):
    # the edits arrive as files, some of them twice
    base = f"{shared_dir(t.spark)}/relish-log-{uuid.uuid4().hex}"
    edits = label_edits(t).select("example_id", "labeler_id", "esci_label", "edited_at", "seq")
    edits.write.json(f"{base}/edits")
    edits.filter("seq % 3 = 0").write.mode("append").json(f"{base}/edits")
    label_log.start_label_log(t.spark, f"{base}/edits", f"{base}/log", f"{base}/checkpoint").awaitTermination()
    return label_log.labels_of(store_of(t, "label"), f"{base}/log").label.drop("created_at", "auto_label_score")


@query("M10_delete_own_labels", f"{W}, {EDITS} SELECT id FROM s_label WHERE NOT (labeler_id = 1 AND example_id IN (SELECT example_id FROM edits))")
def m10(t: Tables):
    return ops.delete_own_labels(store_of(t), label_edits(t)).label.select("id")


@query("M11_effective_label", f"{VIEW} SELECT example_id, coalesce(nullif(human_esci_label, ''), ai_esci_label, '') AS esci_label FROM view")
def m11(t: Tables):
    return ops.annotation_view(store_of(t), HUMAN, bulk=True).select("example_id", ops.effective_label().alias("esci_label"))


@query("M12_update_reasons", f"""{W}, r AS (SELECT id AS example_id, step, CASE WHEN (example_gen_hash = 'g1') = (step = 2) THEN 'seen' ELSE '' END AS reason
  FROM s_example, (VALUES (1), (2)) v(step) WHERE example_gen_hash IN ('g1', 'g2')),
last AS (SELECT example_id, arg_max(reason, step) AS reason FROM r GROUP BY 1)
SELECT l.id, CASE WHEN l.labeler_id = 1 AND e.example_id IS NOT NULL THEN nullif(e.reason, '') ELSE l.label_reason END AS label_reason
FROM s_label l LEFT JOIN last e USING (example_id)""")
def m12(t: Tables):
    """Every label is edited twice: to a reason and away from one, or the other way round."""
    s = store_of(t)
    edits = s.example.filter("example_gen_hash IN ('g1', 'g2')").withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        F.col("id").alias("example_id"), F.lit(1).cast("long").alias("labeler_id"), "seq",
        F.when((F.col("example_gen_hash") == "g1") == (F.col("seq") == 2), "seen").otherwise("").alias("label_reason"))
    return ops.update_label_reasons(s, edits).label.select("id", "label_reason")


@query("M13_copy_ai_labels", f"""{VIEW}, w AS MATERIALIZED (SELECT example_id, ai_esci_label FROM view WHERE example_gen_hash = 'g3' AND ai_esci_label IS NOT NULL)
SELECT l.example_id, l.esci_label FROM s_label l ANTI JOIN w USING (example_id) WHERE l.labeler_id = 1
UNION ALL SELECT example_id, ai_esci_label FROM w""")
def m13(t: Tables):
    s = store_of(t)
    out, _ = ops.copy_ai_labels(s, s.example.filter("example_gen_hash = 'g3'").select("id"), HUMAN, at())
    return out.label.filter(F.col("labeler_id") == HUMAN).select("example_id", "esci_label")


# examples of one generator get an existing text, of another a text per item, of a third two texts, the second a text per item
TEXT_EDITS = f"""{W}, every AS (SELECT id AS example_id, query_id, consumable_id, id + 1000000 * step AS seq,
  CASE WHEN example_gen_hash = 'g0' THEN (SELECT min(query_content) FROM s_query) WHEN step = 0 AND example_gen_hash = 'g2' THEN 'draft ' || id % 7 ELSE 'edited ' || consumable_id END AS new_text
  FROM s_example, (VALUES (0), (1)) v(step) WHERE (example_gen_hash IN ('g0', 'g1') AND step = 0) OR example_gen_hash = 'g2'),
edits AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY seq DESC) = 1),
stored AS (SELECT query_content AS new_text, min(id) AS target FROM s_query GROUP BY 1),
m AS (SELECT e.*, s.target FROM edits e LEFT JOIN stored s USING (new_text)),
f AS (SELECT new_text, min(seq) AS first_seq, arg_min(query_id, seq) AS first_query FROM m WHERE target IS NULL GROUP BY 1),
won AS (SELECT first_query, arg_max(new_text, first_seq) AS text FROM f GROUP BY 1),
p AS (SELECT m.*, m.target IS NULL AND m.seq = f.first_seq AS leads, w.text IS NOT DISTINCT FROM m.new_text AS wins,
  CASE WHEN m.target IS NOT NULL THEN m.target WHEN w.text = m.new_text THEN f.first_query END AS goal
  FROM m LEFT JOIN f USING (new_text) LEFT JOIN won w ON w.first_query = f.first_query),
h AS (SELECT query_id AS goal, consumable_id, min(id) AS holder FROM s_example GROUP BY ALL),
j AS (SELECT p.*, CASE WHEN leads AND wins THEN 'renamed' WHEN leads THEN 'superseded' WHEN p.goal IS NULL THEN 'refused' WHEN holder = p.example_id THEN 'repointed'
    WHEN holder IS NOT NULL THEN 'refused' WHEN row_number() OVER (PARTITION BY p.goal, p.consumable_id, leads ORDER BY seq) = 1 THEN 'repointed' ELSE 'refused' END AS outcome
  FROM p LEFT JOIN h ON h.goal = p.goal AND h.consumable_id = p.consumable_id)"""


def text_edits(s: Store) -> DataFrame:
    known = s.query.agg(F.min("query_content")).scalar()
    step = F.explode(F.when(F.col("example_gen_hash") == "g2", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    text = (F.when(F.col("example_gen_hash") == "g0", F.col("_known"))
            .when((F.col("example_gen_hash") == "g2") & (F.col("step") == 0), F.concat(F.lit("draft "), (F.col("id") % 7).cast("string")))
            .otherwise(F.concat(F.lit("edited "), F.col("consumable_id").cast("string"))))
    return s.example.filter("example_gen_hash IN ('g0', 'g1', 'g2')").withColumn("step", step).withColumn("_known", known).select(
        F.col("id").alias("example_id"), (F.col("id") + 1_000_000 * F.col("step")).alias("seq"), text.alias("new_text"))


@query("M14_edit_outcomes", f"""{TEXT_EDITS} SELECT example_id, seq, new_text, outcome FROM j
UNION ALL SELECT example_id, seq, new_text, 'superseded' FROM every ANTI JOIN edits USING (example_id, seq)""")
def m14(t: Tables):
    s = store_of(t)
    return ops.edit_query_texts(s, text_edits(s))[1]


@query("M14_edited_examples", f"{TEXT_EDITS} SELECT e.id, CASE WHEN j.outcome = 'repointed' THEN j.goal ELSE e.query_id END AS query_id FROM s_example e LEFT JOIN j ON j.example_id = e.id")
def m14_examples(t: Tables):
    s = store_of(t)
    return ops.edit_query_texts(s, text_edits(s))[0].example.select("id", "query_id")


@query("M14_edited_queries", f"""{TEXT_EDITS}, r AS (SELECT query_id, any_value(new_text) AS new_text FROM j WHERE outcome = 'renamed' GROUP BY 1)
SELECT q.id, coalesce(r.new_text, q.query_content) AS query_content FROM s_query q LEFT JOIN r ON r.query_id = q.id""")
def m14_queries(t: Tables):
    s = store_of(t)
    return ops.edit_query_texts(s, text_edits(s))[0].query.select("id", "query_content")


@query("M14_edited_violations", "SELECT NULL::VARCHAR AS table_name, NULL::VARCHAR AS column_name, NULL::VARCHAR AS rule, NULL::VARCHAR AS id WHERE false")
def m14_violations(t: Tables):
    """The edited store breaks no rule."""
    s = store_of(t)
    return ops.store_violations(ops.edit_query_texts(s, text_edits(s))[0])


# ------------------------------------------------------------------ duplicate query texts

DEDUP = f"""{W}, first AS (SELECT id, min(id) OVER (PARTITION BY query_content) AS first_id FROM s_query),
moved AS (SELECT e.id, f.first_id AS query_id, e.consumable_id, f.first_id <> e.query_id AS moved FROM s_example e JOIN first f ON f.id = e.query_id
          UNION ALL SELECT e.id, e.query_id, e.consumable_id, false FROM s_example e WHERE e.query_id NOT IN (SELECT id FROM s_query)),
kept AS (SELECT *, min(id) OVER (PARTITION BY query_id, consumable_id) AS keep_id FROM moved)"""


@query("D-5_examples", f"{DEDUP} SELECT id, query_id, consumable_id FROM kept WHERE id = keep_id")
def d5_examples(t: Tables):
    return ops.deduplicate_queries(store_of(t))[0].example.select("id", "query_id", "consumable_id")


@query("D-5_labels", f"{DEDUP} SELECT l.id, k.keep_id AS example_id FROM s_label l JOIN kept k ON k.id = l.example_id")
def d5_labels(t: Tables):
    return ops.deduplicate_queries(store_of(t))[0].label.select("id", "example_id")


@query("D-5_stats", f"""{DEDUP} SELECT (SELECT count(*) FROM first WHERE id <> first_id) AS duplicate_queries, (SELECT count(DISTINCT first_id) FROM first WHERE id <> first_id) AS duplicated_texts,
count(*) FILTER (moved) AS examples_repointed, count(*) FILTER (id <> keep_id) AS examples_collapsed FROM kept""")
def d5_stats(t: Tables):
    return ops.deduplicate_queries(store_of(t))[1]


@query("D-6_verification", f"""{DEDUP} SELECT count(DISTINCT query_content) AS total_queries, count(DISTINCT query_content) AS unique_queries, 0 AS remaining_duplicates,
(SELECT count(*) FROM s_example WHERE query_id NOT IN (SELECT id FROM s_query)) AS orphaned_examples, count(*) - count(DISTINCT query_content) AS removed,
(SELECT count(*) FROM s_example WHERE query_id NOT IN (SELECT id FROM s_query)) = 0 AS ok FROM s_query""")
def d6(t: Tables):
    s = store_of(t)
    return ops.verify_deduplication(s, ops.deduplicate_queries(s)[0])


# ------------------------------------------------------------------ runs from events

RUNS = """r AS (SELECT 'e' || event_id AS run_id, user_id, event_id, event_type, value, (props->>'k')::INT AS k, ts,
  CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'view' THEN 'migrated' WHEN 'signup' THEN 'migrated_partial' WHEN 'click' THEN 'pending_review' ELSE 'pending_approval' END AS status,
  CASE WHEN user_id % 4 = 3 THEN 'Intent_Generation' ELSE 'Initial_' || (user_id % 4) END AS experiment_name,
  CASE user_id % 3 WHEN 0 THEN 'initial_generation.py' WHEN 1 THEN 'intent_generation_approach.py' END AS script FROM events),
runs AS (SELECT *, CASE WHEN k % 3 <> 0 THEN 'h' || k END AS p_hash, CASE WHEN k % 2 = 0 THEN 'c' || k END AS t_hash,
  CASE WHEN k % 2 = 0 THEN 'True' ELSE 'False' END AS stop, CASE WHEN k % 5 = 0 THEN '1_2' END AS step FROM r)"""


def runs_of(t: Tables) -> DataFrame:
    """One run per event: type as status, user as experiment and script, ``props.k`` as parameters."""
    k = F.get_json_object("props", "$.k").cast("int")
    s = lambda c: c.cast("string")
    kind, user = F.col("event_type"), F.col("user_id")

    def present(*pairs):
        return F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n, _ in pairs]), F.array(*[v for _, v in pairs])),
                            lambda _, v: v.isNotNull())

    status = (F.when(kind == "purchase", "approved").when(kind == "view", "migrated").when(kind == "signup", "migrated_partial")
              .when(kind == "click", "pending_review").otherwise("pending_approval"))
    script = F.when(user % 3 == 0, "initial_generation.py").when(user % 3 == 1, "intent_generation_approach.py")
    return t.events.withColumn("k", k).select(
        F.concat(F.lit("e"), s(F.col("event_id"))).alias("run_id"),
        F.when(user % 4 == 3, "Intent_Generation").otherwise(F.concat(F.lit("Initial_"), s(user % 4))).alias("experiment_name"),
        F.concat(F.lit("run "), s(F.col("event_id"))).alias("run_name"),
        present(("script_name", script), ("stop_at_intents", F.when(F.col("k") % 2 == 0, "True").otherwise("False")),
                ("step", F.when(F.col("k") % 5 == 0, "1_2")), ("start_idx", s(F.col("k"))),
                ("limit", F.when(F.col("k") % 4 == 0, "None").otherwise(s(F.col("k") * 2))), ("batch_size", F.lit("50")),
                ("data_gen_hash", F.when(F.col("k") % 3 != 0, F.concat(F.lit("h"), s(F.col("k"))))),
                ("esci_label", F.when(F.col("k") % 7 != 0, "S"))).alias("params"),
        present(("data_status", status), ("mlflow.source.git.commit", F.when(F.col("k") % 2 == 0, F.concat(F.lit("c"), s(F.col("k"))))),
                ("intent-generation", F.when(user % 6 == 2, "yes"))).alias("tags"),
        F.create_map(F.lit("total_runtime_seconds"), F.col("value")).alias("metrics"),
        F.col("ts").cast("timestamp").alias("start_time"), F.col("ts").cast("timestamp").alias("end_time"))


@query("P12_runs_with_status", f"WITH {RUNS} SELECT run_id FROM runs WHERE status = 'approved'")
def p12(t: Tables):
    return filters.runs_with_status(runs_of(t), "approved").select("run_id")


@query("M3_eligible_runs", f"""WITH {RUNS} SELECT run_id, experiment_name, coalesce(p_hash, t_hash) AS data_gen_hash, run_id AS mlflow_run_id, step,
CASE WHEN k % 7 <> 0 THEN 'S' END AS esci_label FROM runs WHERE status = 'approved' AND coalesce(p_hash, t_hash) IS NOT NULL""")
def m3(t: Tables):
    return run_ops.eligible_runs(runs_of(t)).select("run_id", "experiment_name", "data_gen_hash", "mlflow_run_id", "step", "esci_label")


@query("M15_approve_runs", f"WITH {RUNS} SELECT run_id, CASE WHEN status = 'pending_review' THEN 'approved' ELSE status END AS data_status, t_hash FROM runs")
def m15(t: Tables):
    runs = runs_of(t)
    pending = filters.runs_with_status(runs, "pending_review").select("run_id")
    after, _ = run_ops.approve_runs(runs, pending)
    return after.select("run_id", run_ops.tag("data_status").alias("data_status"), run_ops.tag("mlflow.source.git.commit").alias("t_hash"))


@query("M15_approve_counts", f"WITH {RUNS} SELECT (SELECT count(*) FROM runs WHERE status = 'pending_review') AS approved, (SELECT count(*) FROM orders) AS errors")
def m15_counts(t: Tables):
    runs = runs_of(t)
    ids = filters.runs_with_status(runs, "pending_review").select("run_id").unionByName(
        t.orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("run_id")))
    return run_ops.approve_runs(runs, ids)[1]


# every run is told to become approved, then (every second run) pending_approval again, then migrated
STEPS = f"""WITH RECURSIVE {RUNS}, allowed(a, b) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in run_ops.TRANSITIONS)}),
steps(seq, new_status) AS (VALUES (1, 'approved'), (2, 'pending_approval'), (3, 'migrated')),
walk AS (SELECT run_id, k, 0 AS seq, status AS old_status, status, NULL::VARCHAR AS new_status, true AS ok FROM runs
  UNION ALL SELECT w.run_id, w.k, s.seq, w.status, CASE WHEN a.a IS NOT NULL AND NOT (s.seq = 2 AND w.k % 2 = 0) THEN s.new_status ELSE w.status END, s.new_status,
    a.a IS NOT NULL OR (s.seq = 2 AND w.k % 2 = 0)
  FROM walk w JOIN steps s ON s.seq = w.seq + 1 LEFT JOIN allowed a ON a.a = w.status AND a.b = s.new_status)"""


def status_changes(runs):
    steps = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(x).alias("new_status")) for i, x in ((3, "migrated"), (1, "approved"), (2, "pending_approval"))])
    rows = runs.withColumn("s", F.explode(steps)).filter("NOT (s.seq = 2 AND cast(params['start_idx'] AS int) % 2 = 0)")
    return rows.select("run_id", "s.new_status", "s.seq")


@query("M16_invalid_changes", f"{STEPS} SELECT run_id, old_status, new_status, 'invalid transition' AS reason FROM walk WHERE NOT ok")
def m16(t: Tables):
    runs = runs_of(t)
    return run_ops.change_status(runs, status_changes(runs))[1]


@query("M16_changed_status", f"{STEPS} SELECT run_id, status AS data_status FROM walk WHERE seq = 3")
def m16_after(t: Tables):
    runs = runs_of(t)
    return run_ops.change_status(runs, status_changes(runs))[0].select("run_id", run_ops.tag("data_status").alias("data_status"))


SUMMARY = f"""WITH {RUNS}, summary AS (SELECT experiment_name, run_id, CASE WHEN script = 'initial_generation.py' THEN 'initial_generation'
  WHEN script IS NOT NULL AND (stop = 'True' OR step = '1_2') THEN 'intent_generation_2step' WHEN script IS NOT NULL THEN 'intent_generation_3step'
  WHEN user_id % 6 = 2 AND stop = 'True' THEN 'intent_generation_2step' WHEN user_id % 6 = 2 THEN 'intent_generation_3step' ELSE 'unknown' END AS generation_type,
  status AS migration_status, CASE WHEN k % 7 <> 0 THEN 'S' WHEN experiment_name LIKE 'Intent%' THEN 'E' ELSE 'unknown' END AS esci_label,
  coalesce(p_hash, t_hash, 'unknown') AS data_gen_hash, k AS start_idx, CASE WHEN k % 4 <> 0 THEN k + k * 2 - 1 END AS end_idx,
  CASE WHEN k % 4 <> 0 THEN k * 2 END AS "limit", 50 AS batch_size, 'unknown' AS model, value AS runtime_seconds, ts FROM runs WHERE status LIKE 'migrated%')"""


@query("M17_run_summary", f"{SUMMARY} SELECT * EXCLUDE (ts) FROM summary")
def m17(t: Tables):
    return run_ops.run_summary(runs_of(t)).drop("start_time", "end_time")


@query("A17_run_summary_stats", f"{SUMMARY} SELECT count(*) AS n_runs, count(DISTINCT experiment_name) AS n_experiments, min(ts)::VARCHAR AS first_start, max(ts)::VARCHAR AS last_start FROM summary")
def a17(t: Tables):
    return aggregates.run_summary_stats(run_ops.run_summary(runs_of(t))).withColumns(
        {c: F.col(c).cast("string") for c in ("first_start", "last_start")})


@query("A17_run_type_counts", f"{SUMMARY} SELECT generation_type, migration_status, count(*) AS n FROM summary GROUP BY ALL")
def a17_types(t: Tables):
    return aggregates.value_counts(run_ops.run_summary(runs_of(t)), "generation_type", "migration_status")
