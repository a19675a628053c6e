import pytest
from pyspark.sql import functions as F

from relish.operators import runs as run_ops
from relish.operators import store as ops
from relish.operators.store import Store, conform

LABELERS = [(1, "ana", "labeler", "human"), (2, "h0", "labeler", "synthetic_data_generation_initial")]
QUERIES = [(1, "rice", None, "h0", "r0"), (2, "soup", None, "h0", "r0"), (3, "rice", None, "h9", "r9")]
ITEMS = [(i, f"img{i}", n) for i, n in enumerate(["rice", "soup", "bread"], 1)]
EXAMPLES = [(1, 1, 1, "h0", "r0"), (2, 1, 2, "h0", "r0"), (3, 2, 2, "h0", "r0"), (4, 3, 1, "h9", "r9")]
LABELS = [(1, 2, 1, "E", "why"), (2, 2, 2, "S", None), (3, 1, 2, "I", "no"), (4, 2, 3, "E", None)]


def at():
    return F.to_timestamp(F.lit("2025-01-01 00:00:00"))


@pytest.fixture(scope="module")
def store(spark):
    def frame(rows, names, table):
        return ops.stage(conform(spark.createDataFrame(rows, names), table))
    return Store(
        labeler=frame(LABELERS, "id long, name string, role string, type string", "labeler"),
        query=frame(QUERIES, "id long, query_content string, query_filters string, data_gen_hash string, mlflow_run_id string", "query"),
        consumable=frame(ITEMS, "id long, image_url string, consumable_name string", "consumable"),
        example=frame(EXAMPLES, "id long, query_id long, consumable_id long, example_gen_hash string, run_id string", "example"),
        label=frame(LABELS, "id long, labeler_id long, example_id long, esci_label string, label_reason string", "label"))


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def a_run(spark, status="approved", **params):
    base = {"data_gen_hash": "h1", "generation_approach": "intent", "output_type": "intent_matches", **params}
    return conform_runs(spark, [("n1", "Intent_X", "run", base, {"data_status": status}, {}, None, None)])


def conform_runs(spark, rows):
    return spark.createDataFrame(rows, run_ops.RUN_SCHEMA)


def generated(spark):
    rows = [("n1", 1, 1, "rice", "{}", "r", "intent"), ("n1", 2, 1, "new dish", '{"a":1}', None, "bridged"),
            ("n1", 3, 2, "new dish", None, "x", "bridged"), ("n1", 4, 2, "new dish", None, "again", "bridged"),
            ("n1", 5, 99, "lost", None, None, "bridged"), ("n1", 6, 2, None, None, None, "bridged"), ("n1", 7, 3, "broken", "{x", None, "bridged")]
    return spark.createDataFrame(rows, "run_id string, row_id long, consumable_id long, query string, query_filters string, reasoning string, query_type string")


def test_promote_rules_and_rollback(spark, store):
    out, runs, results = run_ops.promote_runs(store, a_run(spark), generated(spark), at(), dry_run=False)
    row = results.first()
    assert (row["status"], row["records_processed"], row["queries_inserted"], row["examples_inserted"], row["labels_inserted"]) == ("success", 7, 2, 3, 3)
    new = {r["query_content"]: r["query_filters"] for r in out.query.filter("mlflow_run_id = 'n1'").collect()}
    assert new == {"new dish": '{"a":1}', "broken": None}
    labels = out.label.filter("auto_label_score IS NOT NULL").collect()
    assert {r["esci_label"] for r in labels} == {"E"} and {r["label_reason"] for r in labels} == {None, "x"}
    assert run_ops.tag("data_status") is not None and runs.select(run_ops.tag("data_status")).first()[0] == "migrated"
    again, _, second = run_ops.promote_runs(out, a_run(spark), generated(spark), at(), dry_run=False)
    assert second.first()["examples_inserted"] == 0 and ids(again.example) == ids(out.example)
    assert ops.store_violations(out).count() == 0
    back, reset, counts, blocking = run_ops.rollback_run(out, runs, "n1", at())
    assert counts.first().asDict() == {"status": "success", "queries_removed": 2, "examples_removed": 3, "labels_removed": 3, "labelers_removed": 1}
    assert all(ids(a) == ids(b) for a, b in zip(back.tables().values(), store.tables().values()))
    assert reset.select(run_ops.tag("data_status")).first()[0] == "pending_approval"
    with pytest.raises(ValueError):
        run_ops.rollback_run(back, reset, "n1", at())


def test_bridged_and_error_rows(spark, store):
    _, runs, results = run_ops.promote_runs(store, a_run(spark), generated(spark), at(), bridged=True, dry_run=False)
    assert results.first()["records_processed"] == 6 and runs.select(run_ops.tag("data_status")).first()[0] == "migrated_partial"
    bare = generated(spark).drop("query_type")
    assert run_ops.promote_runs(store, a_run(spark), bare, at(), bridged=True)[2].first()["status"] == "error"
    odd = a_run(spark, output_type="other")
    assert run_ops.promote_runs(store, odd, generated(spark), at(), dry_run=False)[2].first()["status"] == "error"
    assert run_ops.promote_runs(store, a_run(spark, status="migrated"), generated(spark), at(), run_ids=["n1"])[2].count() == 0


def test_human_labels_block_rollback(store):
    same, stats, blocking = ops.rollback(store, "h0", "r0", "initial")
    assert ids(blocking) == [3] and stats.first()["status"] == "error" and ids(same.label) == ids(store.label)


def test_cascades(spark, store):
    out, stats = ops.delete_consumables(store, spark.createDataFrame([(2,)], "id long"))
    assert stats.first().asDict() == {"consumables": 1, "examples": 2, "labels": 3, "queries": 2, "orphaned_queries": 1}
    assert ids(out.query) == [1, 3] and ids(out.example) == [1, 4] and ids(out.label) == [1]
    preview = ops.preview_consumable_deletion(store, spark.createDataFrame([(2,), (3,), (77,)], "id long")).orderBy("id").collect()
    assert [tuple(r) for r in preview] == [(2, 2, 3, 2, 1), (3, 0, 0, 0, 0)]
    out, _ = ops.delete_queries(store, spark.createDataFrame([(1,)], "id long"))
    assert ids(out.query) == [2, 3] and ids(out.example) == [3, 4] and ids(out.label) == [4]
    out, _ = ops.delete_examples(store, spark.createDataFrame([(3,)], "id long"))
    assert ids(out.query) == [1, 3] and ids(out.label) == [1, 2, 3]


def test_label_edits(spark, store):
    edits = spark.createDataFrame([(2, 1, "E", 1), (2, 1, "C", 2), (1, 1, "S", 3), (3, 1, "X", 4)], "example_id long, labeler_id long, esci_label string, seq long").withColumn("edited_at", at())
    out, bad = ops.upsert_labels(store, edits)
    human = {r["example_id"]: (r["esci_label"], r["label_reason"]) for r in out.label.filter("labeler_id = 1").collect()}
    assert human == {2: ("C", "no"), 1: ("S", None)} and bad.count() == 1 and max(ids(out.label)) == 5
    assert ids(ops.delete_own_labels(store, edits).label) == [1, 2, 4]
    reasons = spark.createDataFrame([(2, 1, "", 2), (2, 1, "first", 1)], "example_id long, labeler_id long, label_reason string, seq long")
    edited = ops.update_label_reasons(store, reasons).label
    assert edited.filter("id = 3").first()["label_reason"] is None and edited.count() == store.label.count()
    copied, without = ops.copy_ai_labels(store, spark.createDataFrame([(1,), (2,), (4,)], "id long"), 1, at())
    assert {r["example_id"]: r["esci_label"] for r in copied.label.filter("labeler_id = 1").collect()} == {1: "E", 2: "S"}
    assert [r["example_id"] for r in without.collect()] == [4]


def test_query_text_edits(spark, store):
    edits = spark.createDataFrame([(3, "rice", 1), (1, "pilaf", 2)], "example_id long, new_text string, seq long")
    out, outcome = ops.edit_query_texts(store, edits)
    # example 3 (soup, item 2) cannot move to the query of example 2, which has the same item
    assert {r["example_id"]: r["outcome"] for r in outcome.collect()} == {3: "refused", 1: "renamed"}
    assert {r["id"]: r["query_content"] for r in out.query.collect()} == {1: "pilaf", 2: "soup", 3: "rice"}
    again = spark.createDataFrame([(3, "stew", 1), (3, "broth", 2), (1, "broth", 3), (4, "broth", 4)], "example_id long, new_text string, seq long")
    out, outcome = ops.edit_query_texts(store, again)
    assert {r["seq"]: r["outcome"] for r in outcome.collect()}[1] == "superseded" and ops.store_violations(out).isEmpty()
    moved, _ = ops.edit_query_texts(store, spark.createDataFrame([(4, "soup", 1)], "example_id long, new_text string, seq long"))
    assert moved.example.filter("id = 4").first()["query_id"] == 2


def test_duplicate_queries_collapse(spark, store):
    out, stats = ops.deduplicate_queries(store)
    assert ids(out.query) == [1, 2] and ids(out.example) == [1, 2, 3]
    assert stats.first().asDict() == {"duplicate_queries": 1, "duplicated_texts": 1, "examples_repointed": 1, "examples_collapsed": 1}
    assert ops.verify_deduplication(store, out).first()["ok"]


def test_ambiguous_generators_do_not_multiply_rows(spark, store):
    twice = store.replace(labeler=store.labeler.unionByName(conform(
        spark.createDataFrame([(9, "h0", "labeler", "synthetic_data_generation_intent")], "id long, name string, role string, type string"), "labeler")))
    view = ops.annotation_view(twice, 1, ordered=True)
    assert [(r["example_id"], r["ai_esci_label"], r["human_esci_label"]) for r in view.collect()] == [(1, "E", None), (2, "S", "I"), (3, "E", None), (4, None, None)]
    assert ops.ambiguous_generators(twice).first()["name"] == "h0"


def test_run_rules(spark):
    rows = [
        ("a", "Intent_1", "n", {"script_name": "intent_generation_approach.py", "stop_at_intents": "False", "limit": "None"}, {"data_status": "migrated"}, {}, None, None),
        ("b", "Init", "n", {"script_name": "initial_generation.py", "start_idx": "10", "limit": "5"}, {"data_status": "migrated_partial", "mlflow.source.git.commit": "c"}, {}, None, None),
        ("c", "Init", "n", {}, {"data_status": "approved"}, {}, None, None)]
    runs = conform_runs(spark, rows)
    got = {r["run_id"]: (r["generation_type"], r["esci_label"], r["end_idx"], r["data_gen_hash"]) for r in run_ops.run_summary(runs).collect()}
    assert got == {"a": ("intent_generation_3step", "E", None, "unknown"), "b": ("initial_generation", "unknown", 14, "c")}
    assert run_ops.eligible_runs(runs).count() == 0  # no hash
    after, bad = run_ops.change_status(runs, spark.createDataFrame([("a", "approved", 1), ("b", "migrated", 3), ("b", "approved", 1), ("b", "migrated", 2), ("z", "approved", 1)],
                                                                   "run_id string, new_status string, seq int"))
    assert sorted((r["run_id"], r["reason"]) for r in bad.collect()) == [("a", "invalid transition"), ("b", "invalid transition"), ("z", "unknown run")]
    assert after.count() == 3 and {r["run_id"]: r["tags"]["data_status"] for r in after.collect()} == {"a": "migrated", "b": "migrated", "c": "approved"}


def test_joins_have_parts_by_the_size_of_their_tables(spark, store, monkeypatch):
    from relish import session

    monkeypatch.setattr(session, "PART_INPUT", 100, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        view = ops.annotation_view(store, 1)
        after, stats = ops.deduplicate_queries(store)
        preview = ops.preview_query_deletion(store, store.query.select("id"))
        assert [df.rdd.getNumPartitions() > 8 for df in (view, after.label, preview)] == [True] * 3
        assert {(r["example_id"], r["ai_esci_label"], r["human_esci_label"]) for r in view.collect()} == {
            (1, "E", None), (2, "S", "I"), (3, "E", None), (4, None, None)}
        assert stats.first().asDict() == {"duplicate_queries": 1, "duplicated_texts": 1, "examples_repointed": 1, "examples_collapsed": 1}
        assert {(r["id"], r["examples"], r["labels"]) for r in preview.collect()} == {(1, 2, 3), (2, 1, 1), (3, 1, 0)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
