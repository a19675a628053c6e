import json

import pytest
from pyspark.sql import functions as F

from relish.operators import generation
from relish.operators.store import SCHEMAS, Store
from relish.sources import readers, writers


def test_markdown_table_layout(spark):
    df = spark.createDataFrame([(0, 1, "a", True), (0, 12345, None, False)], "batch long, id int, consumable_name string, is_vegan boolean")
    table = generation.markdown_tables(df, "batch", "id", ["id", "consumable_name", "is_vegan"]).first()["table"]
    assert table.split("\n") == [
        "|    id | consumable_name   | is_vegan   |",
        "|------:|:------------------|:-----------|",
        "|     1 | a                 | True       |",
        "| 12345 |                   | False      |"]


def test_batches_fail_alone(spark):
    prompts = spark.createDataFrame([(0, "good"), (1, "bad")], "batch long, prompt string")

    def fn(prompt):
        if prompt == "bad":
            raise ValueError("nope")
        return json.dumps({"candidates": [{"id": 1, "name": "n", "queries": []}]})

    rows = {r["batch"]: r for r in generation.apply_batches(prompts, fn, max_retries=3, parallelism=2).collect()}
    assert (rows[0]["status"], rows[0]["attempts"]) == ("success", 1)
    assert (rows[1]["status"], rows[1]["attempts"], rows[1]["error"], rows[1]["output"]) == ("failed", 3, "nope", None)
    with pytest.raises(ValueError):
        generation.apply_batches(prompts, fn, parallelism=0)


def test_flattening_edges(spark):
    rows = [([(1, "a", [("q", {"price": "low"}, "r"), ("p", {}, None)]), (2, "b", [])],), ([],)]
    df = spark.createDataFrame(rows, f"candidates {generation.CANDIDATES_TYPE}")
    flat = generation.flatten_with_dimensions(df).collect()
    assert [(r["query"], r["dimensions_json"], r["dim_price"]) for r in flat] == [("q", '{"price":"low"}', "low"), ("p", "{}", None)]
    empty = generation.final_rows(generation.flatten_candidates(df.limit(0)), None, "E", "now")
    assert empty.columns == generation.OUTPUT_COLUMNS and empty.count() == 0


def test_results_give_intent_then_bridged(spark):
    df = spark.createDataFrame([(1, "n", "i", ["x", "y"]), (2, "m", "j", None)], "consumable_id long, consumable_name string, original_intent string, queries array<string>")
    got = [(r["consumable_id"], r["query"], r["query_type"]) for r in generation.flatten_results(df, "now").collect()]
    assert got == [(1, "i", "intent"), (1, "x", "bridged"), (1, "y", "bridged"), (2, "j", "intent")]


def test_intent_sets_remainder_and_few_intents(spark):
    df = spark.range(23).select("id", F.lit("t").alias("theme"), F.col("id").cast("string").alias("intent"))
    sizes = [r["n"] for r in generation.intent_sets(df, "id", 5).groupBy("set_number").agg(F.count("*").alias("n")).orderBy("set_number").collect()]
    assert sizes == [4, 4, 4, 4, 7]
    few = generation.intent_sets(df.limit(3), "id", 5).select("set_number").distinct().collect()
    assert [r["set_number"] for r in few] == [5]


def test_match_rule(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (3, "c")], "consumable_id long, intent string")
    assert {(r["rule"], r["value"]) for r in generation.match_violations(df).collect()} == {("food matched twice", "3"), ("intent used twice", "a")}


def test_missing_inputs(spark):
    with pytest.raises(FileNotFoundError):
        readers.read_csv(spark, "/tmp/no-such-file.csv", "a string")
    with pytest.raises(FileNotFoundError):
        readers.load_intent_sets(spark, "/tmp/no-such-folder")


def test_catalogue_load_rejects_rows_not_batches(spark):
    empty = Store(**{n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()})
    raw = spark.createDataFrame(
        [(1, "u1", "rice", '["a","b"]', "{}"), (2, "u2", "rice", '["a","b"]', "{"), (3, "u3", " ", "x", None), (4, None, "soup", "x", None), (5, "u5", "soup", "y", None)],
        "row_id long, image_url string, dish_name string, ingredients string, nutritional_profile string")
    at = F.to_timestamp(F.lit("2025-01-01 00:00:00"))
    out, prepared, stats = writers.load_catalogue(empty, raw, "row_id", at, 0.9, 10)
    assert [(r["id"], r["image_url"]) for r in out.consumable.orderBy("id").collect()] == [(1, "u1"), (2, "u5")]
    gaps = spark.createDataFrame([(1, "u", "n"), (2, None, "n"), (3, "u", None), (4, "u", "n")], "row_id long, image_url string, consumable_name string")
    out, stats, rejected = writers.insert_consumables(empty, gaps, "row_id", at, 2)
    assert writers.insert_totals(stats).first().asDict() == {"total_records": 4, "successful_batches": 0, "failed_batches": 2, "total_inserted": 2}
    assert rejected.count() == 2


def test_get_table_takes_sql_orders_and_columns(spark):
    df = spark.createDataFrame([(1, "b", "{x}"), (2, "a", None), (3, "a", "y")], "id long, consumable_type string, note string")
    got = readers.get_table({"consumable": df}, "consumable", 2, "id, concat(consumable_type, ',', id) AS c", "note IS NULL OR note <> '{z}'", "consumable_type, note DESC NULLS LAST")
    assert [tuple(r) for r in got.collect()] == [(3, "a,3"), (2, "a,2")]
