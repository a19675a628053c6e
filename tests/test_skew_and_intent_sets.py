"""Joins on hot keys, intent sets as one file each, and catalogue loading by vectors."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from relish.operators import generation, skew
from relish.operators.store import SCHEMAS, Store
from relish.sources import intent_sets, readers, writers


def task_sizes(joined):
    return sorted(r["n"] for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())


def test_a_text_with_most_rows_is_dealt_over_tasks(spark):
    tasks = 16
    names = ["spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions"]
    before = {n: spark.conf.get(n) for n in names}
    for name, value in zip(names, ["false", "-1", str(tasks)], strict=True):
        spark.conf.set(name, value)
    try:
        text = F.when(F.col("id") % 5 < 4, F.lit("hot")).when(F.col("id") % 100 == 99, F.lit(None)).otherwise(F.concat(F.lit("t"), F.col("id") % 997))
        left = spark.range(40_000).select("id", text.alias("query"))
        right = left.select("query").distinct().withColumn("query_id", F.xxhash64("query"))
        salted = skew.salted_join(left, right, "query", ["id"])
        plain = left.join(right, "query")
        assert sorted(salted.select("id", "query_id").collect()) == sorted(plain.select("id", "query_id").collect())
        sizes, plain_sizes = task_sizes(salted), task_sizes(plain)
        assert len(sizes) == tasks and sizes[-1] <= 3 * sizes[tasks // 2]
        assert plain_sizes[-1] > 10 * plain_sizes[tasks // 2]
        counted = skew.salted_join(left, right, "query", ["id"], counts=left.groupBy("query").agg(F.count("*").alias("n")))
        assert sorted(counted.select("id", "query_id").collect()) == sorted(plain.select("id", "query_id").collect())
        sizes = task_sizes(counted)
        assert len(sizes) == tasks and sizes[-1] <= 3 * sizes[tasks // 2]
        some = right.filter("query like 't1%'")
        kept = skew.salted_join(left, some, "query", ["id"], "left")
        assert kept.count() == 40_000
        assert kept.filter("query_id is not null").count() == left.join(some, "query").count()
    finally:
        for name in names:
            spark.conf.set(name, before[name])


def test_hot_keys_are_named_and_bounded(spark):
    df = spark.range(10_000).select(F.when(F.col("id") < 3000, F.lit("a")).when(F.col("id") < 4000, F.lit("b")).otherwise(F.col("id").cast("string")).alias("k"))
    hashes = {r["k"]: r["h"] for r in df.filter("k in ('a', 'b')").select("k", F.xxhash64("k").alias("h")).distinct().collect()}
    hot = {r["_key"]: r["_pieces"] for r in skew.hot_keys(df, "k", 8).collect()}
    assert set(hot) == set(hashes.values()) and 17 <= hot[hashes["a"]] <= 20  # 2.4 shares of 8 pieces
    exact = skew.hot_of_counts(df.groupBy("k").agg(F.count("*").alias("n")), "k", 8)
    assert {r["_key"]: r["_pieces"] for r in exact.collect()} == {hashes["a"]: 20, hashes["b"]: 7}
    assert skew.hot_of_counts(df.limit(0).withColumn("n", F.lit(1)), "k", 8).count() == 0
    assert skew.hot_keys(df.limit(0), "k", 8).count() == 0
    assert skew.hot_keys(df.withColumn("k", F.lit(None).cast("string")), "k", 8).count() == 0
    even = skew.salted_join(df.filter("k > 'a'"), df.limit(0).withColumn("v", F.lit(1)), "k", ["k"])
    assert even.count() == 0
    with pytest.raises(ValueError, match="inner or left"):
        skew.salted_join(df, df, "k", ["k"], "outer")


def test_sets_are_one_file_each_and_load_again(spark):
    folder = tempfile.mkdtemp(prefix="sets-", dir="/tmp") + "/new"
    texts = ['plain', 'with "quotes" and \\', "line\nbreak", "ünï — 食", "", "tab\t"]
    rows = spark.createDataFrame([(i, t, texts[i % 6]) for i, t in enumerate(["a", "b", None] * 8)], "id long, theme string, intent string")
    members = generation.intent_sets(rows, "id", 5)
    intent_sets.export_intent_set_files(members, folder, "2025-01-01", 5)
    intents, about = readers.load_intent_sets(spark, folder)
    want = {(r["set_number"], r["intent"]) for r in members.collect()}
    assert {(r["set_number"], r["intent"]) for r in intents.collect()} == want and intents.count() == 24
    in_order = [r["intent"] for r in intents.filter("set_number = 5").orderBy("pos").collect()]
    assert in_order == [r["intent"] for r in members.filter("set_number = 5").orderBy("pos").collect()]
    sizes = {r["set_number"]: (r["total_intents"], sum(r["theme_distribution"].values()), r["seed"]) for r in about.collect()}
    assert sizes == {n: (4, 4, 42) for n in range(1, 5)} | {5: (8, 8, 42)}
    with open(f"{folder}/intent_sets_summary.json", encoding="utf-8") as f:
        summary = json.load(f)
    assert summary["generation_info"]["total_sets"] == 5 and summary["theme_info"] == ["", "a", "b"] and len(summary["files"]) == 5
    again = members.filter("set_number = 5").withColumn("intent", F.lit("new"))
    intent_sets.export_intent_set_files(again, folder, "2025-01-02", 5)  # sets without intents are empty now
    intents, about = readers.load_intent_sets(spark, folder)
    assert {(r["set_number"], r["intent"]) for r in intents.collect()} == {(5, "new")} and about.count() == 5


def test_an_empty_table_gives_empty_sets(spark):
    folder = tempfile.mkdtemp(prefix="sets-", dir="/tmp")
    none = spark.createDataFrame([], "set_number int, pos long, intent string, theme string")
    intent_sets.export_intent_set_files(none, folder, "2025-01-01", 3)
    intents, about = readers.load_intent_sets(spark, folder)
    assert intents.count() == 0 and [r["total_intents"] for r in about.collect()] == [0, 0, 0]


def test_a_failed_job_leaves_no_set(spark):
    folder = tempfile.mkdtemp(prefix="sets-", dir="/tmp")
    bad = F.when(F.col("id") == 7, F.raise_error(F.lit("stop"))).otherwise(F.lit("x"))
    rows = spark.range(10).select(F.lit(1).alias("set_number"), F.col("id").alias("pos"), bad.cast("string").alias("intent"), F.lit("t").alias("theme"))
    with pytest.raises(Exception, match="stop"):
        intent_sets.export_intent_set_files(rows, folder, "2025-01-01", 1)
    with pytest.raises(FileNotFoundError):
        readers.load_intent_sets(spark, folder)


def test_catalogue_loads_by_vectors(spark):
    empty = Store(**{n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()})
    raw = spark.createDataFrame(
        [(1, "u1", "rice", '["a"]', [1.0, 0.0]), (2, "u2", "rice", '["c"]', [0.99, 0.01]), (3, "u3", "rice", '["b"]', [0.0, 1.0]),
         (4, "u4", "soup", '["a"]', [1.0, 0.0]), (5, "u5", "rice", '["ab"]', None), (6, "u6", "rice", '["ba"]', None)],
        "row_id long, image_url string, dish_name string, ingredients string, v array<double>")
    at = F.to_timestamp(F.lit("2025-01-01 00:00:00"))

    def by_letter(texts):
        return [[1.0, 0.0] if "a" in t else [0.0, 1.0] for t in texts]

    def loaded(**how):
        out, _, _ = writers.load_catalogue(empty, raw, "row_id", at, 0.9, **how)
        return [r["image_url"] for r in out.consumable.orderBy("id").collect()]

    assert loaded(vec="v") == ["u1", "u3", "u4", "u5", "u6"]  # rows without a vector stay
    assert loaded(encoder=by_letter) == ["u1", "u2", "u4"]
    assert loaded() == ["u1", "u2", "u3", "u4", "u5", "u6"]
    with pytest.raises(ValueError, match="not both"):
        loaded(vec="v", encoder=by_letter)
