"""Merged sketches against exact values; streamed label edits against one upsert."""

import json
import random

import pytest
from pyspark.sql import functions as F

from relish.operators import sketches
from relish.operators.store import Store, conform, upsert_labels
from relish.streaming import label_log

POINTS = {"p05": 0.05, "p50": 0.5, "p99": 0.99}


def test_merged_parts_keep_the_error_of_the_whole(spark, tmp_path):
    df = spark.range(60_000).select(
        (F.col("id") % 7).alias("run"), F.pmod(F.xxhash64("id"), F.lit(20_011)).alias("v"),
        F.when(F.col("id") % 10 > 0, F.col("id") * 0.5).otherwise(F.lit(float("nan"))).alias("w"), (F.col("id") % 3).cast("string").alias("name"))
    path = str(tmp_path / "parts")
    for run in range(7):  # every run stores its own part
        sketches.profile_parts(df.filter(F.col("run") == run), ["run"], ["v", "w"], ["name"]).write.mode("append").parquet(path)
    merged = sketches.merge_parts(spark.read.parquet(path))
    whole = sketches.profile_parts(df, [], ["v", "w"], ["name"])
    for parts in (merged, whole):
        got = {r["column"]: r for r in sketches.read_profile(parts, POINTS).collect()}
        assert {c: (r["rows"], r["nulls"]) for c, r in got.items()} == {"v": (60_000, 0), "w": (60_000, 6_000), "name": (60_000, 0)}
        assert got["name"]["distinct"] == 3 and got["name"]["p50"] is None
        for column in ("v", "w"):
            values = sorted(r[0] for r in df.filter(~F.isnan(column)).select(column).collect())
            assert abs(got[column]["distinct"] / len(set(values)) - 1) < 4 * sketches.DISTINCT_ERROR
            for name, p in POINTS.items():
                low = sum(v < got[column][name] for v in values) / len(values)
                high = sum(v <= got[column][name] for v in values) / len(values)
                assert low - 2 * sketches.RANK_ERROR <= p <= high + 2 * sketches.RANK_ERROR
    assert sketches.profile_parts(df.limit(0), [], ["v"]).count() == 0


def test_column_of_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None)], "run int, v double")
    r = sketches.read_profile(sketches.merge_parts(sketches.profile_parts(df, ["run"], ["v"])), POINTS).first()
    assert (r["rows"], r["nulls"], r["distinct"], r["p50"]) == (2, 2, 0, None)


@pytest.fixture
def store(spark):
    label = spark.createDataFrame([(i, 1 + i % 2, i // 2, "E", "why") for i in range(20)], "id long, labeler_id long, example_id long, esci_label string, label_reason string")
    return Store(**{t: conform(label.limit(0) if t != "label" else label, t) for t in Store.__dataclass_fields__})


def test_streamed_edits_equal_one_upsert(spark, store, tmp_path):
    rng = random.Random(2)
    edits = [{"example_id": rng.randrange(14), "labeler_id": rng.randrange(1, 4), "esci_label": rng.choice(["E", "S", "C", "I", "X", None]),
              "edited_at": f"2025-01-0{rng.randrange(1, 6)}T00:00:00Z", "seq": i} for i in range(120)]
    folder, log = tmp_path / "edits", str(tmp_path / "log")
    folder.mkdir()

    def arrive(name, rows):
        (folder / name).write_text("\n".join(json.dumps(r) for r in rows))
        label_log.start_label_log(spark, str(folder), log, str(tmp_path / "cp"), files_per_batch=1).awaitTermination()

    arrive("b.json", edits[60:])  # the late half comes second
    arrive("a.json", edits[:60])
    arrive("c.json", edits[30:90])  # sent again
    want = upsert_labels(store, spark.createDataFrame(edits, "example_id long, labeler_id long, esci_label string, edited_at string, seq long")
                         .withColumn("edited_at", F.col("edited_at").cast("timestamp")))[0]

    def rows(s):
        return sorted(map(str, s.label.collect()))

    assert rows(label_log.labels_of(store, log)) == rows(want)
    sizes = [spark.read.parquet(f"{log}/batch={i}").count() for i in range(3)]
    assert max(sizes) <= 42 and len(sizes) == 3
    # a batch repeated after a failure changes nothing
    again = spark.read.schema(label_log.EDITS).json(str(folder / "b.json"))
    label_log.append_edits(again, 0, log)
    assert rows(label_log.labels_of(store, log)) == rows(want)
