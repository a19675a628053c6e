"""One CSV file with line breaks in cells over many ranges, against the one-task reader and what was written."""

import csv
import random

import pytest
from pyspark.sql import types as T

from relish.sources.csv_ranges import read_csv_ranges
from relish.sources.readers import read_csv

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("note", T.StringType())])


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ranges_cut_anywhere(small_ranges, tmp_path, end):
    rng = random.Random(4)
    pieces = ['"', "\n", ",", "x" * 50, "é", '""', "\n\n", " ", "word", "'", "a,b"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 12))) + "z", rng.choice(["", "n", 'q"', "l1\nl2"])) for i in range(700)]
    rows += [(700, "long\n" * 3000, "over several ranges"), (701, '"', "\n")]
    for part in range(2):
        with open(tmp_path / f"part{part}.csv", "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator=end)
            out.writerow(["id", "te\nxt" if part else "text", "note"])
            out.writerows(rows[part::2])
    df = read_csv_ranges(small_ranges, str(tmp_path), SCHEMA)
    assert small_ranges.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted((i, text, note or None) for i, text, note in rows)
    if end == "\n":
        one_task = read_csv(small_ranges, str(tmp_path), SCHEMA)
        assert got == sorted(tuple(r) for r in one_task.collect())


def test_empty_and_single_line_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text,note\n")
    (tmp_path / "b.csv").write_text("")
    (tmp_path / "c.csv").write_text('id,text,note\n1,plain,"x"\n\n2,,')
    got = read_csv_ranges(spark, str(tmp_path), SCHEMA).collect()
    assert sorted(tuple(r) for r in got) == [(1, "plain", "x"), (2, None, None)]
