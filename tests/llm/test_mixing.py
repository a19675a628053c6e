"""Source mixing against the stated rules, worked out one by one."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from relish.llm import mixing


def reshared(sizes, share=1.5, most=2.0):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_ = dict.fromkeys(order, 0.0), set(order)
    rest = share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > most * sizes[s]}
        if not over:
            for s in open_:
                target[s] = rest * weight[s] / total
            break
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
        open_ -= over
    return target


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def place(row):
    row_id, _, text = row
    return hashlib.md5(f"mix:{'null' if row_id is None else row_id}:{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()


def plain(rows):
    sizes = {}
    for _, source, text in rows:
        sizes[source] = sizes.get(source, 0) + n_words(text)
    target, taken, out = reshared(sizes), {}, []
    for row_id, source, text in sorted(rows, key=place):
        n, size = n_words(text), sizes[source]
        passes = int(target[source] // size) if size else 0
        rest = int(target[source]) - passes * size
        last = max(0, min(n, rest - taken.get(source, 0)))
        taken[source] = taken.get(source, 0) + n
        out.append((row_id, source, n, size, pytest.approx(target[source]), passes * n + last))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0))


def run(spark, rows):
    docs = spark.createDataFrame([(*r, -1, "key") for r in rows], "doc_id long, source string, text string, mix_size int, size string").repartition(3)
    got = mixing.mix(docs).select("doc_id", "source", "mix_size", "mix_source_size", "mix_target", "mix_taken").collect()
    return sorted((tuple(r) for r in got), key=lambda r: (r[0] is None, r[0] or 0))


def rows_of(counts):
    rows, row_id = [], 0
    for source, sizes in counts.items():
        for n in sizes:
            rows.append((row_id, source, " ".join(f"w{i}" for i in range(n)) if n else (None if row_id % 2 else " ")))
            row_id += 1
    return rows


@pytest.mark.parametrize("counts", [
    {"a": [100] * 30, "b": [7, 9, 0, 11], None: [5, 3], "c": [1], "d": [0], "e": [40, 50]},
    {"big": [5] * 200, "B": [1] * 3, "ä": [400], "z": [30] * 10},
    {"only": [3, 4, 5]},
    {"none": [0, 0]},
])
def test_targets_and_taken_words(spark, counts):
    rows = rows_of(counts)
    rows[0] = (None, *rows[0][1:])
    assert run(spark, rows) == plain(rows)


def test_rerun_agrees_and_an_empty_table_is_empty(spark):
    rows = rows_of({"a": [10] * 20, "b": [3] * 9})
    assert run(spark, rows) == run(spark, list(reversed(rows)))
    assert run(spark, []) == []


@pytest.mark.parametrize("rows", [
    [(7, "a", "x y z")] * 50 + [(i, "b", "u v") for i in range(100, 160)],
    [(7, "a", f"w{i}") for i in range(500)] + [(7, "a", "v " * 1000)] + [(8, "b", "x " * 500)],
    [(None, "a", " ".join(["x"] * (i % 90))) for i in range(400)] + [(None, "b", "y")] * 300 + [(None, None, "z z")] * 40,
])
def test_repeated_and_null_ids_reach_the_targets(spark, rows):
    got = run(spark, rows)
    for source in {r[1] for r in rows}:
        own = [r for r in got if r[1] == source]
        assert 0 <= own[0][4] - sum(r[5] for r in own) < 1
        assert all(r[5] <= 2 * r[2] for r in own)
    full = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=full) == sorted(run(spark, rows[::-1]), key=full)


def test_documents_of_the_mix(spark):
    rows = rows_of({"a": [50] * 8, "b": [20] * 7, "c": [30]})
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, extra int")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert words == {r[0]: r[5] for r in run(spark, rows) if r[5]}
