"""The pipeline on a small folder, stage by stage, against plain versions of what each stage decides."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    base = str(tmp_path_factory.mktemp("spark-pipeline"))
    passage = " ".join(f"q{i}" for i in range(55))
    rows = []
    for i in range(200):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(30, 90))]
        if i % 10 == 3:
            words[5:5] = ["vile", "scum", "moron"]
        if i % 25 == 1:
            words += passage.split()
        rows.append((i, " ".join(words), "en", f"s{i % 4}", 0))
    rows += [(200 + i, rows[i * 7 % 100][1], "en", "s1", 0) for i in range(20)] + [(230, None, None, None, None), (231, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 3)) for i in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)

    clean = stages["toxicity"](spark, docs, folder).cache()
    bad = {r["doc_id"] for r in docs.collect() if "scum" in words(r["text"])}
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - bad

    single = stages["near_copies"](spark, clean, folder).cache()
    seen, want = set(), set()
    for r in sorted(clean.collect(), key=lambda r: r["doc_id"]):
        if not words(r["text"]) or r["text"] not in seen:
            want.add(r["doc_id"])
        seen.add(r["text"])
    assert single.columns == columns and {r["doc_id"] for r in single.collect()} == want

    cut = stages["repeated_passages"](spark, single, folder).cache()
    assert cut.columns == columns and cut.count() == single.count()
    assert Counter(w for r in cut.collect() for w in words(r["text"]) if w.startswith("q")).most_common(1)[0][1] == 1
    untouched = {r["doc_id"]: r["text"] for r in single.collect() if "q0" not in words(r["text"])}
    assert {r["doc_id"]: r["text"] for r in cut.collect() if r["doc_id"] in untouched} == untouched

    mixed = stages["mixing"](spark, cut, folder).cache()
    total = sum(len(words(r["text"])) for r in cut.collect())
    assert mixed.columns == columns and abs(sum(len(words(r["text"])) for r in mixed.collect()) - 1.5 * total) <= 10

    packed = stages["packing"](spark, mixed, folder).collect()
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == Counter(r["doc_id"] for r in mixed.collect())
    assert all(r["length"] & (r["length"] - 1) == 0 for r in packed)
    assert corpus_pipeline.run(spark, folder).count() == len(packed)


CLASHES = ["score", "block", "row", "n_words", "n_removed", "repeats", "kept_text", "mix_size", "mix_taken", "root", "id", "_copy", "ids", "start", "dotted.name"]


@pytest.mark.parametrize("number", [0, 3])
def test_clashing_columns_pass_through_and_empty_tables_stay_empty(spark, folder, number):
    rows = [(10 * i, " ".join(f"u{i}x{j}" for j in range(40 + number * i)), "s", *[f"{c}{10 * i}" for c in CLASHES]) for i in range(4 * number)]
    rows += [(None, None, None, *["n"] * len(CLASHES))] * number
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    docs = spark.createDataFrame(rows, schema)
    for name, function in corpus_pipeline.STAGES[:-1]:
        after = function(spark, docs, folder)
        assert after.columns == docs.columns, name
        got = after.collect()
        assert {r["doc_id"] for r in got} <= {r[0] for r in rows}
        assert all(r[c] == (f"{c}{r['doc_id']}" if r["doc_id"] is not None else "n") for r in got for c in CLASHES), name
        assert name == "mixing" or len(got) == len(rows), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert len({r["doc_id"] for r in packed}) == len({r[0] for r in rows})
