"""Byte-string removal against a plain one: every window of every text looked up in a dictionary."""

import random

import pytest

from relish.llm import suffix_dedup

SCHEMA = "doc_id long, text string, block int, n_bytes string, step int, bin long"


def rows(seed, length):
    rng = random.Random(seed)
    letters = rng.choice(["ab", "abc é", "abcdefghij 漢\U0001f600"])
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [make(rng.randrange(length // 2, 4 * length)) for _ in range(8)]
    out = []
    for i in range(70):
        text = make(rng.randrange(0, 3 * length))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            at = rng.randrange(len(text) + 1)
            text = text[:at] + p[a:a + rng.randrange(1, len(p) + 1)] + text[at:]
        out.append((rng.choice([i, i, i, i, None, 30]), text))
    out += [(100, None), (101, ""), (102, "x" * (length - 1)), (103, "x" * length), (104, "x" * 5000), (50, "x" * (length + 7)), (105, passages[0] * 6)]
    out += [(106, out[3][1]), (106, out[3][1]), (107, out[3][1] + out[4][1]), (-5, out[5][1]), (None, out[6][1]), (None, "only here " * 9)]
    return out


def plain(data, length):
    big = 2**63 - 1
    first = {}
    texts = [(big if i is None else i, i, (t or "").encode()) for i, t in data]
    for i, _, t in texts:
        for a in range(len(t) - length + 1):
            g = t[a:a + length]
            first[g] = min(first.get(g, big), i)
    out = []
    for i, given, t in texts:
        gone = [False] * len(t)
        for a in range(len(t) - length + 1):
            if first[t[a:a + length]] < i:
                gone[a:a + length] = [True] * length
        spans = [a for a in range(len(t)) if gone[a] and (a == 0 or not gone[a - 1])]
        ends = [a + 1 for a in range(len(t)) if gone[a] and (a + 1 == len(t) or not gone[a + 1])]
        out.append((given, len(t), sum(gone), tuple(zip(spans, ends)), bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], tuple((s["start"], s["end"]) for s in r["removed"]), bytes(r["kept_bytes"])) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed, length, partitions", [(1, 50, 1), (2, 50, 9), (3, 17, 5), (4, 33, 3), (5, 120, 4)])
def test_removal_equals_a_plain_one(spark, seed, length, partitions):
    data = rows(seed, length)
    docs = spark.createDataFrame([(*r, 5, "n", 1, 2) for r in data], SCHEMA).repartition(partitions)
    got = suffix_dedup.remove_repeated_bytes(docs, length=length)
    assert got.columns == ["doc_id", "text", "step", "bin", "n_bytes", "n_removed", "removed", "kept_bytes"]
    assert result(got) == plain(data, length)


def test_long_texts_in_parts(spark, monkeypatch):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(4_500_000))
    data = [(1, long), (2, "zz" + long[1_048_500:1_048_700] + "yy"), (3, long[2_097_000:4_300_000]), (0, long[4_400_100:4_400_160])]
    got = result(suffix_dedup.remove_repeated_bytes(spark.createDataFrame(data, "doc_id long, text string").repartition(2)))
    assert [r[:4] for r in got] == [(0, 60, 0, ()), (1, 4_500_000, 60, ((4_400_100, 4_400_160),)), (2, 204, 200, ((2, 202),)), (3, 2_203_000, 2_203_000, ((0, 2_203_000),))]


def test_empty_table_and_short_threshold(spark):
    assert suffix_dedup.remove_repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeated_bytes(spark.createDataFrame([], "doc_id long, text string"), length=15)


def test_blocks_follow_the_size_of_the_files(spark, monkeypatch, tmp_path):
    data = [(i, "".join(random.Random(i % 60).choices("abcdefgh ", k=300))) for i in range(90)]
    spark.createDataFrame(data, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    blocks, most = [], []
    stage_blocks, judge = suffix_dedup.stage_blocks, suffix_dedup._earlier_elsewhere
    monkeypatch.setattr(suffix_dedup, "stage_blocks", lambda *x: blocks.append(stage_blocks(*x)) or blocks[-1])
    monkeypatch.setattr(suffix_dedup, "BLOCK_INPUT", 4096)
    got = suffix_dedup.remove_repeated_bytes(spark.read.parquet(f"{tmp_path}/docs"))
    assert result(got) == plain(data, 50)
    sizes = [r["count"] for r in blocks[0].groupBy("block").count().collect()]
    assert len(sizes) > 2 and max(sizes) <= 45  # one file of one row group would be one block

    monkeypatch.setattr(suffix_dedup, "SORTED", 100)
    keys = [suffix_dedup.np.arange(i, 3000, 3, dtype="u8") << suffix_dedup.np.uint64(50) for i in (0, 0, 1)]
    sent = suffix_dedup._table({"step": [2] * 3, "bin": [0] * 3, "block": [1, 2, 3], "keys": [suffix_dedup.squeeze(k, True) for k in keys],
                                "extra": [suffix_dedup.squeeze(k * 0 + i) for i, k in enumerate(keys)]}, suffix_dedup.SENT)
    monkeypatch.setattr(suffix_dedup, "_earlier_elsewhere", lambda k, ids: most.append(len(k)) or judge(k, ids))
    back = suffix_dedup._sort_bin([suffix_dedup.pa.scalar(2)], sent).to_pylist()
    assert [r["block"] for r in back] == [2] and suffix_dedup.unsqueeze(back[0]["keys"], True).tolist() == keys[1].tolist()
    assert max(most) <= 300 and sum(most) == sum(map(len, keys))
