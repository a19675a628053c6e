"""Search with all words of a query text, as registered, and its sums."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from relish.llm import topk
from relish.llm.queries import op5


def test_registered_search_uses_all_words(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{min(rng.randrange(1, 400), rng.randrange(1, 400))}" for _ in range(rng.choice([3, 40, 150])))) for i in range(301)]
    rows += [(400, rows[100][1]), (401, rows[100][1]), (402, rows[200][1])]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bags = [Counter(t.split()) for _, t in rows]
    df = Counter(w for bag in bags for w in bag)
    mean = sum(map(Counter.total, bags)) / len(rows)

    def score(query, bag):
        return sum(math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * bag.total() / mean)) for w in query if w in bag)

    got = {}
    for r in op5(lambda name: table).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    assert set(got) == {0, 100, 200, 300, 400}
    for n, (query, _) in enumerate(rows):
        if query in got:
            want = sorted((-round(score(bags[n], bag), 9), i) for m, ((i, _), bag) in enumerate(zip(rows, bags)) if m != n)[:10]
            mine = sorted(got[query])
            assert [m[1] for m in mine] == [i for _, i in want] and np.allclose([m[2] for m in mine], [-s for s, _ in want])


@pytest.mark.parametrize("step", [1, 700, 1 << 18])
def test_adding_up_equals_wand(monkeypatch, step):
    monkeypatch.setattr(topk, "STEP", step)
    rng = np.random.default_rng(8)
    for _ in range(20):
        lists = [np.sort(rng.choice(900, rng.integers(1, 400), replace=False)).astype(np.int32) for _ in range(8)]
        starts, at = np.append(0, np.cumsum([len(x) for x in lists])), np.concatenate(lists)
        share, weights, places = rng.choice([0.5, 1.0, 0.7], len(at)), rng.random(8), np.array([0, 2, 3, 6, 7])
        own = [(at[starts[p]:starts[p + 1]].tolist(), share[starts[p]:starts[p + 1]] * weights[p]) for p in places]
        skip = int(at[0])
        want = topk.wand([(d, s.tolist(), np.maximum.reduceat(s, np.arange(0, len(s), topk.POSTINGS)).tolist()) for d, s in own], 10, skip)
        assert topk.full(places, weights[places], starts, at, share, 900, 10, skip) == want


@pytest.mark.parametrize("partitions, postings", [(1, 1 << 20), (8, 1 << 20), (2, 3)])
def test_repeated_ids_do_not_depend_on_partitions(spark, partitions, postings):
    rows = [(100, "one two three four")] * 3 + [(i, f"word{i % 4} two four x{i}") for i in range(1, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    got = topk.search(df, lambda i: i % 100 == 0, k=2, shard_postings=postings)
    assert sorted((r["query_id"], r["rank"], r["doc_id"]) for r in got.collect()) == [(100, 1, 100)] * 3 + [(100, 2, 100)] * 3


def _postings(rng, docs):
    lists = [np.sort(rng.choice(docs, rng.choice([2, 30, docs // 2]), replace=False)).astype(np.int32) for _ in range(60)]
    starts, at = np.append(0, np.cumsum([len(x) for x in lists])), np.concatenate(lists)
    copies = np.arange(docs) % 7  # documents of one remainder have equal shares
    return starts, at, (rng.choice([0.5, 1.0, 0.7, 1.3], (60, 7))[np.repeat(np.arange(60), np.diff(starts)), copies[at]])


@pytest.mark.parametrize("visits, cells", [(1 << 16, 1 << 20), (1 << 16, 1), (40, 3000)])
def test_matrix_equals_adding_up(monkeypatch, visits, cells):
    monkeypatch.setattr(topk, "VISITS", visits)
    monkeypatch.setattr(topk, "CELLS", cells)
    rng = np.random.default_rng(5)
    for docs in (256, 300, 1000):
        starts, at, share = _postings(rng, docs)
        often = np.flatnonzero(np.diff(starts) > 30)[:15 * (docs < 1000)]
        queries = [(p := rng.choice(60, rng.integers(1, 60), replace=False), rng.random(len(p))) for _ in range(20)]
        queries = [(p[np.lexsort((p, ~np.isin(p, often)))], w) for p, w in queries]
        skips = [-1, *rng.integers(0, docs, 19).tolist()]
        want = [topk.full(*q, starts, at, share, docs, 10, s) for q, s in zip(queries, skips)]
        assert topk.Dense(starts, at, share, docs, often).best(queries, skips, [0.0] * 20, 10) == want
        floors = [x[len(x) // 2][0] for x in want]
        got = topk.Dense(starts, at, share, docs, often).best(queries, skips, floors, 10)
        assert [[x for x in g if x[0] >= f] for g, f in zip(got, floors)] == [[x for x in w if x[0] >= f] for w, f in zip(want, floors)]


def test_wand_with_a_floor_keeps_what_reaches_it():
    rng = np.random.default_rng(9)
    starts, at, share = _postings(rng, 400)
    lists = [(at[a:b].tolist(), share[a:b].tolist(), np.maximum.reduceat(share[a:b], np.arange(0, b - a, topk.POSTINGS)).tolist()) for a, b in zip(starts[:8], starts[1:9])]
    want = topk.wand(lists, 10, -1)
    for floor in {s for s, _ in want}:
        assert [x for x in topk.wand(lists, 10, -1, floor) if x[0] >= floor] == [x for x in want if x[0] >= floor]


def test_many_words_do_not_add_up_all_postings(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{min(rng.randrange(900), rng.randrange(900))}" for _ in range(60))) for i in range(1, 700)]
    rows += [(i + 1000, text) for i, text in rows[:60]]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    best = lambda n, **more: sorted(map(tuple, topk.search(table.repartition(n), lambda i: i % 100 == 0, k=5, **more).collect()))
    assert best(1) == best(6) == best(1, shard_postings=20_000)

    words = np.arange(400, dtype=np.uint64)
    at = np.tile(np.arange(600, dtype=np.int32), 400)
    shard = {"ids": np.arange(600), "rows": np.arange(600), "sizes": np.full(600, 400, np.int32), "keys": words, "starts": np.arange(401) * 600, "at": at,
             "tf": np.random.default_rng(1).integers(1, 9, len(at)).astype(np.int32), "q_query_ids": np.array([7]), "q_rows": np.array([7]), "q_lengths": np.array([400]),
             "q_keys": words, "q_weights": np.linspace(0.1, 2, 400)}
    batch = topk.pa.RecordBatch.from_pydict({k: [v.tobytes()] for k, v in shard.items()})
    share = shard["tf"] * 2.2 / (shard["tf"] + 1.2)
    want = topk.full(np.arange(400), shard["q_weights"], shard["starts"], at, share, 600, 5, 7)
    monkeypatch.setattr(topk, "full", None)
    found = topk.pa.Table.from_batches(topk._search_shards([batch], 600, 240_000, 5))
    assert found["id"].to_pylist() == [d for _, d in want] and np.allclose(found["score"], [s for s, _ in want], rtol=1e-12)


@pytest.mark.parametrize("most, size", [(0, 1), (255, 1), (256, 2), (65_536, 4)])
def test_numbers_of_an_index_take_few_bytes(most, size):
    values = np.array([most, 0, most // 2])
    data = topk.packed(topk.narrow(values))
    assert len(data) == 3 * size and topk.wide(data, 3).tolist() == values.tolist()
