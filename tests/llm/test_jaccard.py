"""The n-gram Jaccard join against all pairs in plain Python."""

import random
import re

import numpy as np
import pytest

from relish.llm import jaccard
from relish.llm.trie import Tree, groups


def plain(rows, gram=5, percent=80):
    sets = []
    for _, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append(frozenset(tuple(w[i:i + gram]) for i in range(len(w) - gram + 1)) if len(w) >= gram else frozenset([tuple(w)] if w else []))
    top = list(range(len(rows)))

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                top[find(i)] = find(j)
    lowest = {}
    for i, (row_id, _) in enumerate(rows):
        if row_id is not None:
            lowest[find(i)] = min(row_id, lowest.get(find(i), row_id))
    return sorted(((row_id, len(s), lowest.get(find(i))) for i, ((row_id, _), s) in enumerate(zip(rows, sets))), key=repr)


def run(spark, rows, parts=4, **options):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, block int, id string").repartition(parts)
    return sorted((tuple(r) for r in jaccard.similar_components(docs, **options).collect()), key=repr)


def some_words(rng, n, kinds=4000):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def edited(rng, words, share):
    return [f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def test_near_copies_shared_passages_and_edge_rows(spark):
    rng = random.Random(3)
    passage = some_words(rng, 40)
    rows = [(i, " ".join(some_words(rng, rng.randrange(1, 120)) + (passage if i % 3 == 0 else []))) for i in range(80)]
    rows += [(100 + i, " ".join(edited(rng, rows[i % 20][1].split(), rng.choice([0, 0.005, 0.01, 0.03])))) for i in range(120)]
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "Two WORDS"), (304, "two words"), (305, "two words"), (None, rows[0][1]), (None, None), (306, "a b c d"),
             (307, "x " * 30_000), (307, rows[5][1]), (307, rows[5][1])]
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("share", [0.004, 0.02])
def test_a_large_group_of_near_copies_is_cut_into_pieces(spark, share):
    rng = random.Random(5)
    base = some_words(rng, 150)
    other = edited(rng, base, 0.04)
    rows = [(i, " ".join(edited(rng, base if i % 4 else other, share))) for i in range(150)]
    assert run(spark, rows, piece_size=8) == plain(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_tree_finds_what_all_pairs_find():
    rng = np.random.default_rng(1)
    sets = {}
    for _ in range(60):
        a = rng.choice(40, rng.integers(1, 25), replace=False).astype(np.uint64)
        for drop in range(3):
            s = np.sort(a[drop:] if len(a) > drop else a)
            sets[s.tobytes()] = s
    sets = list(sets.values())
    tree = Tree(sets)
    for i, s in enumerate(sets):
        want = {j for j, t in enumerate(sets) if 180 * len(set(s) & set(t)) >= 80 * (len(s) + len(t))}
        assert set(tree.similar(tree.sets[i], len(s), 80)) == want
        assert set(tree.similar(*tree.place(np.append(s, np.uint64(999))), 80)) == {
            j for j, t in enumerate(sets) if 180 * len(set(s) & set(t)) >= 80 * (len(s) + 1 + len(t))}
    roots = groups(sets, 80)
    for i, s in enumerate(sets):
        for j, t in enumerate(sets):
            if 180 * len(set(s) & set(t)) >= 80 * (len(s) + len(t)):
                assert roots[i] == roots[j]
