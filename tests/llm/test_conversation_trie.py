"""The prefix trie against a plain trie of lists, over few and many partitions, small crowns, bands and queues."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from relish.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k1 string, total double, piece int"


def rows():
    rng = random.Random(3)
    out = []
    for c in [*range(0, 40), *range(100, 130), 250, 251, 300, -7, -120, 10**12 + 5]:
        for turn in range(rng.choice([1, 2, 3, 6, 9])):
            out.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "user", "bot", None]), rng.choice(["a", "b", "a", "", None, "é漢"])))
    out += [(400 + i, t, "user", f"same {t}") for i in range(30) for t in range(4)]
    out += [(500, t, "user", str(t % 3)) for t in range(120)] + [(501, t, "user", str(t % 3)) for t in range(90)]
    out += [(502, 0, "bot", "long " * 40_000), (None, 1, "user", "no id"), (3, 1, "user", "twice"), (3, 1, "user", "twice")]
    return out


def plain(data):
    own = defaultdict(list)
    for c, turn, role, text in data:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in sorted(whole.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        below[node] = (sum(below[x][0] for x in children[node]) or 1, saved + sum(below[x][1] for x in children[node]))
    return {(m[0], len(node), members[node[:-1]][0] if node else None, len(m), len(children[node]), *below[node],
             hashlib.sha256(",".join(str(c) for c in m if whole[c] == node).encode()).hexdigest()) for node, m in members.items()}


@pytest.mark.parametrize("partitions, options", [(1, {}), (9, {"crown_size": 5, "band": 4, "most": 4}), (3, {"crown_size": 40, "band": 1}), (5, {"crown_size": 300, "band": 50, "most": 6})])
def test_trie_equals_a_plain_one(spark, partitions, options):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        docs = spark.createDataFrame([(*r, 1, "x", 0.5, 7) for r in rows()], SCHEMA).repartition(partitions)
        got = [tuple(r) for r in trie.rebuilt_trie(docs, **options).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(set(got)) and set(got) == plain(rows())


def test_empty_table(spark):
    assert trie.rebuilt_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    only = trie.rebuilt_trie(spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string"))
    assert only.count() == 0


def test_queue_spills_and_keeps_order():
    rng = random.Random(1)
    queue, waiting = trie.SpillingQueue(most=16, block=3), defaultdict(list)
    for level in range(60, 0, -1):
        for _ in range(rng.randrange(40)):
            message = (-rng.randrange(level), rng.randrange(-3, 3), rng.randrange(3), 1, rng.randrange(100), rng.randrange(100))
            queue.push(message)
            waiting[message[:3]].append(message)
        for place in sorted(p for p in waiting if p[0] <= -(level - 1)):
            assert sorted(queue.pop(place)) == sorted(waiting.pop(place))
    assert not waiting and queue.spilled > 100 and len(queue.heap) <= 16


def test_ids_of_a_node_are_hashed_in_pieces(spark):
    ends = spark.createDataFrame([(0, 0, 0, i) for i in range(9000)] + [(2, 5, -5, 77)], "depth long, k1 long, k2 long, conv_id long").repartition(6)
    got = {r["depth"]: r["ends_sha256"] for r in trie.end_digests(ends).collect()}
    assert got == {0: hashlib.sha256(",".join(map(str, range(9000))).encode()).hexdigest(), 2: hashlib.sha256(b"77").hexdigest()}
