"""The filter audit against a plain run of every order over the rows."""

import itertools
import random
import re
from fractions import Fraction

import pytest

from relish.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, mask int, n string, good double, content string, first boolean"
LABELS = "doc_id long, quality int, toxic int, id string"


def rows():
    rng = random.Random(5)
    out = []
    for i in range(120):
        words = [rng.choice(["a", "B", "éß", "漢", "#x", "Word"]) + str(rng.randrange(rng.choice([2, 400]))) for _ in range(rng.choice([0, 3, 49, 50, 80]))]
        if rng.random() < 0.5:
            words = [w.replace("#", "").lower() for w in words]
        out.append((rng.choice([i, i, i, None, 7]), rng.choice([" ", "\n", "\x0b "]).join(words), rng.choice(["s", "t", None, ""])))
    out += [(200, None, "s"), (201, "", None), (202, out[0][1], "t"), (202, out[0][1], "s"), (None, out[0][1], "s"), (203, "LONG $ " * 50_000, "u"), (1, out[3][1], "u")]
    return out


def labels():
    rng = random.Random(6)
    return [(rng.choice([i, i, None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 205, 2)] + [(2, 1, 1), (2, 0, 0)]


def plain(docs, marks):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    texts = [(i, t or "", s or "") for i, t, s in docs]
    failed = []
    for i, t, _ in texts:
        w = word.findall(t)
        failed.append({"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                       "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i and u == t for j, u, _ in texts)})
    good = {i for i, q, _ in marks if q == 1} - {None}
    toxic = {i for i, _, x in marks if x == 1} - {None}
    out = set()
    for part in {s for _, _, s in texts}:
        own = [(texts[k][0], failed[k]) for k in range(len(texts)) if texts[k][2] == part]
        steps, total = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if d[1][letter]]
                left = [d for d in left if not d[1][letter]]
                total[letter] += len(gone)
                steps.append((letter, (part, "".join(order), step, len(left), len(gone), sum(d[1][letter] for d in own) - len(gone),
                              sum(d[1][letter] and sum(d[1].values()) == 1 for d in own), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone))))
        out |= {(*row, total[letter]) for letter, row in steps}
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_every_order_equals_a_plain_run(spark, partitions):
    docs = spark.createDataFrame([(*r, 1, "x", 0.5, "y", True) for r in rows()], SCHEMA).repartition(partitions)
    marks = spark.createDataFrame([(*r, "z") for r in labels()], LABELS)
    got = [tuple(r) for r in filter_audit.audit(docs, marks).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows(), labels())


def test_empty_tables(spark):
    docs = spark.createDataFrame(rows()[:5], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert filter_audit.audit(docs, marks).filter("good_lost > 0 OR toxic_lost > 0").count() == 0


def test_shapley_values_are_exact_averages():
    worth = [0, 3, 5, 9, 2, 4, 7, 10]
    want = [Fraction(0)] * 3
    for order in itertools.permutations(range(3)):
        s = 0
        for p in order:
            want[p] += Fraction(worth[s | 1 << p] - worth[s], 6)
            s |= 1 << p
    assert filter_audit.shapley(worth, 3) == want
