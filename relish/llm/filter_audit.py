"""Which filter removes what, in every order: a cooperative game of five filters, solved exactly.

Every document gets a mask of the filters it fails.  Spark counts documents by
part and mask, so a part of any size becomes at most 32 rows; from these, all 32
coalitions of filters are tabulated.  Differences of coalitions give the counts
of each step in each of the 120 orders.  Shapley values are the solution of the
least-squares problem weighted by the Shapley kernel under the constraint that
the values add up to what all filters remove together; its normal equations are
solved in rationals, so they are exact.

A text never leaves the task that reads it: equal texts are found by SHA-256,
and the first of them by an aggregate, which is combined before the shuffle,
joined back on text and id, so a text in a third of all rows makes no large
group.  Rows without an id are dealt by their text where labels are joined.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from fractions import Fraction
from math import comb, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relish.llm.arrow import per_group
from relish.session import stage

LETTERS = "ABCDE"
REPEATED = "E"  # the filter that depends on the other rows
COUNTS = ("n", "good", "toxic")
RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that depend on one text: too few words, repetitive, upper case, markup characters."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0)
    n = F.size(words)
    return {
        "A": n < 50,
        "B": F.size(F.array_distinct(words)) * 100 < n * 65,
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.length(text) * 5,
        "D": text.rlike("[#$%&*|]"),
    }


def mask_of(failed: dict[str, Column]) -> Column:
    """Bit i is set if filter LETTERS[i] fails."""
    out = F.lit(0)
    for letter, condition in failed.items():
        out = out + F.when(condition, 1 << LETTERS.index(letter)).otherwise(0)
    return out.cast("int")


def masks(docs: DataFrame, labels: DataFrame, filters: Callable[[Column], dict[str, Column]] = text_filters,
          row_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents by part and set of failed filters, as many as there are such sets."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = stage(docs.select(
        F.col(row_id).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(content, 256)).alias("content"), mask_of(filters(content)).alias("mask")))
    rows = rows.groupBy("id", "content", "part", "mask").agg(F.count("*").alias("n"))
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic").filter("id IS NOT NULL").groupBy("id").agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic")).withColumn("deal", F.lit(0).cast("long"))
    spread = F.when(F.col("id").isNull(), F.crc32("content") + 1).otherwise(0)  # rows without an id have no labels: no group of them
    marked = rows.withColumn("deal", spread).join(marks, ["id", "deal"], "left")
    first = rows.filter("id IS NOT NULL").groupBy("content").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    judged = marked.join(first, ["content", "id"], "left")
    repeated = F.col("id").isNotNull() & F.col("first").isNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return judged.withColumn("mask", F.col("mask") + F.when(repeated, 1 << LETTERS.index(REPEATED)).otherwise(0)).groupBy("part", "mask").agg(
        F.sum("n").cast("long").alias("n"), total(F.col("n") * F.col("good")).alias("good"), total(F.col("n") * F.col("toxic")).alias("toxic"))


def coalitions(mask: np.ndarray, counts: np.ndarray, players: int = len(LETTERS)) -> list[int]:
    """For every set of filters, how much they remove together."""
    return [sum(int(c) for m, c in zip(mask, counts) if m & s) for s in range(1 << players)]


def solve(matrix: list[list[Fraction]], right: list[Fraction]) -> list[Fraction]:
    """The solution of a regular linear system, by elimination in rationals."""
    rows = [[*row, value] for row, value in zip(matrix, right)]
    for i in range(len(rows)):
        pivot = next(r for r in range(i, len(rows)) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(len(rows)):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i])]
    return [row[-1] for row in rows]


def shapley(worth: list[int], players: int = len(LETTERS)) -> list[Fraction]:
    """Shapley values of a game given by the worth of each coalition (bit sets; the empty one is worth nothing).

    They minimise sum over coalitions S of w(|S|) * (worth(S) - sum of the
    values in S)^2 with w(s) = (k - 1) / (C(k, s) * s * (k - s)), under the
    constraint that all values add up to the worth of all players.  The
    normal equations with one multiplier for the constraint are solved exactly.
    """
    inner = range(1, (1 << players) - 1)
    weight = {s: Fraction(players - 1, comb(players, s.bit_count()) * s.bit_count() * (players - s.bit_count())) for s in inner}
    has = lambda s, i: s >> i & 1
    matrix = [[sum((weight[s] for s in inner if has(s, i) and has(s, j)), Fraction(0)) for j in range(players)] + [Fraction(1)] for i in range(players)]
    matrix.append([Fraction(1)] * players + [Fraction(0)])
    right = [sum((weight[s] * worth[s] for s in inner if has(s, i)), Fraction(0)) for i in range(players)] + [Fraction(worth[-1])]
    return solve(matrix, right)[:players]


def _audit_part(key, table: pa.Table) -> pa.Table:
    """All orders and steps of one part, from its at most 32 counts."""
    k = len(LETTERS)
    mask = table.column("mask").to_numpy()
    n, good, toxic = (table.column(c).to_numpy() for c in COUNTS)
    removed, good_lost, toxic_lost = (coalitions(mask, c) for c in (n, good, toxic))
    everything = int(n.sum())
    in_all_orders = [int(v * factorial(k)) for v in shapley(removed)]
    out = []
    for order in itertools.permutations(range(k)):
        before = 0
        for step, player in enumerate(order, 1):
            after, own = before | 1 << player, 1 << player
            gone = removed[after] - removed[before]
            out.append((key[0].as_py(), "".join(LETTERS[i] for i in order), step, everything - removed[after], gone, removed[own] - gone,
                        removed[-1] - removed[(1 << k) - 1 - own], good_lost[after] - good_lost[before], toxic_lost[after] - toxic_lost[before],
                        in_all_orders[player]))
            before = after
    names = [c.split()[0] for c in RESULT.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    return pa.table({name: pa.array(column, kinds[c.split()[1]]) for name, c, column in zip(names, RESULT.split(", "), zip(*out))})


def audit(docs: DataFrame, labels: DataFrame, filters: Callable[[Column], dict[str, Column]] = text_filters,
          row_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, order of the five filters, and step: what the step keeps, removes and loses, and its filter's Shapley value.

    ``filters`` gives the conditions A to D for a text column; E fails for a
    text that a row of a smaller id has too.  ``shapley`` is 120 times the
    Shapley value of the filter: its removals summed over all orders.

    Null texts count as empty, a null part as the empty string.  A row without
    an id has no smaller id, is smaller than none, and has no labels; rows that
    share id and text do not fail E for each other.  Several labels of one id
    count as one, good or toxic if any is.  Ties are no matter, since rows are
    only counted.  Texts of any length are handled one at a time.  An empty
    table gives an empty result.  Other columns are not looked at.
    """
    return masks(docs, labels, filters, row_id, text, part).groupBy("part").applyInArrow(per_group(_audit_part), RESULT)


SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
first AS (
  SELECT t, min(doc_id) AS first_id FROM texts GROUP BY t),
marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
words AS (
  SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(first_id < doc_id, false)::INT AS mask
  FROM words JOIN first USING (t) LEFT JOIN marks USING (doc_id)),
counts AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, mask),
worth AS (
  SELECT part, s, coalesce(sum(n) FILTER (mask & s <> 0), 0)::BIGINT AS n, coalesce(sum(good) FILTER (mask & s <> 0), 0)::BIGINT AS good,
    coalesce(sum(toxic) FILTER (mask & s <> 0), 0)::BIGINT AS toxic, sum(n)::BIGINT AS everything
  FROM counts, range(32) AS r(s) GROUP BY part, s),
letters AS (SELECT chr(65 + i::INT) AS c, (1 << i::INT) AS b FROM range(5) AS r(i)),
orders AS (
  SELECT l1.c || l2.c || l3.c || l4.c || l5.c AS filter_order, [l1.b, l2.b, l3.b, l4.b, l5.b] AS bits
  FROM letters l1, letters l2, letters l3, letters l4, letters l5
  WHERE l1.b + l2.b + l3.b + l4.b + l5.b = 31 AND l1.b | l2.b | l3.b | l4.b | l5.b = 31),
steps AS (
  SELECT filter_order, step::INT AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS earlier
  FROM orders, range(1, 6) AS r(step)),
changes AS (
  SELECT x.part, filter_order, step, own, x.everything - x.n AS kept, x.n - y.n AS removed, x.good - y.good AS good_lost, x.toxic - y.toxic AS toxic_lost
  FROM steps JOIN worth x ON x.s = earlier + own JOIN worth y ON y.s = earlier AND y.part = x.part),
summed AS (SELECT part, own, sum(removed)::BIGINT AS shapley FROM changes GROUP BY part, own)
SELECT c.part, filter_order, step, kept, removed, a.n - removed AS redundant, z.n - o.n AS unique_fails, good_lost, toxic_lost, shapley
FROM changes c JOIN summed USING (part, own) JOIN worth a ON a.part = c.part AND a.s = own
JOIN worth z ON z.part = c.part AND z.s = 31 JOIN worth o ON o.part = c.part AND o.s = 31 - own
"""
