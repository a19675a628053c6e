"""Mix sources to target weights, in words, with an exact budget for every source.

Each row gets a hash-random key.  Whole passes over a source (epochs) are taken
while its target allows; of the last, partial pass the rows come in key order up
to the exact word where the budget ends.  Only sums per source and key range
are shuffled: prefix sums over 4,096 key ranges name the range in which the
budget ends, and only the rows of that one range are sorted.  Rows equal in id
and text have one key; they are told apart by their place in the input.  The
texts themselves never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relish.session import stage

WORD = r"[^\x20\x09-\x0D]+"
RANGE_DIGITS = 3  # hexadecimal digits of the key that name a range


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    marks = F.regexp_replace(text, r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")  # one character a word, no array of words
    return F.when(text.rlike(WORD), F.length(marks)).otherwise(0).cast("long")


def random_key(row_id: Column, text: Column, seed: str) -> Column:
    """MD5 of seed, id and text: rows that share an id have keys of their own unless their texts are equal too."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(row_id.cast("string"), F.lit("null")), F.lit(":"),
                          F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))))


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """``(source, source_size, target)`` from ``sizes(source, source_size)``, one row per source.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    ``share`` times all sizes.  A target stops at ``most`` times its source's
    size; what is over goes to the others by weight until none is above.  That
    ends where target = min(cap, level * weight) for one common level, found by
    one running sum over the sources in order of cap / weight.
    """
    everything = Window.partitionBy()
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    capped = weighed.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    before = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    levels = capped.withColumn("_level", level)
    found = F.max(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_level"))).over(everything)  # of those that fit, that with the fewest capped
    return levels.withColumn("_found", found).select(
        "source", "source_size",
        F.when(F.col("_found").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_found") * F.col("_w"))).alias("target"))


def _last_step(steps: DataFrame, goal: DataFrame, order: str) -> DataFrame:
    """Per source the step at which its budget ends: ``(source, <order>, _left)``, with what is left of it there.

    ``steps(source, <order>, _words)`` are sums, ``goal(source, _left)`` is the budget.
    """
    ahead = Window.partitionBy("source").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = steps.withColumn("_before", F.coalesce(F.sum("_words").over(ahead), F.lit(0)))
    return placed.alias("s").join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).filter(
        (F.col("_before") <= F.col("_left")) & (F.col("_left") < F.col("_before") + F.col("_words"))).select(
        "s.source", order, (F.col("_left") - F.col("_before")).alias("_left"))


def _within(rows: DataFrame, edge: DataFrame, at: Column, order: str) -> DataFrame:
    """The rows of the step that ``edge`` names for their source."""
    named = edge.select(F.col("source").alias("_source"), F.col(order).alias("_at"))
    return rows.join(named, F.col("source").eqNullSafe(F.col("_source")) & (at == F.col("_at"))).drop("_source", "_at")


def cuts(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """Where each source's budget ends: ``(source, source_size, target, passes, cut_key, cut_row, cut_words)``.

    ``rows(source, key, part, row, size)``, in the order of key and row; ``row``
    matters among rows of one key only, and lies in the partition ``part``.
    Rows before the cut are taken once more than ``passes`` times, the row at the
    cut gives ``cut_words`` words, later rows nothing more.  Ranges of keys, keys,
    partitions and rows are summed in turn, each inside the step found before,
    so no window meets more rows than one range or one partition holds.
    """
    budget = goal.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    left = budget.select("source", (F.floor("target") - F.col("passes") * F.col("source_size")).cast("long").alias("_left"))
    digits = F.substring("key", 1, RANGE_DIGITS)
    total = F.sum("size").alias("_words")
    in_range = _last_step(rows.groupBy("source", digits.alias("_bin")).agg(total), left, "_bin")
    key = stage(_last_step(_within(rows, in_range, digits, "_bin").groupBy("source", "key").agg(total), in_range, "key"))
    same_key = _within(rows, key, F.col("key"), "key")
    part = stage(_last_step(same_key.groupBy("source", "part").agg(total), key, "part"))
    row = _last_step(_within(same_key, part, F.col("part"), "part").select("source", "row", F.col("size").alias("_words")), part, "row")
    cut = key.alias("k").join(row.alias("r"), F.col("k.source").eqNullSafe(F.col("r.source"))).select(
        F.col("k.source").alias("_cut_source"), F.col("key").alias("cut_key"), F.col("row").alias("cut_row"), F.col("r._left").alias("cut_words"))
    return budget.join(cut, budget.source.eqNullSafe(cut["_cut_source"]), "left").select(
        "source", "source_size", "target", "passes", "cut_key", "cut_row", "cut_words")


def mix(docs: DataFrame, text: str = "text", source: str = "source", row_id: str = "doc_id", seed: str = "mix",
        share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """Every row of ``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target``, ``mix_passes``, ``mix_last`` and ``mix_taken``.

    ``mix_taken`` = ``mix_passes`` whole copies + the first ``mix_last`` words.  Per
    source the taken words add up to the floor of its target.  Null and empty
    texts have size 0 and take nothing; a null source is a source of its own;
    a null id is one more id.  Keys come from id and text; rows equal in both are
    taken one after the other, which of them first does not change the result.
    An empty table gives an empty result; other columns pass through, unless
    they bear a ``mix_`` name from above, which is replaced.
    """
    made = ["mix_size", "mix_source_size", "mix_target", "mix_passes", "mix_last", "mix_taken"]
    docs = docs.drop(*made)
    key = random_key(F.col(row_id), F.col(text), seed)
    rows = stage(docs.select(F.col(source).alias("source"), key.alias("key"), F.spark_partition_id().alias("part"),
                             F.monotonically_increasing_id().alias("row"), word_count(F.col(text)).alias("size")))
    goal = stage(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights))
    cut = cuts(rows, goal).select(*[F.col(c).alias(f"_mix_{c}") for c in
                                    ("source", "source_size", "target", "passes", "cut_key", "cut_row", "cut_words")])
    keyed = docs.withColumns({"mix_size": word_count(F.col(text)), "_mix_key": key, "_mix_row": F.monotonically_increasing_id()})
    joined = keyed.join(stage(cut), F.col(source).eqNullSafe(F.col("_mix_source")), "left")
    same = F.col("_mix_key") == F.col("_mix_cut_key")
    last = (F.when((F.col("_mix_key") < F.col("_mix_cut_key")) | (same & (F.col("_mix_row") < F.col("_mix_cut_row"))), F.col("mix_size"))
            .when(same & (F.col("_mix_row") == F.col("_mix_cut_row")), F.col("_mix_cut_words"))
            .otherwise(F.lit(0)).cast("long"))
    return joined.withColumns({
        "mix_source_size": F.col("_mix_source_size"), "mix_target": F.col("_mix_target"), "mix_passes": F.col("_mix_passes"), "mix_last": last,
    }).withColumn("mix_taken", F.col("mix_passes") * F.col("mix_size") + F.col("mix_last")).select(*docs.columns, *made)


def mixed_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: one row per copy taken, the last one cut to its words.

    Rows of which nothing is taken are left out.  A cut text keeps its first
    words, joined by one space.
    """
    planned = mix(docs, text=text, **options)
    whole = F.when(F.col("mix_size") > 0, F.col("mix_passes") + (F.col("mix_last") == F.col("mix_size")).cast("long")).otherwise(0)
    part = F.when((F.col("mix_last") > 0) & (F.col("mix_last") < F.col("mix_size")), 1).otherwise(0)
    copies = planned.withColumn("_whole", whole).withColumn("_copies", (F.col("_whole") + part).cast("int")).filter("_copies > 0")
    copies = copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), F.lit(1), F.col("mix_last").cast("int")), " ")
    return copies.withColumn(text, F.when(F.col("_copy") > F.col("_whole"), cut).otherwise(F.col(text))).select(*docs.columns)


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(source_size * 2.0::DOUBLE) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM sources WINDOW before AS (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT source, source_size, coalesce(least(cap, w * (SELECT max(level) FROM ranked WHERE level <= cap / w)), cap) AS target FROM ranked),
budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM goal),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized)
SELECT p.doc_id, p.size, b.source_size, b.target,
  (b.passes * p.size + greatest(0, least(p.size, floor(b.target)::BIGINT - b.passes * b.source_size - p.before)))::BIGINT AS taken
FROM placed p JOIN budget b ON p.source IS NOT DISTINCT FROM b.source
"""
