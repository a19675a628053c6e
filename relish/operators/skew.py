"""Joins on keys of which a few hold a large share of the rows.

A first pass counts frequent keys in counters of a fixed size, which every task
fills for itself and which are merged; it names the keys that hold more than a
task's share.  Only their rows are dealt on by a second key, and only their
rows of the other side are repeated, so other keys cost nothing extra.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECES = 8  # pieces of a hot key for every share of a task, so that pieces spread evenly
MOST_TASKS = 8192  # bounds the table of hot keys at 2 * 8192 rows of two numbers
HOT_SCHEMA = T.StructType([T.StructField("_key", T.LongType()), T.StructField("_pieces", T.IntegerType())])


def hot_keys(df: DataFrame, key: str, tasks: int) -> DataFrame:
    """Hashes of the keys with over half a task's share of the rows, with the number of pieces they need.

    Counts may be too low by a fifth of a share, so a key with 0.7 shares is
    always found.  At most ``2 * tasks`` rows come back.
    """
    tasks = min(tasks, MOST_TASKS)
    tracked = 16 * tasks
    counted = df.filter(F.col(key).isNotNull()).select(F.xxhash64(key).alias("_h")).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(_h, {2 * tasks}, {tracked})").alias("top")).first()
    share = counted["n"] / tasks
    hot = [(t["item"], -int(-PIECES * t["count"] // share)) for t in counted["top"] or [] if 2 * t["count"] > share]
    return df.sparkSession.createDataFrame(hot, HOT_SCHEMA)


def hot_of_counts(counts: DataFrame, key: str, tasks: int) -> DataFrame:
    """The same from the exact counts ``(key, n)`` of all keys; not more rows, since their shares add up to one."""
    share = counts.agg(F.sum("n") / F.lit(min(tasks, MOST_TASKS))).scalar()
    hot = counts.filter(F.col(key).isNotNull()).withColumn("_share", share).filter(2 * F.col("n") > F.col("_share"))
    return hot.groupBy(F.xxhash64(key).alias("_key")).agg(F.max(F.ceil(PIECES * F.col("n") / F.col("_share"))).cast("int").alias("_pieces"))


def salted_join(left: DataFrame, right: DataFrame, key: str, spread_by: Sequence[str], how: str = "inner",
                tasks: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, rows of hot keys of ``left`` dealt by ``spread_by``.

    ``how`` is inner or left.  Null keys match nothing.  ``spread_by`` names
    columns of ``left`` that tell its rows apart; equal rows stay together.
    ``right`` is repeated for hot keys only, once per piece.  Where the rows of
    ``left`` per key are known already, ``counts(key, n)`` spares the first pass.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"a salted join is inner or left, not {how}")
    tasks = tasks or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(hot_keys(left, key, tasks) if counts is None else hot_of_counts(counts, key, tasks))  # bounded: see MOST_TASKS
    pieces = F.coalesce("_pieces", F.lit(1))

    def marked(df: DataFrame) -> DataFrame:
        return df.withColumn("_key", F.xxhash64(key)).join(hot, "_key", "left")

    dealt = marked(left).withColumn("_piece", F.pmod(F.xxhash64(F.lit("piece"), *spread_by), pieces).cast("int"))
    repeated = marked(right).withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return dealt.drop("_key", "_pieces").join(repeated.drop("_key", "_pieces"), [key, "_piece"], how).drop("_piece")
