"""Sorts, limits, samples, dense positions and splits.

Positions are never taken from an unpartitioned window.  Two forms exist:

* ``with_position`` for any unique ordering: range-partition, sort, stage once,
  then add per-partition offsets.
* ``with_hash_position`` for seeded shuffles: the md5 order is uniform, so its
  leading hex digits are ready-made buckets and no staging is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relish.session import stage

_LOCAL_BITS = (1 << 33) - 1


def shuffle_key(seed: int | str, id_col: str | Column) -> Column:
    """Repeatable random order: md5 of ``seed:id`` (same text in any SQL engine)."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), col.cast("string")))


def sort_by(df: DataFrame, *cols: str | Column) -> DataFrame:
    """Total order by several keys."""
    return df.orderBy(*cols)


def with_position(df: DataFrame, order: Sequence[str | Column], name: str = "pos") -> DataFrame:
    """Dense 0-based position by ``order``, which must be unique per row.

    The input is sorted by range partitions and written once; the partition
    sizes (one row per partition) then give each partition its offset.
    """
    sorted_rows = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_BITS)))
    )
    staged = stage(sorted_rows)
    sizes = staged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: the running total below is over a bounded table
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        staged.join(offsets, "_part")
        .withColumn(name, F.col("_off") + F.col("_local"))
        .drop("_part", "_local", "_off")
    )


def with_hash_position(df: DataFrame, key: Column, groups: Sequence[str] = (), name: str = "pos",
                       digits: int = 3) -> DataFrame:
    """Dense 0-based position by an md5 ``key``, per group or over the whole table.

    Rows fall into ``16**digits`` uniform buckets by the leading digits of the
    key.  Only bucket sizes are accumulated, and row numbers are taken inside a
    bucket, so a group holding most of the rows is still spread over many tasks.
    """
    groups = list(groups)
    keyed = df.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, digits))
    sizes = keyed.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    join_on = [F.col(f"k.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*groups, "_bucket"]]
    cond = join_on[0]
    for c in join_on[1:]:
        cond = cond & c
    inside = Window.partitionBy(*groups, "_bucket").orderBy("_key")
    numbered = keyed.withColumn("_rn", F.row_number().over(inside) - 1)
    return (
        numbered.alias("k").join(offsets.alias("o"), cond)
        .select("k.*", (F.col("o._off") + F.col("k._rn")).cast("long").alias(name))
        .drop("_key", "_bucket", "_rn")
    )


TOP_ROWS = 10_000  # so many first rows are taken by a bounded sort; deeper ones by their position


def seeded_window(df: DataFrame, id_col: str, seed: int = 42, start: int = 0, limit: int | None = None) -> DataFrame:
    """Shuffle the whole table by seed, skip ``start`` rows, keep ``limit`` rows.

    The first TOP_ROWS rows come from a bounded top sort, deeper windows from
    hash positions; both are in shuffled order.  The whole table is returned as
    it is.
    """
    if limit is None and start == 0:
        return df
    if limit is not None and start + limit <= TOP_ROWS:
        return df.orderBy(shuffle_key(seed, id_col)).offset(start).limit(limit)
    placed = with_hash_position(df, shuffle_key(seed, id_col), name="_pos").filter(F.col("_pos") >= start)
    return (placed if limit is None else placed.filter(F.col("_pos") < start + limit)).orderBy("_pos").drop("_pos")


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """T4: repeatable random sample of ``n`` rows."""
    return seeded_window(df, id_col, seed, 0, n)


def sample_fraction(df: DataFrame, id_col: str, fraction: float, seed: int = 42) -> DataFrame:
    """T4: repeatable Bernoulli sample; the leading 32 bits of the md5 decide, without a shuffle."""
    draw = F.conv(F.substring(shuffle_key(seed, id_col), 1, 8), 16, 10).cast("long")
    return df.filter(draw < int(fraction * (1 << 32)))


def systematic_sample(df: DataFrame, order: Sequence[str | Column], size: int) -> DataFrame:
    """T5: every ⌊N/s⌋-th row in order, at most ``size`` rows."""
    placed = with_position(df, order, "_pos")
    step = df.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / F.lit(size)))).scalar()
    return (
        placed.withColumn("_step", step)
        .filter((F.col("_pos") % F.col("_step") == 0) & (F.col("_pos") < F.col("_step") * F.lit(size)))
        .drop("_pos", "_step")
    )


def page(df: DataFrame, order: Sequence[str | Column], number: int, size: int = 6) -> DataFrame:
    """One page of records (0-based page number)."""
    start = number * size
    if start + size <= TOP_ROWS:
        return df.orderBy(*order).offset(start).limit(size)
    return with_position(df, order, "_pos").filter((F.col("_pos") >= start) & (F.col("_pos") < start + size)).drop("_pos").orderBy(*order)


def batch_numbers(df: DataFrame, order: Sequence[str | Column], size: int, name: str = "batch") -> DataFrame:
    """Consecutive batches of ``size`` rows; the last may be short."""
    return with_position(df, order, "pos").withColumn(name, F.floor(F.col("pos") / F.lit(size)).cast("long"))


def stratified_split(df: DataFrame, group: str, id_col: str, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split``; the first ``max(1, int(n*ratio))`` shuffled rows of a group go to test."""
    sizes = df.groupBy(group).agg(
        F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(ratio))).alias("_n_test")
    )
    placed = with_hash_position(df, shuffle_key(seed, id_col), [group], "_pos")
    return (
        placed.join(sizes, group)
        .withColumn("split", F.when(F.col("_pos") < F.col("_n_test"), "test").otherwise("train"))
        .drop("_pos", "_n_test")
    )
