"""Exact order statistics without gathering the values anywhere."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relish.session import stage


def cumulative_counts(df: DataFrame, column: str) -> DataFrame:
    """Distinct values ``v`` with the rows before (``lo``) and up to (``hi``) them.

    Repeated values are combined first, so a value held by many rows is one row
    here; sorting is by range partitions with per-partition offsets.
    """
    values = (
        df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    parts = stage(values.repartitionByRange("v").withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy("_part").agg(F.sum("n").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    running = F.sum("n").over(Window.partitionBy("_part").orderBy("v"))
    return (
        parts.withColumn("_run", running).join(offsets, "_part")
        .select("v", (F.col("_off") + F.col("_run") - F.col("n")).alias("lo"), (F.col("_off") + F.col("_run")).alias("hi"))
    )


def quantiles(df: DataFrame, column: str, points: Mapping[str, float], method: str = "linear") -> DataFrame:
    """Rows ``(q, value)`` for named quantile points in 0..1.

    ``linear`` interpolates at (n-1)p, the usual data-frame rule; ``exclusive``
    at (n+1)p, clamped to the data.
    """
    cum = cumulative_counts(df, column)
    n = F.col("_n")

    def place(p: float) -> tuple[Column, Column]:
        if method == "linear":
            h = (n - 1) * F.lit(p)
            low = F.floor(h)
            return low, h - low
        if method == "exclusive":
            h = (n + 1) * F.lit(p)
            low = F.greatest(F.lit(1), F.least(F.floor(h), n - 1))
            return low - 1, h - low
        raise ValueError(method)

    wanted = []
    for name, p in points.items():
        low, frac = place(p)
        last = n - 1
        wanted += [
            F.struct(F.lit(name).alias("q"), F.least(low, last).cast("long").alias("at"), (F.lit(1.0) - frac).alias("w"), F.lit(0).alias("side")),
            F.struct(F.lit(name).alias("q"), F.least(low + 1, last).cast("long").alias("at"), frac.cast("double").alias("w"), F.lit(1).alias("side")),
        ]
    hits = (
        cum.withColumn("_n", cum.agg(F.max("hi")).scalar())
        .withColumn("_w", F.filter(F.array(*wanted), lambda s: (s["at"] >= F.col("lo")) & (s["at"] < F.col("hi"))))
        .filter(F.size("_w") > 0)
        .select("v", F.explode("_w").alias("s"))
    )
    return hits.groupBy(F.col("s.q").alias("q")).agg(F.sum(F.col("v") * F.col("s.w")).alias("value"))
