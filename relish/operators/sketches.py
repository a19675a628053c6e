"""Profiles that are stored per run and merged later, beside the exact forms.

A part holds, for every column, its rows, nulls, a distinct-count sketch and,
for numbers, a quantile sketch.  Sketches have a fixed size, so parts can be
kept for ever; merging them gives the profile of all runs without reading the
rows again, within the same error as one sketch of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_DISTINCT = 12  # binary logarithm of the registers of a distinct-count sketch
QUANTILE_SIZE = 400
# standard error of a distinct count, relative to it; and error of a quantile's rank, relative to
# the rows, that 99 in 100 quantiles keep (published bound of the sketch for one quantile)
DISTINCT_ERROR = 1.04 / 2 ** (LG_DISTINCT / 2)
RANK_ERROR = 2.296 / QUANTILE_SIZE ** 0.9723


def profile_parts(df: DataFrame, run: Sequence[str], numbers: Sequence[str], others: Sequence[str] = ()) -> DataFrame:
    """``(<run>, column, rows, nulls, distinct_sketch, quantile_sketch)``, one row per run and column, in one pass.

    Nulls and NaN count as nulls.  An empty table gives no rows.
    """
    def part(name: str, number: bool) -> Column:
        value = F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double")) if number else F.col(name).cast("string")
        return F.struct(
            F.lit(name).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(value.isNull()).alias("nulls"),
            F.hll_sketch_agg(value.cast("string"), LG_DISTINCT).alias("distinct_sketch"),
            (F.kll_sketch_agg_double(value, QUANTILE_SIZE) if number else F.lit(None).cast("binary")).alias("quantile_sketch"))

    parts = [part(c, True) for c in numbers] + [part(c, False) for c in others]
    rows = df.groupBy(*run).agg(F.array(*parts).alias("parts"), F.count(F.lit(1)).alias("_n")).filter("_n > 0")
    return rows.select(*run, F.inline("parts"))


def merge_parts(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Parts of several runs as one, for every column and the columns ``by``; the result is a part again."""
    return parts.groupBy(*by, "column").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"))


def read_profile(parts: DataFrame, points: dict[str, float]) -> DataFrame:
    """Parts with ``distinct`` (relative error DISTINCT_ERROR) and the named quantiles (rank error RANK_ERROR) in place of the sketches.

    Quantiles are values that occur; null for columns that are no numbers and
    for columns of nulls.
    """
    n = F.when(F.col("quantile_sketch").isNotNull(), F.kll_sketch_get_n_double("quantile_sketch")).otherwise(0)
    return parts.withColumn("distinct", F.hll_sketch_estimate("distinct_sketch")).withColumns({
        name: F.when(n > 0, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(p))) for name, p in points.items()
    }).drop("distinct_sketch", "quantile_sketch")
