"""Local names for remote media."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relish.functions.text import url_suffix
from relish.operators.ordering import with_position


def media_manifest(df: DataFrame, url: str, order: str) -> DataFrame:
    """each distinct URL with its local file name, numbered by first appearance."""
    first = df.filter(F.col(url).isNotNull()).groupBy(url).agg(F.min(order).alias("_first"))
    placed = with_position(first, ["_first"], "_pos")
    digits = F.col("_pos").cast("string")
    padded = F.when(F.length(digits) < 8, F.lpad(digits, 8, "0")).otherwise(digits)
    return placed.select(url, F.concat(F.lit("image_"), padded, url_suffix(url)).alias("local_name"))


def use_local_names(df: DataFrame, url: str, manifest: DataFrame) -> DataFrame:
    """Replace URLs by their local names; unknown URLs become null."""
    names = manifest.select(url, "local_name")
    return df.join(names, url, "left").withColumn(url, F.col("local_name")).drop("local_name")
