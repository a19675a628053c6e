"""Bag and set operations."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concat(*frames: DataFrame) -> DataFrame:
    """Bag union by column name; columns missing in a frame are null."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_union(*frames: DataFrame) -> DataFrame:
    """Set union."""
    return concat(*frames).distinct()


def overlap(relevant: str | Column, retrieved: str | Column) -> Column:
    """Ids in both arrays."""
    return F.array_intersect(relevant, retrieved)


def difference(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` does not have."""
    return left.select(*columns).distinct().join(right.select(*columns), list(columns), "left_anti")
