"""Relational joins of the store, the catalogue and shopping tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relish.operators.windows import first_per_key, top_groups


def attach(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left equi-join on shared key names."""
    return left.join(right, list(on), "left")


def split_known(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> tuple[DataFrame, DataFrame]:
    """Distinct referenced ids that exist, and those that do not."""
    ids = df.select(key).distinct()
    known = parent.select(F.col(parent_key).alias(key))
    return ids.join(known, key, "left_semi"), ids.join(known, key, "left_anti")


def attach_labels(generated: DataFrame, labels: DataFrame, id_col: str = "consumable_id",
                  label_col: str = "labels") -> DataFrame:
    """The label array of each row's item, empty when there is none."""
    empty = F.lit([]).cast("array<string>")
    return generated.join(labels.select(id_col, label_col), id_col, "left").withColumn(
        label_col, F.coalesce(label_col, empty))


def attach_first(rows: DataFrame, items: DataFrame, key: str, columns: Sequence[str], order: str) -> DataFrame:
    """Columns of the first item with the same key, null when absent."""
    single = first_per_key(items.select(key, *columns, *([order] if order not in (key, *columns) else [])), [key], order)
    return rows.join(single.select(key, *columns), key, "left")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose parent is missing (null references included)."""
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def orphan_count(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Number of orphans."""
    return orphans(child, key, parent, parent_key).agg(F.count(F.lit(1)).alias("orphaned_count"))


def remap(df: DataFrame, column: str, mapping: DataFrame, old: str, new: str, keep_unmapped: bool = True) -> DataFrame:
    """Replace a key through ``mapping``; unmapped keys stay, or become null."""
    m = mapping.select(F.col(old).alias(column), F.col(new).alias("_new"))
    value = F.coalesce("_new", column) if keep_unmapped else F.col("_new")
    return df.join(m, column, "left").withColumn(column, value).select(*df.columns)


def rows_of_top_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows whose key is among the ``n`` most frequent."""
    return df.join(top_groups(df, key, n).select(key), key, "left_semi")


def not_in(df: DataFrame, key: str, other: DataFrame) -> DataFrame:
    """Rows whose key does not occur in ``other``."""
    return df.join(other.select(key), key, "left_anti")


def label_count(examples: DataFrame, labels: DataFrame, condition: Column) -> DataFrame:
    """Labels on the examples that satisfy ``condition``."""
    chosen = examples.filter(condition).select(F.col("id").alias("example_id"))
    return labels.join(chosen, "example_id").agg(F.count(F.lit(1)).alias("n_labels"))


def judge_results(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """Each retrieved document with its relevance, 0 when unjudged."""
    return results.join(qrels.select("query_id", "doc_id", "rel"), ["query_id", "doc_id"], "left").withColumn(
        "rel", F.coalesce("rel", F.lit(0)))


def sum_scores(*hit_lists: DataFrame) -> DataFrame:
    """Union of hit lists with scores of the same item added."""
    out = hit_lists[0]
    for h in hit_lists[1:]:
        out = out.unionByName(h)
    return out.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
