"""Projections, filters, lookups and constraint checks."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relish.functions.text import strip
from relish.session import stage


def _all(conditions: Sequence[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, conditions, F.lit(True))


def remove_null_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep rows whose listed columns are present and not blank; absent columns are ignored."""
    present = [c for c in columns if c in df.columns]
    return df.filter(_all([F.col(c).isNotNull() & (strip(F.col(c).cast("string")) != "") for c in present]))


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")


def select_renamed(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Select and rename the mapped columns that exist."""
    return df.select(*[F.col(old).alias(new) for old, new in mapping.items() if old in df.columns])


def drop_missing(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Drop rows missing a required field."""
    return df.dropna(subset=list(required))


def clean_text_fields(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text form, trimmed, with the literal ``nan`` as null."""
    return df.withColumns({
        c: F.nullif(strip(F.col(c).cast("string")), F.lit("nan")) for c in columns if c in df.columns
    })


def bridged_only(df: DataFrame) -> DataFrame:
    """P5: only the generated bridge queries; the type column must be there."""
    if "query_type" not in df.columns:
        raise ValueError("'query_type' column not found: cannot select bridged records")
    return df.filter(F.col("query_type") == "bridged")


def bridged_info(df: DataFrame, requested: bool = True) -> DataFrame:
    """P5: one row telling how the bridged filter applies to a run's data."""
    has_type = "query_type" in df.columns
    if requested and not has_type:
        raise ValueError("'query_type' column not found: cannot select bridged records")
    kept = F.count_if(F.col("query_type") == "bridged") if requested else F.count(F.lit(1))
    return df.agg(F.count(F.lit(1)).alias("original_count"), kept.alias("final_count")).select(
        "*",
        F.lit(has_type).alias("has_query_type"),
        F.lit(requested).alias("bridged_requested"),
        F.lit(requested).alias("filtering_applied"),
        (F.lit(requested) & (F.col("final_count") > 0)).alias("can_mark_partial"),
    )


def reviewed_only(df: DataFrame, column: str = "human_esci_label") -> DataFrame:
    """Rows with a human label."""
    return df.filter(F.col(column).isNotNull() & (F.col(column) != ""))


def drop_trivial_matches(view: DataFrame, threshold_pct: float = 70.0) -> DataFrame:
    """In a run whose AI labels are more than ``threshold_pct`` exact, drop rows naming the item itself.

    The share is a scalar subquery.  Rows with a null side are kept.
    """
    share = view.agg(
        (F.count_if(F.col("ai_esci_label") == "E") * 100.0).alias("e"), F.count("ai_esci_label").alias("n")
    ).select(F.coalesce(F.try_divide("e", "n"), F.lit(0.0))).scalar()
    same = F.coalesce(F.lower("query") == F.lower("consumable_name"), F.lit(False))
    return view.withColumn("_e", share).filter((F.col("_e") <= threshold_pct) | ~same).drop("_e")


def drop_trivial_matches_by_run(view: DataFrame, run: str, threshold_pct: float = 70.0) -> DataFrame:
    """P7 for many runs at once: the share is taken per run."""
    share = view.groupBy(run).agg(
        F.coalesce(
            F.try_divide(F.count_if(F.col("ai_esci_label") == "E") * 100.0, F.count("ai_esci_label")), F.lit(0.0)
        ).alias("_e")
    )
    same = F.coalesce(F.lower("query") == F.lower("consumable_name"), F.lit(False))
    # one row per run, written out: joined by its known size, the view is not dealt by run
    return view.join(stage(share), run).filter((F.col("_e") <= threshold_pct) | ~same).drop("_e")


def find_by_ids(df: DataFrame, id_col: str, ids: Sequence[int] | DataFrame) -> DataFrame:
    """Rows with the given ids, ordered by id; ids may be a list or a one-column DataFrame."""
    if isinstance(ids, DataFrame):
        wanted = ids.select(F.col(ids.columns[0]).alias(id_col)).distinct()
        return df.join(wanted, id_col, "left_semi").orderBy(id_col)
    return df.filter(F.col(id_col).isin([int(i) for i in ids])).orderBy(id_col)


def matches_pattern(text: str | Column, pattern: str, exact: bool = False) -> Column:
    """Case-insensitive equality, or substring in which ``%`` and ``_`` stay wildcards."""
    c = F.lower(F.col(text) if isinstance(text, str) else text)
    if exact:
        return c == F.lower(F.lit(pattern))
    return c.like(f"%{pattern}%".lower())


def find_by_pattern(df: DataFrame, text: str, pattern: str, exact: bool = False) -> DataFrame:
    """Rows whose text matches, ordered by text."""
    return df.filter(matches_pattern(text, pattern, exact)).orderBy(text)


def find_by_patterns(df: DataFrame, text: str, patterns: Sequence[str]) -> DataFrame:
    """Rows matching any pattern, once each, ordered by text (one scan)."""
    hit = functools.reduce(lambda a, b: a | b, [matches_pattern(text, p.strip()) for p in patterns])
    return df.filter(hit).distinct().orderBy(text)


def contains_ignore_case(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """Regular expression found anywhere, ignoring case; null text does not match."""
    return df.filter(F.coalesce(F.col(text).rlike("(?i)" + pattern), F.lit(False)))


def equals(df: DataFrame, column: str, value) -> DataFrame:
    """P10: rows of one category."""
    return df.filter(F.col(column) == F.lit(value))


def runs_with_status(runs: DataFrame, *statuses: str) -> DataFrame:
    """Runs whose status tag is one of ``statuses``."""
    return runs.filter(F.try_element_at("tags", F.lit("data_status")).isin(*statuses))


def acceptable_clusterings(sweep: DataFrame) -> DataFrame:
    """Settings with 5..50 clusters, 5..30 % noise and a positive silhouette."""
    return sweep.filter(
        F.col("n_clusters").between(5, 50) & F.col("noise_ratio").between(0.05, 0.30)
        & (F.col("silhouette_score") > 0)
    )


def drop_empty_text(df: DataFrame, column: str) -> DataFrame:
    """Rows whose trimmed text is not empty."""
    return df.filter(F.length(strip(column)) > 0)


def any_modality(df: DataFrame, text: str = "text", image: str = "image") -> DataFrame:
    """Rows that have text or image."""
    present = [F.coalesce(strip(c), F.lit("")) != "" for c in (text, image)]
    return df.filter(present[0] | present[1])


def labeler_id(labelers: DataFrame, name: str) -> int:
    """Id of the first labeler of that name; an error when there is none."""
    row = labelers.filter(F.col("name") == name).agg(F.min("id").alias("id")).first()
    if row["id"] is None:
        raise ValueError(f"labeler '{name}' not found")
    return int(row["id"])


def constraint_violations(df: DataFrame, table: str, key: str, not_null: Sequence[str] = (),
                          allowed: Mapping[str, Sequence[str]] | None = None,
                          unique: Sequence[str] = (),
                          references: Mapping[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """Rows ``(table, rule, column, id)`` for every broken constraint.

    Row-level rules are one pass; uniqueness keeps the lowest id of a pair and
    reports the others; references are anti joins.
    """
    rules = [(F.col(c).isNull(), "not_null", c) for c in not_null]
    rules += [(F.col(c).isNotNull() & ~F.col(c).isin(list(vals)), "check", c) for c, vals in (allowed or {}).items()]

    def shaped(frame: DataFrame, rule: str, column: str, id_col: Column) -> DataFrame:
        return frame.select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
                            F.lit(column).alias("column_name"), id_col.cast("long").alias("id"))

    parts = []
    if rules:
        broken = F.array_compact(F.array(*[
            F.when(cond, F.struct(F.lit(rule).alias("rule"), F.lit(col).alias("column_name")))
            for cond, rule, col in rules
        ]))
        parts.append(
            df.select(F.col(key).alias("_id"), F.explode(broken).alias("b"))
            .select(F.lit(table).alias("table_name"), "b.rule", "b.column_name", F.col("_id").cast("long").alias("id"))
        )
    if unique:
        first = df.dropna(subset=list(unique)).groupBy(*unique).agg(
            F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        dup = df.join(first, list(unique)).filter(F.col(key) != F.col("_first"))
        parts.append(shaped(dup, "unique", ",".join(unique), F.col(key)))
    for column, (parent, parent_key) in (references or {}).items():
        ids = parent.select(F.col(parent_key).alias(column)).distinct()
        orphan = df.filter(F.col(column).isNotNull()).join(ids, column, "left_anti")
        parts.append(shaped(orphan, "foreign_key", column, F.col(key)))
    return functools.reduce(DataFrame.unionByName, parts)
