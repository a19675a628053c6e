"""Counting, profiling and summary operators (all hash aggregates with map-side combine)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relish.operators.quantiles import quantiles


def value_counts(df: DataFrame, *columns: str, normalize: bool = False) -> DataFrame:
    """A1: rows per value (null keys left out); ``normalize`` adds the share of all counted rows."""
    counts = df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    if not normalize:
        return counts
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("ratio", F.col("n") / total)


def distinct_count(df: DataFrame, *columns: str) -> DataFrame:
    """A2: distinct non-null values of each column, one row."""
    return df.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def frequency_of_frequencies(df: DataFrame, column: str) -> DataFrame:
    """A3: how many values occur how often."""
    return value_counts(df, column).groupBy(F.col("n").alias("frequency")).agg(F.count(F.lit(1)).alias("n_values"))


def _duplicate_rate() -> Column:
    total, unique = F.col("total_records"), F.col("unique_queries")
    return F.try_divide((total - unique) * F.lit(100.0), total)


def duplicate_rate(df: DataFrame, text: str) -> DataFrame:
    """A4: total, unique and percentage of repeated texts."""
    return df.agg(F.count(F.lit(1)).alias("total_records"), F.count_distinct(text).alias("unique_queries")).select(
        "*", _duplicate_rate().alias("duplicate_rate"))


def run_audit(df: DataFrame, run: str, text: str, created: str) -> DataFrame:
    """A5: per run, rows, distinct texts, first and last creation, duplicate rate."""
    return (
        df.filter(F.col(run).isNotNull()).groupBy(run)
        .agg(
            F.count(F.lit(1)).alias("total_records"),
            F.count_distinct(text).alias("unique_queries"),
            F.min(created).alias("first_created"),
            F.max(created).alias("last_created"),
        )
        .withColumn("duplicate_rate", F.round(_duplicate_rate(), 2))
    )


def duplicate_groups(df: DataFrame, text: str, id_col: str) -> DataFrame:
    """Texts that occur more than once with count and lowest id."""
    return (
        df.filter(F.col(text).isNotNull()).groupBy(text)
        .agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id"))
        .filter(F.col("n") > 1)
    )


def duplicate_members(df: DataFrame, text: str, id_col: str) -> DataFrame:
    """The ids of every duplicate group, one per row ``(first_id, n, id)``.

    Rows rather than one id list per text: a text may be held by a large part
    of the table.
    """
    return df.join(duplicate_groups(df, text, id_col), text).select("first_id", "n", F.col(id_col).alias("id"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles, maximum."""
    q = quantiles(df, column, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    quartiles = q.agg(F.map_from_entries(F.collect_list(F.struct("q", "value")))).scalar()
    return df.agg(
        F.count(column).alias("count"), F.mean(column).alias("mean"), F.stddev_samp(column).alias("std"),
        F.min(column).cast("double").alias("min"), F.max(column).cast("double").alias("max"),
    ).withColumn("_q", quartiles).select(
        "*", *[F.try_element_at("_q", F.lit(p)).alias(p) for p in ("p25", "p50", "p75")]
    ).drop("_q")


def percentiles(df: DataFrame, column: str, points: Sequence[int] = (10, 25, 50, 75, 90, 95, 99)) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per point."""
    return quantiles(df, column, {str(p): p / 100 for p in points}).select(
        F.col("q").cast("int").alias("percentile"), "value")


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width bins over the value range, the last one closed, empty bins kept."""
    spark = df.sparkSession
    c = F.col(column).cast("double")
    limits = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
    values = df.filter(c.isNotNull()).select(c.alias("v"), limits.select(F.struct("lo", "hi")).scalar().alias("r"))
    width = (F.col("r.hi") - F.col("r.lo")) / F.lit(bins)
    binned = values.select(
        F.when(width > 0, F.least(F.floor((F.col("v") - F.col("r.lo")) / width), F.lit(bins - 1)))
        .otherwise(F.lit(bins // 2)).cast("int").alias("bin")
    ).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    edges = spark.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn(
        "r", limits.select(F.struct("lo", "hi")).scalar())
    step = (F.col("r.hi") - F.col("r.lo")) / F.lit(bins)
    return edges.join(binned, "bin", "left").select(
        "bin", (F.col("r.lo") + F.col("bin") * step).alias("bin_start"),
        (F.col("r.lo") + (F.col("bin") + 1) * step).alias("bin_end"), F.coalesce("n", F.lit(0)).alias("n"),
    )


def table_counts(**tables: DataFrame) -> DataFrame:
    """Row count of each table."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def theme_distribution(members: DataFrame, set_col: str = "set_number", theme: str = "theme") -> DataFrame:
    """Map theme → count for each intent set."""
    counts = members.groupBy(set_col, theme).agg(F.count(F.lit(1)).cast("int").alias("n"))
    return counts.groupBy(set_col).agg(
        F.map_from_entries(F.collect_list(F.struct(theme, "n"))).alias("theme_distribution")
    )


def intent_set_usage(batches: DataFrame, set_index: str = "set_idx", batch: str = "batch") -> DataFrame:
    """How many batches used each intent set, keyed ``set_<i>`` from 1."""
    return batches.groupBy(F.concat(F.lit("set_"), (F.col(set_index) + 1).cast("string")).alias("set_key")).agg(
        F.count_distinct(batch).alias("n_batches"))


def generation_metrics(batches: DataFrame, generated: DataFrame) -> DataFrame:
    """One row of run metrics from batch rows and flattened query rows.

    ``batches(batch, status, seconds, n_candidates)``; ``generated(query)``.
    The two single-row aggregates meet as scalar subqueries.
    """
    examples = generated.agg(F.struct(F.count(F.lit(1)).alias("examples"), F.count_distinct("query").alias("queries")))
    ok = F.count_if(F.col("status") == "success")
    failed = F.count_if(F.col("status") == "failed")
    return batches.agg(
        F.coalesce(F.sum("n_candidates"), F.lit(0)).alias("total_candidates"),
        ok.alias("successful_batches"), failed.alias("failed_batches"),
        F.try_divide(ok * F.lit(100.0), ok + failed).alias("success_rate_percent"),
        F.sum("seconds").alias("total_seconds"), F.avg("seconds").alias("avg_batch_time"),
        F.min("seconds").alias("min_batch_time"), F.max("seconds").alias("max_batch_time"),
    ).withColumn("_e", examples.scalar()).select(
        "*", F.col("_e.examples").alias("total_examples"), F.col("_e.queries").alias("total_queries")
    ).drop("_e")


def label_coverage(view: DataFrame) -> DataFrame:
    """Rows with an AI label and with a human label."""
    return view.agg(F.count("ai_esci_label").alias("ai_labels"), F.count("human_esci_label").alias("human_labels"))


def dimension_fill(flat: DataFrame, dimensions: str = "dimensions", id_col: str = "consumable_id") -> DataFrame:
    """Per dimension key, rows that carry it and their share of all rows."""
    total = flat.agg(F.count(F.lit(1))).scalar()
    return (
        flat.select(F.explode(dimensions).alias("dimension", "v")).filter(F.col("v").isNotNull())
        .groupBy("dimension").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("pct", F.col("n") * 100.0 / total)
    )


def queries_per_candidate(flat: DataFrame, id_col: str = "consumable_id") -> DataFrame:
    """Total queries, distinct candidates and their ratio."""
    return flat.agg(F.count(F.lit(1)).alias("total_queries"), F.count_distinct(id_col).alias("candidates")).select(
        "*", F.try_divide("total_queries", "candidates").alias("queries_per_candidate"))


def run_summary_stats(summary: DataFrame) -> DataFrame:
    """Number of runs, experiments and the range of start times."""
    return summary.agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_distinct("experiment_name").alias("n_experiments"),
        F.min("start_time").alias("first_start"), F.max("start_time").alias("last_start"),
    )


def promotion_totals(results: DataFrame) -> DataFrame:
    """Per status, runs and summed insert counts."""
    return results.groupBy("status").agg(
        F.count(F.lit(1)).alias("n_runs"), *[F.sum(c).alias(c) for c in
        ("records_processed", "queries_inserted", "examples_inserted", "labels_inserted")]
    )


def deletion_totals(preview: DataFrame) -> DataFrame:
    """Summed impact of a deletion preview."""
    numeric = [c for c in preview.columns if c != "id"]
    return preview.agg(F.count(F.lit(1)).alias("n_items"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numeric])


def embedding_quality(df: DataFrame, vec: str) -> DataFrame:
    """Whether any value is NaN or infinite, value range and mean norm."""
    v = F.col(vec)
    bad = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return df.agg(
        F.coalesce(F.bool_or(bad), F.lit(False)).alias("has_bad"),
        F.min(F.array_min(v)).cast("double").alias("min_value"),
        F.max(F.array_max(v)).cast("double").alias("max_value"), F.avg(norm).alias("mean_norm"),
    )


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Rows per cluster, noise included."""
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))


def cluster_size_summary(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Largest, smallest and mean cluster without noise; ties go to the lower cluster."""
    sizes = cluster_sizes(df, cluster)
    real, c = F.col(cluster) != -1, F.col(cluster)
    return sizes.agg(
        F.sum("n").alias("n_points"), F.count_if(real).alias("n_clusters"),
        F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("n_noise"),
        F.max(F.when(real, F.struct(F.col("n"), (-c).alias("c")))).alias("big"),
        F.min(F.when(real, F.struct(F.col("n"), c.alias("c")))).alias("small"),
        F.avg(F.when(real, F.col("n"))).alias("mean_size"),
    ).select(
        "n_points", "n_clusters", "n_noise", (-F.col("big.c")).alias("largest_cluster"),
        F.col("big.n").alias("largest_size"), F.col("small.c").alias("smallest_cluster"),
        F.col("small.n").alias("smallest_size"), "mean_size",
    )


def text_profile(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """Missing values per column and mean text length."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns],
        F.avg(F.length(text)).alias("mean_length"),
    )


def query_type_counts(df: DataFrame) -> DataFrame:
    """Intent and bridged rows."""
    return value_counts(df, "query_type")
