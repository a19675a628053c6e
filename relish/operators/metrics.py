"""Retrieval quality and latency measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relish.operators.joins import judge_results
from relish.operators.quantiles import quantiles
from relish.operators.windows import first_relevant_rank, rank_results


def drop_identical(results: DataFrame) -> DataFrame:
    """Results without documents that are the query itself."""
    return results.filter(~(F.col("query_id") == F.col("doc_id")))


def hit_rates(results: DataFrame, qrels: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """V9: share of judged, retrieved queries with a relevant document in the top k, one row per k."""
    judged = qrels.select("query_id").distinct().join(results.select("query_id"), "query_id", "left_semi")
    ranks = judged.join(first_relevant_rank(results, qrels), "query_id", "left")
    wide = ranks.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("rank") <= k).alias(str(k)) for k in ks])
    return wide.unpivot(["n"], [str(k) for k in ks], "k", "hits").select(
        F.col("k").cast("int").alias("k"), F.col("n").alias("n_queries"),
        F.coalesce(F.try_divide("hits", "n"), F.lit(0.0)).alias("recall"))


def true_label_rates(ranked: DataFrame, truth: DataFrame, ks: Sequence[int] = (1, 5)) -> DataFrame:
    """Recall on the single true document of each query; every query counts."""
    qrels = truth.withColumn("rel", F.lit(1))
    ranks = truth.select("query_id").distinct().join(first_relevant_rank(ranked, qrels), "query_id", "left")
    return ranks.agg(F.count(F.lit(1)).alias("n_queries"), *[
        F.coalesce(F.try_divide(F.count_if(F.col("rank") <= k), F.count(F.lit(1))), F.lit(0.0)).alias(f"recall_{k}")
        for k in ks])


def _discount(rank: str | Column) -> Column:
    return F.log2((F.col(rank) if isinstance(rank, str) else rank) + 1)


def ndcg_per_query(results: DataFrame, qrels: DataFrame, k: int = 10, ignore_identical: bool = True) -> DataFrame:
    """Graded NDCG@k of each judged, retrieved query; the ideal uses all judgements of the query."""
    if ignore_identical:
        results = drop_identical(results)
    gains = judge_results(rank_results(results, top=k), qrels).groupBy("query_id").agg(
        F.sum(F.greatest("rel", F.lit(0)) / _discount("rank")).alias("dcg"))
    best = Window.partitionBy("query_id").orderBy(F.col("rel").desc())
    ideal = (
        qrels.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .groupBy("query_id").agg(F.sum(F.greatest("rel", F.lit(0)) / _discount("rank")).alias("idcg"))
    )
    return gains.join(ideal, "query_id").select(
        "query_id", F.coalesce(F.try_divide("dcg", F.nullif("idcg", F.lit(0.0))), F.lit(0.0)).alias("ndcg"))


def ndcg(results: DataFrame, qrels: DataFrame, k: int = 10, ignore_identical: bool = True) -> DataFrame:
    """Mean NDCG@k."""
    return ndcg_per_query(results, qrels, k, ignore_identical).agg(
        F.count(F.lit(1)).alias("n_queries"), F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("ndcg"))


def truncated_ndcg_per_query(results: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """NDCG@k whose ideal is the best order of the k retrieved documents themselves."""
    judged = judge_results(rank_results(results, top=k), qrels)
    best = Window.partitionBy("query_id").orderBy(F.col("rel").desc())
    return judged.withColumn("best_rank", F.row_number().over(best)).groupBy("query_id").agg(
        F.sum(F.col("rel") / _discount("rank")).alias("dcg"), F.sum(F.col("rel") / _discount("best_rank")).alias("idcg"),
    ).select("query_id", F.coalesce(F.try_divide("dcg", F.nullif("idcg", F.lit(0.0))), F.lit(0.0)).alias("ndcg"))


def truncated_ndcg(results: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """Mean of the truncated NDCG@k."""
    return truncated_ndcg_per_query(results, qrels, k).agg(
        F.count(F.lit(1)).alias("n_queries"), F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("ndcg"))


def median_rank(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """Median rank of the first relevant document; queries without one are left out, 0 when none is left."""
    ranks = first_relevant_rank(results, qrels)
    return quantiles(ranks, "rank", {"median": 0.5}).agg(
        F.coalesce(F.max("value"), F.lit(0.0)).alias("median_rank"))


def p95_latency(calls: DataFrame, ms: str = "ms") -> DataFrame:
    """95th percentile by the exclusive rule, 0 without calls."""
    return quantiles(calls, ms, {"p95": 0.95}, "exclusive").agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("p95_ms"))


def throughput(calls: DataFrame, ms: str = "ms", order: str = "call_id", warmup: int = 0) -> DataFrame:
    """Calls per second of the measured time after the first ``warmup`` calls."""
    if warmup:
        skipped = calls.orderBy(order).limit(warmup).select(order)
        calls = calls.join(skipped, order, "left_anti")
    return calls.agg(F.count(F.lit(1)).alias("n_calls"), (F.sum(ms) / 1000.0).alias("seconds")).select(
        "*", F.coalesce(F.try_divide("n_calls", F.nullif("seconds", F.lit(0.0))), F.lit(0.0)).alias("qps"))


def leaderboard(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Long ``(dataset, model, metric, value)`` rows to one row per dataset and model."""
    return scores.groupBy("dataset", "model").pivot("metric", list(metrics)).agg(F.first("value"))


def peek(results: DataFrame, qrels: DataFrame, corpus: DataFrame, k: int = 5, query_id=None,
         show: int = 10) -> DataFrame:
    """Per query, its relevant ids (count and first ``show``), the top-k with score and title, and the overlap."""
    if query_id is not None:
        results, qrels = results.filter(F.col("query_id") == query_id), qrels.filter(F.col("query_id") == query_id)
    relevant = qrels.filter(F.col("rel") > 0).select("query_id", "doc_id").distinct()
    w = Window.partitionBy("query_id").orderBy("doc_id")
    first = relevant.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= show).groupBy("query_id").agg(
        F.sort_array(F.collect_list("doc_id")).alias("relevant_ids"))
    counts = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    top = rank_results(results, top=k).join(corpus.select("doc_id", "title"), "doc_id", "left").join(
        relevant.withColumn("hit", F.lit(True)), ["query_id", "doc_id"], "left")
    listed = top.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct(
            "rank", "doc_id", F.round("score", 4).alias("score"),
            F.substring(F.coalesce("title", F.lit("")), 1, 80).alias("title")))).alias("retrieved"),
        F.sort_array(F.collect_list(F.when(F.col("hit"), F.col("doc_id")))).alias("overlap"))
    return counts.join(first, "query_id").join(listed, "query_id")


def evaluation_row(ranked: DataFrame, truth: DataFrame, model: str, benchmark: str, total_items: DataFrame) -> DataFrame:
    """One row with model, benchmark, R@1, R@5, NDCG@5 and totals."""
    qrels = truth.withColumn("rel", F.lit(1))
    gain = truncated_ndcg(ranked, qrels, 5).select("ndcg").scalar()
    items = total_items.agg(F.count(F.lit(1))).scalar()
    rates = true_label_rates(ranked, truth)
    return rates.select(
        F.lit(model).alias("model_path"), F.lit(benchmark).alias("benchmark"), F.col("recall_1").alias("r_at_1"),
        F.col("recall_5").alias("r_at_5"), gain.alias("ndcg_at_5"), F.col("n_queries").alias("total_queries"),
        items.alias("total_dishes"))
