"""Per-key choices and ranks.

Where the answer is one row per key an aggregate is used instead of a window,
so a key holding much of the table is combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relish.operators.ordering import with_position


def first_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """W1, D-1: the first row of each key in row order; null keys form one group."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return first.select(*keys, "_row.*").select(*df.columns)


def rank_results(results: DataFrame, query: str = "query_id", doc: str = "doc_id", score: str = "score",
                 top: int | None = None) -> DataFrame:
    """Rank by score descending, ties by document id.

    With ``top`` Spark prunes each partition to ``top`` rows per query before
    the shuffle.
    """
    w = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(doc).asc())
    ranked = results.withColumn("rank", F.row_number().over(w))
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


def first_relevant_rank(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """Rank of the best relevant document of each query that has one.

    The rank is one plus the number of documents ahead of that document, found
    by two aggregates: no query's result list is sorted in one task.
    """
    relevant = qrels.filter(F.col("rel") > 0).select("query_id", "doc_id").distinct()
    hits = results.join(relevant, ["query_id", "doc_id"])
    # smallest (-score, doc_id) is the best ranked relevant document
    best = hits.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "doc_id")).alias("best"))
    ahead = F.struct((-F.col("score")).alias("s"), "doc_id") < F.col("best")
    return (
        results.join(best, "query_id").groupBy("query_id")
        .agg((F.count_if(ahead) + 1).alias("rank"))
    )


def top_category(df: DataFrame, group: str, category: str) -> DataFrame:
    """Most frequent category of each group with its count; ties by name."""
    counts = df.filter(F.col(category).isNotNull()).groupBy(group, category).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col(category).alias("c"))).alias("b"))
    return best.select(group, F.col("b.c").alias("top_category"), (-F.col("b.neg")).alias("top_count"))


def top_categories(df: DataFrame, group: str, category: str, n: int = 3) -> DataFrame:
    """The ``n`` most frequent categories of each group with rank."""
    counts = df.filter(F.col(category).isNotNull()).groupBy(group, category).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy(F.col("n").desc(), F.col(category).asc())
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def first_rows(df: DataFrame, group: str, order: str | Column, n: int) -> DataFrame:
    """The first ``n`` rows of each group; partitions are pruned to ``n`` per group before the shuffle."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` most frequent keys, ties by key."""
    return (
        df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col(key).asc()).limit(n)
    )


def elbow(curve: DataFrame, value: str, id_col: str, plotted: bool = True) -> DataFrame:
    """The value at the sharpest bend of the descending curve.

    Over 100 points the bend is one past the position with the largest absolute
    second difference (the first one wins ties); otherwise, or when not
    ``plotted``, it is the value at position ``n // 10``.

    Neighbouring points are found by joining positions, so the curve is never
    gathered into one window.
    """
    placed = with_position(curve, [F.col(value).desc(), F.col(id_col).asc()], "pos").select("pos", F.col(value).alias("v"))
    # every point contributes to the second differences that start at pos, pos-1 and pos-2
    parts = placed.select(
        F.explode(F.array(*[
            F.struct((F.col("pos") - back).alias("at"), F.lit(weight).alias("w"))
            for back, weight in ((0, 1.0), (1, -2.0), (2, 1.0))
        ])).alias("t"), "v"
    )
    bends = (
        parts.groupBy(F.col("t.at").alias("at"))
        .agg(F.count(F.lit(1)).alias("k"), F.max(F.when(F.col("t.w") == -2.0, F.col("v"))).alias("mid"),
             F.min(F.when(F.col("t.w") == 1.0, F.col("v"))).alias("lo"),
             F.max(F.when(F.col("t.w") == 1.0, F.col("v"))).alias("hi"))
        .filter((F.col("k") == 3) & (F.col("at") >= 0))
        .select("at", F.abs((F.col("lo") - F.col("mid")) - (F.col("mid") - F.col("hi"))).alias("bend"))
    )
    n = placed.agg(F.count(F.lit(1))).scalar()
    bend_at = bends.agg(F.min(F.struct((-F.col("bend")).alias("b"), "at")).alias("m")).select(F.col("m.at") + 1).scalar()
    wanted = F.when(F.lit(plotted) & (F.col("_n") > 100), F.col("_bend")).otherwise(F.floor(F.col("_n") / 10))
    return (
        placed.withColumn("_n", n).withColumn("_bend", bend_at)
        .filter(F.col("pos") == wanted).select(F.col("pos").alias("elbow_pos"), F.col("v").alias("eps"))
    )
