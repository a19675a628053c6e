"""Exact vector search, score fusion and the vector catalogue."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relish.functions.text import strip
from relish.functions.vectors import normalize, zero_fill
from relish.operators import cells as cell_ops
from relish.operators.joins import sum_scores
from relish.operators.windows import first_per_key, rank_results
from relish.session import stage

QUERY_ROWS = 4096
ITEM_ROWS = 16384
SCORE_DIGITS = 12  # scores are compared at this precision, so equal vectors tie in any block
SINGLE = 1e15  # products of smaller components are far from the limits of single precision
FLOOR_SLACK = 1e-11  # scores of one pair differ less between blocks, beside their size


def _first_of_each(k: int, row: np.ndarray, query_ids: np.ndarray, doc_ids: np.ndarray, score: np.ndarray) -> pd.DataFrame:
    """The ``k`` first entries of each query (``row`` is its place), best score first, then the lowest item."""
    sort = np.lexsort((np.unique(doc_ids, return_inverse=True)[1], -score, row))
    row, doc_ids, score = row[sort], doc_ids[sort], score[sort]
    keep = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
    return pd.DataFrame({"query_id": query_ids[row[keep]], "doc_id": doc_ids[keep], "score": score[keep]})


class _Above:
    """The best items of a span by scores that reach each query's ``floor``.

    Products in single precision, with what they may be off, tell which pairs
    can; these are few, and only their scores are computed exactly and sorted.
    """

    def __init__(self, k: int, skip_same_id: bool, query_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, doc_ids: np.ndarray, docs: np.ndarray):
        self.k, self.skip, self.ids, self.doc_ids, self.q, self.docs = k, skip_same_id, query_ids, doc_ids, q, docs
        kind = np.float32 if max(np.abs(q).max(initial=0.0), np.abs(docs).max(initial=0.0)) < SINGLE else np.float64  # not if it is NaN either
        self.low_q, self.low_docs = q.astype(kind, copy=False), docs.astype(kind, copy=False)
        length = np.sqrt((q * q).sum(1)) * math.sqrt((docs * docs).sum(1).max(initial=0.0))
        self.least = floor - FLOOR_SLACK * (1.0 + np.abs(floor)) - 2 * np.finfo(kind).eps * (q.shape[1] + 4) * length

    def find(self, rows: np.ndarray, cols: np.ndarray) -> pd.DataFrame:
        docs = self.low_docs if len(cols) == len(self.docs) else self.low_docs[cols]
        row, col = np.nonzero(self.low_q[rows] @ docs.T >= np.nextafter(self.least[rows].astype(docs.dtype), docs.dtype.type(-np.inf))[:, None])
        row, col = rows[row], cols[col]
        if self.skip:
            other = self.ids[row] != self.doc_ids[col]
            row, col = row[other], col[other]
        score = np.empty(len(row))
        for a in range(0, len(row), 1 << 14):
            part = slice(a, a + (1 << 14))
            score[part] = np.einsum("ij,ij->i", self.q[row[part]], self.docs[col[part]])
        return _first_of_each(self.k, row, self.ids, self.doc_ids[col], np.round(score, SCORE_DIGITS) + 0.0)


def _best(k: int, skip_same_id: bool, query_ids: np.ndarray, q: np.ndarray, doc_ids: np.ndarray, docs: np.ndarray) -> pd.DataFrame:
    """The ``k`` highest inner products of each query, ties to the lower item."""
    if len(docs) == 0:
        return pd.DataFrame({"query_id": query_ids[:0], "doc_id": doc_ids, "score": np.zeros(0)})
    scores = np.round(q @ docs.T, SCORE_DIGITS) + 0.0
    if skip_same_id:
        scores[query_ids[:, None] == doc_ids[None, :]] = -np.inf
    if k < scores.shape[1]:
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
    else:
        kth = np.full((len(q), 1), -np.inf)
    row, col = np.nonzero((scores >= kth) & (scores > -np.inf))
    return _first_of_each(k, row, query_ids, doc_ids[col], scores[row, col])


def _block_top_k(k: int, skip_same_id: bool):
    def run(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        if len(queries) == 0 or len(items) == 0:
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": []})
        docs = np.stack(items["vec"].to_numpy()).astype(np.float64, copy=False)
        doc_ids, query_ids = items["doc_id"].to_numpy(), queries["query_id"].to_numpy()
        return pd.concat([
            _best(k, skip_same_id, query_ids[start:start + 256],
                  np.stack(queries["vec"].iloc[start:start + 256].to_numpy()).astype(np.float64, copy=False), doc_ids, docs)
            for start in range(0, len(queries), 256)], ignore_index=True)

    return run


def _span_top_k(k: int, skip_same_id: bool):
    """The best items of a span for each query, by tiles of the buckets that its queries want."""
    def run(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        if len(queries) == 0 or len(items) == 0:
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": []})
        q_vecs, d_vecs = [np.stack(f["vec"].to_numpy()).astype(np.float64, copy=False) for f in (queries, items)]
        q_ids, d_ids, floor = queries["query_id"].to_numpy(), items["doc_id"].to_numpy(), queries["floor"].to_numpy(dtype=np.float64)
        above, out = _Above(k, skip_same_id, q_ids, q_vecs, floor, d_ids, d_vecs), []
        for rows, cols in cell_ops.tiles(queries, items):
            low = np.isneginf(floor[rows])
            if low.any():
                out.append(_best(k, skip_same_id, q_ids[rows[low]], q_vecs[rows[low]], d_ids[cols], d_vecs[cols]))
            if not low.all():
                out.append(above.find(rows[~low], cols))
        return pd.concat(out, ignore_index=True)

    return run


def _search_buckets(queries: DataFrame, items: DataFrame, k: int, query_rows: int | None, skip_same_id: bool) -> DataFrame:
    """Local top-k of every query in the one bucket it was sent to.

    Queries of a bucket are split into groups of ``query_rows``, or kept
    together when there are few queries in all (None).
    """
    q, d = queries.select("query_id", "vec", "bucket"), items.select("doc_id", "vec", "bucket")
    if query_rows is None:
        # fresh column names on both sides: queries and items often come from one table
        q, d = [f.select(*[F.col(c).alias(c) for c in f.columns]) for f in (q, d)]
        keys = ["bucket"]
    else:
        q, d = cell_ops.pair_up(stage(q), d, ["bucket"], "query_id", query_rows)
        keys = ["bucket", "part"]
    return q.groupBy(*keys).cogroup(d.groupBy(*keys)).applyInPandas(_block_top_k(k, skip_same_id), _hits_schema(queries, items))


def _hits_schema(queries: DataFrame, items: DataFrame) -> str:
    return f"query_id {dict(queries.dtypes)['query_id']}, doc_id {dict(items.dtypes)['doc_id']}, score double"


def _search_spans(queries: DataFrame, items: DataFrame, cells: cell_ops.Cells, k: int, rows: int, skip_same_id: bool) -> DataFrame:
    """Local top-k of every query with a ``floor`` in every span of buckets that may reach it."""
    marked = stage(cell_ops.marked_scoring(queries, "vec", "floor", cells, rows))
    q, d = cell_ops.pair_up(
        cell_ops.visiting(marked).select("query_id", "vec", "floor", "span", "wanted"),
        cell_ops.in_spans(items, cells, rows).select("doc_id", "vec", "span", "place"), ["span"], "query_id", rows)
    return q.groupBy("span", "part").cogroup(d.groupBy("span", "part")).applyInPandas(
        _span_top_k(k, skip_same_id), _hits_schema(queries, items))


def top_k(queries: DataFrame, items: DataFrame, k: int = 5, skip_same_id: bool = False,
          item_rows: int = ITEM_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The ``k`` items with the highest inner product for each query, exact.

    ``queries(query_id, vec)``, ``items(doc_id, vec)``; gives ``(query_id,
    doc_id, score, rank)``.  Items are split into bounded buckets around pivots.
    Every query first looks into its nearest bucket, which gives a score that
    its k-th best item must reach; it then looks only into buckets whose bound
    reaches that score, and is sent once to each span that holds such buckets.
    A block pair is a few matrix products that emit at most k rows per query.
    """
    n_items, n_queries = items.count(), queries.count()
    split = query_rows if n_queries > query_rows else None
    placed, cells = cell_ops.partition_vectors(items, "doc_id", "vec", item_rows, n_items)
    if len(cells.pivots) == 1:
        with_floor = queries.withColumn("floor", F.lit(float("-inf")))
    else:
        first = _search_buckets(cell_ops.home_bucket(queries, "vec", cells), placed, k, split, skip_same_id)
        floors = first.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n"))
        low = F.when(F.col("n") >= k, F.col("floor")).otherwise(F.lit(float("-inf")))
        floors = stage(floors.select("query_id", low.alias("floor")))
        with_floor = queries.join(floors, "query_id", "left").withColumn(
            "floor", F.coalesce("floor", F.lit(float("-inf"))))
    hits = _search_spans(with_floor, placed, cells, k, cell_ops.span_rows(max(n_items, n_queries)), skip_same_id)
    return rank_results(hits, top=k)


def fused_top_k(text_queries: DataFrame, image_queries: DataFrame, text_items: DataFrame, image_items: DataFrame,
                k: int = 5, **options) -> DataFrame:
    """V7: top-k of each modality, scores of the same item added, top-k of the sums.

    A query present in one modality only keeps that modality's result.
    """
    text = top_k(text_queries, text_items, k, **options).drop("rank")
    image = top_k(image_queries, image_items, k, **options).drop("rank")
    return rank_results(sum_scores(text, image), top=k)


def full_fusion_top_k(queries: DataFrame, items: DataFrame, k: int, dim: int, **options) -> DataFrame:
    """V8: top-k by the sum of both cosines over all items, with no cut per modality.

    ``queries(query_id, text_vec, image_vec)``, ``items(doc_id, text_vec,
    image_vec)``.  The sum of two cosines is the inner product of the two unit
    vectors laid end to end, so one exact search answers it; a missing modality
    is zeros and adds nothing.
    """
    joined = F.concat(normalize(zero_fill("text_vec", dim)), normalize(zero_fill("image_vec", dim)))
    has_any = F.col("text_vec").isNotNull() | F.col("image_vec").isNotNull()
    return top_k(
        queries.filter(has_any).select("query_id", joined.alias("vec")),
        items.filter(has_any).select("doc_id", joined.alias("vec")), k, **options)


def build_catalogue(rows: DataFrame, name: str, order: str, dim: int, text: str = "text", image: str = "image",
                    text_vec: str = "text_vec", image_vec: str = "image_vec") -> DataFrame:
    """V5: one row per name from its first row, dropped without text and image, vectors unit length or zero."""
    first = first_per_key(rows.select(name, order, text, image, text_vec, image_vec), [name], order)
    has_text = F.coalesce(strip(text), F.lit("")) != ""
    has_image = F.coalesce(strip(image), F.lit("")) != ""
    return first.filter(has_text | has_image).select(
        name,
        normalize(zero_fill(F.when(has_text, F.col(text_vec)), dim)).alias("text_vec"),
        normalize(zero_fill(F.when(has_image, F.col(image_vec)), dim)).alias("image_vec"),
    )


def names_in_any(text_names: DataFrame, image_names: DataFrame, name: str) -> DataFrame:
    """Names with a text or an image vector."""
    return text_names.select(name).union(image_names.select(name)).distinct()


def encode(df: DataFrame, text: str | Column, encoder, output: str = "vec", batch_size: int = 32,
           setup: Sequence = ()) -> DataFrame:
    """Apply a caller's batch encoder ``list[str] -> 2-D array`` to a text column.

    ``encoder`` may be a callable, or with ``setup`` a factory called once per
    task with these arguments, so that a model is loaded once per task.
    """
    args = tuple(setup)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = encoder(*args) if args else encoder
        for texts in batches:
            values = texts.fillna("").tolist()
            rows = []
            for i in range(0, len(values), batch_size):
                rows.extend(np.asarray(fn(values[i:i + batch_size]), dtype=np.float32))
            yield pd.Series(rows)

    return df.withColumn(output, run(F.col(text) if isinstance(text, str) else text))
