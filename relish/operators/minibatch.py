"""Mini-batch k-means in parallel, for several numbers of clusters at once.

Rows are dealt into buckets by a seeded hash of their id.  In a round every
bucket goes through its rows in batches, in hash order, moving its own copy of
the centres towards each batch with a rate that falls with the rows a centre
has seen; the buckets' moves are merged, weighted by the rows behind them.  A
last pass sets every centre to the mean of its rows.  One pass serves all k.

Buckets, orders and starting centres depend on ids and seed only, and merged
sums are decimals, so the result is the same however the table is partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relish.operators.cluster import silhouette_points
from relish.session import stage

BATCH = 1000
BUCKET_ROWS = 65_536
INIT_ROWS = 3000  # rows that starting centres are chosen from, at most
STARTS = 3
ROUNDS = 5


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row (the lowest of equals), and the squared distance, from true differences."""
    near = ((centres**2).sum(1)[None, :] - 2 * (x @ centres.T)).argmin(1)
    return near, ((x - centres[near]) ** 2).sum(1)


def starting_centres(x: np.ndarray, k: int, seed: int, starts: int = STARTS, steps: int = 10) -> np.ndarray:
    """Centres spread over a sample by squared distances, the best of some starts after a few steps on the sample."""
    best, least = None, math.inf
    for start in range(starts):
        rng = np.random.default_rng([seed, k, start])
        chosen = [int(rng.integers(len(x)))]
        far = ((x - x[chosen[0]]) ** 2).sum(1)
        while len(chosen) < k:
            chosen.append(int(rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(x))))
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
        centres = x[chosen].copy()
        for _ in range(steps):
            near, _ = _nearest(x, centres)
            counts = np.bincount(near, minlength=k)
            for j in np.flatnonzero(counts):
                centres[j] = x[near == j].mean(0)
        total = _nearest(x, centres)[1].sum()
        if total < least:
            best, least = centres, total
    return best


def _vectors(table: pa.Table, column: str = "vec") -> np.ndarray:
    values = table.column(column).combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _moves(models: dict[int, np.ndarray], seen: dict[int, np.ndarray], batch: int):
    """A bucket's moves: per k and centre, rows and (moved centre - centre) times rows; with ``batch`` 0, towards the mean."""

    def run(table: pa.Table) -> pa.Table:
        x = _vectors(table.sort_by([("place", "ascending"), ("id", "ascending")]))
        out: list[tuple] = []
        for k, start in models.items():
            centres, counts = start.copy(), np.zeros(k, np.int64)
            for a in range(0, len(x), batch or len(x)):
                part = x[a:a + (batch or len(x))]
                near, _ = _nearest(part, centres)
                many = np.bincount(near, minlength=k)
                for j in np.flatnonzero(many):
                    rate = many[j] / (seen[k][j] + counts[j] + many[j]) if batch else 1.0
                    centres[j] += (part[near == j].mean(0) - centres[j]) * rate
                counts += many
            out += [(k, j, int(counts[j]), ((centres[j] - start[j]) * counts[j]).tolist()) for j in np.flatnonzero(counts).tolist()]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()))
        return pa.table({name: pa.array(c, t) for name, c, t in zip(("k", "centre", "n", "move"), zip(*out), kinds)})

    return run


def _round(rows: DataFrame, models: dict[int, np.ndarray], seen: dict[int, np.ndarray], batch: int, buckets: int) -> None:
    """One pass over all rows; changes ``models`` and ``seen``.  What comes back is one row per k, centre and component."""
    moved = rows.groupBy("bucket").applyInArrow(_moves(models, seen, batch), "k int, centre int, n long, move array<double>")
    merged = moved.select("k", "centre", "n", F.posexplode("move").alias("at", "x")).groupBy("k", "centre", "at").agg(
        F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,12)")).cast("double").alias("x"))
    for r in merged.collect():
        models[r["k"]][r["centre"], r["at"]] += r["x"] / r["n"]
        if r["at"] == 0:
            seen[r["k"]][r["centre"]] += r["n"] / buckets


def fit(df: DataFrame, id_col: str, vec: str, ks: Sequence[int], batch: int = BATCH, rounds: int = ROUNDS, seed: int = 42,
        init_rows: int = INIT_ROWS, bucket_rows: int = BUCKET_ROWS) -> dict[int, np.ndarray]:
    """For every k, the centres of a mini-batch fit.  Rows with a null vector take no part."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("vec")).filter("vec IS NOT NULL")
    rows = stage(rows.withColumn("place", F.xxhash64(F.lit(seed), "id")))
    n = rows.count()
    if n == 0:
        return {}
    buckets = max(1, math.ceil(n / bucket_rows))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("place"), F.lit(buckets)))
    sample = np.array([r["vec"] for r in rows.orderBy("place", "id").limit(init_rows).collect()])
    models = {k: starting_centres(sample, k, seed) for k in dict.fromkeys(int(k) for k in ks)}
    seen = {k: np.zeros(k) for k in models}
    for _ in range(rounds):
        _round(rows, models, seen, batch, buckets)
    _round(rows, models, seen, 0, buckets)
    return models


def assign(df: DataFrame, vec: str, models: dict[int, np.ndarray]) -> DataFrame:
    """``df`` with ``k``, ``cluster`` and ``distance2`` (squared, to its centre), one row per row and k."""

    def nearest(batches):
        for b in batches:
            x = _vectors(pa.Table.from_batches([b]), "_vec")
            found = [(k, *_nearest(x, c)) for k, c in models.items()]
            out = [[{"k": k, "cluster": int(near[i]), "distance2": float(far[i])} for k, near, far in found] for i in range(len(x))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(out, kind)], [*names, "found"])

    names = df.columns
    kind = pa.list_(pa.struct([("k", pa.int32()), ("cluster", pa.int32()), ("distance2", pa.float64())]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    rows = df.filter(F.col(vec).isNotNull()).withColumn("_vec", F.col(vec).cast("array<double>"))
    found = rows.mapInArrow(nearest, f"{schema}, found array<struct<k:int,cluster:int,distance2:double>>")
    return found.select(*names, F.inline("found"))


def sweep(df: DataFrame, id_col: str, vec: str, ks: Sequence[int] = range(5, 21), **options) -> DataFrame:
    """Inertia and Euclidean silhouette of a mini-batch fit for each k: ``(k, inertia, silhouette)``."""
    models = fit(df, id_col, vec, ks, **options)
    points = df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    labelled = stage(assign(points, "vec", models))
    inertia = labelled.groupBy("k").agg(F.sum(F.col("distance2").cast("decimal(38,12)")).cast("double").alias("inertia"))
    scores = silhouette_points(labelled, "id", "vec", "cluster", group="k").groupBy(F.col("g").alias("k")).agg(F.avg("silhouette").alias("silhouette"))
    return inertia.join(scores, "k")
