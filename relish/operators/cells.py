"""Partitioning of vectors into bounded buckets, shared by search, near-duplicates and clustering.

A vector belongs to the cell of its nearest pivot.  A cell is cut into chunks of
bounded size by a hash of the id, so many copies of one vector never meet in one
task.  Distance bounds between a vector and a cell decide which cells have to be
visited; they only skip cells that provably hold nothing of interest, so the
results stay exact.  Bounds are widened by what rounding may do to them, which
follows the lengths of the vectors.  Pivots form a tree of two levels: groups
whose bound fails are left out, and rows pass in tiles of a fixed size.

Neighbouring buckets are packed into at most a few spans.  A row is sent once to
each span that holds a bucket of interest, with one bit per bucket, so that it
is repeated ``SPANS`` times at most, however many buckets there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relish.session import stage

PIVOT_BYTES = 32 << 20  # size bound of the pivot matrix shipped with every task
CHUNK_BITS = 20
TILE_BYTES = 16 << 20  # size bound of the distances that a task holds at once
REACHED = 1 << 20  # pairs of rows and cells that a task lists at once
SPANS = 8
LEAST_SPAN, MOST_SPAN = 4096, 131072  # rows of a span; the latter bounds a task's memory
ROUNDING = 4 * np.finfo(np.float64).eps


def matrix(column: pd.Series, dim: int) -> np.ndarray:
    if len(column) == 0:
        return np.zeros((0, dim))
    return np.stack(column.to_numpy()).astype(np.float64, copy=False)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0)


def rounding(d: np.ndarray, dim: int, lengths: np.ndarray | float) -> np.ndarray:
    """What a distance ``d`` from ``squared_distances`` may be off, at squared lengths that sum to ``lengths``."""
    off = ROUNDING * (dim + 4) * np.asarray(lengths, dtype=np.float64)
    return np.minimum(np.sqrt(off), off / np.maximum(d, np.finfo(np.float64).tiny))


class PivotTree:
    """Pivots in about sqrt(n) groups, each a centre and its reach.

    All distances are taken from the pivots' mean, so that vectors far from the
    origin lose nothing by it.  ``looked`` counts the distances to pivots taken.
    """

    def __init__(self, pivots: np.ndarray):
        self.shift = pivots.mean(0)
        self.points = pivots - self.shift
        self.dim = pivots.shape[1]
        pick = np.random.default_rng(0).permutation(len(pivots))[:max(1, math.isqrt(len(pivots)))]
        centres = self.points[np.sort(pick)]
        owner = np.concatenate([squared_distances(self.points[a:a + 4096], centres).argmin(1) for a in range(0, len(pivots), 4096)])
        owned = np.unique(owner)
        self.members = [np.flatnonzero(owner == g) for g in owned]
        self.centres = centres[owned]
        self.longest = float((self.points ** 2).sum(1).max())
        apart = [np.sqrt(squared_distances(self.points[m], c[None, :]).max()) for m, c in zip(self.members, self.centres, strict=True)]
        self.reach = np.array(apart) + math.sqrt(ROUNDING * (self.dim + 4) * 2 * self.longest)
        self.looked = 0

    def tiles(self, vecs: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        width = max(len(self.centres), max(len(m) for m in self.members), self.dim)
        rows = max(1, TILE_BYTES // (8 * width))
        for start in range(0, len(vecs), rows):
            yield slice(start, start + rows), vecs[start:start + rows] - self.shift

    def distances(self, x: np.ndarray, to: np.ndarray) -> np.ndarray:
        self.looked += len(x) * len(to)
        return np.sqrt(squared_distances(x, to))

    def slack(self, x: np.ndarray, d: np.ndarray) -> np.ndarray:
        return rounding(d, self.dim, (x * x).sum(1) + self.longest)

    def nearest(self, vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row the nearest pivot, its distance and what that may be off."""
        cell, dist, off = np.zeros(len(vecs), dtype=np.int64), np.full(len(vecs), np.inf), np.zeros(len(vecs))
        for rows, x in self.tiles(vecs):
            low = np.sqrt(squared_distances(x, self.centres))
            first = low.argmin(1)
            low = low - self.reach - self.slack(x, np.zeros(len(x)))[:, None]
            best, at = np.full(len(x), np.inf), np.zeros(len(x), dtype=np.int64)
            for own in (True, False):
                for g, members in enumerate(self.members):
                    todo = np.flatnonzero(first == g) if own else np.flatnonzero((first != g) & (low[:, g] <= best))
                    if len(todo):
                        d = self.distances(x[todo], self.points[members])
                        k = d.argmin(1)
                        d = d[np.arange(len(todo)), k]
                        better = (d < best[todo]) | ((d == best[todo]) & (members[k] < at[todo]))
                        best[todo[better]], at[todo[better]] = d[better], members[k[better]]
            cell[rows], dist[rows], off[rows] = at, best, self.slack(x, best)
        return cell, dist, off

    def reached(self, vecs: np.ndarray, group_bound, bound) -> list[np.ndarray]:
        """For each row the pivots that pass ``bound(rows, x, pivots)``, asked for groups that pass ``group_bound(rows, x)`` only."""
        out = []
        for rows, x in self.tiles(vecs):
            open_groups = group_bound(rows, x)
            row, pivot = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for g, members in enumerate(self.members):
                todo = np.flatnonzero(open_groups[:, g])
                if len(todo):
                    r, c = np.nonzero(bound(np.arange(rows.start, rows.start + len(x))[todo], x[todo], members))
                    row.append(todo[r])
                    pivot.append(members[c])
            row, pivot = np.concatenate(row), np.concatenate(pivot)
            order = np.lexsort((pivot, row))
            out.extend(np.split(pivot[order], np.cumsum(np.bincount(row, minlength=len(x)))[:-1]))
        return out

    def most(self, values: np.ndarray) -> np.ndarray:
        """The largest of the pivots' values in each group."""
        return np.array([values[m].max() for m in self.members])


@dataclass(frozen=True)
class Cells:
    """Pivots with the radius and the number of chunks of each cell (all bounded by the pivot count).

    ``off`` bounds by how much a row may be farther from its pivot than from another.
    """

    pivots: np.ndarray
    radius: np.ndarray
    chunks: np.ndarray
    off: float = 0.0
    rows: np.ndarray | None = None

    @property
    def dim(self) -> int:
        return self.pivots.shape[1]

    def cells_within(self, vecs: np.ndarray, eps: float, tree: PivotTree | None = None) -> list[np.ndarray]:
        """For each row the cells that may hold a vector within ``eps``.

        A cell is skipped when it is farther than its radius plus ``eps``, or
        when its pivot is more than ``2*eps`` farther than the nearest pivot.
        """
        tree = tree or PivotTree(self.pivots)
        _, near, off = tree.nearest(vecs)
        farthest = near + off + 2 * eps + self.off
        reach = tree.most(self.radius)

        def groups(rows, x):
            d = np.sqrt(squared_distances(x, tree.centres)) - tree.slack(x, np.zeros(len(x)))[:, None] - tree.reach
            return (d <= reach + eps) & (d <= farthest[rows, None])

        def pivots(rows, x, members):
            d = tree.distances(x, tree.points[members])
            d = d - rounding(d, tree.dim, ((x * x).sum(1) + tree.longest)[:, None])
            return (d <= self.radius[members] + eps) & (d <= farthest[rows, None])

        return tree.reached(vecs, groups, pivots)

    def cells_scoring(self, vecs: np.ndarray, low: np.ndarray, tree: PivotTree | None = None) -> list[np.ndarray]:
        """For each row the cells that may hold an inner product of at least its ``low``."""
        tree = tree or PivotTree(self.pivots)
        length = np.sqrt((vecs * vecs).sum(1))
        radius = np.maximum(self.radius, 0.0)
        reach = tree.reach + tree.most(np.where(self.chunks > 0, radius, 0.0))
        size = np.sqrt((self.pivots ** 2).sum(1).max()) + radius.max()
        enough = low - ROUNDING * (tree.dim + 4) * length * size - 1e-12  # scores are compared at 12 digits

        def groups(rows, x):
            q = vecs[rows]
            return q @ (tree.centres + tree.shift).T + length[rows, None] * reach >= enough[rows, None]

        def pivots(rows, x, members):
            tree.looked += len(x) * len(members)
            best = vecs[rows] @ self.pivots[members].T + length[rows, None] * radius[members]
            return (best >= enough[rows, None]) & (self.chunks[members] > 0)

        return tree.reached(vecs, groups, pivots)


def _assign(pivots: np.ndarray):
    @F.pandas_udf("cell int, dist double, off double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tree = PivotTree(pivots)
        for vecs in batches:
            cell, dist, off = tree.nearest(matrix(vecs, pivots.shape[1]))
            yield pd.DataFrame({"cell": cell.astype("int32"), "dist": dist + off, "off": off})

    return nearest


def partition_vectors(items: DataFrame, id_col: str, vec: str, rows_per_bucket: int,
                      rows: int | None = None) -> tuple[DataFrame, Cells]:
    """Add ``bucket`` (cell and chunk in one number) and ``cell`` to ``items``.

    The pivots are a repeatable random choice of rows; their number follows the
    row count up to a fixed byte size.
    """
    n = items.count() if rows is None else rows
    first = items.select(F.size(vec).alias("d")).limit(1).collect()
    dim = first[0]["d"] if first else 1
    limit = max(1, PIVOT_BYTES // (8 * dim))
    n_pivots = min(limit, max(1, math.ceil(n / rows_per_bucket)))
    if n_pivots == 1:
        plain = items.withColumns({"cell": F.lit(0), "bucket": F.lit(0).cast("long")})
        chunks = max(1, math.ceil(n / rows_per_bucket))
        if chunks > 1:
            plain = plain.withColumn("bucket", F.pmod(F.xxhash64(id_col), F.lit(chunks)))
        return plain, Cells(np.zeros((1, dim)), np.array([np.inf]), np.array([chunks]), rows=np.array([n]))
    chosen = items.select(id_col, vec).orderBy(F.md5(F.col(id_col).cast("string"))).limit(n_pivots).collect()
    pivots = np.unique(np.array([r[vec] for r in chosen], dtype=np.float64), axis=0)
    placed = stage(items.withColumn("_a", _assign(pivots)(F.col(vec))))
    stats = placed.groupBy("_a.cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("_a.dist").alias("r"), F.max("_a.off").alias("off")).collect()  # one row per pivot
    radius, chunks, held = np.full(len(pivots), -np.inf), np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots), dtype=np.int64)
    for s in stats:
        radius[s["cell"]], held[s["cell"]] = s["r"], s["n"]
        chunks[s["cell"]] = math.ceil(s["n"] / rows_per_bucket)
    cells = Cells(pivots, radius, chunks, 2 * max((s["off"] for s in stats), default=0.0), held)
    counts = F.array(*[F.lit(int(c)) for c in chunks]) if len(chunks) <= 64 else None
    placed = placed.withColumn("cell", F.col("_a.cell"))
    if counts is not None:
        per_cell = F.get(counts, F.col("cell"))
        placed = placed.withColumn("_k", per_cell)
    else:
        table = items.sparkSession.createDataFrame(
            [(i, int(c)) for i, c in enumerate(chunks)], "cell int, _k int")
        placed = placed.join(table, "cell")
    bucket = F.shiftleft(F.col("cell").cast("long"), CHUNK_BITS) + F.pmod(
        F.xxhash64(id_col), F.greatest(F.col("_k"), F.lit(1)))
    return placed.withColumn("bucket", bucket).drop("_a", "_k"), cells


def _codes(cells: Cells, chosen: np.ndarray) -> np.ndarray:
    """Bucket numbers of all chunks of the chosen cells."""
    out = [(int(c) << CHUNK_BITS) + np.arange(cells.chunks[c]) for c in chosen]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def visits_within(df: DataFrame, vec: str, cells: Cells, eps: float) -> DataFrame:
    """Rows repeated for every bucket that may hold a vector within ``eps`` (column ``bucket``)."""

    @F.pandas_udf("array<long>")
    def route(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tree = PivotTree(cells.pivots)
        for vecs in batches:
            yield pd.Series([_codes(cells, found) for found in cells.cells_within(matrix(vecs, cells.dim), eps, tree)], dtype=object)

    if len(cells.pivots) == 1:
        every = F.sequence(F.lit(0).cast("long"), F.lit(int(cells.chunks[0]) - 1).cast("long"))
        return df.withColumn("bucket", F.explode(every))
    return df.withColumn("bucket", F.explode(route(F.col(vec))))


def span_rows(n: int) -> int:
    """Rows of a span, and of a part of its visitors, for ``n`` rows in all: blocks stay few, so rows are repeated few times."""
    return min(MOST_SPAN, max(LEAST_SPAN, math.ceil(n / SPANS)))


class Spans:
    """The buckets in order, each with its span of about ``rows`` rows and its place in it."""

    def __init__(self, cells: Cells, rows: int):
        chunks = np.maximum(cells.chunks, 0)
        self.cell = cell = np.repeat(np.arange(len(chunks)), chunks)
        self.cells = len(chunks)
        self.codes = (cell << CHUNK_BITS) + np.arange(len(cell)) - (np.cumsum(chunks) - chunks)[cell]
        held = cells.rows[cell] / chunks[cell]
        span = ((np.cumsum(held) - held) // rows).astype(np.int64)
        _, self.starts, self.span = np.unique(span, return_index=True, return_inverse=True)
        self.place = np.arange(len(cell)) - self.starts[self.span]

    def marks(self, found: list[np.ndarray]) -> pd.DataFrame:
        """For each row's cells the spans that hold their buckets, and a bit per bucket of these spans."""
        spans, wanted, ends = [], [], [*self.starts[1:], len(self.codes)]
        for cells in found:
            flags = np.zeros(self.cells, dtype=bool)
            flags[cells] = True
            flags = flags[self.cell]
            here = np.unique(self.span[flags])
            spans.append(here.astype(np.int32))
            wanted.append([np.packbits(flags[self.starts[s]:ends[s]]).tobytes() for s in here])
        return pd.DataFrame({"span": pd.Series(spans, dtype=object), "wanted": pd.Series(wanted, dtype=object)})


MARKS = "span array<int>, wanted array<binary>"


def _marked(spans: Spans, cells: Cells, tree: PivotTree, vecs: pd.Series, low: np.ndarray | None, eps: float | None) -> pd.DataFrame:
    """The marks of a batch of rows, a few at a time: without structure every row reaches every cell."""
    if len(cells.pivots) == 1:
        return spans.marks([np.zeros(1, dtype=np.int64)] * len(vecs))
    x, out, step = matrix(vecs, cells.dim), [spans.marks([])], max(1, REACHED // len(cells.pivots))
    for a in range(0, len(x), step):
        part = x[a:a + step]
        out.append(spans.marks(cells.cells_within(part, eps, tree) if low is None else cells.cells_scoring(part, low[a:a + step], tree)))
    return pd.concat(out, ignore_index=True)


def in_spans(placed: DataFrame, cells: Cells, rows: int) -> DataFrame:
    """Items with the span and the place in it that belong to their ``bucket``."""
    spans = Spans(cells, rows)

    @F.pandas_udf("span int, place int")
    def find(bucket: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(spans.codes, bucket.to_numpy())
        return pd.DataFrame({"span": spans.span[at].astype("int32"), "place": spans.place[at].astype("int32")})

    return placed.withColumn("_s", find("bucket")).withColumns({"span": F.col("_s.span"), "place": F.col("_s.place")}).drop("_s")


def marked_within(df: DataFrame, vec: str, cells: Cells, eps: float, rows: int) -> DataFrame:
    """``df`` with ``marks``: the buckets that may hold a vector within ``eps``, by spans of ``rows`` rows."""
    spans = Spans(cells, rows)

    @F.pandas_udf(MARKS)
    def route(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tree = PivotTree(cells.pivots)
        for vecs in batches:
            yield _marked(spans, cells, tree, vecs, None, eps)

    return df.withColumn("marks", route(F.col(vec)))


def marked_scoring(df: DataFrame, vec: str, floor: str, cells: Cells, rows: int) -> DataFrame:
    """``df`` with ``marks``: the buckets that may hold an inner product of at least ``floor``, by spans of ``rows`` rows."""
    spans = Spans(cells, rows)

    @F.pandas_udf(MARKS)
    def route(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tree = PivotTree(cells.pivots)
        for vecs, low in batches:
            yield _marked(spans, cells, tree, vecs, low.to_numpy(dtype=np.float64), None)

    return df.withColumn("marks", route(F.col(vec), F.col(floor)))


def visiting(marked: DataFrame) -> DataFrame:
    """One row for every span that a row is to visit, with ``span`` and ``wanted``."""
    return marked.withColumn("_m", F.explode(F.arrays_zip("marks.span", "marks.wanted"))).withColumns(
        {"span": F.col("_m.span"), "wanted": F.col("_m.wanted")}).drop("_m", "marks")


def tiles(visitors: pd.DataFrame, home: pd.DataFrame, most: int = 4 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the visitors and of the home rows to compare, every visitor once, ``most`` pairs or one visitor at a time.

    Visitors that want the same buckets go together; home rows of buckets that
    none of them wants are left out.
    """
    wanted, place = visitors["wanted"].tolist(), home["place"].to_numpy()
    order = np.array(sorted(range(len(wanted)), key=wanted.__getitem__), dtype=np.int64)
    rows = max(1, most // len(place))
    for start in range(0, len(order), rows):
        tile = order[start:start + rows]
        bits = np.stack([np.frombuffer(w, dtype=np.uint8) for w in {wanted[i] for i in tile.tolist()}])
        yield tile, np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits, axis=0))[place])


def home_bucket(df: DataFrame, vec: str, cells: Cells) -> DataFrame:
    """The first bucket of the nearest non-empty cell (column ``bucket``)."""
    full = np.nonzero(cells.chunks > 0)[0]

    @F.pandas_udf("long")
    def home(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tree = PivotTree(cells.pivots[full])
        for vecs in batches:
            cell, _, _ = tree.nearest(matrix(vecs, cells.dim))
            yield pd.Series(full[cell].astype(np.int64) << CHUNK_BITS)

    return df.withColumn("bucket", home(F.col(vec)))


def pair_up(visitors: DataFrame, home: DataFrame, keys: Sequence[str], id_col: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``part``, ready to be grouped by ``keys`` and part.

    The visitors of each key are split into parts of about ``rows`` rows by a
    hash of the id, and the key's home rows are repeated once per part.  The
    number of parts is the key's own, so one crowded key does not multiply the
    others.
    """
    parts = visitors.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias("_parts"))
    keys = list(keys)
    # fresh column names on both sides: they often come from one table
    left = visitors.select(*[F.col(c).alias(c) for c in visitors.columns]).join(parts, keys)
    right = home.select(*[F.col(c).alias(c) for c in home.columns]).join(parts, keys)
    return (
        left.withColumn("part", F.pmod(F.xxhash64(id_col), F.col("_parts")).cast("int")).drop("_parts"),
        right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts"),
    )
