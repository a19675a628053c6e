"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Vectors are turned by several rotations, each fitted to make the signs of the
turned coordinates lose little, and the signs are their codes.  Codes are cut
into bytes and every byte is indexed.  If two codes differ in at most R bits,
one of their bytes differs in at most R / bytes bits, so looking up all bytes
that near to a query's finds every code within R.  Those are ranked by the
original vectors.  R follows from the score of the k-th best vector found so
far: codes of vectors that reach it lie within R with a stated confidence.  A
query that finds fewer than k vectors that way is compared with all of them.

A block of vectors meets a block of queries in one task; both have bounded
size, and a task returns k rows a query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relish.llm.arrow import per_pair
from relish.session import stage

ROTATIONS = 4
SAMPLE = 8192  # vectors to fit on, at most
ROUNDS = 30
CONFIDENCE = 0.97
BLOCK = 8192  # vectors of a task
QUERY_BLOCK = 8192  # queries of a task
BIT_COUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
NEAR = [np.flatnonzero(BIT_COUNT <= r) for r in range(9)]  # NEAR[r]: all differences of at most r bits in a byte


def fit_rotation(vectors: np.ndarray, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """A rotation whose signs stay close to the turned (unit) vectors, from a random start."""
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((vectors.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.sign(vectors @ turn).T @ vectors)
        turn = (u @ v).T
    return turn


@dataclass
class Codec:
    """Codes of vectors, and the radius that a score asks for."""

    longest: float  # largest norm of all vectors
    rotation: np.ndarray
    shift: float  # how far code distances lie above those of a random rotation, in standard deviations
    sample: np.ndarray
    sample_ids: np.ndarray

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]

    def codes(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """Packed codes.  A coordinate that fills vectors up to the largest norm turns inner products into angles."""
        norm = (vectors**2).sum(1)
        fill = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(self.longest**2 - norm, 0))
        return np.packbits(np.column_stack([vectors, fill]) @ self.rotation > 0, axis=1)

    def radius(self, score: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Bits within which a vector with this score has its code."""
        p = np.clip(np.arccos(np.clip(score / np.maximum(norm * self.longest, 1e-300), -1, 1)) / math.pi, 1e-6, 1)
        return np.ceil(self.bits * p + self.shift * np.sqrt(self.bits * p * (1 - p)) + 1).astype(int)


def fit_codec(sample: np.ndarray, ids: np.ndarray, longest: float, k: int, confidence: float = CONFIDENCE, rotations: int = ROTATIONS) -> Codec:
    fill = np.sqrt(np.maximum(longest**2 - (sample**2).sum(1), 0))
    full = np.column_stack([sample, fill]) / longest
    width = full.shape[1] - full.shape[1] % 8 or 8
    codec = Codec(longest, np.hstack([fit_rotation(full, seed)[:, :width] if full.shape[1] >= 8 else np.random.default_rng(seed).standard_normal((full.shape[1], 8))
                                      for seed in range(rotations)]), 0.0, sample, ids)
    asked = np.arange(0, len(sample), max(1, len(sample) // 256))
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-scores, axis=1, kind="stable")[:, :min(k, len(sample) - 1)]
    far = np.bitwise_count(codec.codes(sample[asked], True)[:, None, :] ^ codec.codes(sample)[best]).sum(2)
    norm = np.sqrt((sample[asked] ** 2).sum(1))[:, None]
    p = np.clip(np.arccos(np.clip(np.take_along_axis(scores, best, 1) / (norm * longest), -1, 1)) / math.pi, 1e-6, 1 - 1e-6)
    z = (far - codec.bits * p) / np.sqrt(codec.bits * p * (1 - p))
    codec.shift = max(NormalDist().inv_cdf(confidence), float(np.quantile(z, confidence)) if z.size else 0.0)
    return codec


def _words(codes: np.ndarray) -> np.ndarray:
    """The same bits in 64-bit words."""
    return np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8)))).view(np.uint64)


class Index:
    """The codes of a block: for every byte of a code, the vectors by that byte's value."""

    def __init__(self, codes: np.ndarray):
        self.words = _words(codes)
        self.order = [np.argsort(codes[:, j], kind="stable").astype(np.uint16 if len(codes) <= 1 << 16 else np.int32) for j in range(codes.shape[1])]
        self.starts = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]
        self.near: dict[tuple[int, int, int], np.ndarray] = {}

    def bucket(self, j: int, value: int, reach: int) -> np.ndarray:
        """The vectors whose byte j differs from ``value`` in at most ``reach`` bits; looked up once."""
        key = (j, value, reach)
        if key not in self.near:
            order, starts = self.order[j], self.starts[j]
            self.near[key] = np.concatenate([order[starts[v]:starts[v + 1]] for v in (NEAR[min(reach, 8)] ^ value).tolist()])
        return self.near[key]

    def within(self, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All vectors whose code is within the radius, and how far."""
        bytes_ = len(code)
        least, more = divmod(min(radius, 8 * bytes_), bytes_)
        seen = np.zeros(len(self.words), bool)
        for j in range(bytes_):
            # if every one of the first more + 1 bytes differed in over `least` bits and every other in `least`, the sum would be over the radius
            reach = least if j <= more else least - 1
            if reach < 0:
                continue
            seen[self.bucket(j, int(code[j]), reach)] = True
            if seen.all():
                break
        found = np.flatnonzero(seen)
        far = np.bitwise_count(self.words[found] ^ _words(code[None, :])).sum(1, dtype=np.int32)
        inside = far <= radius
        return found[inside], far[inside]


def _scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products; equal vectors get equal results wherever they stand."""
    return (vectors * query).sum(1)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    scores = np.where(np.isnan(scores), -np.inf, scores)  # opposite overflows
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return some[np.lexsort((ids[some], -scores[some]))][:k]
    return np.lexsort((ids, -scores))[:k]


def _vectors(table: pa.Table) -> np.ndarray:
    values = table.column("vector").combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _sample_limits(asked: np.ndarray, own: np.ndarray, codec: Codec, k: int) -> np.ndarray:
    """A score that k vectors reach, for every query: the k-th best in the sample; -inf if the sample is too small."""
    scores = asked @ codec.sample.T
    scores[own[:, None] == codec.sample_ids[None, :]] = -np.inf
    if scores.shape[1] < k:
        return np.full(len(asked), -np.inf)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] - 1e-9 * codec.longest**2


def _hits(row: list, query: list, id_: list, score: list) -> pa.Table:
    return pa.table({"row": pa.array(row, pa.int64()), "query_id": pa.array(query, pa.int64()),
                     "id": pa.array(id_, pa.int64()), "score": pa.array(score, pa.float64())})


def _search_block(key, data: pa.Table, queries: pa.Table, codec: Codec | None, k: int, every: bool = False) -> pa.Table:
    """The best vectors of a block for each query, of those within the radius or of ``every`` one."""
    out_row, out_query, out_id, out_score = [], [], [], []
    if data.num_rows and queries.num_rows:
        vectors, ids = _vectors(data), np.array(data.column("id"))
        asked, own = _vectors(queries), np.array(queries.column("id"))
        if every:
            for i, row in enumerate(queries.column("row").to_pylist()):
                found = np.flatnonzero(ids != own[i])
                scores = _scores(vectors[found], asked[i])
                top = _best(scores, ids[found], k)
                out_row += [row] * len(top)
                out_query += [own[i]] * len(top)
                out_id += ids[found[top]].tolist()
                out_score += scores[top].tolist()
            return _hits(out_row, out_query, out_id, out_score)
        index = Index(codec.codes(vectors))
        codes, norms = codec.codes(asked, True), np.sqrt((asked**2).sum(1))
        limits = np.concatenate([_sample_limits(asked[i:i + 256], own[i:i + 256], codec, k) for i in range(0, len(asked), 256)])
        for i, row in enumerate(queries.column("row").to_pylist()):
            limit = limits[i]
            radius = codec.bits if limit == -np.inf else int(codec.radius(limit, norms[i]))
            found, far = index.within(codes[i], radius)
            other = ids[found] != own[i]
            found, far = found[other], far[other]
            first = np.argsort(far, kind="stable")[:8 * k] if len(far) > 16 * k else np.arange(len(far))
            scores = _scores(vectors[found[first]], asked[i])
            if len(first) < len(far):
                limit = max(limit, np.partition(scores, len(scores) - k)[len(scores) - k])
                inside = np.flatnonzero(far <= codec.radius(limit, norms[i]))
                found = found[np.union1d(inside, first)]
                scores = _scores(vectors[found], asked[i])
            top = _best(scores, ids[found], k)
            out_row += [row] * len(top)
            out_query += [own[i]] * len(top)
            out_id += ids[found[top]].tolist()
            out_score += scores[top].tolist()
    return _hits(out_row, out_query, out_id, out_score)


def usable(vectors: DataFrame, row_id: str, vector: str) -> DataFrame:
    """``(row, id, vector)`` of the rows that take part."""
    values = F.col(vector).cast("array<double>")
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(row_id).cast("long").alias("id"), values.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def _numbers(n: int):
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def search(vectors: DataFrame, is_query, k: int = 20, row_id: str = "vec_id", vector: str = "embedding",
           sample: int = SAMPLE, block: int = BLOCK, query_block: int = QUERY_BLOCK, confidence: float = CONFIDENCE) -> DataFrame:
    """``(query_id, rank, <row_id>, score)``: of every query the k vectors found with the largest inner product.

    ``is_query`` maps the id column to a condition.  A query's own id is no
    candidate of it.  Vectors that are null, zero, hold a null or non-finite
    component, have a null id or another length than the most common one take
    no part.  Where the square of a norm overflows, codes say nothing, and all
    vectors are compared.  Ties go to the smaller id; rows that repeat an id are candidates
    and queries of their own.  An empty table gives an empty result; other
    columns are not read.
    """
    spark = vectors.sparkSession
    rows = stage(usable(vectors, row_id, vector))
    sizes = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("many"), F.max(F.aggregate(
        "vector", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")).orderBy(F.desc("many"), "n").first()
    empty = f"query_id long, rank int, `{row_id}` long, score double"
    if sizes is None:
        return spark.createDataFrame([], empty)
    rows = rows.filter(F.size("vector") == sizes["n"])
    finite = math.isfinite(sizes["norm"])
    taken = [] if not finite else rows.orderBy(F.xxhash64("id"), "row").limit(sample).collect()
    codec = None if not finite else fit_codec(np.array([r["vector"] for r in taken]), np.array([r["id"] for r in taken]), math.sqrt(sizes["norm"]), k, confidence)
    queries = stage(rows.filter(is_query(F.col("id"))))
    place = Window.partitionBy("row").orderBy(F.desc("score"), "id")

    def best(asked: DataFrame, every: bool) -> DataFrame:
        blocks, parts = max(1, math.ceil(sizes["many"] / block)), max(1, math.ceil(asked.count() / query_block))
        data = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).withColumn("part", F.explode(_numbers(parts)))
        spread = asked.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts))).withColumn("block", F.explode(_numbers(blocks)))
        found = data.groupBy("block", "part").cogroup(spread.groupBy("block", "part")).applyInArrow(
            per_pair(_search_block, codec=codec, k=k, every=every), "row long, query_id long, id long, score double")
        return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)

    if not finite:
        return best(queries, True).select("query_id", "rank", F.col("id").alias(row_id), "score")
    found = stage(best(queries, False))
    # queries that found fewer than there are
    many, copies = found.groupBy("row").agg(F.count("*").alias("many")), rows.groupBy("id").agg(F.count("*").alias("copies"))
    short = stage(queries.join(many, "row", "left").join(copies, "id").filter(
        F.coalesce("many", F.lit(0)) < F.least(F.lit(k), F.lit(sizes["many"]) - F.col("copies"))).select("row", "id", "vector"))
    if not short.isEmpty():
        found = found.join(short.select("row"), "row", "left_anti").unionByName(best(short, True))
    return found.select("query_id", "rank", F.col("id").alias(row_id), "score")
