"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

An n-gram of a text's lower-cased characters is a feature, hashed to one of
``BUCKETS``; it counts once per text.  A feature's ratio r is the smoothed
log of how much more often it is in texts labelled 1 than in texts labelled 0.
The features whose ratio stands out most are kept, each worth r where it
occurs, and a logistic regression weighs them.  The classifier is fitted on at
most ``sample`` labelled texts, taken in hash order of their id; scoring is one
pass over the table without a shuffle, with a model of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relish.llm.arrow import per_batches, per_group
from relish.session import stage

ORDERS = (3, 4, 5)
BITS = 20
BUCKETS = 1 << BITS
PART = 1 << 14  # buckets whose counts travel in one row
SAMPLE = 40_000  # labelled texts to fit on, at most
KEPT = 2048  # features with a weight, at most
SMOOTHING = 1.0
CHUNK_CHARS = 1 << 20
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def gram_buckets(codes: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each character."""
    size = max(0, len(codes) - n + 1)
    h = np.full(size, n, np.uint32)
    for i in range(n):
        h += codes[i:i + size] * _FACTORS[i]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
    return (h ^ (h >> np.uint32(12))) >> np.uint32(32 - BITS)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts, a 0 after each, and where those zeros are."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(("\0".join(lowered) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1) - 1


def _groups(column: pa.Array):
    """Lists of texts of about CHUNK_CHARS characters; null counts as empty."""
    own, size = [], 0
    for t in column.fill_null("").to_pylist():
        if own and size + len(t) > CHUNK_CHARS:
            yield own
            own, size = [], 0
        own.append(t)
        size += len(t)
    if own:
        yield own


def _features(text: str) -> np.ndarray:
    """The distinct buckets of one text."""
    codes, _ = _codes([text])
    return np.unique(np.concatenate([gram_buckets(codes[:-1], n) for n in ORDERS]))


def _count_batches(batches):
    """Texts per bucket and label, of one task, in rows of PART buckets."""
    counts = np.zeros((2, BUCKETS), np.uint32)
    for batch in batches:
        for text, label in zip(batch.column(0).fill_null("").to_pylist(), batch.column(1).to_pylist()):
            counts[label, _features(text)] += 1
    parts = range(BUCKETS // PART)
    yield pa.RecordBatch.from_arrays(
        [pa.array(parts, pa.int32()), *(pa.array([counts[k, p * PART:(p + 1) * PART].tobytes() for p in parts], pa.binary()) for k in (0, 1))],
        ["part", "clean", "toxic"])


def _sum_part(key, table: pa.Table) -> pa.Table:
    sums = [sum(np.frombuffer(x, np.uint32).astype(np.int64) for x in table.column(c).to_pylist()).tobytes() for c in ("clean", "toxic")]
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "clean": pa.array([sums[0]], pa.binary()), "toxic": pa.array([sums[1]], pa.binary())})


def log_count_ratios(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> tuple[np.ndarray, np.ndarray]:
    """Each feature's log ratio, and how many standard deviations its share of label 1 is from the overall share."""
    ratio = np.log((toxic + SMOOTHING) / (n_toxic + 2 * SMOOTHING)) - np.log((clean + SMOOTHING) / (n_clean + 2 * SMOOTHING))
    share, total = n_toxic / (n_toxic + n_clean), toxic + clean
    return ratio, (toxic - total * share) / np.sqrt(np.maximum(total, 1) * share * (1 - share))


def _kept_batches(batches, place: np.ndarray):
    """Numbers of the kept features that each text has."""
    for batch in batches:
        found = []
        for text in batch.column(0).fill_null("").to_pylist():
            own = place[_features(text)]
            found.append(own[own >= 0].astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.binary())], ["label", "features"])


def fit_logistic(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, penalty: float = 1e-5, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the mean log loss plus a square penalty, by accelerated gradient steps."""
    sizes = np.array([len(r) for r in rows])
    at = np.concatenate(rows) if len(rows) else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(rows)), sizes)
    scale = 1 / max(1.0, float(np.max(np.bincount(row, ratio[at] ** 2, len(rows)), initial=1.0)) ** 0.5)
    x = ratio[at] * scale
    w, bias, moment, square = np.zeros(len(ratio)), float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))), 0.0, 0.0
    theta = np.append(w, bias)
    for t in range(1, steps + 1):
        z = np.bincount(row, x * theta[at], len(rows)) + theta[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) / len(labels)
        gradient = np.append(np.bincount(at, x * error[row], len(ratio)) + penalty * scale * theta[:-1], error.sum())
        moment, square = 0.9 * moment + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        theta = theta - 0.3 * (1 - t / (steps + 1)) * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-9)
    return theta[:-1] * scale, float(theta[-1])


def _fit_task(key, table: pa.Table, ratio: np.ndarray) -> pa.Table:
    """The fit of the (bounded) sample, in one task."""
    rows = [np.frombuffer(x, "<i4") for x in table.column("features").to_pylist()]
    order = sorted(range(len(rows)), key=lambda i: rows[i].tobytes())  # the sum's order does not depend on how rows arrive
    labels = np.array(table.column("label").to_pylist(), np.float64)[order]
    weights, bias = fit_logistic([rows[i] for i in order], labels, ratio)
    return pa.table({"weights": pa.array([(weights * ratio).astype("<f8").tobytes()], pa.binary()), "bias": pa.array([bias])})


@dataclass
class Model:
    weights: np.ndarray  # one per bucket
    bias: float


def fit(labelled: DataFrame, sample_text: str = "text", label: str = "label", kept: int = KEPT) -> Model:
    """Fit on all rows of ``labelled`` (text, 0/1 label): bound their number first.

    Without rows of both labels, every text gets the share of label 1 (0.5
    without any rows).
    """
    rows = labelled.select(F.col(sample_text).alias("text"), F.col(label).cast("int").alias("label")).filter("label in (0, 1)")
    n = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if len(n) < 2:
        share = (n.get(1, 0) + 0.5) / (sum(n.values()) + 1)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    sums = rows.mapInArrow(_count_batches, "part int, clean binary, toxic binary").groupBy("part").applyInArrow(
        per_group(_sum_part), "part int, clean binary, toxic binary").orderBy("part").collect()
    clean, toxic = (np.concatenate([np.frombuffer(r[c], np.int64) for r in sums]) for c in (1, 2))
    ratio, strength = log_count_ratios(clean, toxic, n[0], n[1])
    best = np.argsort(-np.abs(strength), kind="stable")[:kept]
    best = np.sort(best[(clean + toxic)[best] > 0])
    place = np.full(BUCKETS, -1, np.int32)
    place[best] = np.arange(len(best))
    found = rows.mapInArrow(per_batches(_kept_batches, place=place), "label int, features binary")
    fitted = found.withColumn("fit", F.lit(0)).groupBy("fit").applyInArrow(per_group(_fit_task, ratio=ratio[best]), "weights binary, bias double").first()
    weights = np.zeros(BUCKETS, np.float32)
    weights[best] = np.frombuffer(fitted["weights"], "<f8")
    return Model(weights, fitted["bias"])


def text_scores(texts: list[str], model: Model) -> np.ndarray:
    codes, ends = _codes(texts)
    keys, values = [], []
    for n in ORDERS:
        bucket = gram_buckets(codes, n)
        weight = model.weights[bucket]
        crossing = (ends[:, None] - np.arange(n)[None, :]).ravel()
        weight[crossing[(crossing >= 0) & (crossing < len(weight))]] = 0
        at = np.flatnonzero(weight)
        keys.append(np.searchsorted(ends, at).astype(np.int64) << BITS | bucket[at])
        values.append(weight[at])
    key, first = np.unique(np.concatenate(keys), return_index=True)
    z = np.bincount(key >> BITS, np.concatenate(values)[first], len(texts)) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _score_batches(batches, model: Model, text: str, kept: list[str]):
    for batch in batches:
        scores = [text_scores(texts, model) for texts in _groups(batch.column(batch.schema.get_field_index(text)))]
        scores = np.concatenate(scores) if scores else np.zeros(0)
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(scores, pa.float64())], [*kept, "score"])


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``score`` between 0 and 1.

    Null and empty texts get the score of a text without features.  Repeated
    rows get equal scores, an empty table gives an empty result, and a column
    named ``score`` is replaced.
    """
    kept = [c for c in (keep or docs.columns) if c != "score"]
    rows = docs.select(*kept, *([] if text in kept else [text])).withColumn(text, F.col(text).cast("string"))
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(per_batches(_score_batches, model=model, text=text, kept=kept), schema)


def held_out(row_id, folds: int = 5):
    """Rows never learned from: the id's CRC is divisible by ``folds``; false for null."""
    return F.coalesce(F.crc32(row_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit_labels(docs: DataFrame, labels: DataFrame, label: str = "toxic", row_id: str = "doc_id", text: str = "text",
               folds: int = 5, sample: int = SAMPLE) -> Model:
    """Fit on the documents with a label whose id is not held out, at most ``sample`` ids, those of smallest hash.

    Labels other than 0 and 1 and null ids are left out; an id with several
    labels counts as 1 if one of them is.  ``sample`` bounds what is broadcast
    and what the fit gathers.
    """
    known = labels.select(F.col(row_id).alias("_id"), F.col(label).cast("int").alias("_label")).filter("_id is not null and _label in (0, 1)")
    known = known.filter(~held_out(F.col("_id"), folds)).groupBy("_id").agg(F.max("_label").alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    own = docs.select(F.col(row_id).alias("_id"), F.col(text).cast("string").alias("text"))
    return fit(stage(own.join(F.broadcast(chosen), "_id").select("text", F.col("_label").alias("label"))))
