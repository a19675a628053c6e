"""Score texts by the marginal likelihood of their subword spellings.

A text's probability is the sum over all ways to write its words with pieces,
followed by one end; since no piece crosses words, that is the product of its
words' sums.  The pieces are those of an existing vocabulary, weighed in a
lattice by a forward recursion in log space (``lattice.py``), and, as one
further piece each, the words of the training texts, whose counts are
discounted in favour of spellings.  The vocabulary's own scores give the first
piece probabilities; passes over the distinct training words, weighed by how
often they occur, then set them to the expected counts of the pieces
(expectation maximisation).

Each block of documents reduces its texts to distinct words once; passes work
on those.  One exchange of word counts gives every block the corpus count of
each of its words, for the word-level base score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relish.llm.arrow import joined, packed, per_batches, per_group, per_pair
from relish.llm.blocks import stage_blocks
from relish.llm.exchange import SENT, answer, bin_bits, count_sorted, deal
from relish.llm.lattice import automaton, by_length, expected, forward, read_pieces
from relish.llm.toxicity import held_out
from relish.llm.words import chunks
from relish.session import stage

ROUNDS = 2
DISCOUNT = 0.75  # taken off each training word's count
SMOOTHING = 0.01  # added to every piece's count
PART = 2048  # pieces whose counts travel in one row
WORDS = "block int, docs long, keys binary, counts binary, lengths binary, letters binary"


def _distinct_words(batches):
    """Distinct words of some rows: hashes (sorted), training counts, and where their bytes are; and the number of training rows."""
    lists, pieces, sizes, base, docs = [], [], [], 0, 0
    for part, words in chunks(batches, "text", lower=True):
        training = ~np.array(part.column("held_out"))
        docs += int(training.sum())
        used = np.repeat(training, np.diff(words.first))
        keys, at, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        lists.append((keys, np.bincount(which, used, len(keys)).astype(np.int64), words.starts[at] + base, words.ends[at] + base))
        pieces.append(words.data)
        base += len(words.data)
    if not lists:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8), 0
    keys, counts, starts, ends = (np.concatenate(x) for x in zip(*lists))
    order, runs, _ = count_sorted(keys)
    counts = np.add.reduceat(counts[order], runs) if len(runs) else counts
    first = order[runs]
    return keys[first], counts, starts[first], ends[first], np.concatenate(pieces), docs


def _words_of_block(key, table: pa.Table) -> pa.Table:
    keys, counts, starts, ends, data, docs = _distinct_words(table.to_batches())
    lengths = ends - starts
    total = np.concatenate([[0], np.cumsum(lengths)])
    letters = data[np.repeat(starts - total[:-1], lengths) + np.arange(total[-1])]
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "docs": pa.array([docs]), "keys": pa.array([packed(keys)], pa.binary()),
                     "counts": pa.array([packed(counts)], pa.binary()), "lengths": pa.array([packed(lengths.astype(np.int32))], pa.binary()),
                     "letters": pa.array([packed(letters)], pa.binary())})


def _expected_batches(batches, pieces: list[bytes], log_p: np.ndarray):
    """Expected piece counts of a task's training words, each as often as it occurs, in rows of PART pieces."""
    tool, counts = automaton(pieces), np.zeros(len(pieces))
    for batch in batches:
        for row in range(batch.num_rows):
            many, lengths, letters = (np.frombuffer(batch.column(c)[row].as_py(), kind) for c, kind in (("counts", np.int64), ("lengths", np.int32), ("letters", np.uint8)))
            ends = np.cumsum(lengths, dtype=np.int64)
            used = np.flatnonzero(many)
            for some, words in by_length(letters, (ends - lengths)[used], ends[used]):
                counts += expected(words, many[used[some]].astype(float), tool, log_p)
    parts = range(-(-len(pieces) // PART))
    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([packed(counts[p * PART:(p + 1) * PART]) for p in parts], pa.binary())], ["part", "counts"])


def _sum_counts(key, table: pa.Table) -> pa.Table:
    total = np.sum(np.sort(np.stack([np.frombuffer(x, np.float64) for x in table.column("counts").to_pylist()]), axis=0), axis=0)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([packed(total)], pa.binary())})


def fit_pieces(words: DataFrame, pieces: list[bytes], log_p: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces, from the training words of all blocks."""
    for _ in range(rounds):
        run = per_batches(_expected_batches, pieces=pieces, log_p=log_p)
        rows = words.select("counts", "lengths", "letters").mapInArrow(run, "part int, counts binary").groupBy("part").applyInArrow(
            per_group(_sum_counts), "part int, counts binary").orderBy("part").collect()
        counts = np.concatenate([np.frombuffer(r["counts"], np.float64) for r in rows]) + SMOOTHING
        log_p = np.log(counts / counts.sum())
    return log_p


def _send_words(batches, bits: int):
    for batch in batches:
        for block, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "keys", "counts"))):
            yield deal(block, np.frombuffer(keys, np.uint64), bits, np.frombuffer(counts, np.int64))


def _corpus_counts(keys, many, block):
    """The corpus count of each entry's word, and 1 for one of the blocks that ask about a word that occurs."""
    order, starts, run = count_sorted(keys)
    values = np.zeros((len(keys), 2), np.int64)
    if len(keys):
        values[order, 0] = np.add.reduceat(many[order], starts)[run]
        values[order[starts], 1] = values[order[starts], 0] > 0
    return np.ones(len(keys), bool), values


def _sum_values(batches, step: int, at: int):
    """Sum of one of every ``step`` packed values."""
    yield pa.RecordBatch.from_arrays([pa.array([sum(
        int(np.frombuffer(x, np.int64)[at::step].sum()) for batch in batches for x in batch.column(0).to_pylist())], pa.int64())], ["n"])


def _total(column: DataFrame, step: int = 1, at: int = 0) -> int:
    return column.mapInArrow(per_batches(_sum_values, step=step, at=at), "n long").agg(F.sum("n")).first()[0] or 0


def _score_block(key, table: pa.Table, answers: pa.Table, pieces: list[bytes], log_p: np.ndarray,
                 tokens: int, distinct: int, docs: int) -> pa.Table:
    keys = joined(answers.column("keys"), np.uint64)
    counts = joined(answers.column("extra"), np.int64).reshape(-1, 2)[:, 0]
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    own, _, starts, ends, data, _ = _distinct_words(table.to_batches())
    tool, spelled = automaton(pieces), np.zeros(len(own))
    for some, words in by_length(data, starts, ends):
        spelled[some] = forward(words, tool, log_p)
    rest = np.log10(tokens + 0.1 * (distinct + 1))
    base = np.log10(counts + 0.1) - rest
    known = counts > 0
    with np.errstate(divide="ignore"):  # a word not in training texts has no piece of its own
        whole = np.log(np.maximum(counts - DISCOUNT, 0) / max(tokens, 1))
        free = np.log(min(1.0, DISCOUNT * distinct / tokens) if tokens else 0.5)
        spelled = np.logaddexp(whole, spelled + free) / np.log(10)
    end = np.log10(docs / tokens) if docs else np.log10(0.5)
    out = []
    for part, words in chunks(table.to_batches(), "text", lower=True):
        n = np.diff(words.first)
        at = np.searchsorted(keys, words.hashes())
        row = np.repeat(np.arange(len(n)), n)
        add = lambda values: np.bincount(row, values, len(n))
        out.append(pa.table({
            "id": part.column("id"), "held_out": part.column("held_out"), "n_tokens": pa.array(n + 1, pa.int64()),
            "n_known": pa.array(add(known[at]).astype(np.int64) + (docs > 0)), "train_tokens": pa.array(np.full(len(n), tokens, np.int64)),
            "base_score": pa.array(add(base[at]) + np.log10(docs + 0.1) - rest), "score": pa.array(add(spelled[at]) + end)}))
    return pa.concat_tables(out)


def score(docs: DataFrame, vocabulary: str, text: str = "text", row_id: str = "doc_id", folds: int = 10, rounds: int = ROUNDS) -> DataFrame:
    """``(<row_id>, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per row of ``docs``.

    ``vocabulary`` is the path of a sentencepiece model.  Learns from the rows
    that are not held out (the id's CRC is not divisible by ``folds``).  Words
    are lower-cased in A-Z; a text's tokens are its words and one end.  ``score``
    is the log10 probability of the text, ``base_score`` that of its tokens by
    smoothed counts.

    Null and empty texts have the end only.  A null id is not held out;
    repeated rows are scored alike and each is learned from.  Without training
    rows the vocabulary's own scores are the model.  An empty table gives an
    empty result; other columns are not read.
    """
    pieces, first = read_pieces(vocabulary)
    blocks = stage_blocks(docs.select(F.col(row_id).alias("id"), F.col(text).cast("string").alias("text")).withColumn("held_out", held_out(F.col("id"), folds)))
    words = stage(blocks.groupBy("block").applyInArrow(per_group(_words_of_block), WORDS))
    trained = words.agg(F.sum("docs")).first()[0] or 0
    bits = bin_bits(words.count())
    answers = stage(answer(words.select("block", "keys", "counts").mapInArrow(per_batches(_send_words, bits=bits), SENT), _corpus_counts, np.int64))
    distinct = _total(answers.select("extra"), 2, 1) + (trained > 0)
    tokens = _total(words.select("counts")) + trained
    log_p = fit_pieces(words, pieces, first, rounds) if trained else first
    fields = f"id {docs.schema[row_id].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(per_pair(
        _score_block, pieces=pieces, log_p=log_p, tokens=tokens, distinct=distinct, docs=trained), fields).withColumnRenamed("id", row_id)

