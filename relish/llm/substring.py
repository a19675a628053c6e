"""Remove word runs that occur earlier in the corpus, by seeds and extension.

Of every run of LENGTH words, the GRAM-word piece with the smallest hash is its
anchor (winnowing), so two equal runs have equal anchors at equal places and
one word in about seven starts an anchor.  Blocks of documents join on anchors:
one exchange tells each block which of its anchors occur elsewhere too.  Only
those are extended, both ways, to all runs of LENGTH words they are the anchor
of; a second exchange names the runs that start earlier in another block.
Adjoining runs make up the maximal repeats, and their words go.

Equal runs are never paired with each other: a run is compared with its first
occurrence only, so a passage in a third of all documents costs one entry a
block.  The texts are written once, bucketed, and never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from relish.llm.arrow import per_batches, per_pair
from relish.llm.blocks import stage_blocks
from relish.llm.exchange import SENT, answer, bin_bits, count_sorted, deal, is_in, keys_of
from relish.llm.words import Words, chunks, gram_hashes, mix
from relish.session import stage

LENGTH = 20
GRAM = 8
NONE = np.uint64(2**64 - 1)
LAST_ID = np.iinfo(np.int64).max


def _slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """best(values[i:i + width]) for every i; shorter at the end."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:len(out) - step] = best(out[:len(out) - step], out[step:])
        have += step
    return out


def run_anchors(words: Words, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all runs: hash of each, index of its first word, its anchor; and the hashes of all anchors, one per place."""
    hashes = words.hashes()
    runs, at = gram_hashes(hashes, words.first, length)
    grams = np.full(len(hashes), NONE)
    own, places = gram_hashes(hashes, words.first, gram)
    grams[places] = own
    reach = length - gram + 1
    lowest = _slide(grams, reach, np.minimum)
    of_runs = np.zeros(len(hashes), np.uint64)
    of_runs[at] = lowest[at]
    highest = np.zeros(len(hashes), np.uint64)  # the largest anchor among the runs over each piece: the piece itself, if it is one
    if len(hashes):
        highest = _slide(of_runs[::-1], reach, np.maximum)[::-1]
    return runs, at, mix(lowest[at]), mix(grams[(highest == grams) & (grams != NONE)])  # the smallest are not spread evenly


def _send_anchors(batches, text: str, length: int, gram: int, bits: int):
    """Distinct anchors of each block, and whether one stands at several places of it."""
    found: dict[int, list[np.ndarray]] = {}
    for part, words in chunks(batches, text):
        blocks = np.array(part.column("block"))
        for block in np.unique(blocks).tolist():  # one, but where a split of the input holds parts of two blocks
            own = words if blocks[0] == blocks[-1] == block else next(chunks([part.filter(pa.array(blocks == block))], text, limit=1 << 40))[1]
            found.setdefault(block, []).append(run_anchors(own, length, gram)[3])
    for block, lists in found.items():
        keys, many = np.unique(np.concatenate(lists), return_counts=True)
        yield deal(block, keys, bits, np.minimum(many, 2).astype(np.uint8))


def _repeated(keys, many, block):
    order, starts, run = count_sorted(keys)
    total = np.add.reduceat(many[order].astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    back = np.zeros(len(keys), bool)
    back[order] = total[run] > 1
    return back, None


def _table_chunks(table: pa.Table, text: str):
    return chunks(table.to_batches(), text)


def _runs_of(table: pa.Table, anchors: np.ndarray, length: int, gram: int, text: str, row_id: str):
    """Runs with a repeated anchor of a block: hash, document (its number in the block), first word; and n of words by document."""
    hashes, docs, places, counts, row = [], [], [], [], 0
    for part, words in _table_chunks(table, text):
        runs, at, anchor, _ = run_anchors(words, length, gram)
        keep = is_in(anchor, anchors)
        at = at[keep]
        doc = np.searchsorted(words.first, at, "right") - 1
        hashes.append(runs[keep])
        docs.append(doc + row)
        places.append(at - words.first[doc])
        counts.append(np.diff(words.first))
        row += part.num_rows
    ids = table.column(row_id).to_numpy(zero_copy_only=False) if not table.column(row_id).null_count else np.array(
        [LAST_ID if x is None else x for x in table.column(row_id).to_pylist()], np.int64)
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    doc, place = cat(docs, np.int64), cat(places, np.int64)
    return cat(hashes, np.uint64), doc, place, cat(counts, np.int64), ids.astype(np.int64)


def _send_runs(key, table: pa.Table, answers: pa.Table, length: int, gram: int, bits: int, text: str, row_id: str) -> pa.Table:
    """The distinct runs of a block's repeated anchors, with the smallest id that has each."""
    if not table.num_rows:
        return pa.table({"bin": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "extra": pa.array([], pa.binary())})
    hashes, doc, _, _, ids = _runs_of(table, keys_of(answers), length, gram, text, row_id)
    order, starts, _ = count_sorted(hashes)
    first = np.minimum.reduceat(ids[doc][order], starts) if len(starts) else np.zeros(0, np.int64)
    return pa.Table.from_batches([deal(key[0].as_py(), hashes[order][starts], bits, first)])


def _seen_elsewhere(keys, ids, block):
    """Entries whose run starts earlier in another block: by id, for one id in two blocks by block."""
    order = np.lexsort((block, ids, keys))
    sorted_keys = keys[order]
    later = np.zeros(len(keys), bool)
    later[order[1:]] = sorted_keys[1:] == sorted_keys[:-1]
    return later, None


def _cut(words: Words, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts without the words ``gone``, joined by single spaces."""
    data, keep = words.data.copy(), ~gone
    flips = np.zeros(len(data) + 1, np.int32)
    kept = np.flatnonzero(keep)
    flips[words.starts[kept]] += 1
    flips[words.ends[kept]] -= 1
    inside = np.cumsum(flips[:-1]) > 0
    doc = np.searchsorted(words.first, kept, "right") - 1
    followed = np.flatnonzero(doc[1:] == doc[:-1])
    gaps = words.ends[kept[followed]]
    inside[gaps] = True
    data[gaps] = 32
    sizes = np.zeros(len(words.first) - 1, np.int64)
    np.add.at(sizes, doc, words.ends[kept] - words.starts[kept])
    np.add.at(sizes, doc[followed], 1)
    return data[inside], np.concatenate([[0], np.cumsum(sizes)])


def _remove(key, table: pa.Table, answers: pa.Table, length: int, gram: int, text: str, row_id: str, names: list[str], schema: pa.Schema) -> pa.Table:
    """Every row of a block with its counts, repeats and kept text."""
    if not table.num_rows:
        return schema.empty_table()
    repeated = answers.column("step").to_numpy(zero_copy_only=False)
    anchors, elsewhere = (keys_of(answers.filter(pa.array(repeated == step))) for step in (1, 2))
    hashes, doc, place, counts, ids = _runs_of(table, anchors, length, gram, text, row_id)
    order = np.lexsort((place, doc, ids[doc], hashes))
    sorted_hashes = hashes[order]
    gone = is_in(hashes, elsewhere)
    gone[order[1:]] |= sorted_hashes[1:] == sorted_hashes[:-1]
    first = np.concatenate([[0], np.cumsum(counts)])
    flips = np.zeros(first[-1] + length + 1, np.int32)
    starts = (first[doc] + place)[gone]
    np.add.at(flips, starts, 1)
    np.add.at(flips, starts + length, -1)
    covered = np.cumsum(flips)[:first[-1]] > 0
    removed = np.zeros(len(counts), np.int64)
    np.add.at(removed, np.repeat(np.arange(len(counts)), counts), covered)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
    opened, closed = edge[::2], edge[1::2]
    cut_at = np.searchsorted(first, opened, "right") - 1
    texts, row = [], 0
    for part, words in _table_chunks(table, text):
        data, offsets = _cut(words, covered[first[row]:first[row + part.num_rows]])
        texts.append(pa.LargeStringArray.from_buffers(part.num_rows, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.append(data, np.uint8(0)))).cast(pa.string()))
        row += part.num_rows
    spans: list[list] = [[] for _ in counts]
    # a repeat that runs to the end of one document and one that opens the next are two
    for a, b, d in zip(opened.tolist(), closed.tolist(), cut_at.tolist()):
        while a < b:
            end = min(b, int(first[d + 1]))
            if end > a:
                spans[d].append({"start": a - int(first[d]), "end": end - int(first[d])})
            a, d = end, d + 1
    return pa.Table.from_arrays([*(table.column(c) for c in names), pa.array(counts), pa.array(removed), pa.array(spans, schema.field("repeats").type),
                                 pa.chunked_array(texts)], schema=schema)


def remove_repeats(docs: DataFrame, text: str = "text", row_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``repeats`` and ``kept_text``.

    A word goes if a run of ``length`` words that covers it starts earlier in
    the corpus: at a smaller id, or earlier in the same document.  ``repeats``
    lists the maximal removed spans [start, end) in words; ``kept_text`` joins
    the other words by one space.  Runs are judged on the input.

    Null and empty texts have no words and an empty ``kept_text``.  A null id
    counts as the largest; rows that share an id count in order of their block
    and place, so of equal rows all but one lose their runs.  An empty table
    gives an empty result.  Columns of ``docs`` with the names above, or named
    block, are replaced or left out.
    """
    made = ["n_words", "n_removed", "repeats", "kept_text"]
    names = [c for c in docs.columns if c not in [*made, "block"]]
    blocks = stage_blocks(docs.select(*names).withColumn(text, F.col(text).cast("string")))
    bits = bin_bits(blocks.select("block").distinct().count())
    options = {"length": length, "gram": gram, "text": text}
    sent = blocks.select("block", text).mapInArrow(per_batches(_send_anchors, bits=bits, **options), SENT)
    anchors = stage(answer(sent, _repeated, np.uint8))
    runs = blocks.select("block", row_id, text).groupBy("block").cogroup(anchors.groupBy("block")).applyInArrow(
        per_pair(_send_runs, bits=bits, row_id=row_id, **options), SENT)
    answers = anchors.withColumn("step", F.lit(1)).union(answer(runs, _seen_elsewhere, np.int64).withColumn("step", F.lit(2)))
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*(blocks.schema[c] for c in names), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("repeats", span), T.StructField("kept_text", T.StringType())])
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        per_pair(_remove, row_id=row_id, names=names, schema=to_arrow_schema(schema), **options), schema)


SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (
  SELECT doc_id, s AS start, md5(array_to_string(w[s:s + 19], ' ')) AS h FROM words, unnest(range(1, len(w) - 18)) AS r(s)),
again AS (
  SELECT doc_id, start FROM runs QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, start) > 1),
gone AS (
  SELECT DISTINCT doc_id, i FROM again, unnest(range(start, start + 20)) AS r(i)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM words d LEFT JOIN kept k USING (doc_id)
"""
