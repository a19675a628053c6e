"""Remove byte strings that occur in an earlier document, by distributed prefix doubling.

Every position has a name for the bytes that start there: first eight bytes, then
pairs of names at growing offsets (8, and so on up to half the threshold, then
the whole threshold), as prefix doubling ranks suffixes.  Names are 64-bit
mixes of the pair, so a task computes them from its texts, and a sort need not
send a rank back for every position: it only says which names stand alone or
who has them first.  Spark sorts names over all documents in three rounds; after
each sort, positions whose name is unique, or settled, drop out.

1. Names of half the threshold, of synchronising positions only: in every
   window of the threshold's length the position with the smallest lower half of a name, so equal
   windows have theirs at the same place and one position in thirteen is sorted.
   Where this name is unique, no window around it is repeated.
2. Pairs of these with the names on both sides: all bytes that any window of
   the position can touch.  If the same bytes stand in an earlier document, all
   windows of the position are settled at once, as they are inside of copies.
   A second key asks whether the name of the position has several surroundings.
3. Where it has, at the ends of repeats, names of whole windows: the pair of
   names at the offset of half the threshold.

A block of documents sends each name once with its smallest id, so the most
frequent string costs as many entries as there are blocks, and texts are
written once and never shuffled.  A block is made of a few megabytes of the
input, since a text without settled positions has 13 names of windows for each
synchronising one, and a bin is sorted range by range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from relish.llm.arrow import per_batches, per_group, per_pair
from relish.llm.blocks import parts_of, stage_blocks
from relish.llm.exchange import bin_bits, count_sorted, is_in
from relish.llm.words import mix, text_bytes
from relish.session import stage

LENGTH = 50
SHORTEST = 16  # a threshold of less than two exact names of eight bytes is not supported
GROUP_BYTES = 1 << 18  # texts are named in groups of about this many bytes
BLOCK_INPUT = 4 << 20  # bytes of the input's files for each block
SORTED = 1 << 20  # keys of a bin sorted at a time, about
SENT = "step int, bin int, block int, keys binary, extra binary"
ANSWER = "step int, block int, keys binary"
LAST_ID = np.iinfo(np.int64).max
LOWER = np.uint64(0x00000000FFFFFFFF)
SEVERAL = np.uint64(0)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def names(data: np.ndarray, length: int) -> np.ndarray:
    """The name of data[i:i + length] for every i, by doubling from eight bytes."""
    out = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,)).copy()
    have = 8
    while have < length:
        step = min(have, length - have)
        out = pair(out[:-step], out[step:])
        have += step
    return out


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def text_groups(batches, text: str, limit: int = GROUP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Groups of whole rows of about ``limit`` bytes, or one longer row: the rows, their bytes, and offsets."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
            yield batch.slice(row, end - row), data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
            row = end


class Synchronised:
    """Windows of a stretch of texts by their synchronising positions.

    ``at`` are the positions, ``first`` and ``count`` the windows of each (a
    run of starts), ``text`` the text each lies in; all local to the stretch.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, low: int, high: int, length: int):
        self.length, self.half, self.offsets = length, (length + 1) // 2, offsets
        empty = np.zeros(0, np.int64)
        self.names, self.at, self.first, self.count = np.zeros(0, np.uint64), empty, empty, empty
        if len(data) >= length:
            self.names = names(data, self.half)
            order = (self.names << np.uint64(32)) | np.arange(len(self.names), dtype=np.uint64)  # by lower halves: keys are dealt by upper bits
            lowest = _lowest(order, length - self.half + 1)
            inside = np.zeros(len(data) + 1, np.int8)
            long_enough = np.diff(offsets) >= length
            inside[offsets[:-1][long_enough]] = 1
            inside[offsets[1:][long_enough] - length + 1] = -1
            starts = np.flatnonzero(np.cumsum(inside, dtype=np.int8))
            starts = starts[(starts >= low) & (starts < high)]
            chosen = (lowest[starts] & LOWER).astype(np.int64)
            fresh = np.ones(len(chosen), bool)
            fresh[1:] = chosen[1:] != chosen[:-1]
            runs = np.flatnonzero(fresh)
            self.at, self.first, self.count = chosen[runs], starts[runs], np.diff(np.append(runs, len(chosen)))
        self.text = np.searchsorted(offsets, self.at, "right") - 1

    def keep(self, chosen: np.ndarray) -> None:
        self.at, self.first, self.count, self.text = self.at[chosen], self.first[chosen], self.count[chosen], self.text[chosen]

    def surroundings(self) -> np.ndarray:
        """Names of all bytes that the windows of each position can touch, within its text."""
        begin = np.maximum(self.offsets[self.text], self.at - (self.length - self.half))
        end = np.minimum(self.offsets[self.text + 1], self.at + self.length)
        sides = pair(pair(self.names[begin], self.names[self.at]), self.names[end - self.half])
        return pair(sides, ((self.at - begin) * self.length + end - self.at).astype(np.uint64)) | np.uint64(1)

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and names of all windows of the chosen positions."""
        count = self.count[chosen]
        starts = np.repeat(self.first[chosen] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        return starts, pair(self.names[starts], self.names[starts + self.length - self.half])


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, limit: int = GROUP_BYTES) -> Iterator[tuple[int, Synchronised]]:
    """The windows of a group of texts; a longer text comes in overlapping parts, each with its place in the text."""
    if len(data) <= 2 * limit or len(offsets) > 2:
        yield 0, Synchronised(data, offsets, 0, len(data), length)
        return
    reach = length - length // 2
    for low in range(0, len(data), limit):
        begin, end = max(0, low - reach), min(len(data), low + limit + reach + length)
        yield begin, Synchronised(data[begin:end], np.array([0, end - begin]), low - begin, low - begin + limit, length)


def squeeze(values: np.ndarray, rising: bool = False) -> bytes:
    """64-bit values as a compressed text of their bytes by place; of sorted values, the differences."""
    values = values.view(np.uint64)
    if rising:
        values = np.diff(values, prepend=np.uint64(0))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unsqueeze(data: bytes, rising: bool = False) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd", asbytes=True), np.uint8)
    values = np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).reshape(n)
    return np.cumsum(values, dtype=np.uint64) if rising else values


def _table(columns: dict[str, list], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.table({name: pa.array(columns[name], kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))})


def _deal(step: int, block: int, keys: np.ndarray, extra: np.ndarray, bits: int) -> pa.Table:
    """A block's sorted distinct keys, with a value each, dealt into bins by their upper bits."""
    bins = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    found, starts = np.unique(bins, return_index=True)
    ends = np.append(starts[1:], len(keys))
    return _table({"step": [step] * len(found), "bin": found, "block": [block] * len(found),
                   "keys": [squeeze(keys[a:b], True) for a, b in zip(starts, ends)],
                   "extra": [squeeze(extra[a:b]) for a, b in zip(starts, ends)]}, SENT)


def _judged(judge, parts: list[np.ndarray], extras: list[np.ndarray], low: int, high: int) -> list[np.ndarray]:
    """The keys of each part from ``low`` to below ``high`` that concern their block."""
    slices = [slice(int(np.searchsorted(part, np.uint64(low))), int(np.searchsorted(part, np.uint64(high - 1), "right"))) for part in parts]
    back = judge(np.concatenate([part[x] for part, x in zip(parts, slices)]), np.concatenate([extra[x] for extra, x in zip(extras, slices)]))
    chosen, at = [], 0
    for part, x in zip(parts, slices):
        n = x.stop - x.start
        chosen.append(part[x][back[at:at + n]])
        at += n
    return chosen


def _sort_bin(key, table: pa.Table) -> pa.Table:
    """The keys of all blocks in one bin, sorted range by range: which of them concern their block."""
    judge = {1: _repeated, 2: _earlier_elsewhere, 3: _several, 4: _earlier_elsewhere}[key[0].as_py()]
    parts = [unsqueeze(b, True) for b in table.column("keys").to_pylist()]
    extras = [unsqueeze(b) for b in table.column("extra").to_pylist()]
    first, last = int(min(part[0] for part in parts)), int(max(part[-1] for part in parts)) + 1
    ranges = 1 + sum(map(len, parts)) // SORTED
    borders = [first + (last - first) * i // ranges for i in range(ranges + 1)]
    found: list[list[np.ndarray]] = [[] for _ in parts]
    for low, high in zip(borders, borders[1:]):
        if low < high:
            for own, chosen in zip(found, _judged(judge, parts, extras, low, high)):
                own.append(chosen)
    blocks, lists = [], []
    for block, chosen in zip(table.column("block").to_pylist(), found):
        keys = np.concatenate(chosen)
        if len(keys):
            blocks.append(block)
            lists.append(squeeze(keys, True))
    return _table({"step": [key[0].as_py()] * len(blocks), "block": blocks, "keys": lists}, ANSWER)


def _sorted_names(sent: DataFrame) -> DataFrame:
    return sent.groupBy("step", "bin").applyInArrow(per_group(_sort_bin), ANSWER)


def _send_names(batches, text: str, length: int, bits: int):
    """Step 1: the distinct names of each block's synchronising positions, and whether one stands at several places."""
    found: dict[int, list[np.ndarray]] = {}
    for part, data, offsets in text_groups(batches, text):
        blocks = np.array(part.column("block"))
        for _, sync in stretches(data, offsets, length):
            own = sync.names[sync.at]
            of = blocks[sync.text]
            for block in np.unique(of).tolist():
                found.setdefault(block, []).append(own[of == block] if of[0] != of[-1] else own)
    for block in list(found):
        keys = np.concatenate(found.pop(block))
        keys.sort()
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        starts = np.flatnonzero(fresh)
        yield from _deal(1, block, keys[starts], np.minimum(np.diff(np.append(starts, len(keys))), 2).astype(np.uint64), bits).to_batches()


def _repeated(keys: np.ndarray, many: np.ndarray) -> np.ndarray:
    order, starts, run = count_sorted(keys)
    back = np.zeros(len(keys), bool)
    back[order] = np.add.reduceat(many[order], starts)[run] > 1
    return back


def _earlier_elsewhere(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Entries whose key another block has with a smaller id."""
    ids = ids.view(np.int64)
    order = np.lexsort((ids, keys))
    sorted_keys, sorted_ids = keys[order], ids[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = sorted_keys[1:] != sorted_keys[:-1]
    back = np.zeros(len(keys), bool)
    back[order] = sorted_ids > sorted_ids[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    return back


def _several(keys: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Names that have more than one surrounding, within a block or over blocks."""
    order, starts, run = count_sorted(keys)
    low, high = (f.reduceat(around[order], starts) for f in (np.minimum, np.maximum))
    back = np.zeros(len(keys), bool)
    back[order] = ((low != high) | (low == SEVERAL))[run]
    return back


def _ids(table: pa.Table, row_id: str) -> np.ndarray:
    return table.column(row_id).fill_null(LAST_ID).to_numpy().astype(np.int64)


def _least(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the smallest id of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(fresh)
    return keys[starts], np.minimum.reduceat(ids[order], starts) if len(starts) else np.zeros(0, np.int64)


def _cat(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


class Block:
    """The synchronising positions of a block's texts whose name is repeated: name, surroundings, text (row of the block) and windows."""

    def __init__(self, table: pa.Table, repeated: np.ndarray, several: np.ndarray | None, elsewhere: np.ndarray | None, text: str,
                 row_id: str, length: int):
        ids = _ids(table, row_id)
        name, around, rows, first, count, detailed, keys = [], [], [], [], [], [], []
        row = 0
        for part, data, offsets in text_groups(table.to_batches(), text):
            for shift, sync in stretches(data, offsets, length):
                sync.keep(is_in(sync.names[sync.at], repeated))
                name.append(sync.names[sync.at])
                around.append(sync.surroundings())
                rows.append((sync.text + row).astype(np.int32))
                first.append(sync.first - sync.offsets[sync.text] + shift)
                count.append(sync.count.astype(np.int32))
                if several is not None:
                    detailed.append(is_in(name[-1], several) & ~is_in(around[-1], elsewhere))
                    keys.append(sync.windows(np.flatnonzero(detailed[-1]))[1])
            row += part.num_rows
        self.name, self.around = _cat(name, np.uint64), _cat(around, np.uint64)
        self.row, self.first, self.count = _cat(rows, np.int32), _cat(first, np.int64), _cat(count, np.int32)
        self.id = ids[self.row]
        self.detailed = _cat(detailed, bool)  # positions whose windows are named one by one
        self.keys = _cat(keys, np.uint64)  # names of the windows of these

    def settled(self, elsewhere: np.ndarray) -> np.ndarray:
        """Positions whose surroundings an earlier document has."""
        keys, least = _least(self.around, self.id)
        return is_in(self.around, elsewhere) | (self.id > least[np.searchsorted(keys, self.around)]) if len(keys) else np.zeros(0, bool)

    def open_windows(self, settled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position (an index) and name of every window of the detailed positions that are not settled."""
        of = np.repeat(np.flatnonzero(self.detailed).astype(np.int32), self.count[self.detailed])
        left = ~settled[of]
        return of[left], self.keys[left]


def _answers(answers: pa.Table) -> list[np.ndarray]:
    """The keys of each step that concern a block, sorted."""
    keys: list[list[np.ndarray]] = [[], [], [], []]
    for step, data in zip(answers.column("step").to_pylist(), answers.column("keys").to_pylist()):
        keys[step - 1].append(unsqueeze(data, True))
    return [np.sort(_cat(parts, np.uint64)) for parts in keys]


def _send_surroundings(key, table: pa.Table, answers: pa.Table, length: int, bits: int, text: str, row_id: str) -> pa.Table:
    """Step 2: surroundings with their smallest id; step 3: names with their only surrounding (or SEVERAL)."""
    if not table.num_rows:
        return _table({"step": [], "bin": [], "block": [], "keys": [], "extra": []}, SENT)
    block, number = Block(table, _answers(answers)[0], None, None, text, row_id, length), key[0].as_py()
    around, least = _least(block.around, block.id)
    order, starts, _ = count_sorted(block.name)
    low, high = (f.reduceat(block.around[order], starts) if len(starts) else np.zeros(0, np.uint64) for f in (np.minimum, np.maximum))
    return pa.concat_tables([_deal(2, number, around, least, bits), _deal(3, number, block.name[order][starts], np.where(low == high, low, SEVERAL), bits)])


def _send_windows(key, table: pa.Table, answers: pa.Table, length: int, bits: int, text: str, row_id: str) -> pa.Table:
    """Step 4: names of the windows that are still open, with their smallest id."""
    if not table.num_rows:
        return _table({"step": [], "bin": [], "block": [], "keys": [], "extra": []}, SENT)
    repeated, elsewhere, several, _ = _answers(answers)
    block = Block(table, repeated, several, elsewhere, text, row_id, length)
    of, keys = block.open_windows(block.settled(elsewhere))
    return _deal(4, key[0].as_py(), *_least(keys, block.id[of]), bits)


def _remove(key, table: pa.Table, answers: pa.Table, length: int, text: str, row_id: str, kept_names: list[str], schema: pa.Schema) -> pa.Table:
    """Every row of a block with its counts, removed spans and kept bytes."""
    if not table.num_rows:
        return schema.empty_table()
    repeated, elsewhere, several, windows = _answers(answers)
    block = Block(table, repeated, several, elsewhere, text, row_id, length)
    settled = block.settled(elsewhere)
    of, keys = block.open_windows(settled)
    distinct, least = _least(keys, block.id[of])
    gone = is_in(keys, windows)
    if len(keys):
        gone |= block.id[of] > least[np.searchsorted(distinct, keys)]
    nth = np.arange(len(of)) - np.searchsorted(of, of)  # windows of a position are neighbours, in order
    rows, begins = np.concatenate([block.row[settled], block.row[of[gone]]]), np.concatenate([block.first[settled], (block.first[of] + nth)[gone]])
    ends = begins + length
    ends[:int(settled.sum())] += block.count[settled] - 1
    del of, keys, nth, distinct, least
    order = np.argsort(rows, kind="stable")
    rows, begins, ends = rows[order], begins[order], ends[order]
    n_bytes, n_removed, span_starts, span_ends, n_spans, kept, row = [], [], [], [], [], [], 0
    for part, data, offsets in text_groups(table.to_batches(), text):
        a, b = np.searchsorted(rows, [row, row + part.num_rows])
        local = offsets[rows[a:b] - row]
        flips = np.zeros(len(data) + 1, np.int32)
        np.add.at(flips, local + begins[a:b], 1)
        np.add.at(flips, local + ends[a:b], -1)
        covered = np.cumsum(flips[:-1]) > 0
        edges = covered.copy()
        edges[1:] &= ~covered[:-1]
        borders = offsets[(offsets > 0) & (offsets < len(data))]
        edges[borders] = covered[borders]
        opened = np.flatnonzero(edges)
        edges = covered.copy()
        edges[:-1] &= ~covered[1:]
        edges[borders - 1] = covered[borders - 1]
        closed = np.flatnonzero(edges) + 1
        total = np.concatenate([[0], np.cumsum(covered)])
        n_bytes.append(np.diff(offsets))
        n_removed.append(np.diff(total[offsets]))
        of = np.searchsorted(offsets, opened, "right") - 1
        span_starts.append(opened - offsets[of])
        span_ends.append(closed - offsets[of])
        n_spans.append(np.bincount(of, minlength=part.num_rows))
        left = offsets - total[offsets]
        kept.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(left.astype(np.int64)),
                                                     pa.py_buffer(np.append(data[~covered], np.uint8(0)))]).cast(pa.binary()))
        row += part.num_rows
    kind = schema.field("removed").type
    edges = pa.StructArray.from_arrays([_cat(span_starts, np.int64), _cat(span_ends, np.int64)], fields=[kind.value_type.field(0), kind.value_type.field(1)])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(_cat(n_spans, np.int64))]).astype(np.int32)), edges).cast(kind)
    return pa.Table.from_arrays([*(table.column(c) for c in kept_names), pa.array(_cat(n_bytes, np.int64)), pa.array(_cat(n_removed, np.int64)),
                                 lists, pa.chunked_array(kept)], schema=schema)


def remove_repeated_bytes(docs: DataFrame, text: str = "text", row_id: str = "doc_id", length: int = LENGTH,
                          keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``n_bytes``, ``n_removed``, ``removed`` and ``kept_bytes``.

    A byte goes if a string of ``length`` bytes (SHORTEST or more) that covers
    it also starts in a document with a smaller id.  ``removed`` lists the
    maximal removed spans [start, end) in bytes; ``kept_bytes`` is what is left,
    in order, and need not be whole characters.  Strings are judged on the
    input and do not cross documents.

    Null and empty texts have no bytes.  A null id counts as the largest; rows
    of the same id do not remove anything from each other, and repeats within
    one row stay.  Long texts are named in overlapping parts.  An empty table gives an
    empty result.  Columns of ``docs`` with the names above, or named block, are
    replaced or left out.
    """
    if length < SHORTEST:
        raise ValueError(f"length must be {SHORTEST} or more")
    made = ["n_bytes", "n_removed", "removed", "kept_bytes"]
    kept_names = [c for c in (docs.columns if keep is None else keep) if c not in [*made, "block"]]
    given = docs.select(*dict.fromkeys([*kept_names, row_id, text])).withColumn(text, F.col(text).cast("string")).withColumn(row_id, F.col(row_id).cast("long"))
    parts = parts_of(given, BLOCK_INPUT)
    blocks = stage_blocks(given, parts)
    options = {"length": length, "text": text, "row_id": row_id}
    bits = bin_bits(-(-blocks.select("block").distinct().count() // parts))
    rows = blocks.select("block", row_id, text)
    ask = lambda fn, known: rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(per_pair(fn, bits=bits, **options), SENT)
    known = stage(_sorted_names(blocks.select("block", text).mapInArrow(per_batches(_send_names, text=text, length=length, bits=bits), SENT)))
    known = known.unionByName(stage(_sorted_names(ask(_send_surroundings, known))))
    known = known.unionByName(_sorted_names(ask(_send_windows, known)))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*(blocks.schema[c] for c in kept_names), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("removed", span), T.StructField("kept_bytes", T.BinaryType())])
    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        per_pair(_remove, kept_names=kept_names, schema=to_arrow_schema(schema), **options), schema)


SQL = r"""
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
grams AS (
  SELECT coalesce(doc_id, 9223372036854775807) AS id, doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS g
  FROM texts, unnest(range(0, strlen(h) // 2 - 49)) AS r(i)),
first AS (SELECT g, min(id) AS first_id FROM grams GROUP BY g HAVING min(id) < max(id)),
again AS (SELECT doc_id, i FROM grams JOIN first USING (g) WHERE first_id < id),
runs AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT doc_id, i, (i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -99) + 50)::INT AS fresh FROM again)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS nth FROM runs GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans),
kept AS (
  SELECT d.doc_id, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS h,
    sum(b - a) AS n_removed, count(*) AS n_spans
  FROM gaps JOIN texts d USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, (strlen(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM texts d LEFT JOIN kept k USING (doc_id)
"""
