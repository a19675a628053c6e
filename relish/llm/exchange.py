"""Exchange of 64-bit keys between the blocks of a table.

Every block sends its distinct keys, packed and dealt into bins by their upper
bits; a bin task compares the keys of all blocks and answers each block with
the keys that concern it.  However often a key occurs, a block sends it once,
so the most frequent key costs a bin no more entries than there are blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from relish.llm.arrow import joined, packed, per_group

SENT = "bin int, block int, keys binary, extra binary"
ANSWER = "block int, keys binary, extra binary"


def bin_bits(blocks: int) -> int:
    """Upper bits that name a bin: about as many bins as blocks."""
    return max(0, min(16, (max(1, blocks) - 1).bit_length()))


def deal(block: int, keys: np.ndarray, bits: int, extra: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of a block's keys (sorted, distinct), one per bin that has any; ``extra`` has one value per key."""
    bins = (keys >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)
    found, starts = np.unique(bins, return_index=True)
    ends = np.append(starts[1:], len(keys))
    return pa.RecordBatch.from_arrays(
        [pa.array(found, pa.int32()), pa.array(np.full(len(found), block, np.int32)),
         pa.array([packed(keys[a:b]) for a, b in zip(starts, ends)], pa.binary()),
         pa.array([packed(extra[a:b]) if extra is not None else b"" for a, b in zip(starts, ends)], pa.binary())],
        ["bin", "block", "keys", "extra"])


def keys_of(table: pa.Table) -> np.ndarray:
    """All keys in the answers to a block, sorted."""
    return np.sort(joined(table.column("keys"), np.uint64))


def is_in(values: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_keys, values)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == values


def answer(sent: DataFrame, fn, extra_type=None) -> DataFrame:
    """``fn(keys, extra, block)`` per bin gives which entries go back to their block (and their new extra values, or None)."""

    def run(key, table, fn=fn, extra_type=extra_type):
        blobs = table.column("keys").to_pylist()
        sizes = np.array([len(b) // 8 for b in blobs], np.int64)
        keys = np.concatenate([np.frombuffer(b, np.uint64) for b in blobs]) if blobs else np.zeros(0, np.uint64)
        block = np.repeat(np.array(table.column("block")), sizes)
        extra = joined(table.column("extra"), extra_type) if extra_type is not None else None
        back, values = fn(keys, extra, block)
        order = np.flatnonzero(back)
        order = order[np.argsort(block[order], kind="stable")]
        found, starts = np.unique(block[order], return_index=True)
        ends = np.append(starts[1:], len(order))
        return pa.table({
            "block": pa.array(found, pa.int32()),
            "keys": pa.array([packed(keys[order[a:b]]) for a, b in zip(starts, ends)], pa.binary()),
            "extra": pa.array([packed(values[order[a:b]]) if values is not None else b"" for a, b in zip(starts, ends)], pa.binary())})

    return sent.groupBy("bin").applyInArrow(per_group(run), ANSWER)


def count_sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts the keys, the start of each run of equal keys in it, and the run of each entry in it."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return order, np.flatnonzero(fresh), np.cumsum(fresh) - 1
