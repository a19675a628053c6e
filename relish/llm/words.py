"""Words, word hashes and n-gram hashes of whole batches of texts, in numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D, which in UTF-8
is the same as a maximal run of such characters.  All functions work on the
concatenated bytes of many texts at once, so there is no Python step per word.
Hashes have 64 bits, depend only on the bytes of a word (or the words of an
n-gram) and are the same in every task and every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # texts are handled in groups of about this many bytes; one longer text makes its own group
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _powers:
        if size > 4 * CHUNK_BYTES:
            return _make_powers(size)
        _powers.clear()
        _powers[size] = _make_powers(size)
    return _powers[size]


def _make_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        a = np.full(size, base, np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def _range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for every range."""
    up, down = _power_table(max(1, len(values)))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """Words of some texts: word w of text i has index first[i] + w."""

    data: np.ndarray  # bytes of all texts
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # index of each text's first word; one longer than the texts

    def hashes(self) -> np.ndarray:
        return _range_hashes(_BYTE_VALUE[self.data], self.starts, self.ends)

    def word(self, w: int) -> bytes:
        return self.data[self.starts[w]:self.ends[w]].tobytes()


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]]."""
    inside = ~SPACE[data]
    opened = inside.copy()
    opened[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    opened[edges] = inside[edges]
    closed = inside.copy()
    closed[:-1] &= ~inside[1:]
    closed[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(opened)
    return Words(data, starts, np.flatnonzero(closed) + 1, np.searchsorted(starts, offsets))


def gram_hashes(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words of one text and the index of each run's first word."""
    count = np.diff(first)
    at = np.arange(len(hashes))
    last = np.repeat(first[1:], count) - n
    at = at[at <= last]
    return _range_hashes(hashes, at, at + n), at


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offset of each row; null counts as empty."""
    column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(batches, text: str = "text", lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Cut record batches into groups of whole rows of about ``limit`` text bytes and find their words."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        data, offsets = text_bytes(column)
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
            part = data[offsets[row]:offsets[end]]
            yield batch.slice(row, end - row), find_words(LOWER[part] if lower else part, offsets[row:end + 1] - offsets[row])
            row = end
