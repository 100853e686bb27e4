"""Vectorised work on blocks of texts: byte buffers, words, and rolling hashes in wrapping 64-bit arithmetic.

A block holds the UTF-8 bytes of several whole texts and their offsets. A text longer than the target makes a block
of its own, so nothing is cut. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes worked on at once; a worker's memory is some tens of times this.
BLOCK_BYTES = 1 << 20

#: ASCII white space: space and \x09-\x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def column_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; nulls are empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = pc.fill_null(column.cast(pa.large_string()), "")
    else:
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def text_blocks(batches: Iterable[pa.RecordBatch], column: str,
                target: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes and offsets of their texts, about target bytes each."""
    for batch in batches:
        data, offsets = column_buffers(batch.column(batch.schema.get_field_index(column)))
        start, n = 0, batch.num_rows
        while start < n:
            end = int(np.searchsorted(offsets, offsets[start] + target, "right")) - 1
            end = min(max(end, start + 1), n)
            yield batch.slice(start, end - start), data[offsets[start]:offsets[end]], offsets[start:end + 1] - offsets[start]
            start = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words [^\\x20\\x09-\\x0D]+, and per text the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, solid[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    before[firsts] = False
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, solid[1:]
    after[firsts[firsts > 0] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**64, 256, dtype=np.uint64)


#: Two independent families: random values of the bytes, and an odd multiplier with its inverse mod 2^64.
_FAMILIES = [(_table(s), m, pow(m, -1, 2**64)) for s, m in ((11, 0x9E3779B97F4A7C15), (29, 0xD6E8FEB86659FD93))]


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16), base, np.uint64)
        full[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[base] = np.cumprod(full, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes give equal hashes wherever they stand."""
    table, base, inverse = _FAMILIES[family]
    prefix = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(table[data] * _power(base, len(data)), out=prefix[1:])
        return mix((prefix[ends] - prefix[starts]) * _power(inverse, len(data) + 1)[starts])


def run_hashes(values: np.ndarray, length: int, family: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of so many consecutive values (len(values) - length + 1 of them)."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, base, inverse = _FAMILIES[family]
    prefix = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * _power(base, len(values)), out=prefix[1:])
        return mix((prefix[length:] - prefix[:n]) * _power(inverse, n))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of the spans (start, length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
