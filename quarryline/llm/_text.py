"""Vectorised text primitives over Arrow string arrays: UTF-8 bytes, words, hashes, windows.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. All separators are ASCII, so bytes and code points agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64
_K1, _K2, _K3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=object).astype(np.uint64)
STEP_BYTES = 4 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> _U(30))) * _K2
    h = (h ^ (h >> _U(27))) * _K3
    return h ^ (h >> _U(31))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about `most` bytes at most, one row at least: bounds a worker's memory."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        total = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        at = 0
        while at < n:
            before = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of all texts end to end; a null text is empty. offsets has one entry more than there are rows."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    offs = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offs[0] : offs[-1]] if buffers[2] is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~SEPARATOR[data]
    first = np.zeros(len(data), bool)
    first[offs[:-1][offs[:-1] < len(data)]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:]
    ends = inside
    ends[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; equal ranges have equal hashes, whatever stands around them."""
    import xxhash

    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    n = end - start
    h = mix(n.astype(np.uint64) * _K1 ^ (eight[start] & _MASK[np.minimum(n, 8)]))
    at, longer = 8, np.flatnonzero(n > 8)
    while len(longer):
        if at == 128:  # few are as long
            for i in longer:
                h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
            break
        rest = n[longer] - at
        h[longer] = mix((h[longer] * _K1) ^ (eight[start[longer] + at] & _MASK[np.minimum(rest, 8)]))
        at, longer = at + 8, longer[rest > 8]
    return h


def windows(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of k words of one row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = mix(total * _K1 + h[j : j + n])
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return at, total[at]


def per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of flags between offsets."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... start+len-1 of every range, end to end."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = starts - np.concatenate([[0], np.cumsum(lens[:-1])])
    return np.repeat(shift, lens) + np.arange(total)
