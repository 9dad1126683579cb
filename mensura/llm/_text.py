"""Vectorised byte-level text handling on Arrow string columns.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, which equals the
pattern ``[^\\x20\\x09-\\x0D]+`` because UTF-8 continuation bytes are all above
0x7F. Everything works on slices of a bounded number of bytes; a single longer
text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with good avalanche (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class Slice:
    """Some rows' texts as one byte array: ``data`` and ``offsets`` (rows + 1); ``rows`` is the range of the batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: slice):
        self.data, self.offsets, self.rows = data, offsets, rows

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and for each row the index of its first word (rows + 1)."""
        data = self.data if data is None else data
        inside = WORD[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.offsets] = True
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of an Arrow string column, nulls as empty, in slices of about ``most`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    _, at, values = column.buffers()
    offsets = np.frombuffer(at, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(max(end, row + 1), n)
        yield Slice(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], slice(row, end))
        row = end


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded.data, 0, (1,))
    left = ends - starts
    out = mix(left.astype(np.uint64) * _M3 + _M3)
    at, which = starts, None
    while len(at):
        part = eight[at] & _MASK[np.minimum(left, 8)]
        if which is None:
            out = mix(out ^ (part * _M3))
        else:
            out[which] = mix(out[which] ^ (part * _M3))
        more = np.flatnonzero(left > 8)
        which = more if which is None else which[more]
        at, left = at[more] + 8, left[more] - 8
    return out


def bare(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words without the bytes of ``edge`` on either side; a word of such bytes only is left empty."""
    solid = np.flatnonzero(~edge[data])
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = high > low
    if not len(solid):
        return starts.copy(), starts.copy()
    last = len(solid) - 1
    begin = np.where(some, solid[np.minimum(low, last)], starts)
    return begin, np.where(some, solid[np.maximum(high - 1, 0)] + 1, starts)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles of each row and for each row the index of its first one (rows + 1).

    A row with fewer words, but at least one, has its whole sequence as one shingle.
    """
    counts = np.diff(first)
    rows = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(rows)])
    # a shingle's first word: its place among the row's shingles, counted from the row's first word
    place = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], rows)
    room = np.repeat(first[1:], rows)
    out = np.zeros(at[-1], np.uint64)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    for k in range(size):
        term = mix(padded[place + k] + np.uint64((k + 1) * int(_M3) % 2**64))
        short = place + k >= room
        if short.any():
            term[short] = np.uint64(0)
        out = out * _M2 + term
    return mix(out), at
