"""Word and window hashes of whole text columns, as array operations without a step per word.

A text is UTF-8 bytes. A word's hash comes from prefix sums of byte * BASE^place in wrapping 64-bit arithmetic, divided
by BASE^start (BASE is odd, so it has an inverse) and mixed; a window's from prefix sums over word hashes likewise.
Words are runs between separator bytes and never cross two texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Bytes that end a word: ASCII white space, and everything in ASCII that is no letter or digit.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[np.r_[48:58, 65:91, 97:123, 128:256]] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 20

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1), wrapping."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, CHUNK + 4096), base, U)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= 4 * CHUNK:
            _powers[base] = known
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit over the word."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for each pair."""
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    inverse = powers(pow(base, -1, 2**64), len(values) + 1)
    length = (ends - starts).astype(U)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + length * U(0x632BE59BD9B4E019))


class Words:
    """The words of some texts: ``start`` and ``end`` are byte places in ``data``; ``first[i]:first[i+1]`` are text i's."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, fold: bool):
        self.data = FOLD[data] if fold else data
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~separators[data]
        # a border between texts also ends a word
        begins = inside[1:-1] & ~inside[:-2]
        border = offsets[1:-1]
        border = border[border < len(data)]
        begins[border] = inside[1:-1][border]
        self.start = np.flatnonzero(begins)
        stops = inside[1:-1] & ~inside[2:]
        last = border[border > 0] - 1
        stops[last] = inside[1:-1][last]
        self.end = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)

    def hashes(self, which: int = 0) -> np.ndarray:
        return spans_hash(self.data.astype(U) + U(1), self.start, self.end, BASES[which])

    def prefix_hashes(self, size: int) -> np.ndarray:
        """Hash of each word's first ``size`` bytes."""
        return spans_hash(self.data.astype(U) + U(1), self.start, np.minimum(self.end, self.start + size), BASES[0])


def windows(hashes: np.ndarray, first: np.ndarray, size: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``size`` words inside one text, and the place of its first word."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    starts = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return spans_hash(hashes, starts, starts + size, BASES[which]), starts


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows with some ``limit`` bytes; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, places, body = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        stop = min(stop, len(column))
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop
