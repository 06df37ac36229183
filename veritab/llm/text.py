"""Words and hashes of many texts at once, on numpy views of Arrow columns.

A word is a maximal run of bytes other than the six ASCII white-space bytes. Hashes are
polynomials modulo 2^64 over bytes or over word hashes, taken from running sums, so that the hash
of any stretch costs two lookups. Work goes slice by slice, which bounds memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 * 0xD1342543DE82EF95 % 2**64 | 1
_WORD_BASE = 0xDA942042E4DD58B5


@lru_cache(maxsize=4)
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, 2^bits of each."""
    out = []
    for b in (base, pow(base, -1, 2**64)):
        steps = np.full(1 << bits, b, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of stretches [start, end) of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, base: int = _WORD_BASE):
        bits = max(16, int(len(values)).bit_length())
        self.up, self.down = _powers(base, bits)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=self.sums[1:], dtype=np.uint64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column in one array, and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(table: pa.Table, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.Table]:
    """Consecutive rows of at most `limit` bytes of text, or one longer row."""
    _, offsets = raw(table.column(column))
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), n)
        yield table.slice(start, end - start)
        start = end


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


class Words:
    """Words of the rows of a text column: byte spans, row of each word, first word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE):
        word = ~breaks[data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        first[heads] |= word[heads]
        tails = offsets[1:][offsets[1:] > 0] - 1
        last[tails] |= word[tails]
        self.data = data
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.bounds = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return Rolling(self.data.astype(np.uint64) + np.uint64(1), _BASE).of(self.start, self.end)

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every `size` consecutive words of one row."""
        at = np.arange(max(0, len(self) - size + 1))
        at = at[self.row[at] == self.row[at + size - 1]]
        return at, Rolling(hashes).of(at, at + size)


def words_of(column: pa.Array | pa.ChunkedArray, lowered: bool = False) -> Words:
    data, offsets = raw(column)
    return Words(lower(data) if lowered else data, offsets)


def cover(starts: np.ndarray, size: int, total: int) -> np.ndarray:
    """Which of `total` places lie in some [start, start + size)."""
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + size, total), -1)
    return np.cumsum(change[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true places."""
    edge = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class WordHashes:
    """Word hashes of all rows of a chunk, made slice by slice; `bounds[i]` is the first word of row i."""

    def __init__(self, table: pa.Table, lowered: bool = False):
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for part in slices(table):
            words = words_of(part.column("text"), lowered)
            hashes.append(words.hashes())
            counts.append(np.diff(words.bounds))
        self.hashes = np.concatenate(hashes)
        self.counts = np.concatenate(counts)
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)])
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)
        self.rolling = Rolling(self.hashes)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every `size` consecutive words of one row."""
        at = np.arange(max(0, len(self.hashes) - size + 1))
        at = at[self.row[at] == self.row[at + size - 1]]
        return at, self.rolling.of(at, at + size)
