"""Words of whole text columns as numpy arrays, without a Python step per word.

A batch is cut into pieces of a few megabytes, so memory follows the longest text, not the batch. Null texts have
no words. Hashes have 64 bits and take in every byte of a word, mixed before it is added up: two different words, or
windows of words, share one with a chance near 2**-60, also if they are long or have a pattern.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# [^\x20\x09-\x0D]: in UTF-8 every byte of any other character is another byte
BLANK_SEPARATED = np.ones(256, dtype=bool)
BLANK_SEPARATED[[0x20, *range(0x09, 0x0E)]] = False
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_STEP = np.uint64(0x9E3779B97F4A7C15)
_Q = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finisher of splitmix64)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# the lowest bytes of a number
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range, none of them empty: eight bytes at a time, each mixed with its place, and the length."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    size = end - begin
    chunks = (size + 7) >> 3
    start = np.cumsum(chunks) - chunks
    place = np.arange(start[-1] + chunks[-1]) - np.repeat(start, chunks)
    done = 8 * place
    left = np.minimum(np.repeat(size, chunks) - done, 8)
    done += np.repeat(begin, chunks)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    value = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))[done] & _LOWEST[left]
    value ^= mix((place + 1).astype(np.uint64) * _STEP)
    return mix(np.add.reduceat(mix(value), start) + size.astype(np.uint64) * _STEP)


class Words:
    """Words of consecutive texts: `hash`, byte range `begin` to `end` in `data`, and texts as ranges `first`."""

    def __init__(self, data, begin, end, hashes, first):
        self.data, self.begin, self.end, self.hash, self.first = data, begin, end, hashes, first

    def __len__(self):
        return len(self.hash)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def full(self, k: int) -> np.ndarray:
        """Positions at which a window of k words of one text starts."""
        n = len(self)
        left = np.repeat(self.first[1:], self.counts) - np.arange(n)
        return np.flatnonzero(left >= k)

    def texts(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[b:e] for b, e in zip(self.begin.tolist(), self.end.tolist(), strict=True)]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and text offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split(column: pa.Array, lower: bool = False, kept: np.ndarray = BLANK_SEPARATED) -> Words:
    """Words of every text: longest runs of `kept` bytes, A-Z lower-cased first if `lower`."""
    data, offsets = raw(column)
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = kept[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    after = np.ones(n, dtype=bool)
    after[1:] = ~inside[:-1] | cut[1:n]
    begin = np.flatnonzero(inside & after)
    before = np.ones(n, dtype=bool)
    before[:-1] = ~inside[1:] | cut[1:n]
    end = np.flatnonzero(inside & before) + 1
    first = np.searchsorted(begin, offsets)
    return Words(data, begin, end, hashes(data, begin, end), first)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive hashes, in order; built by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, cur, size = None, 0, h, 1
    while True:
        if k & size:
            if out is None:
                out = cur
            else:
                shifted = cur[have:]
                out = out[: len(shifted)] * np.uint64(pow(_Q, size, 1 << 64)) + shifted[: len(out)]
            have += size
        if have == k:
            return mix(out[:n] + np.uint64(k))
        cur = cur[:-size] * np.uint64(pow(_Q, size, 1 << 64)) + cur[size:]
        size *= 2


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values; built by doubling."""
    cur, size = x, 1
    while 2 * size <= w:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    n = len(x) - w + 1
    return np.minimum(cur[:n], cur[w - size : w - size + n])


def joined(words: Words, kept: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Each text's kept words (a mask over all words) with one space between them."""
    data = words.data.copy()
    text = words.text_of[kept]
    begin, end = words.begin[kept], words.end[kept]
    follows = np.zeros(len(text), bool)
    follows[:-1] = text[1:] == text[:-1]
    # a word that another follows in its text has a blank behind it
    data[end[follows]] = 0x20
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end + follows, -1)
    mask = np.cumsum(edge[:-1]) > 0
    sums = np.concatenate([[0], np.cumsum(mask)])
    out = pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(sums[offsets].astype(np.int64)), pa.py_buffer(data[mask])
    )
    return out.cast(pa.string())


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch whose texts have about `limit` bytes."""
    if not batch.num_rows:
        return
    sizes = np.diff(raw(batch.column(column))[1])
    total, start = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            total, start = 0, i
        total += size
    yield batch.slice(start)
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)
