"""Whole Arrow columns of texts as one byte array: words, word hashes and n-gram hashes in numpy.

Every function works on all texts of a slice at once, so the cost per document is a few
array operations rather than a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP, _BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_HASH_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Word bytes: digits, ASCII letters and all bytes of non-ASCII characters.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, from 0 to n - 1."""
    up, down = np.full(n, _STEP, np.uint64), np.full(n, _BACK, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values in order; one sort, which is many times as fast here as hashing them."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def strings(column: pa.Array) -> pa.Array:
    """A plain UTF-8 column without nulls (null: empty)."""
    if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its texts (one more than texts)."""
    column = strings(column)
    n = len(column)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``size`` bytes; one row at least."""
    if not batch.num_rows:
        return
    _, at = flat(batch.column(batch.schema.get_field_index(column)))
    row, n = 0, batch.num_rows
    while row < n:
        end = min(n, max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1))
        yield batch.slice(row, end - row)
        row = end


def spans_of(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True, cut at the texts' bounds."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.empty(n, bool)
    first[0] = mask[0]
    np.logical_and(mask[1:], ~mask[:-1], out=first[1:])
    inner = at[1:-1]
    inner = inner[inner < n]
    first[inner] = mask[inner]
    last = np.empty(n, bool)
    last[-1] = mask[-1]
    np.logical_and(mask[:-1], ~mask[1:], out=last[:-1])
    ends = inner[inner > 0] - 1
    last[ends] = mask[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; spans ascend and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + _HASH_BYTES, "right")))
        part = raw[low : ends[j - 1]]
        up, down = powers(max(_HASH_BYTES, 1 << (len(part) - 1).bit_length()) if len(part) else 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=total[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (total[b] - total[a]) * down[np.minimum(a, len(down) - 1)]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


class Words:
    """Words of a slice: hashes, byte spans and, for each text, the range of its words."""

    def __init__(self, column: pa.Array):
        raw, at = flat(column)
        self.raw, self.at = raw, at
        self.starts, self.ends = spans_of(_WORD[raw], at)
        self.hash = hash_spans(_LOWER[raw], self.starts, self.ends)
        #: first[i] to first[i + 1]: the words of text i
        self.first = np.searchsorted(self.starts, at)
        self.n = len(at) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def byte_starts(self) -> np.ndarray:
        """Start of each word counted from its own text."""
        return self.starts - self.at[self.text_of()]

    def byte_ends(self) -> np.ndarray:
        return self.ends - self.at[self.text_of()]


def window_hash(word: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive words, for all starts (texts aren't told apart)."""
    n = len(word) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += word[k : k + n]
    return mix(out)


def window_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows that lie within one text, and the number of them in each text."""
    counts = np.diff(first)
    per = np.maximum(counts - size + 1, 0)
    base = np.repeat(first[:-1], per)
    lead = np.concatenate(([0], np.cumsum(per)))
    return base + np.arange(lead[-1]) - np.repeat(lead[:-1], per), per


def binaries(parts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column: consecutive pieces of ``parts`` with these lengths in items."""
    data = np.ascontiguousarray(parts)
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64) * data.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())
