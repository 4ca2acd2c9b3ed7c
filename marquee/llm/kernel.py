"""Vectorised text kernel: words, shingles and window hashes straight from Arrow buffers.

Texts are cut into words and hashed with NumPy over the UTF-8 bytes of a whole slice of rows, so no
Python code runs per word. Null texts count as empty. Hashes are a pure function of the words, hence
equal in every task and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Items hashed at once.
CHUNK = 1 << 16

_U = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers that spreads all bits."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


#: Separators of `[^\x20\x09-\x0D]+`.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`; A-Z must be lower-cased before.
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Poly:
    """Polynomial prefix hash modulo 2**64 with random byte values: the hash of any range is one subtraction and one product."""

    def __init__(self, seed: int) -> None:
        r = splitmix(np.arange(260, dtype=np.uint64) + _U(seed * 1000))
        self.values, base = r[:256], int(r[256]) | 5
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self._up = self._down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            up, down = np.full(n, self.base, dtype=np.uint64), np.full(n, self.inverse, dtype=np.uint64)
            up[0] = down[0] = 1
            with np.errstate(over="ignore"):
                self._up, self._down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self._up[:n], self._down[:n]

    def ranges(self, items: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        """Hashes of items[start:end] for ascending starts; items are 64-bit values, or places of them in table.

        Done in chunks that fit in a core's cache; a hash doesn't depend on where its chunk begins.
        """
        out, done = np.empty(len(start), dtype=np.uint64), 0
        while done < len(start):
            low = start[done]
            stop = max(done + 1, int(np.searchsorted(start, low + CHUNK)))
            high = end[done:stop].max()
            part = items[low:high] if table is None else table[items[low:high]]
            up, down = self._powers(max(CHUNK + 64, len(part) + 1))
            with np.errstate(over="ignore"):
                prefix = np.zeros(len(part) + 1, dtype=np.uint64)
                np.cumsum(part * up[: len(part)], out=prefix[1:])
                s, e = start[done:stop] - low, end[done:stop] - low
                out[done:stop] = splitmix((prefix[e] - prefix[s]) * down[s] + (e - s).astype(np.uint64))
            done = stop
        return out


_BYTES, _BYTES2, _WORDS, _WORDS2 = Poly(1), Poly(2), Poly(3), Poly(4)


def hash_order(x: np.ndarray) -> np.ndarray:
    """Indices that sort 64-bit hashes: by their high bits first, which nearly always decide, and by all bits where they don't."""
    low = np.uint64((1 << max(1, (len(x) - 1).bit_length())) - 1)
    order = (np.sort(x & ~low | np.arange(len(x), dtype=np.uint64)) & low).astype(np.int64)
    return order if (x[order][1:] >= x[order][:-1]).all() else np.argsort(x, kind="stable")


def key_order(key: np.ndarray) -> np.ndarray:
    """Indices that sort small non-negative integers, equal ones in their order."""
    bits = np.uint64(max(1, (len(key) - 1).bit_length()))
    return (np.sort(key.astype(np.uint64) << bits | np.arange(len(key), dtype=np.uint64)) & ((_U(1) << bits) - _U(1))).astype(np.int64)


@dataclass
class Words:
    """The words of a slice of rows: buf[start[i]:end[i]] is word i; the words of row r are first[r] to first[r + 1]."""

    buf: np.ndarray
    row_at: np.ndarray  # byte offsets of the rows, one more than rows
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def parts(self, max_bytes: int = SLICE_BYTES // 2) -> Iterator[tuple[int, Words]]:
        """(first row, words) of runs of rows of about max_bytes."""
        low = 0
        while low < self.rows:
            high = max(low + 1, int(np.searchsorted(self.row_at, self.row_at[low] + max_bytes, side="right")) - 1)
            byte, word = self.row_at[low], slice(self.first[low], self.first[high])
            yield low, Words(self.buf[byte : self.row_at[high]], self.row_at[low : high + 1] - byte, self.start[word] - byte, self.end[word] - byte, self.first[low : high + 1] - word.start)
            low = high

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def hashes(self, second: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; second: by an independent function."""
        poly = _BYTES2 if second else _BYTES
        return poly.ranges(self.buf, self.start, self.end, poly.values)

    def byte_ranges(self, start: np.ndarray, end: np.ndarray, mapped: np.ndarray | None = None) -> np.ndarray:
        """Hashes of buf[start:end]; mapped: a table that replaces each byte first."""
        return _BYTES.ranges(self.buf, start, end, _BYTES.values if mapped is None else _BYTES.values[mapped])

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of width consecutive words of one row, and each window's row."""
        n = np.maximum(self.counts - width + 1, 0)
        row = np.repeat(np.arange(self.rows), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.first[row]
        return at, row


def window_hashes(word_hashes: np.ndarray, at: np.ndarray, width: int, second: bool = False) -> np.ndarray:
    return (_WORDS2 if second else _WORDS).ranges(word_hashes, at, at + width)


def sequence_hashes(word_hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _WORDS.ranges(word_hashes, start, end)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its rows' offsets in them; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def cut(raw: np.ndarray, row_at: np.ndarray, separators: np.ndarray, lower: bool) -> Words:
    """The words of rows whose bytes are raw[row_at[r]:row_at[r + 1]]."""
    buf = LOWER[raw] if lower else raw
    inside = ~separators[buf]
    n = len(buf)
    edge = np.zeros(n + 1, dtype=bool)
    edge[row_at] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(buf, row_at, start, end, np.searchsorted(start, row_at))


def slices(texts: pa.Array, separators: np.ndarray = BLANK, lower: bool = False, max_bytes: int = SLICE_BYTES, max_rows: int = 1 << 20) -> Iterator[tuple[int, Words]]:
    """(first row, words) of slices of about max_bytes, and max_rows at most, that cover all rows of an Arrow string array."""
    raw, at = buffers(texts)
    low, rows = 0, len(at) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + max_bytes, side="right")) - 1)
        high = min(high, low + max_rows)
        yield low, cut(raw[at[low] : at[high]], at[low : high + 1] - at[low], separators, lower)
        low = high
