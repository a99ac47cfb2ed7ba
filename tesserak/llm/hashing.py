"""Word and shingle hashes of whole Arrow string columns, by numpy.

A word's hash is a polynomial over its bytes, taken as a difference of prefix
sums, so a batch of texts is hashed without a Python object per word.  Each byte
stands for a random 64-bit number and the sum is mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer text is hashed alone.
CHUNK = 1 << 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(4)
def _bytes_table(seed: int, lower: bool) -> np.ndarray:
    table = mix(np.arange(256, dtype=np.uint64) + np.uint64(1000 * (seed + 1)))
    if lower:
        table[65:91] = table[97:123]
    return table


@lru_cache(4)
def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(mix(np.array([seed + 77], dtype=np.uint64))[0]) | 1
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Polynomial hashes of values[starts:ends], each as if it began at power 0."""
    n = 1 << max(12, int(len(values)).bit_length())
    power, inverse = _powers(seed, n)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _GOLD)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of some texts: byte ranges and text numbers."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.data, self.offsets, self.lower, self.n_texts = data, offsets, lower, len(offsets) - 1
        space = _SPACE[data]
        begins = ~space
        begins[1:] &= space[:-1]
        ends = np.ones(len(data) + 1, dtype=bool)
        ends[:-1] = space
        firsts = offsets[:-1][np.diff(offsets) > 0]
        begins[firsts] = ~space[firsts]
        self.starts = np.flatnonzero(begins)
        bounds = np.zeros(len(data) + 1, dtype=bool)
        bounds[:-1] = space
        bounds[firsts] = True
        bounds[len(data)] = True
        stops = np.flatnonzero(bounds)
        self.ends = stops[np.searchsorted(stops, self.starts, side="right")]
        self.text = np.searchsorted(offsets, self.starts, side="right") - 1
        self.counts = np.bincount(self.text, minlength=self.n_texts)
        #: the number of the first word of each text, and one past the last word of all
        self.first = np.concatenate(([0], np.cumsum(self.counts)))

    def hashes(self, seed: int = 0) -> np.ndarray:
        return _ranges(_bytes_table(seed, self.lower)[self.data], self.starts, self.ends, seed)

    def windows(self, words: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each run of k words inside one text."""
        if len(words) < k:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(self.text[: len(words) - k + 1] == self.text[k - 1 :])
        return at, _ranges(words, at, at + k, seed + 8)

    def wholes(self, words: np.ndarray, seed: int = 0) -> np.ndarray:
        """The hash of each text's whole word sequence."""
        return _ranges(words, self.first[:-1], self.first[1:], seed + 8)

    def shingle_sets(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of k words, as (text, hash), sorted by both.

        A text of fewer than k words, but one at least, has its whole sequence
        as its only shingle; a text without words has none.
        """
        words = self.hashes()
        at, hashed = self.windows(words, k)
        short = np.flatnonzero((self.counts > 0) & (self.counts < k))
        text = np.concatenate((self.text[at], short))
        hashed = np.concatenate((hashed, self.wholes(words)[short] ^ np.uint64(1)))
        order = np.lexsort((hashed, text))
        text, hashed = text[order], hashed[order]
        new = np.ones(len(text), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (hashed[1:] != hashed[:-1])
        return text[new], hashed[new]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def word_chunks(column: pa.Array, lower: bool, most: int = CHUNK) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) over runs of rows with about ``most`` bytes each."""
    data, offsets = text_buffers(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to, Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], lower)
        at = to
