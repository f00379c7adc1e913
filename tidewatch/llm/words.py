"""Texts as flat byte arrays, and word hashes without a Python object per word.

All functions take Arrow string arrays and work on the UTF-8 bytes with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space of the word contracts: space and 0x09 to 0x0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash multiplier and of its inverse modulo 2**64."""
    global _powers, _inverses
    if len(_powers) <= n:
        size = 1 << int(n).bit_length()
        _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _MULTIPLIER))])
        _inverses = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _INVERSE))])
    return _powers, _inverses


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(texts: pa.Array, limit: int = 2_000_000) -> Iterator[pa.Array]:
    """Consecutive slices of at most ``limit`` bytes (or one text)."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    ends, start = np.cumsum(size), 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in a row, and the offset of each text in them. Nulls count as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def range_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, the same for the same bytes wherever they lie."""
    powers, inverses = _power_tables(len(raw))
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverses[starts])


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes other than white space), and the first word of each text."""
    word = ~WHITE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word])
    after = np.concatenate([word, [False]])
    starts = np.flatnonzero(after & (edge | ~before))
    ends = np.flatnonzero(before & (edge | ~after))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of all texts, and the first word of each text (one more at the end)."""
    raw, offsets = flat_bytes(texts)
    raw = LOWER[raw]
    starts, ends, first = word_bounds(raw, offsets)
    return range_hashes(raw, starts, ends), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles; a text of fewer words (not none) has its whole sequence as one. Offsets as before."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    offsets = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(offsets[-1]) + np.repeat(first[:-1] - offsets[:-1], count)
    width = np.minimum(np.repeat(n, count), k)
    h = np.zeros(offsets[-1], np.uint64)
    for j in range(k):
        inside = width > j
        step = words[np.minimum(at + j, max(len(words) - 1, 0))] if len(words) else h
        h = np.where(inside, mix(h + step + np.uint64(j + 1)), h)
    return h, offsets


class HashTable:
    """Open-addressing map from 64-bit hashes to int64 values, with vectorised lookup and insertion."""

    def __init__(self, bits: int = 16):
        self._bits, self.size = bits, 0
        self._keys, self._values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, or -1."""
        mask = np.uint64((1 << self._bits) - 1)
        slot = keys & mask
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        while len(rest):
            at = slot[rest]
            value = self._values[at]
            found = self._keys[at] == keys[rest]
            out[rest[found]] = value[found]
            rest = rest[~found & (value >= 0)]
            slot[rest] = (slot[rest] + np.uint64(1)) & mask
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that are not in the table; values are not negative."""
        if (self.size + len(keys)) * 2 > 1 << self._bits:
            old = self._values >= 0
            keys, values = np.concatenate([self._keys[old], keys]), np.concatenate([self._values[old], values])
            self.__init__(max(self._bits, int(2 * len(keys)).bit_length()))
        mask = np.uint64((1 << self._bits) - 1)
        self.size += len(keys)
        slot, rest = keys & mask, np.arange(len(keys))
        while len(rest):
            at = slot[rest]
            free = self._values[at] < 0
            got = rest[free]
            self._values[slot[got]] = values[got]
            self._keys[slot[got]] = keys[got]
            lost = self._keys[at] != keys[rest]
            rest = rest[lost]
            slot[rest] = (slot[rest] + np.uint64(1)) & mask
