"""Subword ids of whole texts with a public tokenizer file, one encoding per distinct piece.

``PieceEncoder`` gives exactly the ids of ``Tokenizer.encode(text, add_special_tokens=False)``. Both
vocabularies used here cut a text into pre-tokens before they merge. A batch of texts is cut at some
of those boundaries (before white space, before a space that a word follows, between an ASCII letter
or digit and ASCII punctuation), each distinct piece is encoded once, and the ids are gathered per
text. Texts in which such a cut could differ from the tokenizer's own (white space or marks beyond
ASCII, control characters, the start of a special token) are encoded whole.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidewatch.llm.words import WHITE, HashTable, flat_bytes, range_hashes, slices

#: Special-token starts, control characters, white space and invisible marks beyond ASCII, combining marks.
UNSAFE = "<\\||[\\x00-\\x08\\x0e-\\x1f\\x7f-\\x{a0}\\x{300}-\\x{36f}\\x{1680}\\x{180e}\\x{2000}-\\x{200f}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{2060}\\x{3000}\\x{feff}]"

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(0x21, 0x7F) if not _ALNUM[c]]] = True

#: Pieces that the tokenizer gets at once: its results are some hundred times as large as their ids.
_AT_ONCE = 4096

_shared: dict[str, PieceEncoder] = {}


def default_path(name: str) -> str:
    """The place of a public vocabulary file on this machine (each worker asks for its own)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges [starts[i], starts[i] + lengths[i]) as one index array."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def encoder(name_or_path: str) -> PieceEncoder:
    """The encoder of this worker process, so that its cache outlives a task."""
    if name_or_path not in _shared:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core, and each thread keeps memory of its own
        _shared[name_or_path] = PieceEncoder(name_or_path if "/" in name_or_path else default_path(name_or_path))
    return _shared[name_or_path]


class PieceEncoder:
    """Encodes Arrow string arrays; keeps the ids of at most ``cache`` distinct pieces, then starts anew."""

    def __init__(self, path: str, cache: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._limit = cache
        self._clear()

    def _clear(self) -> None:
        self._table = HashTable()
        self._first, self._size, self._pool = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.uint32)
        self._n = self._used = 0

    def _add(self, keys: np.ndarray, pieces: list[str]) -> None:
        lists = [e.ids for a in range(0, len(pieces), _AT_ONCE) for e in self.tokenizer.encode_batch_fast(pieces[a : a + _AT_ONCE], add_special_tokens=False)]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(size.sum())
        for name, n in (("_first", self._n + len(lists)), ("_size", self._n + len(lists)), ("_pool", self._used + total)):
            if n > len(old := getattr(self, name)):
                setattr(self, name, np.concatenate([old, np.zeros(n, old.dtype)]))
        self._pool[self._used : self._used + total] = np.fromiter(chain.from_iterable(lists), np.uint32, total)
        self._first[self._n : self._n + len(lists)] = self._used + np.cumsum(size) - size
        self._size[self._n : self._n + len(lists)] = size
        self._table.put(keys, np.arange(self._n, self._n + len(lists)))
        self._n += len(lists)
        self._used += total

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, offsets = flat_bytes(texts)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        white = WHITE[raw]
        cut = np.zeros(len(raw) + 1, bool)
        cut[offsets] = True
        cut[1:-1] |= white[1:] & ~white[:-1]
        cut[:-2] |= (raw[:-1] == 0x20) & ~white[1:]
        # A two-byte letter of Latin-1 (C3 80 to C3 BF but for the signs 97 and B7) counts as a letter.
        letter = _ALNUM[raw]
        letter[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
        cut[1:-1] |= letter[:-1] & _PUNCT[raw[1:]]
        at = np.flatnonzero(cut)
        starts, ends = at[:-1], at[1:]
        keys = range_hashes(raw, starts, ends)
        value = self._table.get(keys)
        if (value < 0).any():
            missing, where = np.unique(keys[value < 0], return_index=True)
            if self._n + len(missing) > self._limit:
                self._clear()
                missing, where = np.unique(keys, return_index=True)
            else:
                where = np.flatnonzero(value < 0)[where]
            data = raw.tobytes()
            self._add(missing, [data[a:b].decode() for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
            value = self._table.get(keys)
        size = self._size[value].astype(np.int64)
        ids = self._pool[gather(self._first[value], size)]
        upto = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(upto[np.searchsorted(starts, offsets)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has. Null texts count as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        unsafe = np.asarray(pc.match_substring_regex(texts, UNSAFE))
        safe = pc.if_else(pa.array(unsafe), "", texts) if unsafe.any() else texts
        parts = [self._slice(x) for x in slices(safe)]
        ids = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, np.uint32)
        counts = np.concatenate([x for _, x in parts]) if parts else np.zeros(0, np.int64)
        if unsafe.any():
            own = np.split(ids, np.cumsum(counts)[:-1])
            for i in np.flatnonzero(unsafe):
                own[i] = np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
                counts[i] = len(own[i])
            ids = np.concatenate(own)
        return ids, counts
