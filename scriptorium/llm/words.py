"""Words of many texts at once, in numpy and Arrow, and sums by key that a task keeps before Spark sees them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are taken apart at a time.
BLOCK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def blocks(raw: bytes, ends: re.Pattern[bytes], most: int = BLOCK) -> Iterator[bytes]:
    """A text in blocks of about ``most`` bytes, each cut before a match of ``ends``; a stretch without a match stays whole."""
    at = 0
    while len(raw) - at > most:
        found = ends.search(raw, at + most)
        if not found:
            break
        yield raw[at : found.start()]
        at = found.start()
    yield raw[at:]


class Words:
    """Words of a block: starts in bytes, and their places in a dictionary of the block's distinct words, A-Z lower-cased."""

    def __init__(self, raw: bytes, inside: np.ndarray):
        self.data = np.frombuffer(raw, np.uint8)
        word = inside[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
        self.starts, ends = edge[0::2], edge[1::2]
        offsets = np.zeros(len(self.starts) + 1, np.int32)
        np.cumsum(ends - self.starts, out=offsets[1:])
        close = pa.Array.from_buffers(pa.binary(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[self.data[word]])])
        coded = close.dictionary_encode()
        self.places, self.distinct = np.asarray(coded.indices), coded.dictionary.to_pylist()


class Vocabulary:
    """The words that a task has met: numbers, and 64-bit hashes that are the same in every task."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self._hashes = np.zeros(1 << 16, np.uint64)

    def __len__(self) -> int:
        return len(self.words)

    def add(self, distinct: list[bytes]) -> np.ndarray:
        """Numbers of the words; those not met before get the next ones."""
        numbers = self.numbers
        out = np.fromiter((numbers.setdefault(w, len(numbers)) for w in distinct), np.int64, len(distinct))
        if len(numbers) > len(self.words):
            new = sorted((n, w) for n, w in zip(out.tolist(), distinct) if n >= len(self.words))
            while len(numbers) > len(self._hashes):
                self._hashes = np.concatenate([self._hashes, np.zeros_like(self._hashes)])
            self._hashes[new[0][0] : new[-1][0] + 1] = word_hashes([w for _, w in new])
            self.words += [w for _, w in new]
        return out

    def hashes(self, numbers: np.ndarray) -> np.ndarray:
        return self._hashes[numbers]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Tally:
    """Sums by 64-bit key, with what stood at the key first; merged whenever much is pending."""

    def __init__(self, pending: int = 1 << 20):
        self.pending, self.waiting, self.rows = pending, 0, []

    def add(self, keys: np.ndarray, sums: np.ndarray, firsts: np.ndarray | None = None) -> None:
        """``sums`` and ``firsts`` have a row for each key."""
        if len(keys):
            self.rows.append((keys, sums, np.zeros((len(keys), 0), np.int64) if firsts is None else firsts))
            self.waiting += len(keys)
            if self.waiting > self.pending:
                self.pending = max(self.pending, 2 * len(self.merged()[0]))

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Distinct keys in order, their sums and firsts; None if there is nothing."""
        if not self.rows:
            return None
        keys, sums, firsts = (np.concatenate(x) for x in zip(*self.rows))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.rows = [(keys[edge], np.add.reduceat(sums[order], edge, axis=0), firsts[order[edge]])]
        self.waiting = len(edge)
        return self.rows[0]
