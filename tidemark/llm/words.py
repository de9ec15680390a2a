"""Words of whole batches of texts as numpy arrays.

A word is a match of ``[^\\x20\\x09-\\x0D]+``. The separators are ASCII, so words are found on the UTF-8 bytes of many
texts at once; texts are laid end to end with a line feed between them. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are laid out at once; a longer single text is laid out alone.
SLICE_BYTES = 1 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pair_hash(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    return mix(a * _ODD + b + np.uint64(salt))


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` items: halves are paired, lengths double, the last pairing may overlap."""
    if len(h) < length:
        return np.zeros(0, np.uint64)
    size = 1
    while 2 * size <= length:
        h = pair_hash(h[:-size], h[size:], size)
        size *= 2
    return pair_hash(h[: len(h) - (length - size)], h[length - size :], length << 32) if size < length else h


_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        step = np.uint64(pow(_BASE, len(_powers), 1 << 64))
        _powers = np.concatenate([_powers, _powers * step])
    return _powers


class Words:
    """Words of some texts: ``start`` and ``end`` are byte places in ``buf``, words of text i are ``first[i]:first[i+1]``."""

    def __init__(self, texts: list[bytes | None]):
        self.texts = [t or b"" for t in texts]
        self.buf = np.frombuffer(b"\n".join([*self.texts, b""]), np.uint8)
        self.space = SEPARATOR[self.buf]
        edge = np.empty(len(self.buf), bool)
        edge[:1] = ~self.space[:1]
        edge[1:] = self.space[:-1] & ~self.space[1:]
        self.start = np.flatnonzero(edge)
        edge[:-1] = ~self.space[:-1] & self.space[1:]
        edge[-1:] = False
        self.end = np.flatnonzero(edge) + 1
        sizes = np.fromiter(map(len, self.texts), np.int64, len(self.texts)) + 1
        self.text_start = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(self.start, self.text_start)
        self.doc = np.repeat(np.arange(len(self.texts)), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        at = np.zeros(len(self.buf), np.int32 if len(self.buf) < 1 << 31 else np.int64)
        at[self.start] = self.start
        np.maximum.accumulate(at, out=at)
        at = np.arange(len(self.buf), dtype=at.dtype) - at
        value = _power_table(int(at[self.start[0] :].max()) + 1)[at]
        value *= self.buf + np.uint64(1)
        value[self.space] = 0
        return mix(np.add.reduceat(value, self.start) + (self.end - self.start).astype(np.uint64) * _ODD)

    def window_starts(self, length: int) -> np.ndarray:
        """True at each word that starts a run of ``length`` words of its text."""
        n = len(self.doc) - length + 1
        return self.doc[:n] == self.doc[length - 1 :] if n > 0 else np.zeros(0, bool)


def slices(texts: pa.ChunkedArray | pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, texts as UTF-8) of runs of about ``most`` bytes; only a run at a time becomes Python objects."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    end, row = np.cumsum(size), 0
    while row < len(size):
        held = end[row] - size[row]
        to = max(row + 1, int(np.searchsorted(end, held + most, "right")))
        yield row, texts.slice(row, to - row).cast(pa.large_binary()).to_pylist()
        row = to
