"""Whole texts as arrays: words, word hashes and windows of many texts at once.

Works on the UTF-8 bytes of an Arrow column, in slices of about ``SLICE_BYTES`` whole
texts, so memory follows the slice (or one text, if that is longer), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

from .common import mix64

SLICE_BYTES = 2_000_000
WINDOW = 5
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([self.up, self.up * np.uint64(pow(_ODD, k, 1 << 64))])
                self.down = np.concatenate([self.down, self.down * np.uint64(pow(_INVERSE, k, 1 << 64))])
        return self.up, self.down


_powers = _Powers()


class Texts:
    """Arrays over the bytes of some texts (null: empty)."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray):
        self.raw, self.bounds = raw, bounds
        self.n = len(bounds) - 1

    @cached_property
    def inside(self) -> np.ndarray:
        """Bytes that belong to words."""
        return ~BLANK[self.raw]

    @cached_property
    def _word_runs(self) -> tuple[np.ndarray, np.ndarray]:
        before = np.concatenate([[False], self.inside[:-1]]) if len(self.raw) else np.zeros(0, bool)
        after = np.concatenate([self.inside[1:], [False]]) if len(self.raw) else np.zeros(0, bool)
        edge = self.bounds[(self.bounds > 0) & (self.bounds < len(self.raw))]
        before[edge] = False
        after[edge - 1] = False
        return np.flatnonzero(self.inside & ~before), np.flatnonzero(self.inside & ~after) + 1

    @property
    def starts(self) -> np.ndarray:
        return self._word_runs[0]

    @property
    def ends(self) -> np.ndarray:
        return self._word_runs[1]

    @cached_property
    def word_bounds(self) -> np.ndarray:
        """Word number at which each text begins (len n + 1)."""
        return np.searchsorted(self.starts, self.bounds)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_bounds)

    @cached_property
    def _prefix(self) -> np.ndarray:
        up, _ = _powers.get(len(self.raw) + 1)
        with np.errstate(over="ignore"):
            return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[self.raw] * up[: len(self.raw)], dtype=np.uint64)])

    def hash_spans(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans; equal bytes give equal hashes."""
        _, down = _powers.get(len(self.raw) + 1)
        with np.errstate(over="ignore"):
            return mix64((self._prefix[hi] - self._prefix[lo]) * down[lo] + (hi - lo).astype(np.uint64))

    @cached_property
    def word_hashes(self) -> np.ndarray:
        return self.hash_spans(self.starts, self.ends)

    def windows(self, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, text, hash) of each window of ``size`` words that lies within one text."""
        h = self.word_hashes
        if len(h) < size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        out = h[: len(h) - size + 1].copy()
        with np.errstate(over="ignore"):
            for k in range(1, size):
                out = out * np.uint64(_ODD) + h[k : len(h) - size + 1 + k]
        text = np.repeat(np.arange(self.n), self.n_words)
        same = text[: len(out)] == text[size - 1 :]
        first = np.flatnonzero(same)
        return first, text[first], mix64(out[first])

    def count(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.float64 if flags.dtype.kind == "f" else np.int64)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of each ``size`` neighbours; equal neighbours give equal hashes, at any place."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    up, down = _powers.get(len(h) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
        return mix64((total[size:] - total[:-size]) * down[: len(h) - size + 1])


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Cut a string column into (from row, to row, arrays); a slice has ``size`` bytes, or one text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        hi = min(hi, len(texts))
        yield lo, hi, Texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def repeated(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items whose (group, key) occurs twice or more: their indices, ordered by it, and whether each is its first."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    with np.errstate(over="ignore"):
        both = mix64(key + (group.astype(np.uint64) + np.uint64(1)) * np.uint64(_ODD))
    bits = max(10, min(24, int(len(both)).bit_length() + 2))
    slot = (both & np.uint64((1 << bits) - 1)).astype(np.int64)
    some = np.flatnonzero(np.bincount(slot, minlength=1 << bits)[slot] > 1)
    order = some[np.argsort(both[some], kind="stable")]
    sorted_key = both[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]) if len(order) else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    often = np.bincount(run, minlength=1)[run] > 1 if len(order) else np.zeros(0, bool)
    return order[often], new[often]
