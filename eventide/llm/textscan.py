"""Vectorised scans of UTF-8 text: words, word hashes and shingles of a whole batch at a time.

A word is a run of [0-9A-Za-z] and non-ASCII characters, after A-Z are lowered; in UTF-8 that is a run of
bytes, so a table look-up per byte finds all words of a batch without decoding it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = True
WORD[128:] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) | _U(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept and grown on demand."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.empty(max(n, 1 << 12), dtype=_U)
        out[0] = 1
        done = 1
        while done < len(out):
            step = min(done, len(out) - done)
            out[done : done + step] = out[:step] * _U(pow(base, done, 1 << 64))
            done += step
        _powers[base] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in one array, and where each row begins (one more than rows); null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


@dataclass
class Words:
    low: np.ndarray  #: lowered bytes of all rows
    off: np.ndarray  #: row r has bytes off[r] .. off[r + 1]
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: byte after each word
    first: np.ndarray  #: row r has words first[r] .. first[r + 1]
    row: np.ndarray  #: row of each word

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, the same wherever the word stands."""
        n = len(self.low)
        at = np.zeros(n + 1, dtype=_U)
        np.cumsum(_BYTES[self.low] * powers(_BASE, n), out=at[1:])
        return mix((at[self.end] - at[self.start]) * powers(_UNBASE, n + 1)[self.start])

    def text(self, i: int) -> bytes:
        return self.low[self.start[i] : self.end[i]].tobytes()


def words(column: pa.Array) -> Words:
    raw, off = flat(column)
    low = LOWER[raw]
    inside = WORD[low]
    cut = np.zeros(len(low) + 1, dtype=bool)
    cut[off] = True
    before = np.concatenate(([False], inside[:-1])) if len(low) else inside
    after = np.concatenate((inside[1:], [False])) if len(low) else inside
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    first = np.searchsorted(start, off)
    return Words(low, off, start, end, first, np.repeat(np.arange(len(off) - 1), np.diff(first)))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words; those that cross a row are the caller's to leave out."""
    if len(hashes) < k:
        return np.zeros(0, dtype=_U)
    out = np.zeros(len(hashes) - k + 1, dtype=_U)
    for j in range(k):
        out = out * _U(0xD1342543DE82EF95) + hashes[j : len(hashes) - k + 1 + j]
    return mix(out)
