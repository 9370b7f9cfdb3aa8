"""Hashes of words and of word shingles, for many texts at once."""

from __future__ import annotations

import numpy as np

from . import common

#: Odd multipliers of the mixing steps.
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function, element by element."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = 0x5851F42D4C957F2D


def _powers(n: int, base: int = _BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts, in order; where each text's words begin, with the end as last entry)."""
    data = [common.utf8(t).translate(common.WORD_BYTES) for t in texts]
    sizes = np.array([len(d) + 1 for d in data], np.int64)
    arr = np.frombuffer(b" ".join([*data, b""]), np.uint8)
    inside = arr != 32
    if not inside.any():
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    places = np.flatnonzero(inside)
    first = np.empty(len(places), bool)
    first[0] = True
    first[1:] = np.diff(places) > 1
    at = np.flatnonzero(first)
    starts = places[at]
    lengths = np.diff(np.append(at, len(places)))
    within = np.arange(len(places)) - np.repeat(at, lengths)
    hashes = np.add.reduceat(_BYTE[arr[places]] * _powers(int(lengths.max()))[within], at)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return mix(hashes + lengths.astype(np.uint64)), np.searchsorted(starts, ends)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of `size` words; of fewer words, but not none, one of all."""
    n = min(size, len(words))
    if not n:
        return np.empty(0, np.uint64)
    count = len(words) - n + 1
    factors = _powers(size, 0x2545F4914F6CDD1D)
    total = np.full(count, n, np.uint64)
    for k in range(n):
        total += words[k : k + count] * factors[k]
    return mix(total)
