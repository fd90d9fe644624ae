"""Words, windows and 64-bit hashes of whole texts, in numpy."""

from __future__ import annotations

import numpy as np

_R = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: What a byte counts for, and powers of an odd multiplier with their inverses.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _R)
_SPACE = np.isin(np.arange(256), [0x20, *range(9, 14)])
_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWER, _BACK = _powers(_R, 1 << 16), _powers(_INVERSE, 1 << 16)


def word_hashes(data: bytes) -> np.ndarray:
    """One hash for each word ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes, in order."""
    global _POWER, _BACK
    b = np.frombuffer(data, dtype=np.uint8)
    if len(b) == 0:
        return np.empty(0, dtype=np.uint64)
    if len(b) > len(_POWER):
        _POWER, _BACK = _powers(_R, len(b)), _powers(_INVERSE, len(b))
    edge = np.diff(np.concatenate(([True], _SPACE[b], [True])).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * _POWER[: len(b)], dtype=np.uint64)))
    return mix((sums[last] - sums[first]) * _BACK[first] + (last - first).astype(np.uint64))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of ``k`` words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * _R + words[i : i + n]
    return mix(out)


def long_windows(words: np.ndarray, k: int) -> np.ndarray:
    """The same in time that doesn't depend on ``k``, for long runs."""
    global _POWER, _BACK
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    if len(words) > len(_POWER):
        _POWER, _BACK = _powers(_R, len(words)), _powers(_INVERSE, len(words))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * _POWER[: len(words)], dtype=np.uint64)))
    return mix((sums[k:] - sums[:n]) * _BACK[:n])


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """The sorted set of ``k``-word shingle hashes of a text, A-Z lower-cased; fewer words make one shingle, none make none."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    w = word_hashes(text.encode().lower())
    return distinct(windows(w, min(k, len(w)))) if len(w) else w


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values of an array."""
    x = np.sort(x)
    return x[np.concatenate((np.ones(1, bool), x[1:] != x[:-1]))] if len(x) else x


def repeated(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that an array holds twice or more, sorted, and how often."""
    x = np.sort(x)
    starts = np.flatnonzero(np.concatenate((np.ones(1, bool), x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)
    n = np.diff(np.append(starts, len(x)))
    return x[starts[n > 1]], n[n > 1]
