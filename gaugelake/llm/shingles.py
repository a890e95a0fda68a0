"""Word and shingle hashes of many texts at once, in numpy.

Words are runs of anything but ASCII white space, with A-Z in lower case. A word's hash is a polynomial over random 64-bit
byte values; the polynomials of all words come from one prefix sum. Shingles mix the hashes of their words in order.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_P_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ONE = _U(1)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=4)
def byte_values(lower: bool) -> np.ndarray:
    values = np.random.Generator(np.random.PCG64(20_240_229)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _ONE
    if lower:
        values[65:91] = values[97:123]
    return values


@lru_cache(maxsize=2)
def _powers(n: int, inverse: bool) -> np.ndarray:
    out = np.full(n, _P_INVERSE if inverse else _P, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """P^0 .. P^(n-1) mod 2^64, or of its inverse."""
    return _powers(1 << max(16, (n - 1).bit_length()), inverse)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prefix_sums(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """S with S[i] = sum of value(b_j) P^j for j < i, mod 2^64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values(lower)[data] * powers(len(data)), out=out[1:])
    return out


def substring_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], wherever they lie."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums), True)[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts, number of words before each text and after the last)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = SPACES[data]
    edge = np.diff(space.astype(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge[1:] == 1) + 1
    hashes = substring_hashes(prefix_sums(data, lower), starts, ends)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, begins)


def shingle_sets(texts: list[bytes], width: int = 3) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has one for all of them, one without words none."""
    words, at = word_hashes(texts)
    n = len(words)
    if n >= width:
        mixed = words[: n - width + 1].copy()
        for k in range(1, width):
            mixed = mix(mixed * _U(0xFF51AFD7ED558CCD) + words[k : n - width + 1 + k])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(mixed[a : b - width + 1]))
        elif b > a:
            short = words[a : a + 1]
            for k in range(a + 1, b):
                short = mix(short * _U(0xC4CEB9FE1A85EC53) + words[k : k + 1])
            out.append(short + _U(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@lru_cache(maxsize=4)
def _coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(7_919))
    a = draw.integers(0, 1 << 63, (k, 1), dtype=np.uint64) * _U(2) + _ONE
    return a, draw.integers(0, 1 << 63, (k, 1), dtype=np.uint64)


def signature(shingles: np.ndarray, k: int) -> np.ndarray:
    """A token of 64 bits for each of k coordinates: a hash of the coordinate and the least of its hashes over a set of shingles."""
    a, b = _coefficients(k)
    least = np.full((k, 1), ~_U(0))
    for i in range(0, len(shingles), 2048):
        part = shingles[None, i : i + 2048] * a + b
        part ^= part >> _U(32)
        part *= _U(0xD6E8FEB86659FD93)
        least = np.minimum(least, part.min(axis=1, keepdims=True))
    return mix(least[:, 0] + np.arange(1, k + 1, dtype=np.uint64) * _P).view(np.int64)
