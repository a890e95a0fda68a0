"""Directly addressable codes: integers cut into chunks by level, with a continuation bitmap and a rank directory for each level.

Level 0 holds the lowest chunk of every value. A bit a value tells whether it goes on; the next level holds only those,
in order, and a value's place there is the number of set bits before it. So value i is read by at most one chunk and one
rank a level, and no other value is decoded.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"GLDC"
#: Bits of a bitmap between two entries of its rank directory.
RANK_BITS = 512
_HEAD = struct.Struct("<4sBBQ")
_LEVEL = struct.Struct("<Q")


def pack(values: np.ndarray, chunk_bits: int = 8) -> bytes:
    """The code of unsigned integers. chunk_bits: 8 or 16."""
    kind = {8: np.dtype("u1"), 16: np.dtype("<u2")}[chunk_bits]
    rest = np.asarray(values)
    levels, rest = [], rest.astype(np.min_scalar_type(int(rest.max()))) if len(rest) and rest.itemsize > 2 else rest
    n = len(rest)
    while True:
        more = rest >> rest.dtype.type(chunk_bits) if rest.itemsize * 8 > chunk_bits else np.zeros(len(rest), np.uint8)
        on = more > 0
        bits = np.packbits(on, bitorder="little")
        per = RANK_BITS // 8
        ones = np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), per)).astype("<u8") if len(bits) else np.zeros(0, "<u8")
        ranks = np.concatenate([np.zeros(1, "<u8"), np.cumsum(ones, dtype="<u8")])
        levels.append(_LEVEL.pack(len(rest)) + rest.astype(kind).tobytes() + bits.tobytes() + ranks.astype("<u8").tobytes())
        if not on.any():
            break
        rest = more[on]
    return _HEAD.pack(MAGIC, chunk_bits, len(levels), n) + b"".join(levels)


class DirectCodes:
    """Random access to a packed code without decoding it."""

    def __init__(self, buffer: bytes | memoryview):
        magic, self.chunk_bits, n_levels, self.n = _HEAD.unpack_from(buffer)
        if magic != MAGIC:
            raise ValueError("not a code of this format")
        kind = {8: np.dtype("u1"), 16: np.dtype("<u2")}[self.chunk_bits]
        at, self.levels = _HEAD.size, []
        for _ in range(n_levels):
            (n,) = _LEVEL.unpack_from(buffer, at)
            at += _LEVEL.size
            chunks = np.frombuffer(buffer, kind, n, at)
            at += chunks.nbytes
            bits = np.frombuffer(buffer, "u1", -(-n // 8), at)
            at += bits.nbytes
            ranks = np.frombuffer(buffer, "<u8", -(-len(bits) * 8 // RANK_BITS) + 1 if len(bits) else 1, at)
            at += ranks.nbytes
            self.levels.append((chunks, bits, ranks))
        self.nbytes = at

    def __len__(self) -> int:
        return self.n

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Set bits before bit i."""
        block = i // RANK_BITS
        start = block * RANK_BITS // 8
        whole = int(np.bitwise_count(bits[start : i // 8]).sum())
        part = int(bits[i // 8]) & ((1 << i % 8) - 1) if i % 8 else 0
        return int(ranks[block]) + whole + part.bit_count()

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i, shift = self._rank(bits, ranks, i), shift + self.chunk_bits
        return value

    def between(self, a: int, b: int) -> np.ndarray:
        """Values a to b, without those before."""
        parts, lo, hi = [], a, b
        for chunks, bits, ranks in self.levels:
            on = np.unpackbits(bits[lo // 8 : -(-hi // 8)], bitorder="little")[lo % 8 : lo % 8 + hi - lo].astype(bool) if hi > lo else np.zeros(0, bool)
            parts.append((chunks[lo:hi], on))
            first = self._rank(bits, ranks, lo) if lo < len(chunks) else 0
            lo, hi = first, first + int(np.count_nonzero(on))
            if lo == hi:
                break
        kind = np.uint32 if self.chunk_bits * len(parts) <= 32 else np.uint64
        total = np.zeros(0, kind)
        for chunks, on in reversed(parts):
            values = chunks.astype(kind)
            values[on] |= total << kind(self.chunk_bits)
            total = values
        return total
