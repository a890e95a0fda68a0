"""Arrays that travel in compressed runs, a row for each batch and bucket, rather than a row an element."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def packed(*arrays: np.ndarray) -> list[bytes]:
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    return [press.compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()) for a in arrays]


def unpacked(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    kind = np.dtype(kind)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its places in order)."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)]):
        yield int(bucket[order[a]]), order[a:b]


def by_bucket(batches: Iterator, n: int) -> Iterator[tuple[int, list[tuple]]]:
    """(bucket, its rows) of rows of ``n`` columns in order of their first, the bucket; rows of negative buckets come one by one."""
    key, held = None, []
    for batch in batches:
        for bucket, *row in zip(*(batch.column(c).to_pylist() for c in range(n)), strict=True):
            if held and (bucket != key or bucket < 0):
                yield key, held
                held = []
            key = bucket
            held.append(tuple(row))
    if held:
        yield key, held


def edges_of(*keys: np.ndarray) -> np.ndarray:
    """Places where a new combination of keys starts, of keys in order."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)
