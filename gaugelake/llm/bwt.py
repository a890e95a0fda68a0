"""Burrows-Wheeler transforms of collections of short strings, and their merging by iterative interleave refinement.

A collection's strings end in terminators that differ from one another and sort before all bytes, in the order of the strings.
A shard's suffixes are sorted once, for its own transform. From then on there is no text and no sorting of suffixes: two transforms are
merged by refining their interleave, the order in which rows of one and the other follow. The last-to-first mapping leads from a
row to that of the suffix one symbol longer. An interleave that is right for the first h symbols falls into blocks of rows that share
them; a block parts where the rows one symbol on (the mapping backwards) lie in different blocks, and is then right for h + 1. A round looks only at
blocks that hold a predecessor of a row whose own block has parted in the round before, so each common prefix is paid for once. Rows that
part in the round for symbol h + 1 have h symbols in common: that gives the common prefixes, and the intervals that share ``width`` symbols and more.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Symbols of 9 bits that fit into one key of a number.
FIRST = 7


@dataclass
class Transform:
    """symbols: what stands before each suffix, in order of the suffixes (0: a terminator, else byte + 1).

    places: where each suffix starts in the joined strings; carried along for reports, merging does not read it.
    """

    symbols: np.ndarray
    places: np.ndarray
    n_strings: int

    def next_rows(self) -> np.ndarray:
        """For each row that of the suffix one symbol on: the last-to-first mapping backwards. A terminator's row is its own."""
        rows = np.argsort(self.symbols, kind="stable")
        rows[: self.n_strings] = np.arange(self.n_strings)
        return rows

    def first_symbols(self) -> np.ndarray:
        return np.sort(self.symbols, kind="stable")


def joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all strings, each followed by a terminator; start of each string)."""
    lengths = np.array([len(s) for s in strings], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    out = np.zeros(int(lengths.sum()) + len(strings), np.uint16)
    inside = np.ones(len(out), bool)
    inside[starts + lengths] = False
    out[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 1
    return out, starts


def _runs(parts: np.ndarray) -> np.ndarray:
    """Place of each run's first; ``parts``: whether a run starts."""
    return np.maximum.accumulate(np.where(parts, np.arange(len(parts)), 0)) if len(parts) else np.zeros(0, np.int64)


def _first_order(symbols: np.ndarray, follow: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by the first ``size`` symbols, stable; symbols in common with the one before, ``size`` where all are). Terminators differ."""
    key, at = np.zeros(len(symbols), np.uint64), np.arange(len(symbols))
    alive, ended = np.ones(len(symbols), bool), np.full(len(symbols), size)
    for k in range(size):
        symbol = np.where(alive, symbols[at], 0)
        ended[alive & (symbol == 0)] = k
        alive &= symbol > 0
        key = key << np.uint64(9) | symbol.astype(np.uint64)
        at = follow[at]
    order = np.argsort(key, kind="stable")
    k, e = key[order], ended[order]
    gap = k[1:] ^ k[:-1]
    # The place of the upper bit of the difference tells the first symbol that differs.
    bits = np.frexp(gap.astype(np.float64))[1]
    common = np.where(gap > 0, size - 1 - (np.maximum(bits, 1) - 1) // 9, size)
    return order, np.concatenate([[0], np.minimum(np.clip(common, 0, size), np.minimum(e[1:], e[:-1]))])[: len(order)]


def interleave(symbols: np.ndarray, follow: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared) of rows by their first ``depth`` symbols; rows that agree stay in the order given.

    symbols: the first symbol of each row. follow: the row one symbol on. shared: symbols in common with the row before, ``depth`` at most.
    """
    n, size = len(symbols), min(FIRST, depth)
    order, shared = _first_order(symbols, follow, size)
    shared[shared == size] = depth
    if size == depth or n == 0:
        return order, shared
    before = np.empty(n, np.int64)  # the row one symbol longer; rows of whole strings have none, and a terminator follows itself
    before.fill(-1)
    inner = np.flatnonzero(symbols > 0)
    before[follow[inner]] = inner
    block = np.empty(n, np.int64)
    block[order] = _runs(shared < depth)
    length = np.bincount(block, minlength=n)
    # Rows of blocks whose last part may differ: at first all that share ``size`` symbols with another.
    touched = np.flatnonzero(length[block] > 1)
    for h in range(size, depth):
        heads = np.unique(block[touched])
        heads = heads[length[heads] > 1]
        if not len(heads):
            break
        lengths = length[heads]
        at = np.repeat(heads - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(int(lengths.sum()))  # places of these blocks
        rows = order[at]
        mine, on = block[rows], block[follow[rows]]
        by = np.argsort(mine * np.int64(n) + on, kind="stable")
        rows, on = rows[by], on[by]
        own = mine[by]
        parted = np.concatenate([[True], (own[1:] != own[:-1]) | (on[1:] != on[:-1])])
        order[at] = rows
        first = at[_runs(parted)]
        new = parted & (first != own)
        shared[at[new]] = h
        # What the longer suffixes of a parted block's rows see has changed, but for its largest part.
        sizes = np.bincount(np.cumsum(parted) - 1)
        length[heads] = 0
        block[rows] = first
        length[at[parted]] = sizes
        starts = np.flatnonzero(np.concatenate([[True], own[parted][1:] != own[parted][:-1]]))
        several = np.diff(np.concatenate([starts, [len(sizes)]])) > 1
        most = np.maximum.reduceat(sizes, starts)
        of = np.repeat(np.arange(len(starts)), np.diff(np.concatenate([starts, [len(sizes)]])))
        largest = np.full(len(starts), len(sizes))
        np.minimum.at(largest, of[sizes == most[of]], np.flatnonzero(sizes == most[of]))
        seen = several[of] & (np.arange(len(sizes)) != largest[of])
        longer = before[rows[np.repeat(seen, sizes)]]
        touched = longer[longer >= 0]
    return order, shared


def transform(strings: list[bytes]) -> Transform:
    """The transform of one shard: its suffixes are sorted by their first symbols again and again, each symbol on one step in the text."""
    text, starts = joined(strings)
    follow = np.minimum(np.arange(len(text)) + 1, max(0, len(text) - 1))
    ends = np.flatnonzero(text == 0)
    follow[ends] = ends
    order, _ = interleave(text, follow, max(map(len, strings), default=0) + 1)
    return Transform(np.concatenate([text[-1:], text[:-1]])[order], order, len(strings))


def merge(a: Transform, b: Transform, depth: int) -> tuple[Transform, np.ndarray]:
    """(the transform of both collections, ``b``'s strings after ``a``'s, in order to ``depth`` symbols; symbols in common with the row before)."""
    n = len(a.symbols)
    order, shared = interleave(np.concatenate([a.first_symbols(), b.first_symbols()]), np.concatenate([a.next_rows(), b.next_rows() + n]), depth)
    symbols, places = np.concatenate([a.symbols, b.symbols]), np.concatenate([a.places, b.places + n])
    return Transform(symbols[order], places[order], a.n_strings + b.n_strings), shared


def repeated_intervals(shared: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first row, rows) of each maximal interval of several rows that share ``width`` symbols and more."""
    starts = np.flatnonzero(shared < width)
    sizes = np.diff(np.concatenate([starts, [len(shared)]]))
    return starts[sizes > 1], sizes[sizes > 1]


def repeated_windows(strings: list[bytes], width: int, shards: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(class, place) of every substring of ``width`` bytes that occurs more than once; places are in the joined strings, terminators included.

    Strings are dealt to the shards in turn, so that neighbours, which are likely to be alike, meet in merging.
    """
    own = joined(strings)[1] if strings else np.zeros(0, np.int64)
    strings = [*strings, *[b""] * (2 - len(strings))]
    shards = max(2, min(shards, len(strings)))
    dealt = [k for s in range(shards) for k in range(s, len(strings), shards)]
    parts, shared = [transform(strings[s::shards]) for s in range(shards)], np.zeros(0, np.int64)
    while len(parts) > 1:
        # Every merge but the last orders all suffixes, so that its outcome is a transform again.
        depth = width if len(parts) == 2 else max(map(len, strings)) + 1
        merged = [merge(parts[k], parts[k + 1], depth) for k in range(0, len(parts) - 1, 2)]
        shared = merged[0][1]
        parts = [m[0] for m in merged] + parts[len(merged) * 2 :]
    first, sizes = repeated_intervals(shared, width)
    rows = np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum())) if len(first) else first
    group, place = np.repeat(first, sizes), parts[0].places[rows]
    begins = joined([strings[k] for k in dealt])[1]
    at = np.searchsorted(begins, place, side="right") - 1
    return group, own[np.array(dealt)[at]] + place - begins[at] if len(place) else place
