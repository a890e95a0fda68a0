"""Substring dedup by sliding spans of sentences, for any text: with long sentences, short ones, or none.

A text is cut into sentences, and a sentence of so many words that a passage might not hold two such once more: before its winnowed words (the least hash of some stretch of words, so equal
passages are cut alike wherever they stand). Every run of consecutive sentences that has enough words is hashed; a text without any such
run is one itself. Of equal runs in the corpus all but the first go.

Runs are hashed twice, with 64 bits each, and travel in compressed arrays by bucket of their hash. Of runs that a batch of documents holds several times
the first is sent and the others are known to go, so a passage costs one entry for each batch that holds it, however often it occurs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelake.llm._shared import materialize, ship
from gaugelake.llm.buckets import by_bucket, dealt, edges_of, packed, unpacked

#: Stops that end a word and a sentence without white space behind them.
WIDE_STOPS = "。！？、，；：…؟।"
_WORD = re.compile(rf"[^ \t-\r{WIDE_STOPS}]*[{WIDE_STOPS}]|[^ \t-\r{WIDE_STOPS}]+")
_WIDE = [s.encode() for s in WIDE_STOPS]
_STOPS = (b".", b"!", b"?", *_WIDE)
#: Odd, hence invertible modulo 2^64.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MOST_WORDS = 1 << 17
#: Bytes of input for each partition of the shuffle, and buckets in each of them; documents handled together.
PART_BYTES, BUCKETS, BATCH_DOCS = 32_000_000, 4, 4096
#: Stands for a null id, which is the last.
_LAST = (1 << 63) - 1


class _Hashes(dict):
    """64 bits of md5 of each word; of the last four, which order nothing, the last one tells whether the word ends a sentence."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MOST_WORDS:
            self.clear()
        h = int.from_bytes(hashlib.md5(word, usedforsecurity=False).digest()[:8], "big")
        self[word] = h = h & ~1 | word.endswith(_STOPS)
        return h


_hashes = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def words_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, place behind the last word of each sentence)."""
    data, hashes, ends = text.encode(), [], []
    for stop in _WIDE:
        if stop in data:
            data = data.replace(stop, stop + b"\n")
    for line in data.split(b"\n"):
        hashes += map(_hashes.__getitem__, line.split())
        ends.append(len(hashes))
    h = np.array(hashes, np.uint64)
    return h, np.union1d(np.flatnonzero(h & np.uint64(1)) + 1, [e for e in ends if e]).astype(np.int64)


def winnowed(h: np.ndarray, stretch: int) -> np.ndarray:
    """For each stretch of so many words the place of its last least hash (by the upper 60 bits); empty where there is none."""
    n = len(h)
    if n < stretch:
        return np.zeros(0, np.int64)
    least, at, width = h >> np.uint64(4), np.arange(n), 1
    while width < stretch:
        step = min(width, stretch - width)
        later = least[step:] <= least[:-step]
        least, at, width = np.where(later, least[step:], least[:-step]), np.where(later, at[step:], at[:-step]), width + step
    return at


def units_of(h: np.ndarray, ends: np.ndarray, long: int, stretch: int) -> np.ndarray:
    """Place behind the last word of each unit: sentences, those of over ``long`` words cut before their winnowed words."""
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    if not (sizes > long).any():
        return ends
    of = np.repeat(np.arange(len(ends)), sizes)  # the sentence of each word
    first = np.arange(max(0, len(h) - stretch + 1))
    whole = (of[first] == of[first + stretch - 1]) & (sizes[of[first]] > long)
    return np.union1d(ends, np.setdiff1d(winnowed(h, stretch)[whole], [0]))


def runs_of(n: int, units: np.ndarray, run: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) in words of each run of ``run`` units and more, as few as have ``min_words`` words; of a text without one, the whole text."""
    starts = np.concatenate([[0], units[:-1]])
    last = np.maximum(np.arange(len(units)) + run - 1, np.searchsorted(units, starts + min_words))
    ok = last < len(units)
    if not ok.any():
        return np.zeros(1, np.int64), np.full(1, n)
    return starts[ok], units[last[ok]]


_powers_of: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """Powers 0 to ``n`` modulo 2^64; those of common lengths are kept."""
    if n >= len(_powers_of.get(base, ())):
        out = np.full(max(n + 1, 1 << 12), base, np.uint64)
        out[0] = 1
        out = out.cumprod(dtype=np.uint64)
        if n >= 1 << 16:
            return out
        _powers_of[base] = out
    return _powers_of[base][: n + 1]


def run_hashes(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Two hashes of words a to b, wherever they stand."""
    n, mixed, size, out = len(h), _mixed(h), _mixed((b - a).astype(np.uint64)), []
    for base in _BASES:
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed * _powers(base, n)[:n], out=total[1:])
        out.append(_mixed((total[b] - total[a]) * _powers(pow(base, -1, 1 << 64), n)[a] ^ size))
    return out


def left_of(text: str, gone: np.ndarray) -> tuple[str, int, int]:
    """(text left, words removed, stretches of removed words) without the ranges ``gone`` of words (start * 2^32 + size)."""
    places = [m.start() for m in _WORD.finditer(text)]
    a, n = gone >> 32, len(places)
    b = a + (gone & 0xFFFFFFFF)
    mark = np.cumsum(np.bincount(a, minlength=n + 1) - np.bincount(b, minlength=n + 1))[:n] > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mark, [False]]).astype(np.int8)))
    cuts = [0 if e == 0 else len(text) if e == n else places[e] for e in edges.tolist()]
    kept = "".join(text[x:y] for x, y in zip([0, *cuts[1::2]], [*cuts[::2], len(text)], strict=True))
    return kept, int(mark.sum()), len(edges) // 2


def _later(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first of each set of equal runs, by document and start; all that are not at the first's place). Most runs have no equal: only the others are sorted in full."""
    order = np.argsort(h1, kind="stable")
    sizes = np.diff(np.concatenate([edges_of(h1[order]), [len(order)]]))
    several = np.repeat(sizes > 1, sizes)
    alone, some = order[~several], order[several]
    some = some[np.lexsort((start[some], key[some], doc[some], h2[some], h1[some]))]
    heads = edges_of(h1[some], h2[some])
    first = some[np.repeat(heads, np.diff(np.concatenate([heads, [len(some)]])))]
    other = (doc[some] != doc[first]) | (key[some] != key[first]) | (start[some] != start[first])
    return np.concatenate([alone, some[heads]]), some[other]


_COLUMNS = ["bucket", "h1", "h2", "ids", "keys", "starts", "sizes"]


def _sent(texts: DataFrame, buckets: int, run: int, min_words: int, long: int, stretch: int) -> DataFrame:
    """Runs of each batch by bucket; in rows of a negative bucket those that an earlier one in the batch equals. Of rows (id, key, text)."""

    def rows_of(arrays: list[np.ndarray], bucket: np.ndarray) -> list[tuple]:
        return [(b, *packed(arrays[0][at], arrays[1][at], np.diff(arrays[2][at], prepend=0), arrays[3][at], arrays[4][at].astype(np.int32), arrays[5][at].astype(np.int32))) for b, at in dealt(bucket)]

    def out(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in (b.slice(k, BATCH_DOCS) for b in batches for k in range(0, b.num_rows, BATCH_DOCS)):
            found = [[] for _ in range(6)]
            ids, keys = (batch.column(c).to_numpy() for c in (0, 1))
            for k, text in enumerate(batch.column(2).to_pylist()):
                h, ends = words_of(text)
                if not len(h):
                    continue
                a, b = runs_of(len(h), units_of(h, ends, long, stretch), run, min_words)
                for held, x in zip(found, (*run_hashes(h, a, b), np.full(len(a), ids[k]), np.full(len(a), keys[k]), a, b - a), strict=True):
                    held.append(x)
            if not found[0]:
                continue
            arrays = [np.concatenate(x) for x in found]
            first, later = _later(*arrays[:5])
            by = np.lexsort((arrays[3][later], arrays[2][later]))
            later, first = later[by], np.sort(first)
            known = [x[later] for x in arrays]
            known[0] = known[1] = np.zeros(0, np.uint64)
            rows = rows_of([x[first] for x in arrays], (arrays[0][first] % np.uint64(buckets)).astype(np.int64))
            if len(later):
                none = packed(np.zeros(0, np.uint64))[0]
                rows.append((-1 - int(known[3][0]) % buckets, none, none, *packed(np.diff(known[2], prepend=0), known[3], known[4].astype(np.int32), known[5].astype(np.int32))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[c] for r in rows], pa.binary()) for c in range(1, 7))], _COLUMNS)

    return texts.mapInArrow(out, "bucket long, " + ", ".join(f"{c} binary" for c in _COLUMNS[1:]))


def _gone(sent: DataFrame) -> DataFrame:
    """(id, key, start, size) of every run with an equal, earlier one; rows come in order of their bucket."""

    def out(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for bucket, rows in by_bucket(batches, 7):
            h1, h2, ids, keys, starts, sizes = (np.concatenate(x) for x in zip(*((unpacked(r[0], "u8"), unpacked(r[1], "u8"), np.cumsum(unpacked(r[2], "i8")), unpacked(r[3], "i8"), unpacked(r[4], "i4"), unpacked(r[5], "i4")) for r in rows), strict=True))
            if bucket >= 0:
                _, at = _later(h1, h2, ids, keys, starts)
                ids, keys, starts, sizes = ids[at], keys[at], starts[at], sizes[at]
            for k in range(0, len(ids), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in (ids, keys, starts, sizes)], ["id", "key", "start", "size"])

    return sent.mapInArrow(out, "id long, key long, start int, size int")


def dedup_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, run: int = 2, min_words: int = 20, long: int = 16, stretch: int = 16
) -> DataFrame:
    """Each row of ``docs`` as the struct ``row``, with ``text`` (what is left), n_removed_words, n_spans.

    A sentence ends behind a word with a stop (. ! ? or one of other scripts), or at a line feed; those of over ``long`` words are cut before winnowed words, the
    least in a stretch of ``stretch``. A span is a run of ``run`` and more consecutive such units, as few as have ``min_words`` words together; a
    text without one is a span as a whole. Spans are compared by their words, by two 64-bit hashes. Of equal spans the first (least id, null last, then place)
    stays; the words of every other one go, with the white space behind them. No unit has over 16 words, so a passage of 51 words that stands elsewhere, less
    15 at either end in units that it doesn't fill, has 21 in whole units: a full span, whatever its stops. Of equal texts one stays. n_spans counts stretches of removed words.

    Ids are integers. A null text stays null; rows equal in id and text are treated alike; texts of any length are taken whole; other columns
    of any name stay in ``row``; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text, name = F.col(f"`{text_col}`"), F.col(f"`{id_col}`").cast("long")
    keys: list[Column] = [F.coalesce(name, F.lit(_LAST)).alias("id"), F.xxhash64(text, F.lit(11), name).alias("key")]
    slim = docs.where(text.isNotNull()).select(*keys, text.alias("text"))
    size = slim.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    sent = _sent(slim, BUCKETS * parts, run, min_words, long, stretch)
    later = _gone(sent.repartition(parts, "bucket").sortWithinPartitions("bucket"))
    span = F.shiftleft(F.col("start").cast("long"), 32) + F.col("size")
    gone, _ = materialize(later.groupBy("id", "key").agg(F.collect_set(span).alias("gone")), "gone")  # a document's own spans

    @F.arrow_udf("text string, n_removed_words long, n_spans long")
    def applied(texts, gone):
        import pyarrow as pa

        rows = [(None, 0, 0) if t is None else left_of(t.as_py(), g.values.to_numpy()) for t, g in ((t if t.is_valid else None, g) for t, g in zip(texts, gone, strict=True))]
        columns = zip(*rows, strict=True) if rows else [[]] * 3
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["text", "n_removed_words", "n_spans"])

    whole = docs.select(row, *keys, text.alias("text")).join(gone, ["id", "key"], "left")
    cut = whole.select("row", "text", "gone", applied(F.when(F.col("gone").isNotNull(), F.col("text")), "gone").alias("left"))  # other texts stay where they are
    kept = F.when(F.col("gone").isNotNull(), F.col("left.text")).otherwise(F.col("text"))
    return cut.select("row", kept.alias("text"), "left.n_removed_words", "left.n_spans")
