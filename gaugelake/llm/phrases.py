"""Phrase collocation mining: passes over the texts as PCY and DHP make them.

Each pass counts the phrases of one length exactly, and hashes the next longer ones into a fixed number of buckets on the way. The next
pass is given two bitmaps of proven size: buckets that reached the least count, and (Apriori) the frequent phrases of the length before.
Only what passes both is counted exactly. Counts and bitmaps only prune: results don't depend on the number of buckets.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugelake.llm._shared import discard, materialize, salted_join, ship

#: No UTF-8 text holds this byte: it stands for the stops that end a piece.
END = b"\xff"
#: Letters become small, a stop :data:`END`, and a tab a space. No other white space that ``bytes.split`` knows is left then.
_STOPS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _STOPS + b"\t", b"abcdefghijklmnopqrstuvwxyz" + END * len(_STOPS) + b" ")
#: Words that a task looks at together (their numbers take 21 bits), and different phrases that it counts before it hands them on.
CHUNK, BITS, HELD = 1 << 20, 21, 500_000
#: Bytes of a long text that are cut into words at once.
WINDOW = 1 << 20
#: Buckets of a segment, the unit in which bucket counts travel.
SEGMENT = 1 << 14

_PARTS = "kind int, grp string, phrase binary, n long, segment int, data binary"
_PHRASE, _BUCKETS, _TOTAL = 0, 1, 2


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, with :data:`END` behind each piece, a window at a time. Windows end between words."""
    text, start = text.translate(_FOLD), 0
    while start < len(text):
        near = [p for p in (text.find(b" ", start + WINDOW, start + 2 * WINDOW), text.find(END, start + WINDOW, start + 2 * WINDOW)) if p >= 0]
        end = min(near, default=-1)
        if end < 0 and len(text) - start > 2 * WINDOW:  # a very long word
            end = min((p for p in (text.find(b" ", start + WINDOW), text.find(END, start + WINDOW)) if p >= 0), default=len(text))
        end = len(text) if end < 0 else end
        yield text[start:end].replace(END, b" " + END + b" ").split()
        start = end


class Names(dict):
    """Numbers of words, in order of their first use; 0 is :data:`END`."""

    def __init__(self) -> None:
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _mixed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The hash of a phrase and the word behind it."""
    x = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + w
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def word_hashes(words: Iterable[bytes], group: str) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    seed = xxh3_64_intdigest(group)
    return np.array([xxh3_64_intdigest(w, seed) for w in words], np.uint64)


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h ^ (h >> np.uint64(31))) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _has(bitmap: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (bitmap[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1 == 1


class Buckets:
    """Counts of a fixed number of buckets, each up to ``cap``: sums of capped counts still tell which reach it."""

    def __init__(self, bits: int, cap: int) -> None:
        self.counts, self.cap, self.bits = np.zeros(1 << bits, np.uint8), cap, bits

    def add(self, hashes: np.ndarray) -> None:
        at, n = np.unique(_bucket(hashes, self.bits), return_counts=True)
        self.counts[at] = np.minimum(self.counts[at] + n, self.cap)

    def segments(self) -> Iterator[tuple[int, bytes]]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        width = min(SEGMENT, len(self.counts))
        for k, part in enumerate(self.counts.reshape(-1, width)):
            if part.any():
                yield k, press.compress(part.tobytes())


def _batches(rows: list[tuple]) -> Iterator:
    import pyarrow as pa

    kinds = [pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
    names = [c.split()[0] for c in _PARTS.split(", ")]
    for i in range(0, len(rows), 100_000):
        columns = zip(*rows[i : i + 100_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


class Scan:
    """One task's share of the pass that counts phrases of ``length`` words."""

    def __init__(self, length: int, longest: int, bits: int, cap: int, frequent: bytes | None, reached: bytes | None) -> None:
        self.length, self.bits = length, bits
        self.frequent, self.reached = (None if b is None else np.frombuffer(b, np.uint8) for b in (frequent, reached))
        self.next = Buckets(bits, cap) if length < longest else None
        self.found: dict[str, dict[bytes, int]] = {}
        self.totals: Counter = Counter()
        self.held: dict[str, tuple[Names, list[np.ndarray]]] = {}
        self.size = 0

    def read(self, text: bytes, group: str) -> Iterator:
        for words in words_of(text):
            if self.size + len(words) >= CHUNK and END in words:  # a chunk ends with a piece
                cut = len(words) - words[::-1].index(END)
                self._take(words[:cut], group)
                yield from self.flush()
                words = words[cut:]
            self._take(words, group)
        self._take([END], group)

    def _take(self, words: list[bytes], group: str) -> None:
        if words:
            names, parts = self.held.setdefault(group, (Names(), []))
            parts.append(np.fromiter(map(names.__getitem__, words), np.int64, len(words)))
            self.size += len(words)

    def flush(self) -> Iterator:
        for group, (names, parts) in self.held.items():
            self._count(group, names, np.concatenate([*parts, np.zeros(1, np.int64)]))
        self.held, self.size = {}, 0
        if sum(map(len, self.found.values())) >= HELD:
            yield from self.handed()

    def handed(self) -> Iterator:
        yield from _batches([(_PHRASE, g, p, n, None, None) for g, found in self.found.items() for p, n in found.items()])
        self.found = {}

    def finished(self) -> Iterator:
        yield from self.flush()
        yield from self.handed()
        yield from _batches([(_TOTAL, g, None, n, None, None) for g, n in self.totals.items()])
        if self.next is not None:
            yield from _batches([(_BUCKETS, None, None, None, k, data) for k, data in self.next.segments()])

    def _count(self, group: str, names: Names, ids: np.ndarray) -> None:
        words = list(names)
        ends = np.flatnonzero(ids == 0)
        n, size = self.length, len(ids)
        if n == 1:
            self.totals[group] += size - len(ends)
        left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(size)  # words from here to the piece's end
        hashed = word_hashes(words, group)[ids] if n > 1 or self.next is not None else None
        # Hashes of phrases of 1 to n + 1 words at each place; those that run over a piece's end are never looked at.
        runs = [hashed]
        for k in range(1, n + (self.next is not None)):
            runs.append(_mixed(runs[-1][: max(size - k, 0)], hashed[k:]))
        at = np.flatnonzero(left >= n)
        if n > 1:
            known = _has(self.frequent, _bucket(runs[n - 2], self.bits))
            at = at[known[at] & known[at + 1]]
            at = at[_has(self.reached, _bucket(runs[n - 1][at], self.bits))]
        if self.next is not None:
            open_ = np.zeros(size + 1, bool)
            open_[at] = True
            longer = at[open_[at + 1] & (left[at] > n)]
            self.next.add(runs[n][longer])
        found = self.found.setdefault(group, {})
        if n == 1:
            times = np.bincount(ids[at], minlength=len(words)).tolist()
            phrases = words
        elif n <= 3 and len(words) < 1 << BITS:
            key = ids[at]
            for k in range(1, n):
                key = key << BITS | ids[at + k]
            key, times = np.unique(key, return_counts=True)
            parts = [[words[i] for i in (key >> BITS * k & (1 << BITS) - 1).tolist()] for k in range(n - 1, -1, -1)]
            phrases, times = list(map(b" ".join, zip(*parts, strict=True))), times.tolist()
        else:
            rows, times = np.unique(np.stack([ids[at + k] for k in range(n)], axis=1), axis=0, return_counts=True)
            phrases, times = [b" ".join(words[i] for i in row) for row in rows.tolist()], times.tolist()
        for phrase, t in zip(phrases, times, strict=True):
            if t:
                found[phrase] = found.get(phrase, 0) + t


def _bitmap(parts: DataFrame, bits: int, cap: int) -> bytes:
    """A bit for each bucket whose counts reach ``cap`` in sum, of rows (segment, data). A fixed 2 ** bits / 8 bytes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        width = min(SEGMENT, 1 << bits)

        def made(k: int, total: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(total >= cap).tobytes()], pa.binary())], ["segment", "data"])

        key, total = None, np.zeros(width, np.uint16)
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        yield made(key, total)
                    key, total = k, np.zeros(width, np.uint16)
                total = np.minimum(total + np.frombuffer(unpress.decompress(data), np.uint8), cap).astype(np.uint16)
        if key is not None:
            yield made(key, total)

    out = bytearray((1 << bits) // 8)
    each = min(SEGMENT, 1 << bits) // 8
    # Segments stream through a task in order, so it holds one of them whatever their number.
    for row in parts.select("segment", "data").repartition("segment").sortWithinPartitions("segment").mapInArrow(run, "segment int, data binary").collect():
        out[row.segment * each : (row.segment + 1) * each] = row.data
    return bytes(out)


def _frequent_bitmap(frequent: DataFrame, bits: int) -> bytes:
    """A bit for each bucket that holds one of the phrases (grp, phrase)."""

    def run(batches: Iterator) -> Iterator:
        buckets = Buckets(bits, 1)
        for batch in batches:
            hashes = []
            for group, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first, *rest = word_hashes(phrase.split(b" "), group)[:, None]
                for w in rest:
                    first = _mixed(first, w)
                hashes.append(first)
            if hashes:
                buckets.add(np.concatenate(hashes))
        yield from _batches([(_BUCKETS, None, None, None, k, data) for k, data in buckets.segments()])

    ship(frequent.sparkSession)
    return _bitmap(frequent.select("grp", "phrase").mapInArrow(run, _PARTS), bits, 1)


def _pass(texts: DataFrame, length: int, longest: int, bits: int, cap: int, frequent: bytes | None, reached: bytes | None) -> tuple[DataFrame, str]:
    """The tasks' counts of one pass, as a table."""
    sc = texts.sparkSession.sparkContext
    maps: list[Broadcast] = [sc.broadcast(b) for b in (frequent, reached)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scan = Scan(length, longest, bits, cap, *[m.value for m in maps])
        for batch in batches:
            for group, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                yield from scan.read(text.as_py(), group)
        yield from scan.finished()

    ship(texts.sparkSession)
    made = materialize(texts.mapInArrow(run, _PARTS), f"phrases{length}")
    for m in maps:
        m.unpersist()
    return made


def mine_phrases(
    docs: DataFrame, text_col: str = "text", group_col: str = "lang", *, max_words: int = 3, min_count: int = 10, covered: int = 50, top: int = 2000, bucket_bits: int = 25
) -> DataFrame:
    """(group_col, rank, phrase, a, l, r, n, score): the best phrases of 2 to ``max_words`` words of each group (null: und).

    Texts are lower-cased in A-Z and cut into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs. a counts a phrase's places,
    overlaps included, and is ``min_count`` at least; n counts the group's words. A cut after the first words has l and r places of either part
    and the score floor(1,000,000 a a / (l r)); the cut with the least score counts, of equal ones the first. A phrase that stands in a longer
    one with ``covered`` percent of its places or more is left out. Exact: decimals of 38 digits, up to 10 ** 16 places.

    Null and empty texts have no words; a text's length is free (it is cut into words piece by piece); repeated rows count again; no text gives no row.
    Other columns are not read. ``bucket_bits``: the bitmaps' size is 2 ** bits / 8 bytes (4 MB); more of them prune better, results stay the same.
    """
    cap = min(min_count, 255)
    texts = docs.select(F.coalesce(F.col(f"`{group_col}`").cast("string"), F.lit("und")).alias("grp"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")
    tables, frequent, reached, total = [], None, None, None
    for length in range(1, max_words + 1):
        parts, path = _pass(texts, length, max_words, bucket_bits, cap, frequent, reached)
        counted = parts.where(F.col("kind") == _PHRASE).groupBy("grp", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
        counted, _ = materialize(counted, "frequent")
        tables.append(counted.withColumn("words", F.lit(length)))
        if length == 1:
            total, _ = materialize(parts.where(F.col("kind") == _TOTAL).groupBy("grp").agg(F.sum("n").alias("total")), "totals")
        if length < max_words:
            frequent, reached = _frequent_bitmap(counted, bucket_bits), _bitmap(parts.where(F.col("kind") == _BUCKETS), bucket_bits, cap)
        discard(path)
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    every = every.withColumn("phrase", F.col("phrase").cast("string"))

    candidates = every.where("words >= 2").withColumnRenamed("n", "a")
    words = F.split("phrase", " ")
    part = lambda start, size: F.array_join(F.slice(words, start, size), " ")
    cut = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), part(1, k).alias("head"), part(k + 1, F.col("words") - k).alias("tail")))
    cuts = candidates.select("grp", "phrase", "words", "a", F.explode(cut).alias("c")).select("grp", "phrase", "words", "a", "c.*")
    shorter = every.where(F.col("words") < max_words)
    # Many phrases share their first or last word: salted. Each is one row, however often it stands, so a few salts do.
    cuts = salted_join(cuts, shorter.select("grp", F.col("phrase").alias("head"), F.col("n").alias("l")), ["grp", "head"], salts=4)
    cuts = salted_join(cuts, shorter.select("grp", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["grp", "tail"], salts=4)
    wide = lambda c: f"cast({c} AS decimal(16, 0))"
    scored = cuts.withColumn("score", F.expr(f"(1000000 * ({wide('a')} * {wide('a')})) div ({wide('l')} * {wide('r')})"))
    best = scored.groupBy("grp", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("grp", "phrase", "words", "a", "b.score", "b.l", "b.r")

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda s: part(s, k))))
    longer = candidates.where("words >= 3").select("grp", F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy("grp", "phrase").agg(F.max("longer").alias("longer"))
    left = best.join(longer, ["grp", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))
    place = Window.partitionBy("grp").orderBy(F.desc("score"), F.desc("a"), "phrase")  # each task hands on its first ``top`` rows alone
    ranked = left.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top).join(total, "grp")
    return ranked.select(F.col("grp").alias(group_col), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), F.col("score").cast("long").alias("score"))
