"""Exact substring dedup: bytes covered by a string of ``width`` bytes that also starts earlier in the corpus.

Every window of ``width`` bytes is assigned to the anchor in it: its leftmost least hash of ``gram`` bytes. Equal windows have equal anchors,
so windows whose anchor's hash occurs once in the corpus are settled after one shuffle of bare hashes. For the others, an anchor's consecutive windows
travel as one string (their union) to the bucket of its hash. The distinct strings of a bucket's anchors are a collection in shards: each shard has its
Burrows-Wheeler transform, transforms are merged by refining their interleave, and the intervals of rows with ``width`` symbols in common are the
repeated windows; all but the earliest start of each go.

Both shuffles are combined before they start: of hashes (and strings) that a batch of documents holds several times one is sent, and what that
already says about the others goes straight to their documents. So a passage costs a row for each batch that holds it, however often it occurs.
Buckets grow in number with the bytes of the input and are handled one after another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.llm._shared import discard, materialize, ship
from gaugelake.llm.buckets import by_bucket, dealt, packed, unpacked
from gaugelake.llm.bwt import joined, repeated_windows
from gaugelake.llm.shingles import mix, powers, prefix_sums

#: Bytes of texts whose anchors are found together, and documents whose anchors make one row for each bucket.
GROUP_BYTES, CHUNK_DOCS = 2_000_000, 4096
#: Bytes of a collection whose transforms are merged at a time; anchors of one hash are never parted.
COLLECTION_BYTES, SHARD_BYTES = 1_500_000, 750_000
#: Bytes of input for each partition of the shuffles, and buckets in each of them.
PART_BYTES, BUCKETS = 16_000_000, 8


def anchors(texts: list[bytes], width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, place of the anchor, first and last window start that it is the anchor of, hash) of every anchor of the texts of ``width`` bytes and more."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    if len(data) < width:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    sums = prefix_sums(data)
    n = len(data) - gram + 1
    hashes = mix((sums[gram:] - sums[:-gram]) * powers(n, True))
    # The least (hash, place) of each window: by its upper bits the hash, in its lower bits the place.
    bits = np.uint64(max(1, n - 1).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = (hashes & ~low) | np.arange(n, dtype=np.uint64)
    span, least, size = width - gram + 1, key, 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    place = (least & low).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(begins))[: len(place)]
    inside = np.arange(len(place)) + width <= begins[text + 1]
    start, place, text = np.flatnonzero(inside), place[inside], text[inside]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])])) if len(place) else np.zeros(0, np.int64)
    last = np.concatenate([new[1:], [len(place)]])[: len(new)] - 1
    text = text[new]
    return text, place[new] - begins[text], start[new] - begins[text], start[last] - begins[text], hashes[place[new]]


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= GROUP_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of intervals."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.concatenate([[True], starts[1:] > ends[:-1]]) if len(starts) else np.zeros(0, bool)
    return starts[new], ends[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(ends) - 1]])] if len(starts) else ends


def _spans_by_doc(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Arrow rows (doc_id, starts and ends of its spans)."""
    import pyarrow as pa

    order = np.argsort(docs, kind="stable")
    docs, starts, ends = docs[order], starts[order], ends[order]
    edges = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, np.int64)
    rows = [(int(docs[a]), *(x.astype(np.int64) for x in _merged(starts[a:b], ends[a:b]))) for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(docs)])]
    columns = [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[c] for r in rows], pa.list_(pa.int64())) for c in (1, 2))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "starts", "ends"])


def _groups_of(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by hash, whether a new hash starts at each place of it, how often the hash at each place occurs)."""
    order = np.argsort(hashed, kind="stable")
    new = np.concatenate([[True], hashed[order][1:] != hashed[order][:-1]]) if len(order) else np.zeros(0, bool)
    edges = np.flatnonzero(new)
    times = np.diff(np.concatenate([edges, [len(order)]]))
    return order, new, np.repeat(times, times)


def _places_by_doc(doc: np.ndarray, place: np.ndarray) -> list[tuple[int, bytes]]:
    order = np.argsort(doc, kind="stable")
    doc, place = doc[order], place[order].astype(np.int32)
    edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    return [(int(doc[a]), place[a:b].tobytes()) for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(doc)])]


def _bare_hashes(texts: DataFrame, width: int, gram: int, buckets: int) -> DataFrame:
    """(bucket, hashes, docs, places, several): anchors of each chunk of documents, dealt by hash; of those that the chunk holds several times
    the first, marked. In rows of a negative bucket, docs and places of all the others and of the first: these are known to repeat."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["bucket", "hashes", "docs", "places", "several"]
        for batch in batches:
            for k in range(0, batch.num_rows, CHUNK_DOCS):
                part = batch.slice(k, CHUNK_DOCS)
                docs, texts = np.array(part.column(0).to_pylist(), np.int64), [t.encode() for t in part.column(1).to_pylist()]
                found = []
                for a, b in _groups(texts):
                    text, place, _, _, hashed = anchors(texts[a:b], width, gram)
                    found.append((docs[a:b][text], place.astype(np.int32), hashed))
                doc, place, hashed = (np.concatenate(x) for x in zip(*found, strict=True))
                order, new, times = _groups_of(hashed)
                known = np.sort(order[times > 1])
                sent, several = order[new], (times > 1)[new]
                back = np.argsort(sent, kind="stable")
                sent, several = sent[back], several[back].astype(np.uint8)
                rows = [(bucket, *packed(hashed[sent[at]], np.diff(doc[sent[at]], prepend=0), place[sent[at]], several[at])) for bucket, at in dealt((hashed[sent] % np.uint64(buckets)).astype(np.int64))]
                if len(known):
                    none = packed(np.zeros(0, np.uint64), np.zeros(0, np.uint8))
                    at = known[np.argsort(doc[known], kind="stable")]
                    rows.append((-1 - int(doc[known[0]]) % buckets, none[0], *packed(np.diff(doc[at], prepend=0), place[at]), none[1]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[c] for r in rows], pa.binary()) for c in (1, 2, 3, 4))], names)

    return texts.mapInArrow(run, "bucket long, hashes binary, docs binary, places binary, several binary")


def _repeated_anchors(dealt: DataFrame) -> DataFrame:
    """(doc_id, places): anchors whose hash occurs twice or more, for each document and bucket; rows come in order of their bucket."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for bucket, rows in by_bucket(batches, 5):
            hashed, doc, place, several = (np.concatenate(x) for x in zip(*((unpacked(h, "u8"), np.cumsum(unpacked(d, "i8")), unpacked(p, "i4"), unpacked(s, "u1")) for h, d, p, s in rows), strict=True))
            if bucket >= 0:
                order, new, times = _groups_of(hashed)
                marked = np.maximum.reduceat(several[order], np.flatnonzero(new)) if len(order) else several
                repeats = (times > 1) | (np.repeat(marked, np.diff(np.concatenate([np.flatnonzero(new), [len(order)]]))) > 0)
                tell = order[repeats & (several[order] == 0)]
                doc, place = doc[tell], place[tell]
            told = _places_by_doc(doc, place)
            for k in range(0, len(told), 10_000):
                some = told[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in some], pa.int64()), pa.array([p for _, p in some], pa.binary())], ["doc_id", "places"])

    return dealt.mapInArrow(run, "doc_id long, places binary")


def _strings(rows: DataFrame, width: int, gram: int, buckets: int) -> DataFrame:
    """(bucket, hashes, docs, starts, lengths, offsets, strings): the windows of every repeated anchor as one string; of rows (doc_id, text, places).

    Of equal strings in a batch the earliest is sent. The others' windows are known to go: docs, starts and lengths in rows of a negative bucket.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["bucket", "hashes", "docs", "starts", "lengths", "offsets", "strings"]
        for batch in batches:
            order = np.argsort(np.array(batch.column(0).to_pylist(), np.int64), kind="stable")
            batch = batch.take(pa.array(order))  # the earliest comes first
            docs, places = np.array(batch.column(0).to_pylist(), np.int64), batch.column(2).to_pylist()
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            seen: set[tuple] = set()
            for a, b in _groups(texts):
                some = texts[a:b]
                text, place, first, last, hashed = anchors(some, width, gram)
                base = np.concatenate([[0], np.cumsum([len(t) for t in some])])
                listed = np.concatenate([np.concatenate([np.frombuffer(x, np.int32) for x in ps]).astype(np.int64) + base[i] for i, ps in enumerate(places[a:b])])
                chosen = np.isin(place + base[text], listed)
                text, first, last, hashed, offset = text[chosen], first[chosen], last[chosen], hashed[chosen], (place - first)[chosen]
                lengths, new, held = last - first + width, np.ones(len(text), bool), []
                for k, (t, x, size, h, o) in enumerate(zip(text.tolist(), first.tolist(), lengths.tolist(), hashed.tolist(), offset.tolist(), strict=True)):
                    key = (h, o, some[t][x : x + size])
                    held.append(key[2])
                    if key in seen:
                        new[k] = False
                    else:
                        seen.add(key)
                rows, sent, late = [], np.flatnonzero(new), np.flatnonzero(~new)
                for bucket, at in dealt((hashed[sent] % np.uint64(buckets)).astype(np.int64)):
                    at = sent[at]
                    parts = b"".join(held[k] for k in at.tolist())
                    rows.append((bucket, *packed(hashed[at], np.diff(docs[a:b][text[at]], prepend=0), first[at].astype(np.int32), lengths[at].astype(np.int32), offset[at].astype(np.int32)), packed(np.frombuffer(parts, np.uint8))[0]))
                if len(late):
                    none = packed(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint8))
                    rows.append((-1 - int(docs[a + text[late[0]]]) % buckets, none[0], *packed(np.diff(docs[a:b][text[late]], prepend=0), first[late].astype(np.int32), lengths[late].astype(np.int32)), *none[1:]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[c] for r in rows], pa.binary()) for c in range(1, 7))], names)

    return rows.mapInArrow(run, "bucket long, hashes binary, docs binary, starts binary, lengths binary, offsets binary, strings binary")


def _later_windows(dealt: DataFrame, width: int) -> DataFrame:
    """(doc_id, starts, ends): spans of all windows that have an equal, earlier one; rows come in order of their bucket."""

    def bucket_of(rows: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        first: dict[tuple, tuple[int, int]] = {}  # (hash, offset, string): least (document, start)
        late: list[tuple[int, int, int]] = []
        for row in rows:
            hashed, docs, starts, lengths, offsets = (unpacked(x, k) for x, k in zip(row[:5], ("u8", "i8", "i4", "i4", "i4"), strict=True))
            data, at = unpacked(row[5], "u1").tobytes(), 0
            for h, doc, start, length, offset in zip(hashed.tolist(), np.cumsum(docs).tolist(), starts.tolist(), lengths.tolist(), offsets.tolist(), strict=True):
                key, mine = (h, offset, data[at : at + length]), (doc, start)
                at += length
                known = first.setdefault(key, mine)
                if mine < known:
                    first[key] = mine
                    late.append((*known, known[1] + length))
                elif mine > known:
                    late.append((*mine, start + length))
        if late:
            yield tuple(np.array(late, np.int64).T)
        several: dict[int, int] = {}
        for h, _, _ in first:
            several[h] = several.get(h, 0) + 1
        left = sorted((k for k in first if several[k[0]] > 1), key=lambda k: k[0])
        at = 0
        while at < len(left):
            stop, size = at, 0
            while stop < len(left) and (size < COLLECTION_BYTES or left[stop][0] == left[stop - 1][0]):
                size += len(left[stop][2])
                stop += 1
            yield _later_in(left[at:stop], first, width)
            at = stop

    def run(batches: Iterator) -> Iterator:
        for bucket, rows in by_bucket(batches, 7):
            if bucket < 0:
                docs, starts, lengths = np.cumsum(unpacked(rows[0][1], "i8")), unpacked(rows[0][2], "i4").astype(np.int64), unpacked(rows[0][3], "i4")
                yield _spans_by_doc(docs, starts, starts + lengths)
            elif out := list(bucket_of(rows)):
                yield _spans_by_doc(*(np.concatenate(x) for x in zip(*out, strict=True)))

    return dealt.mapInArrow(run, "doc_id long, starts array<long>, ends array<long>")


def _later_in(keys: list[tuple], first: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, starts, ends) of windows of these strings that are not the earliest of their equals."""
    strings = [k[2] for k in keys]
    group, place = repeated_windows(strings, width, -(-sum(map(len, strings)) // SHARD_BYTES))
    _, begins = joined(strings)
    string = np.searchsorted(begins, place, side="right") - 1
    where = np.array([first[k] for k in keys], np.int64)
    doc, start = where[string, 0], where[string, 1] + place - begins[string]
    order = np.lexsort((start, doc, group))
    group, doc, start = group[order], doc[order], start[order]
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    of = np.repeat(head, np.diff(np.concatenate([head, [len(group)]])))
    later = (doc != doc[of]) | (start != start[of])
    return doc[later], start[later], start[later] + width


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 100, gram: int = 32) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, starts, ends, kept) for each row of ``docs``.

    Texts as UTF-8; a byte goes when a string of ``width`` bytes covers it that also starts earlier: in a document of a smaller id, or in
    the same one before. Strings are judged on the input. starts and ends: maximal removed runs; kept: the remaining bytes.
    Null texts are empty. Rows of a null id stay whole and make nothing else go. Ids name documents: rows that share an id should share
    their text, and are then treated alike; where they don't, spans end with the text. Texts of under ``width`` bytes stay whole; an empty table gives
    an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    long_enough = texts.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= width))
    size = long_enough.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    buckets = BUCKETS * parts
    hashes = _bare_hashes(long_enough, width, gram, buckets).repartition(parts, "bucket").sortWithinPartitions("bucket")
    repeated = _repeated_anchors(hashes).groupBy("doc_id").agg(F.collect_list("places").alias("places"))  # a document's own anchors
    repeated, _ = materialize(repeated, "anchors")
    strings = _strings(long_enough.join(repeated, "doc_id").select("doc_id", "text", "places"), width, gram, buckets)
    spans = _later_windows(strings.repartition(parts, "bucket").sortWithinPartitions("bucket"), width)
    spans = spans.groupBy("doc_id").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))  # a document's own spans
    spans, _ = materialize(spans, "spans")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                data = (text or "").encode()
                if not starts:
                    rows.append((len(data), 0, 0, [], [], data))
                    continue
                a, b = (x.tolist() for x in _merged(np.array(starts, np.int64), np.array(ends, np.int64)))
                pairs = [(x, min(y, len(data))) for x, y in zip(a, b, strict=True) if x < len(data)]
                edges = [0, *(e for p in pairs for e in p), len(data)]
                kept = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(data), len(data) - len(kept), len(pairs), [p[0] for p in pairs], [p[1] for p in pairs], kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "starts", "ends", "kept"])

    whole = texts.join(spans, "doc_id", "left").select("doc_id", "text", "starts", "ends")
    return whole.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, starts array<long>, ends array<long>, kept binary")
