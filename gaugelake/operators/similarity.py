"""Nearest neighbours of bit sets, kept as arrays of set bits.

Rows on either side fall into blocks; a block of queries meets a span of blocks in one group as words of 64 bits, whose shared bits are counted a strip at a time, and
only the best of each query leave the group. So no pair of rows is ever a row of a table, and a task holds a block, a span and a strip whatever the tables' size. Within a
strip the greatest counts of runs of columns bound what a query's best can be, and only counts that reach it are looked at one by one.

Blocks hold rows of like size (number of set bits). A first round compares each block of queries with the blocks of ``train`` nearest in size and leaves a lower bound
of the k-th best score; a second round skips every pair of blocks whose sizes, and whose unions of bits, can't reach it. The answers are those of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugelake.operators.ranks import places
from gaugelake.tables import large, small, written

#: Rows of a block; blocks of dense vectors hold a quarter.
BLOCK = 16384
#: Pairs whose distances are held at once, runs whose greatest counts are, and pairs whose common words are; columns that these span.
STRIP, RUNS, WORDS, ACROSS = 1 << 20, 1 << 16, 1 << 16, 1 << 13
#: Most rows, and bytes of their words, of a span of blocks; least tiles that a search is cut into.
SPAN, SPAN_BYTES, TILES = 1 << 18, 1 << 26, 96
#: Most bits of a set whose subsets are listed, and what a subset costs, in comparisons of two rows.
SUBSETS, SUBSET_COST = 12, 500
#: Tasks that share a mask of 64 bits.
MASK = 60


def set_bits(vector: Column, threshold: float) -> Column:
    """Places of the components above a single-precision threshold."""
    above = F.transform(vector, lambda x, i: F.when(x > F.lit(threshold).cast("float"), i))
    return F.filter(above, lambda i: i.isNotNull())


def with_words(df: DataFrame, words: int, more: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """``df`` with ``packed``: its ``bits`` as so many words of 64 bits. more: other columns by the lists that they come from, with their words."""
    made = {"packed": ("bits", words)} | {name: (bits, n) for bits, (name, n) in (more or {}).items()}

    def packed(column, words: int):
        import pyarrow as pa

        wide, size, n, parts = 64 * words, 8 * words, len(column), []
        step = max(1, (1 << 24) // wide)
        for at in range(0, n, step):
            piece = column.slice(at, step)
            lengths = np.diff(piece.offsets.to_numpy())
            flat = np.zeros((len(piece), wide), np.uint8)
            flat[np.repeat(np.arange(len(piece)), lengths), piece.flatten().to_numpy(zero_copy_only=False)] = 1
            parts.append(np.packbits(flat, axis=1, bitorder="little"))
        data = np.concatenate(parts) if parts else np.zeros((0, size), np.uint8)
        offsets = np.arange(0, (n + 1) * size, size, dtype=np.int32)
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            new = [packed(batch.column(batch.schema.get_field_index(bits)), n) for bits, n in made.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *made])

    return df.mapInArrow(pack, df.withColumns({name: F.lit(None).cast("binary") for name in made}).schema)


def _words(packed) -> np.ndarray:
    """Rows of words from values of ``packed``."""
    return np.frombuffer(b"".join(packed), np.uint64).reshape(len(packed), -1)


def _sizes(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=1, dtype=np.int64)


def _shared(left: np.ndarray, right: np.ndarray, more: int = 0) -> np.ndarray:
    """Bits that each row of ``left`` shares with each column of ``right`` (words by rows), plus ``more``, in the least type that holds them."""
    kind = np.uint8 if 64 * len(right) + more < 256 else np.uint16 if 64 * len(right) + more < 65536 else np.uint32
    out = np.full((len(left), right.shape[1]), more, kind)
    for w in range(len(right)):
        out += np.bitwise_count(left[:, w, None] & right[w])
    return out


def _score(both: np.ndarray, nq: np.ndarray, nt: np.ndarray, measure: str = "tanimoto") -> np.ndarray:
    """Similarity of sets of sizes ``nq`` and ``nt`` that share ``both``; 0 where neither has a bit. Cosines to 12 places."""
    both = both.astype(np.float64)
    under = (nq + nt - both) if measure == "tanimoto" else np.sqrt(nq.astype(np.float64) * nt)
    score = np.divide(both, under, out=np.zeros_like(both), where=under > 0)
    return np.round(score, 12) if measure == "cosine" else score


def _by_size(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]], np.ndarray]:
    """(places in order of size, words by rows in that order, where each size starts and ends, those sizes)."""
    sizes = _sizes(words)
    order = np.argsort(sizes, kind="stable")
    found, starts = np.unique(sizes[order], return_index=True)
    ends = [*starts[1:].tolist(), len(order)]
    return order, np.ascontiguousarray(words[order].T), list(zip(starts.tolist(), ends, strict=True)), found


def _distinct(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different rows, which of them each row is)."""
    if words.shape[1] == 1:
        found, which = np.unique(words[:, 0], return_inverse=True)
        return found[:, None], which
    found, which = np.unique(np.ascontiguousarray(words).view(f"V{8 * words.shape[1]}").ravel(), return_inverse=True)
    return found.view(np.uint64).reshape(len(found), -1), which


def _lists(which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in order of their row of ``_distinct``, where each row's start, and the end)."""
    return np.argsort(which, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(which, minlength=n))])


class _Columns:
    """Different rows of train as columns, in order of size; runs of ``width`` columns have one size, padded with empty ones (``row`` is -1 there)."""

    def __init__(self, train: np.ndarray, most: int):
        sizes = _sizes(train)
        order = np.argsort(sizes, kind="stable")
        found, counts = np.unique(sizes, return_counts=True)
        self.width = 1 << min(8, max(3, int(len(train) // max(8 * most, 4 * len(found))).bit_length()))  # of padding less than of rows
        runs = -(-counts // self.width)
        starts = np.cumsum(runs) - runs
        at = np.repeat(starts * self.width - (np.cumsum(counts) - counts), counts) + np.arange(len(order))
        self.row = np.full(int(runs.sum()) * self.width, -1, np.int64)
        self.row[at] = order
        words = np.zeros((train.shape[1], len(self.row)), np.uint64)
        words[:, at] = train[order].T
        self.sizes = np.repeat(found, runs)
        self.words = words.reshape(len(words), -1, self.width)
        bits = 64 * len(words)
        self.kind = np.uint8 if bits < 256 else np.uint16 if bits < 65536 else np.uint32

    def greatest(self, left: np.ndarray) -> np.ndarray:
        """The most bits that each row shares with a column of each run. A few rows and runs are counted at a time, and only this is kept of them."""
        out = np.empty((len(left), len(self.sizes)), self.kind)
        runs = min(len(self.sizes), max(1, ACROSS // self.width))
        step = max(1, WORDS // (runs * self.width))
        held, counts = np.empty((step, runs * self.width), np.uint64), np.empty((step, runs * self.width), self.kind)
        for x in range(0, len(self.sizes), runs):
            lane = self.words[:, x : x + runs].reshape(len(self.words), -1)
            for s in range(0, len(left), step):
                rows = left[s : s + step]
                both, n = held[: len(rows), : lane.shape[1]], counts[: len(rows), : lane.shape[1]]
                for w, words in enumerate(lane):
                    np.bitwise_and(rows[:, w, None], words, out=both)
                    if w:
                        n += np.bitwise_count(both)
                    else:
                        np.bitwise_count(both, out=n)
                n.reshape(len(rows), -1, self.width).max(axis=2, out=out[s : s + step, x : x + runs])
        return out

    def counted(self, left: np.ndarray, runs: np.ndarray) -> np.ndarray:
        """Bits that each row shares with each column of its run."""
        out = np.zeros((len(left), self.width), self.kind)
        for w, words in enumerate(self.words):
            out += np.bitwise_count(left[:, w, None] & words[runs])
        return out

    def strips(self, rows: np.ndarray) -> Iterator[slice]:
        step = max(1, RUNS // len(self.sizes))
        return (slice(s, s + step) for s in range(0, len(rows), step))

    def hits(self, left: np.ndarray, nq: np.ndarray, most: int, measure: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows, columns, scores, bounds): all columns that share a bit and are as similar as ``bounds``, which the ``most`` best columns of each row are at least."""
        top = self.greatest(left)
        scored = _score(top, nq[:, None], self.sizes[None, :], measure)
        # The best of each run: so many columns score as much.
        bound = np.partition(scored, -most, axis=1)[:, -most] if most <= scored.shape[1] else np.zeros(len(top))
        r, g = np.nonzero((top > 0) & (scored >= bound[:, None]))
        nr, ng = nq[r], self.sizes[g]
        least = bound[r] * (nr + ng) / (1 + bound[r]) if measure == "tanimoto" else bound[r] * np.sqrt(nr.astype(float) * ng)
        least = np.maximum(np.floor(least).astype(np.int64) - 1, 1)
        for _ in range(3):
            least += _score(least, nr, ng, measure) < bound[r]
        found = [(np.zeros(0, np.int64),) * 3]
        step = max(1, WORDS // self.width)
        for s in range(0, len(r), step):
            counts = self.counted(left[r[s : s + step]], g[s : s + step])
            a, b = np.nonzero(counts >= least[s : s + step, None])
            found.append((a + s, b, counts[a, b]))
        a, b, n = (np.concatenate(x) for x in zip(*found, strict=True))
        return r[a], g[a] * self.width + b, _score(n, nr[a], ng[a], measure), bound


def best_sets(queries: np.ndarray, train: np.ndarray, k: int, measure: str, same: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``train``, similarities) of the k most similar rows of each query, the first of equal ones; ``same``: (queries, rows) that are no candidates, at -inf.

    Copies on either side are compared once. With ``same`` so many more are found as a query has rows that are none.
    """
    k = min(k, len(train))
    near, score = np.zeros((len(queries), k), np.int64), np.full((len(queries), k), -np.inf)
    most = k + (int(np.bincount(same[0]).max()) if same is not None and len(same[0]) else 0)
    asked, asks = _distinct(queries)
    kept, holds = _distinct(train)
    copies, first = _lists(holds, len(kept))
    users, start = _lists(asks, len(asked))
    columns, sizes = _Columns(kept, most), _sizes(asked)
    pairs = np.sort(same[0] * np.int64(len(train)) + same[1]) if same is not None else np.zeros(0, np.int64)
    for s in columns.strips(asked):
        left, nq = asked[s], sizes[s]
        r, c, found, bound = columns.hits(left, nq, most, measure)
        rows, n = columns.row[c], np.minimum(first[1:] - first[:-1], most)  # of more copies none is among the best
        n = n[rows]
        r, found, at = np.repeat(r, n), np.repeat(found, n), np.repeat(first[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        place = copies[at]
        bare = np.flatnonzero((bound <= 0) & (np.bincount(r, minlength=len(left)) < most))  # rows that share no bit come next, the first of them
        more = [(np.full(len(z), q), z) for q in bare for z in [_first_others(place[r == q], most, len(train))]]
        if more:
            r, place = np.concatenate([r, *[a for a, _ in more]]), np.concatenate([place, *[b for _, b in more]])
            found = np.concatenate([found, np.zeros(len(place) - len(found))])
        order = np.lexsort((place, -found, r))
        r, place, found = r[order], place[order], found[order]
        head = np.arange(len(r)) - np.searchsorted(r, r) < most
        r, place, found = r[head], place[head], found[head]
        # Each copy of a query has these; its own row goes.
        ends = np.searchsorted(r, np.arange(len(left) + 1))
        own = users[start[s.start] : start[s.start + len(left)]]
        group = np.repeat(np.arange(len(left)), np.diff(start[s.start : s.start + len(left) + 1]))
        n = (ends[1:] - ends[:-1])[group]
        at = np.repeat(ends[group] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        q, place, found = np.repeat(own, n), place[at], found[at]
        turn = np.repeat(np.arange(len(own)), n)
        if len(pairs):
            key = q * np.int64(len(train)) + place
            other = pairs[np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)] != key
            q, place, found, turn = q[other], place[other], found[other], turn[other]
        j = np.arange(len(q)) - np.searchsorted(turn, turn)
        q, j, place, found = (x[j < k] for x in (q, j, place, found))
        near[q, j], score[q, j] = place, found
    return near, score


def _first_others(taken: np.ndarray, n: int, of: int) -> np.ndarray:
    """The first n places that aren't taken."""
    free = np.setdiff1d(np.arange(min(of, n + len(taken))), taken)
    return free[:n]


def best_of_tasks(queries: np.ndarray, asks: np.ndarray, train: np.ndarray, fits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tasks, places of queries, similarities): for each task that a query asks, the greatest similarity to the rows of ``train`` that fit it; none where none does.

    asks, fits: rows by tasks. A pair is counted once for all tasks: a query's best few rows are mostly some of each task's. Where they aren't, more of them are looked at,
    then all.
    """
    tasks = asks.shape[1]
    asked, which = _distinct(queries)
    kept, holds = _distinct(train)
    users, start = _lists(which, len(asked))
    copies, first = _lists(holds, len(kept))
    wanted = np.logical_or.reduceat(asks[users], start[:-1], axis=0).T.copy()
    held = np.logical_or.reduceat(fits[copies], first[:-1], axis=0).T.copy()
    open_, sizes = wanted & held.any(axis=1)[:, None], _sizes(asked)
    best = np.full((tasks, len(asked)), -np.inf)
    # Tasks that share few pairs (one task, or small parts of all rows) are counted each for itself.
    apart = int((open_.sum(axis=1) * held.sum(axis=1)).sum()) <= len(asked) * len(kept)
    for most in () if apart else (8, 64):
        rows = np.flatnonzero(open_.any(axis=0))
        if not len(rows):
            break
        columns = _Columns(kept, most)
        for s in columns.strips(rows):
            mine = rows[s]
            r, c, score, _ = columns.hits(asked[mine], sizes[mine], most, "tanimoto")
            order = np.lexsort((-score, r))
            r, c, score = mine[r[order]], columns.row[c[order]], score[order]
            for t in np.flatnonzero(open_[:, mine].any(axis=1)):
                hit = np.flatnonzero(open_[t, r] & held[t, c])
                hit = hit[np.concatenate([[True], r[hit][1:] != r[hit][:-1]])] if len(hit) else hit
                best[t, r[hit]] = score[hit]
        open_ &= best == -np.inf
    for t in np.flatnonzero(open_.any(axis=1)):
        rows, columns = np.flatnonzero(open_[t]), _Columns(kept[held[t]], 1)
        for s in columns.strips(rows):
            mine = rows[s]
            best[t, mine] = _score(columns.greatest(asked[mine]), sizes[mine, None], columns.sizes[None, :]).max(axis=1)
    t, q = np.nonzero(asks.T & held.any(axis=1)[:, None])
    return t.astype(np.int32), q, best[t, which[q]]


def most_shared(queries: np.ndarray, train: np.ndarray) -> np.ndarray:
    """The greatest similarity of each query to a row of ``train``."""
    _, right, edges, sizes = _by_size(train)
    nq, out = _sizes(queries), np.zeros(len(queries))
    step = max(1, STRIP // max(1, len(train)))
    for s in range(0, len(queries), step):
        both = _shared(queries[s : s + step], right)
        top = np.stack([both[:, x:y].max(axis=1) for x, y in edges], axis=1)
        out[s : s + step] = _score(top, nq[s : s + step, None], sizes[None, :]).max(axis=1)
    return out


def distances(queries: np.ndarray, train: np.ndarray, held: int = 1 << 22) -> np.ndarray:
    """Euclidean distance of each two rows, from their differences; so many of these are held at once."""
    out = np.empty((len(queries), len(train)))
    step = max(1, held // max(1, train.size))
    for a in range(0, len(queries), step):
        gap = queries[a : a + step, None, :] - train[None]
        out[a : a + step] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
    return out


def best_dense(queries: np.ndarray, train: np.ndarray, k: int, same: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """As ``best_sets``, by the negated Euclidean distance of vectors."""
    k = min(k, len(train))
    near, score = np.empty((len(queries), k), np.int64), np.empty((len(queries), k))
    step = max(1, STRIP // max(1, len(train)))
    for s in range(0, len(queries), step):
        found = -distances(queries[s : s + step], train)
        if same is not None:
            mine = (same[0] >= s) & (same[0] < s + step)
            found[same[0][mine] - s, same[1][mine]] = -np.inf
        # What reaches the k-th best, ties with it included, in order of places.
        least = np.partition(found, len(train) - k, axis=1)[:, len(train) - k] if k < len(train) else np.full(len(found), -np.inf)
        for r, row in enumerate(found):
            at = np.flatnonzero(row >= least[r])
            at = at[np.argsort(-row[at], kind="stable")[:k]]
            near[s + r], score[s + r] = at, row[at]
    return near, score


def most_similar(queries: DataFrame, train: DataFrame, k: int = 1, keys: tuple[str, ...] = (), others: bool = False, measure: str = "tanimoto") -> DataFrame:
    """(keys, query, candidate, similarity): the ``k`` rows of ``train`` most similar to each query (ties: least id), among those of equal ``keys``.

    Rows: (keys, entity_id, bits); a null set is empty, and two empty sets have similarity 0. measure: tanimoto; cosine (to 12 places); or euclidean, where bits
    is a dense vector of doubles and the similarity the negated distance. ``others``: a query's own row is no candidate. A query whose keys no row of ``train`` has gets none.
    """
    own, dense = queries.schema["entity_id"].dataType.simpleString(), measure == "euclidean"
    kind = "array<double>" if dense else "array<int>"
    side = lambda df, s: df.select(*keys, F.lit(s).alias("side"), F.col("entity_id").alias("id"), F.coalesce("bits", F.array().cast(kind)).cast(kind).alias("bits"))
    # What blocks are in order of: the number of set bits, or the distance from the origin.
    width = F.sqrt(F.aggregate("bits", F.lit(0.0), lambda t, x: t + x * x)) if dense else F.size("bits").cast("double")
    sides = side(queries, 0).unionByName(side(train, 1))
    if dense:
        rows, _ = written(sides.withColumn("_w", width), "bits")
    else:
        rows, seen = written(sides.withColumn("bits", F.array_distinct("bits")).withColumn("_w", width), "bits", last=F.max(F.array_max("bits")))
        words = 1 + (seen.get("last") or 0) // 64
        rows = with_words(rows, words)
    blocks, cards = _blocked(rows, keys, max(1, BLOCK // 4) if dense else BLOCK, dense)
    held = "bits" if dense else "packed"
    pairs, table = _pairs(cards, keys, measure)
    kinds = dict(queries.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], f"query {own}", f"candidate {own}", "similarity double"])

    def tile(group):
        import pandas as pd

        a, b = (group[group["side"] == s].sort_values("id", kind="stable") for s in (0, 1))
        names = [*keys, "query", "candidate", "similarity"]
        if not len(a) or not len(b):
            return pd.DataFrame(columns=names, dtype=object)  # Arrow takes no empty floats for strings
        same = None
        if others:
            met = pd.merge(pd.DataFrame({"id": a["id"].to_numpy(), "q": np.arange(len(a))}), pd.DataFrame({"id": b["id"].to_numpy(), "t": np.arange(len(b))}), on="id")
            same = met["q"].to_numpy(), met["t"].to_numpy()
        if dense:
            left, right = (np.array(x[held].tolist(), float).reshape(len(x), -1) for x in (a, b))
            near, score = best_dense(left, right, k, same)
        else:
            near, score = best_sets(_words(a[held].tolist()), _words(b[held].tolist()), k, measure, same)
        out = pd.DataFrame({"query": np.repeat(a["id"].to_numpy(), near.shape[1]), "candidate": b["id"].to_numpy()[near.ravel()], "similarity": score.ravel()})
        for c in keys:
            out[c] = group[c].iloc[0]
        return out[out["similarity"] > -np.inf][names]

    # Blocks of a span; vectors come one block at a time.
    widest = 1 if dense else max(1, min(SPAN // BLOCK, SPAN_BYTES // (8 * words * BLOCK)))

    def met(chosen: DataFrame, n: int) -> DataFrame:
        """The k best of each query over these ``n`` pairs of blocks, for each span."""
        span = max(1, min(widest, n // TILES))
        dealt = chosen.withColumn("at", F.floor(F.col("j") / span))
        q = blocks.where("side = 0").join(dealt.drop("j").distinct(), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys] + [F.col("block") == F.col("i")])
        t = blocks.where("side = 1").join(dealt, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys] + [F.col("block") == F.col("j")])
        names = [*keys, "side", "id", held, "i", "at"]
        return q.select(*names).unionByName(t.select(*names)).groupBy(*keys, "i", "at").applyInPandas(tile, schema)

    place = Window.partitionBy(*keys, "query").orderBy(F.desc("similarity"), "candidate")  # k rows a span of ``train``
    best = lambda df: df.withColumn("_p", F.row_number().over(place)).where(F.col("_p") <= k)
    first, _ = written(met(pairs.where("near").select(*[f"_{c}" for c in keys], "i", "j"), table.get("near", 0)), "near")
    # A block's bound: the least k-th best of its queries; none where one has fewer than k yet.
    kth = best(first).where(F.col("_p") == k).select(*keys, F.col("query").alias("id"), "similarity")
    asked = blocks.where("side = 0").select(*[F.col(c).alias(f"_{c}") for c in keys], "id", "block")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    least = asked.join(kth.withColumnRenamed("id", "_id"), [*on, F.col("id").eqNullSafe(F.col("_id"))], "left")
    bounds = least.groupBy(*[f"_{c}" for c in keys], F.col("block").alias("i")).agg(F.when(F.count("*") == F.count("similarity"), F.min("similarity")).alias("least"))
    same = [F.col(f"_{c}").eqNullSafe(F.col(f"_b_{c}")) for c in keys]
    bounds = bounds.withColumnsRenamed({f"_{c}": f"_b_{c}" for c in keys} | {"i": "_i"})
    open_ = pairs.where("NOT near").join(bounds, [*same, F.col("i") == F.col("_i")]).where("least IS NULL OR bound >= least")
    left, seen_pairs = written(open_.select(*[f"_{c}" for c in keys], "i", "j"), "open")
    skipped.update(pairs=table["n"], compared=table.get("near", 0) + seen_pairs["n"])
    every = first if not seen_pairs["n"] else first.unionByName(met(left, seen_pairs["n"]))
    return best(every).drop("_p")


#: How many pairs of blocks the last search had, and how many of them it compared.
skipped: dict[str, int] = {}


def _blocked(rows: DataFrame, keys: tuple[str, ...], size: int, dense: bool) -> tuple[DataFrame, DataFrame]:
    """(rows with ``block``, a row for each side and block: extent of ``_w`` and union of bits). A block has ``size`` rows of a side, in order of ``_w``."""
    order = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    placed = places(rows.withColumn("_h", order), [*keys, "side"], ["_w", "_h"], "_at")
    blocks, _ = written(placed.withColumn("block", F.floor((F.col("_at") - 1) / size).cast("int")).drop("_at", "_h"), "blocks")
    cards = blocks.groupBy(*keys, "side", "block").agg(F.min("_w").alias("low"), F.max("_w").alias("high"))
    none = F.array().cast("array<int>")
    if dense:
        return blocks, written(cards.withColumn("union", none), "cards")[0]
    bits = blocks.select(*keys, "side", "block", F.explode("bits").alias("bit")).distinct().groupBy(*keys, "side", "block").agg(F.collect_set("bit").alias("union"))
    on = [cards[c].eqNullSafe(bits[c]) for c in [*keys, "side", "block"]]
    joined = cards.join(bits, on, "left").select(*[cards[c] for c in [*keys, "side", "block"]], "low", "high", F.coalesce("union", none).alias("union"))
    return blocks, written(joined, "cards")[0]


def _pairs(cards: DataFrame, keys: tuple[str, ...], measure: str) -> tuple[DataFrame, dict]:
    """(_keys, i, j, bound, near): the greatest score that rows of two blocks can have, and whether j is one of the two best blocks for i by it."""
    side = lambda n, name, a, p: cards.where(F.col("side") == n).select(*[F.col(c).alias(f"{p}{c}") for c in keys], F.col("block").alias(name), F.col("low").alias(f"{a}l"), F.col("high").alias(f"{a}h"), F.col("union").alias(f"{a}u"))
    q, t = side(0, "i", "q", "_"), side(1, "j", "t", "_t_")
    both = q.join(t, [F.col(f"_{c}").eqNullSafe(F.col(f"_t_{c}")) for c in keys]) if keys else q.crossJoin(t)  # a row a block, not a row a row
    # The two sizes that are as like as the blocks allow.
    a, b = F.greatest("ql", F.least("qh", "tl")), F.greatest("tl", F.least("th", "ql"))
    if measure == "euclidean":  # the triangle's other side
        bound = -F.abs(a - b) * (1 - 1e-9)
    else:
        # Of a and b bits at most min(a, b) are shared, and at most those of both unions, s, with sizes of s at least.
        s = F.size(F.array_intersect("qu", "tu")).cast("double")
        x, y = F.greatest("ql", s), F.greatest("tl", s)
        part = F.coalesce(F.try_divide(F.least(a, b), F.greatest(a, b)), F.lit(0.0))
        if measure == "tanimoto":
            bound = F.least(part, F.coalesce(F.try_divide(s, x + y - s), F.lit(0.0)))
        else:
            bound = F.least(F.sqrt(part), F.coalesce(F.try_divide(s, F.sqrt(x * y)), F.lit(0.0)))
    order = Window.partitionBy(*[f"_{c}" for c in keys], "i").orderBy(F.desc("bound"), F.abs(F.col("ql") + F.col("qh") - F.col("tl") - F.col("th")), "j")  # a row a block of ``train``
    made = both.withColumn("bound", bound + 1e-9).withColumn("near", F.row_number().over(order) <= 2)
    return written(made.select(*[f"_{c}" for c in keys], "i", "j", "bound", "near"), "pairs", near=F.count_if("near"))


def nearest_neighbour(queries: DataFrame, train: DataFrame, others: bool = False) -> DataFrame:
    """For each query its most similar row of ``train`` (ties: least id), with single-precision similarity; 0 and the least id where no bit is shared."""
    best = most_similar(queries, train, others=others)
    out = queries.select(F.col("entity_id").alias("query")).join(best, "query", "left")
    return out.select("query", F.col("candidate").alias("nearest"), F.coalesce("similarity", F.lit(0.0)).cast("float").alias("similarity"))


def max_similarity(queries: DataFrame, train: DataFrame, keys: tuple[str, ...] = (), others: bool = False) -> DataFrame:
    """For each query the similarity of its nearest row of ``train`` (with equal ``keys``, columns of both); 0 where no bit is shared."""
    best = most_similar(queries, train, 1, keys, others).select(*keys, F.col("query").alias("entity_id"), F.col("similarity").alias("max_similarity"))
    return queries.select(*keys, "entity_id").join(best, [*keys, "entity_id"], "left").select(*keys, "entity_id", F.coalesce("max_similarity", F.lit(0.0)).alias("max_similarity"))


def max_similarity_by_task(assignments: DataFrame, bits: DataFrame, keys: list[str]) -> DataFrame:
    """``assignments`` with max_similarity: of each row that isn't train, the similarity of its entity to the nearest train row of its task; null for train.

    A task is a combination of ``keys`` (columns of ``assignments``; none: one task). Null sets are empty; 0 where no bit is shared or a task has no train rows; an
    entity without bits has 0 too. All tasks are answered at once: an entity carries a list of tasks in which it is train and one of those in which it isn't.

    Small sets meet in the subsets they share: the best of a query's train rows is the smallest that holds one of its subsets, so a table has a row for each subset, not for
    each pair. Up to which size sets count as small (0: none) follows from how many there are of each. Pairs with a larger set are compared as blocks of words.
    """
    assigned, seen = written(assignments, "assigned")
    tasks, numbered = 1, assigned.withColumn("_task", F.lit(0))
    if keys:
        named = [f"_{c}" for c in keys]
        place = F.row_number().over(Window.orderBy(*keys)) - 1  # a row a task
        numbers, counted = written(assigned.select(*keys).distinct().select(*[F.col(c).alias(n) for c, n in zip(keys, named, strict=True)], place.alias("_task")), "tasks")
        on = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(keys, named, strict=True)]
        tasks, numbered = counted["n"], assigned.join(small(numbers, counted["n"]), on).drop(*named)
    train = F.col("partition") == "train"
    sides = numbered.groupBy("entity_id").agg(F.collect_list(F.when(train, F.col("_task"))).alias("fit"), F.collect_list(F.when(~train, F.col("_task"))).alias("ask"))
    sets = bits.select("entity_id", F.array_sort(F.array_distinct(F.coalesce("bits", F.array().cast("array<int>")).cast("array<int>"))).alias("bits"))
    rows, size = written(large(sides).join(large(sets), "entity_id").where(F.size("bits") > 0), "sides", last=F.max(F.array_max("bits")))
    counts = {r[0]: r[1] for r in rows.groupBy(F.size("bits")).count().collect()}  # a row a size
    small_upto = _small(counts)
    own, found = rows.schema["entity_id"].dataType.simpleString(), []
    if small_upto:
        found.append(_by_subsets(rows.where(F.size("bits") <= small_upto)))
    if any(k > small_upto for k in counts):
        n = {True: sum(c for k, c in counts.items() if k > small_upto), False: sum(c for k, c in counts.items() if k <= small_upto)}
        found.append(_by_blocks(rows, small_upto, n[True], n[False], 1 + size["last"] // 64, tasks, own))
    if not found:
        return numbered.withColumn("max_similarity", F.when(~train, F.lit(0.0))).select(*assignments.columns, "max_similarity")
    every = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    best, _ = written(every.groupBy("task", "entity_id").agg(F.max("similarity").alias("_best")).withColumnsRenamed({"task": "_task"}), "nearest")
    out = numbered.join(large(best), ["_task", "entity_id"], "left")
    return out.withColumn("max_similarity", F.when(~train, F.coalesce("_best", F.lit(0.0)))).select(*assignments.columns, "max_similarity")


def _small(counts: dict[int, int]) -> int:
    """Up to which size (0: none) sets are compared by their subsets, of which there are 2^size: where that is much less work than all pairs. ``counts``: sets by size."""
    total = sum(counts.values())

    def work(upto: int) -> float:
        few = sum(c for k, c in counts.items() if k <= upto)
        return total * total - few * few + SUBSET_COST * sum(c << k for k, c in counts.items() if k <= upto)

    best = min(range(SUBSETS + 1), key=work)
    return best if work(best) < work(0) / 2 else 0


def _by_subsets(rows: DataFrame) -> DataFrame:
    """(task, entity_id, similarity) of the ``ask`` tasks of sets of a few bits, from the subsets that they share with the ``fit`` ones."""
    mask = lambda c: F.aggregate(F.filter(c, lambda t: F.floor(t / MASK) == F.col("chunk")), F.lit(0).cast("long"), lambda m, t: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (t % MASK).cast("int"))))
    chunks = F.array_distinct(F.transform(F.concat("fit", "ask"), lambda t: F.floor(t / MASK).cast("int")))
    masked = rows.select("entity_id", "bits", "fit", "ask", F.explode(chunks).alias("chunk")).select("entity_id", "bits", "chunk", mask("fit").alias("fit"), mask("ask").alias("ask"))
    masked, _ = written(masked, "masks")
    sets, _ = written(masked.groupBy("bits", "chunk").agg(F.bit_or("fit").alias("fit"), F.bit_or("ask").alias("ask")), "sets")  # copies are one
    last = F.call_function("shiftleft", F.lit(1), F.size("bits")) - 1
    member = lambda i: F.call_function("shiftright", F.col("m"), i).bitwiseAND(F.lit(1)) == 1
    subsets = lambda df: df.withColumn("m", F.explode(F.sequence(F.lit(1), last))).withColumn("part", F.filter("bits", lambda _, i: member(i))).drop("m")
    sized = subsets(sets.where("fit <> 0")).groupBy("chunk", "part", F.size("bits").alias("n")).agg(F.bit_or("fit").alias("fit"))
    held = sized.groupBy("chunk", "part").agg(F.collect_list(F.struct("n", "fit")).alias("held"))  # an entry a size
    met = subsets(sets.where("ask <> 0").select("bits", "chunk", "ask")).join(large(held), ["chunk", "part"])
    both = F.size("part").cast("double")
    each = met.select("bits", "chunk", "ask", both.alias("both"), F.explode("held").alias("h")).select("bits", "chunk", (F.col("both") / (F.size("bits") + F.col("h.n") - F.col("both"))).alias("score"), F.col("ask").bitwiseAND(F.col("h.fit")).alias("mask"))
    scored = each.where("mask <> 0").groupBy("bits", "chunk", "score").agg(F.bit_or("mask").alias("mask"))
    ladder, _ = written(scored.groupBy("bits", "chunk").agg(F.collect_list(F.struct("score", "mask")).alias("ladder")), "ladders")  # an entry a score
    asked = large(masked.where("ask <> 0")).join(large(ladder), ["bits", "chunk"]).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(MASK - 1))))
    has = lambda m: F.call_function("shiftright", m, F.col("t")).bitwiseAND(F.lit(1).cast("long")) == 1
    best = F.array_max(F.transform(F.filter("ladder", lambda x: has(x["mask"])), lambda x: x["score"]))
    return asked.where(has(F.col("ask"))).select((F.col("chunk") * MASK + F.col("t")).alias("task"), "entity_id", best.alias("similarity")).where("similarity IS NOT NULL")


def _by_blocks(rows: DataFrame, small_upto: int, n_large: int, n_small: int, words: int, tasks: int, own: str) -> DataFrame:
    """(task, entity_id, similarity) from all pairs of which one has over ``small_upto`` bits: greatest ones within a block of queries and a span of train rows.

    Blocks and spans of large sets come first and meet all of the other side; those of small sets meet large ones alone.
    """
    size = min(BLOCK, max(1024, -(-(n_large + n_small) // 16)))
    large, few = max(1, -(-n_large // size)), -(-n_small // size)
    longest = min(SPAN, max(1024, SPAN_BYTES // max(8 * words, tasks)))
    spans = lambda n, least: max(-(-n // longest), min(least, -(-n // size)))
    wide = max(1, spans(n_large, -(-TILES // (large + few))))
    narrow = spans(n_small, -(-TILES // large))
    drawn, is_large = F.xxhash64("entity_id"), F.size("bits") > small_upto
    of = lambda a, b: F.when(is_large, F.pmod(drawn, F.lit(a))).otherwise(a + F.pmod(drawn, F.lit(max(1, b)))).cast("int")
    rows = rows.withColumns({"i": of(large, few), "j": of(wide, narrow), "large": is_large, "asks": F.size("ask") > 0, "fits": F.size("fit") > 0})
    held = 1 + (tasks - 1) // 64
    packed, _ = written(with_words(rows, words, {"ask": ("asked", held), "fit": ("fitted", held)}).drop("bits", "ask", "fit"), "packed")
    upto = lambda a, b: F.explode(F.sequence(F.lit(0), F.when(F.col("large"), a + b - 1).otherwise(a - 1)))
    queries = packed.where("asks").select("entity_id", F.lit(0).alias("side"), "packed", F.col("asked").alias("tasks"), "i", upto(wide, narrow).alias("j"))
    train = packed.where("fits").select(F.lit(None).cast(own).alias("entity_id"), F.lit(1).alias("side"), "packed", F.col("fitted").alias("tasks"), upto(large, few).alias("i"), "j")

    def tile(group):
        import pyarrow as pa
        import pyarrow.compute as pc

        a, b = (group.filter(pc.equal(group["side"], s)) for s in (0, 1))
        sides = [(_column_words(x["packed"], words), _mask(_column_words(x["tasks"], held), tasks)) for x in (a, b)]
        none = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0)
        task, at, score = best_of_tasks(*sides[0], *sides[1]) if len(a) and len(b) else none
        return pa.table({"task": task, "entity_id": a["entity_id"].take(pa.array(at)), "similarity": score})

    return queries.unionByName(train).groupBy("i", "j").applyInArrow(tile, f"task int, entity_id {own}, similarity double")


def _column_words(column, words: int) -> np.ndarray:
    """Rows of words from a column of ``packed``, without an object a row."""
    import pyarrow as pa

    size = 8 * words
    chunks = (c.cast(pa.binary(size)) for c in column.chunks)
    parts = [np.frombuffer(c.buffers()[1], np.uint8)[c.offset * size : (c.offset + len(c)) * size] for c in chunks if len(c)]
    return np.concatenate(parts or [np.zeros(0, np.uint8)]).view(np.uint64).reshape(-1, words)


def _mask(packed: np.ndarray, tasks: int) -> np.ndarray:
    """Rows by tasks, from words of their bits."""
    return np.unpackbits(packed.view(np.uint8), axis=1, count=tasks, bitorder="little").view(bool)
