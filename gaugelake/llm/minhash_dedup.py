"""MinHash near-dedup by an inverted join over signature coordinates.

Each document is posted under the (coordinate, value) tokens of its signature. Two documents above the similarity share at least ``matches`` of their
``k`` tokens, but for a stated chance. So they share ``least`` tokens among the first ``k - matches + least`` of each, in any
one order of all tokens; with the rarest first these prefixes hold short posting lists. Collisions within prefixes are counted, pairs
below ``least`` skipped, and of the rest those stay that collide in ``matches`` coordinates.

Posting lists longer than ``hot`` are not paired up. Their documents (whose prefixes hold little else: near copies of one text) are first compared
with one document each, the least of the list: links to it leave few components, however long the list. All of a list's documents are
candidates of one group; in a group only documents of different components still have to be compared.

Groups are cut into blocks, and two blocks meet in a tile where full shingle sets decide. A component that fills a block or more has blocks of
its own, which meet those of others and never one another. Tiles give a spanning forest of their links, never the pairs, and components of
these forests are the result. ``hot`` moves work between the two ways and changes no result: pairs of both ways meet the same full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugelake.llm._shared import connected_components, discard, forest, materialize, salted_join, ship
from gaugelake.llm.shingles import shingle_sets, signature

#: Documents, and shingles, of a block: what two of them take in memory bounds a tile.
BLOCK_DOCS, BLOCK_SHINGLES = 256, 400_000


def match_threshold(k: int, percent: int, miss: float) -> int:
    """The most of ``k`` coordinates that two sets of this similarity fail to share with a chance of at most ``miss``."""
    p, below = percent / 100, 0.0
    for t in range(k + 1):
        below += comb(k, t) * p**t * (1 - p) ** (k - t)
        if below > miss:
            return t
    return k


def set_table(docs: DataFrame, id_col: str, text_col: str, width: int, k: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, tokens): size, 128-bit digest and signature tokens (64-bit hashes of coordinate and value) of each document's set."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            sizes, digests, tokens, start = [], [], [], 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop]) < 1_000_000):
                    size += len(texts[stop])
                    stop += 1
                for found in shingle_sets(texts[start:stop], width):
                    sizes.append(len(found))
                    digests.append(np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64))
                    tokens.append(signature(found, k) if len(found) else None)
                start = stop
            both = np.array(digests).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(tokens, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "d1", "d2", "tokens"]
            )

    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, tokens array<long>")


def candidates(reps: DataFrame, k: int, matches: int, least: int, hot: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """(links (u, v) of two of ``reps`` (doc_id, tokens) with enough collisions; stars (u, v): each document of a long list and its list's least; tables to delete).

    Every two documents with enough collisions are linked or have a star in common.
    """
    posted = reps.select("doc_id", F.explode("tokens").alias("token"))
    # Written before they are joined: then a frequent token's rows can be split over tasks.
    shared, p1 = materialize(posted.groupBy("token").agg(F.count("*").alias("df"), F.min("doc_id").alias("first")).where("df > 1"), "shared")
    own = posted.join(shared, "token").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("df", "token", "first"))).alias("own"))  # k at most
    room = F.lit(k - matches + least) - (F.lit(k) - F.size("own"))  # tokens that no other document has come first
    prefix = own.where(room > 0).select("doc_id", F.explode(F.slice("own", F.lit(1), room)).alias("p")).select("doc_id", "p.token", "p.df", "p.first")
    prefix, p2 = materialize(prefix, "prefix")
    listed = prefix.where(F.col("df") <= hot).groupBy("token").agg(F.array_sort(F.collect_list("doc_id")).alias("ids")).where(F.size("ids") > 1)  # hot at most
    ahead = F.expr("flatten(transform(ids, (a, i) -> transform(slice(ids, i + 2, size(ids)), b -> struct(a AS u, b AS v))))")
    pairs = listed.select(F.explode(ahead).alias("p")).select("p.u", "p.v").groupBy("u", "v").agg(F.count("*").alias("n"))
    few = prefix.where(F.col("df") > hot).select("doc_id").distinct().withColumn("long_lists", F.lit(True))
    # A document with a long list in its prefix may collide with another mostly there: for those, one collision elsewhere is enough to look closer.
    pairs = pairs.join(few.select(F.col("doc_id").alias("u"), F.col("long_lists").alias("lu")), "u", "left").join(few.select(F.col("doc_id").alias("v"), F.col("long_lists").alias("lv")), "v", "left")
    pairs = pairs.where((F.col("n") >= least) | (F.col("lu") & F.col("lv"))).select("u", "v")
    close = pairs.join(reps.select(F.col("doc_id").alias("u"), F.col("tokens").alias("tu")), "u").join(reps.select(F.col("doc_id").alias("v"), F.col("tokens").alias("tv")), "v")
    close = close.where(F.size(F.array_intersect("tu", "tv")) >= matches).select("u", "v")
    stars = prefix.where(F.col("df") > hot).select(F.col("doc_id").alias("u"), F.col("first").alias("v")).where("u <> v").distinct()
    close, p3 = materialize(close, "close")
    stars, p4 = materialize(stars, "stars")
    discard(p1, p2)
    return close, stars, [p3, p4]


def _dealt(loose: DataFrame) -> DataFrame:
    """(grp, i, j, block, doc_id): which tiles each document goes to; rows: component (the group), node, n_shingles, root (what stars have linked it to).

    In a group of several blocks a root that fills one has blocks of its own. Theirs are not paired with one another; all other two blocks meet.
    """
    blocks = lambda n, w: F.ceil(F.greatest(n / BLOCK_DOCS, w / BLOCK_SHINGLES)).cast("long")
    by_root = loose.groupBy("component", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    by_root = by_root.withColumn("own", F.when((F.col("n") >= BLOCK_DOCS) | (F.col("w") >= BLOCK_SHINGLES), blocks(F.col("n"), F.col("w"))))
    # A group's large roots in order; as many as it has documents over BLOCK_DOCS.
    group = by_root.groupBy("component").agg(
        F.coalesce(blocks(F.sum(F.when(F.col("own").isNull(), F.col("n"))), F.sum(F.when(F.col("own").isNull(), F.col("w")))), F.lit(0).cast("long")).alias("mixed"), F.coalesce(F.sum("own"), F.lit(0)).alias("large"),
        F.count("*").alias("roots"),
    )
    order = Window.partitionBy("component").orderBy("root").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_root.where("own IS NOT NULL").withColumn("at", F.coalesce(F.sum("own").over(order), F.lit(0))).select("component", "root", "own", "at")
    member = salted_join(salted_join(loose, group.where("roots > 1"), ["component"]), starts, ["component", "root"], "left")
    spread = F.xxhash64("node")
    block = F.when(F.col("own").isNull(), F.pmod(spread, F.greatest("mixed", F.lit(1)))).otherwise(F.col("mixed") + F.col("at") + F.pmod(spread, F.col("own")))
    member = member.withColumn("block", block).withColumn("other", F.explode(F.expr("sequence(0L, mixed + large - 1)")))
    member = member.where("own IS NULL OR other < mixed + at OR other >= mixed + at + own")
    return member.select(F.col("component").alias("grp"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", F.col("node").alias("doc_id"))


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with i in ``left``, j in ``right``, whose sets have 100 * intersection >= percent * union."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) <= 8:
        found = []
        for i in left.tolist():
            for j in right.tolist():
                if i < j and 100 * min(sizes[i], sizes[j]) >= percent * max(sizes[i], sizes[j]):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                        found.append((i, j))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = times[column] > 1
    new = np.cumsum(times > 1) - 1
    row, column, width = row[shared], new[column[shared]], int((times > 1).sum())
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both, step = np.zeros((len(left), len(right)), np.float64), 4096
    for start in range(0, width, step):
        a, b = np.searchsorted(column, [start, start + step])
        part = np.zeros((len(sets), min(step, width - start)), np.float32)
        part[row[a:b], column[a:b] - start] = 1
        both += part[left] @ part[right].T  # whole numbers below 2^24
    union = sizes[left][:, None] + sizes[right][None, :] - both
    i, j = np.nonzero(100 * both >= percent * union)
    i, j = left[i], right[j]
    return i[i < j], j[i < j]


def _tiles(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Links of a spanning forest for each tile of rows (grp, i, j, block, doc_id, text)."""

    def tile(block_i: int, block_j: int, blocks: list, ids: list, texts: list) -> Iterator[tuple]:
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        ids, blocks = np.array(ids, np.int64)[order], np.array(blocks)[order]
        sets: list[np.ndarray] = []
        for a in range(0, len(order), 64):
            sets += shingle_sets([texts[k].encode() for k in order[a : a + 64]], width)
        if block_i == block_j:
            left = right = np.arange(len(ids))
            i, j = linked(sets, left, right, percent)
        else:
            left, right = np.flatnonzero(blocks == block_i), np.flatnonzero(blocks == block_j)
            i, j = linked(sets, left, right, percent)
            p, q = linked(sets, right, left, percent)
            i, j = np.concatenate([i, p]), np.concatenate([j, q])
        root = forest(len(ids), i, j)
        for k in np.flatnonzero(root != np.arange(len(ids))).tolist():
            yield int(ids[k]), int(ids[root[k]])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        key, held, found = None, ([], [], []), []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(6)]
            for g, a, b, block, doc_id, text in zip(*columns, strict=True):
                if (g, a, b) != key:
                    if held[1]:
                        found += tile(key[1], key[2], *held)
                    key, held = (g, a, b), ([], [], [])
                for c, x in zip(held, (block, doc_id, text), strict=True):
                    c.append(x)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)], schema=schema)
                found = []
        if held[1]:
            found += tile(key[1], key[2], *held)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)], schema=schema)

    return rows.select("grp", "i", "j", "block", "doc_id", "text").mapInArrow(run, "u long, v long")


def _star_tiles(stars: DataFrame) -> DataFrame:
    """(grp, i, j, block, doc_id) of stars (u, v): v meets its documents in tiles of one block of them each."""
    sizes = stars.groupBy("v").agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("long").alias("blocks"))
    leaves = salted_join(stars, sizes, ["v"]).select(F.col("v").alias("grp"), (F.lit(1) + F.pmod(F.xxhash64("u"), "blocks")).alias("j"), F.col("u").alias("doc_id"))
    heads = sizes.select(F.col("v").alias("grp"), F.explode(F.expr("sequence(1L, blocks)")).alias("j"), F.col("v").alias("doc_id"))
    rows = leaves.withColumn("block", F.col("j")).unionByName(heads.withColumn("block", F.lit(0).cast("long")))
    return rows.select("grp", F.lit(0).cast("long").alias("i"), "j", "block", "doc_id")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, percent: int = 80, k: int = 64, miss: float = 5e-7, least: int = 4, hot: int = 32
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    A document's set: its distinct ``width``-word shingles, A-Z in lower case; with fewer words all of them as one; without words none, and no links.
    Documents link when 100 * intersection >= ``percent`` * union of their whole sets (shingles as 64-bit hashes); component_id is the least
    doc_id reachable, kept tells whether that is the document itself. A pair at the threshold goes unseen with a chance of ``miss``
    at most, more similar pairs with less. Equal sets are one class, found by digest, and only its least id is compared.
    Ids are integers; rows of a null id have a null component, link with nothing and are kept; rows that share an id are one document. Null texts
    have no words. Texts of any length are taken whole. An empty table gives an empty result; other columns are not read.

    Of a long list, documents that its least one does not link to are compared with all of their group: near copies of one another
    that are mostly not linked to it cost the square of their number.
    """
    spark = docs.sparkSession
    matches = match_threshold(k, percent, miss)
    table, _ = materialize(set_table(docs, id_col, text_col, width, k), "sets")
    real = table.where("n_shingles > 0 and doc_id is not null")
    classes, c1 = materialize(real.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    heads = classes.select("d1", "d2", F.col("rep").alias("doc_id"))
    reps, c2 = materialize(real.join(heads, ["d1", "d2", "doc_id"]).select("doc_id", "n_shingles", "tokens").dropDuplicates(["doc_id"]), "reps")
    close, stars, own = candidates(reps, k, matches, least, hot)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def tiles(rows: DataFrame, what: str) -> tuple[DataFrame, str]:
        rows = rows.join(texts.hint("merge"), "doc_id").select("grp", "i", "j", "block", "doc_id", "text")
        return materialize(_tiles(rows.repartition(parts, "grp", "i", "j").sortWithinPartitions("grp", "i", "j"), width, percent), what)

    first, f1 = tiles(_star_tiles(stars), "starlinks")
    roots = first.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))  # all of one root are connected
    loose = connected_components(close.union(stars))
    loose = loose.join(reps.select(F.col("doc_id").alias("node"), "n_shingles"), "node").join(roots, "node", "left")
    loose, c3 = materialize(loose.withColumn("root", F.coalesce("root", "node")), "loose")
    rest, f2 = tiles(_dealt(loose), "links")
    found = connected_components(first.union(rest))
    components = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("root"))
    components, _ = materialize(components, "components")
    discard(c1, c2, c3, f1, f2, *own)
    told = "n_shingles > 0 and doc_id is not null"
    out = table.drop("tokens").where(told).join(components, ["d1", "d2"]).select("doc_id", "n_shingles", "root")
    alone = table.where(f"NOT ({told})").select("doc_id", "n_shingles", F.col("doc_id").alias("root"))
    return out.union(alone).select("doc_id", "n_shingles", F.col("root").alias("component_id"), F.coalesce(F.col("root") == F.col("doc_id"), F.lit(True)).alias("kept"))
