"""Embedding near-dedup: int8 tile products with rigorous error bounds, full precision only where these leave doubt.

A unit vector u is kept as s * q with q of whole numbers from -127 to 127; e = |u - s q| is known exactly. For two of them
u.v = s_u s_v (q_u.q_v) + (u - s_u q_u).v + s_u q_u.(v - s_v q_v), so the product of the quantised vectors misses the cosine by at most
e_u + |s_u q_u| e_v. Pairs whose product plus bound stays below the threshold are settled; the others are computed in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.llm._shared import connected_components, forest, materialize, ship

#: Vectors of a block; two blocks meet in a tile.
BLOCK = 1024
#: Covers rounding in double precision of the bound itself.
SLACK = 1e-9


def quantise(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q as int8, scale, error e, length of s q) of each unit vector."""
    scale = np.abs(units).max(axis=1) / 127
    q = np.rint(units / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.sqrt(((units - back) ** 2).sum(axis=1)), np.sqrt((back**2).sum(axis=1))


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of rows of ``a`` and ``b`` (float64, none zero) with cosine >= threshold; i < j where ``same``."""
    unit = [x / np.sqrt((x**2).sum(axis=1))[:, None] for x in (a / np.abs(a).max(axis=1)[:, None], b / np.abs(b).max(axis=1)[:, None])]
    (qa, sa, ea, la), (qb, sb, eb, _) = quantise(unit[0]), quantise(unit[1])
    product = np.zeros((len(a), len(b)), np.float64)
    for k in range(0, a.shape[1], 1024):  # whole numbers below 2^24 are exact in single precision
        product += qa[:, k : k + 1024].astype(np.float32) @ qb[:, k : k + 1024].astype(np.float32).T
    most = product * sa[:, None] * sb[None, :] + ea[:, None] + la[:, None] * eb[None, :] + SLACK
    i, j = np.nonzero(most >= threshold)
    if same:
        i, j = i[i < j], j[i < j]
    sure = []
    for k in range(0, len(i), 65536):
        x, y = a[i[k : k + 65536]], b[j[k : k + 65536]]
        sure.append((x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))) >= threshold)
    keep = np.concatenate(sure) if sure else np.zeros(0, bool)
    return i[keep], j[keep]


def _tiles(rows: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root) for each node linked within its tile; rows: label, dim, i, j, block, node, copies, embedding."""

    def tile(key: tuple, blocks: list, nodes: list, copies: list, vectors: list) -> Iterator[tuple]:
        order = np.argsort(np.array(nodes, np.int64), kind="stable")
        nodes, blocks, copies = np.array(nodes, np.int64)[order], np.array(blocks)[order], np.array(copies, np.int64)[order]
        matrix = np.array(vectors, np.float64)[order]
        if key[2] == key[3]:
            i, j = tile_links(matrix, matrix, threshold, True)
        else:
            left, right = np.flatnonzero(blocks == key[2]), np.flatnonzero(blocks == key[3])
            i, j = tile_links(matrix[left], matrix[right], threshold, False)
            i, j = left[i], right[j]
        links = np.bincount(i, copies[j], len(nodes)) + np.bincount(j, copies[i], len(nodes))
        root = forest(len(nodes), i, j)
        for k in np.flatnonzero(links > 0).tolist():
            yield int(nodes[k]), int(links[k]), int(nodes[root[k]])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
        key, held, found = None, ([], [], [], []), []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], schema=schema)
            found.clear()
            return made

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(7)]
            vectors = batch.column(7)
            width = np.diff(vectors.offsets.to_numpy())
            flat, at = vectors.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(width)])
            for r, (label, dim, i, j, *rest) in enumerate(zip(*columns, strict=True)):
                if (label, dim, i, j) != key:
                    if held[1]:
                        found.extend(tile(key, *held))
                    key, held = (label, dim, i, j), ([], [], [], [])
                for c, x in zip(held, (*rest, flat[at[r] : at[r + 1]]), strict=True):
                    c.append(x)
            if found:
                yield out()
        if held[1]:
            found.extend(tile(key, *held))
        if found:
            yield out()

    return rows.select("label", "dim", "i", "j", "block", "node", "copies", "embedding").mapInArrow(run, "node long, links long, root long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``.

    Vectors of one label (not null) and one length link when their cosine, in double precision, is ``threshold`` or more. Vectors that are null,
    empty or zero, or hold null or non-finite components, link with nothing, nor do rows without an id. Equal vectors of a label are one class: compared
    once, counted as often as they occur. n_links: other rows linked directly; component_id: least id reachable, the row's own included; kept: they
    are equal (a row of a null id is kept, its component null). All pairs of a label are compared, in tiles of two blocks; tiles return a link count and
    a root for each vector, not the pairs. Rows that share an id but not their vector are one node: it has the links of all its vectors. An empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    base = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("embedding"), F.col(f"`{label_col}`").alias("label"))
    fine = "vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)"
    base = base.withColumn("fine", F.coalesce(F.expr(fine), F.lit(False)))
    classes = base.where("fine").groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    classes, _ = materialize(classes.withColumn("dim", F.size("embedding")), "classes")
    blocks = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    dealt = classes.join(blocks, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["label", "dim", "i", "j"]
    met, _ = materialize(_tiles(dealt.repartition(parts, *keys).sortWithinPartitions(*keys), threshold), "tiles")
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    found = connected_components(met.select(F.col("node").alias("u"), F.col("root").alias("v")))
    known = classes.select("label", "embedding", "node", "copies").join(links, "node", "left").join(found, "node", "left")
    known = known.select("label", "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    good = base.where("fine").join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = base.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = good.union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
