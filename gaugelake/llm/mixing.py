"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents fall into blocks in a pseudo-random order. A source's quota is a number of blocks, taken from
as many whole passes over its order as its target asks for. A tree halves the set of output shards again and again; at each node the
exact block quotas of all sources are split between the halves by one multivariate-hypergeometric draw, so every shard gets
a random but exactly adding up share. A shard's blocks are then consecutive in each source's order, hence disjoint, and
its documents are shuffled within the shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugelake.llm._shared import SPACE, materialize

#: A source has at most so many blocks, and about so many documents in each of them.
MAX_BLOCKS, BLOCK_DOCS = 65_536, 16
#: Blocks of a stretch: sums of blocks are taken in two steps.
STRETCH = 256
#: Output shards.
SHARDS = 64


def words_in(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}|{SPACE}$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def order_number(seed: int, *columns: Column) -> Column:
    """A pseudo-random number of 60 bits that any SQL engine with md5 can compute."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, n_docs, target) for each source of (source, size).

    Sources by code point, null last, take ``weights`` in turn. Targets sum to ``share`` times all sizes in proportion to the
    weights; none exceeds ``cap`` times its source's size, and what is over goes to the others by weight until none is above:
    target = min(cap * size, level * weight) with one level for all. One row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source"))
    every = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(every, (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int")))
    full = Window.orderBy(cap * F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    filled = full.rowsBetween(Window.unboundedPreceding, -1)
    open_ = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = Window.partitionBy()
    # With the sources before this one at their cap, the level the others would share.
    level = (share * F.sum("source_size").over(total) - cap * F.coalesce(F.sum("source_size").over(filled), F.lit(0))) / F.sum("weight").over(open_)
    per = per.withColumn("_level", level).withColumn("_stays", F.col("_level") * F.col("weight") <= cap * F.col("source_size"))
    shared = F.coalesce(F.max(F.when(F.col("_stays"), F.col("_level"))).over(total), F.lit(float("inf")))
    per = per.withColumn("target", F.least(cap * F.col("source_size"), shared * F.col("weight")))
    return per.select("source", "source_size", "n_docs", F.when(F.col("source_size") > 0, F.col("target")).otherwise(0.0).alias("target"))


#: Largest population of one draw: the generator takes no more.
MOST = 500_000_000


def hypergeometric(random: np.random.Generator, colours: np.ndarray, n: int) -> np.ndarray:
    """How many of each colour ``n`` draws without replacement take. Populations over :data:`MOST` are cut into strata of equal make-up, each with its share of the draws."""
    total = int(colours.sum())
    if total < MOST:
        return random.multivariate_hypergeometric(colours, n, method="marginals")
    k = -(-total // (MOST // 2))
    edges = [colours * i // k for i in range(k + 1)]
    sums = [int(e.sum()) for e in edges]
    drawn = [n * s // total for s in sums]
    return sum(random.multivariate_hypergeometric(edges[i + 1] - edges[i], drawn[i + 1] - drawn[i], method="marginals") for i in range(k))


def splitting_tree(quotas: np.ndarray, n_shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows): rows differ by at most one in their sums, columns sum to ``quotas``."""
    out, total = np.zeros((n_shards, len(quotas)), np.int64), int(quotas.sum())
    bounds = [total * i // n_shards for i in range(n_shards + 1)]
    nodes = [(0, n_shards, quotas.astype(np.int64))]
    while nodes:
        lo, hi, left_over = nodes.pop()
        if hi - lo == 1:
            out[lo] = left_over
            continue
        mid = (lo + hi) // 2
        draw = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        left = hypergeometric(draw, left_over, bounds[mid] - bounds[lo])
        nodes += [(lo, mid, left), (mid, hi, left_over - left)]
    return out


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    *,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    n_shards: int = SHARDS,
    seed: int = 17,
    size_col: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sized, draws, sources) of a mix of ``docs``.

    sized: every row of ``docs`` as the struct ``row`` with source, size, source_size, target and times, the number of times the mix takes it.
    draws: one row for each time: ``row``, pass (from 0), shard, place (a number to sort a shard's documents by).
    sources: (source, source_size, n_docs, target).

    Whole passes are taken of every block; the last, partial one takes blocks in order up to the target and, within the block
    that crosses it, documents in order while their words' middle lies below it, so a source misses its target by less than one document.
    No document is taken more than ``cap`` (rounded up) times. Everything follows from ids, source and ``seed``: reruns agree on any cluster.
    A null text has size 0, a null source is a source of its own, the last in order; null ids and repeated rows are documents like others
    (rows equal in id, source and size are taken alike up to the crossing point). Texts of any length count whole. An empty table gives empty results;
    other columns of any name stay in ``row``.
    The tree sees one quota a source: a few numbers for each source, never of each document. Its shards decide the draws: a block's draw
    that no shard takes is none. ``size_col``: a column of sizes, where the words are counted already.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    size = F.col(f"`{size_col}`") if size_col else words_in(F.col(f"`{text_col}`"))
    base = docs.select(row, F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").alias("source"), size.alias("size"))
    slim = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").alias("source"), size.alias("size"))
    sizes, _ = materialize(slim.withColumn("_number", order_number(seed, F.col("_id"))), "sizes")
    sources, _ = materialize(source_targets(sizes, weights, share, cap), "sources")
    n_blocks = F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), F.floor(F.col("n_docs") / BLOCK_DOCS))).cast("long")
    passes = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("long")
    sources = sources.withColumns({"_blocks": n_blocks, "_passes": passes}).withColumn("_rest", F.col("target") - F.col("_passes") * F.col("source_size"))
    # A source's row meets all its documents; there are as many rows as sources.
    with_block = _with_source(sizes, sources).withColumn("_block", F.pmod(F.col("_number"), F.col("_blocks")))
    blocks = with_block.groupBy("source", "_block").agg(F.sum("size").alias("_words"), F.first("_rest").alias("_rest"))
    # Sums up to a block: those of the stretches of blocks before its own, and of the blocks before it there.
    blocks = blocks.withColumn("_stretch", F.floor(F.col("_block") / STRETCH))
    ahead = Window.partitionBy("source").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)  # MAX_BLOCKS / STRETCH rows at most
    stretches = blocks.groupBy("source", "_stretch").agg(F.sum("_words").alias("_w")).withColumn("_ahead", F.coalesce(F.sum("_w").over(ahead), F.lit(0))).drop("_w")
    running = Window.partitionBy("source", "_stretch").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = _with_source(blocks, stretches, ["_stretch"]).withColumn("_end", F.col("_ahead") + F.sum("_words").over(running)).withColumn("_before", F.col("_end") - F.col("_words"))
    blocks, _ = materialize(blocks.withColumn("_extra", F.when(F.col("_end") <= F.col("_rest"), 2).when(F.col("_before") < F.col("_rest"), 1).otherwise(0)), "blocks")
    edge = blocks.where("_extra = 1").select("source", "_block", "_before")  # one block a source at most
    in_edge = _with_source(with_block, edge, ["_block"])
    documents = Window.partitionBy("source").orderBy("_number", "_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossing = in_edge.withColumn("_upto", F.col("_before") + F.sum("size").over(documents)).where(F.col("_upto") - F.col("size") / 2 <= F.col("_rest"))
    last = crossing.groupBy("source").agg(F.max(F.struct("_number", F.col("_id").alias("id"), F.col("size").alias("size"))).alias("_last"))
    state = sources.join(edge.select("source", F.col("_block").alias("_edge")), sources["source"].eqNullSafe(edge["source"]), "left").drop(edge["source"])
    ends = blocks.where("_extra = 2").groupBy("source").agg(F.max("_block").alias("_upto_block"))
    state = state.join(ends.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    state = state.join(last.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    state, _ = materialize(state, "state")
    numbered = base.withColumn("_number", order_number(seed, F.col("_id")))
    sized = _with_source(numbered, state).withColumn("_block", F.pmod(F.col("_number"), F.col("_blocks")))
    mine = F.struct("_number", F.col("_id").alias("id"), F.col("size").alias("size"))
    extra = (F.col("_block") <= F.coalesce("_upto_block", F.lit(-1))) | ((F.col("_block") == F.col("_edge")) & (mine <= F.col("_last")))
    extra = extra & (F.col("_rest") > 0)
    sized = sized.withColumn("times", (F.col("_passes") + F.when(F.coalesce(extra, F.lit(False)), 1).otherwise(0)).cast("long"))
    draws = _draws(sized, state, n_shards, seed)
    return sized.select("row", "source", "size", "source_size", "target", "times"), draws, sources.select("source", "source_size", "n_docs", "target")


def _with_source(many: DataFrame, few: DataFrame, more: tuple | list = ()) -> DataFrame:
    """``many`` with the columns of its source's row (and of ``more`` keys) in ``few``; a null source is a source."""
    right = few.withColumnRenamed("source", "_s").withColumnsRenamed({c: f"_k{c}" for c in more})
    on = many["source"].eqNullSafe(right["_s"])
    for c in more:
        on = on & (many[c] == right[f"_k{c}"])
    return many.join(right, on).drop("_s", *[f"_k{c}" for c in more])


def _draws(sized: DataFrame, state: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """One row for each time that a document is taken, with its shard and its place there."""
    spark = sized.sparkSession
    last_blocks = F.when(F.col("_rest") > 0, F.coalesce("_edge", "_upto_block", F.lit(-1)) + 1).otherwise(0)
    quota = state.select("source", "_blocks", (F.col("_passes") * F.col("_blocks") + last_blocks).cast("long").alias("_quota"))
    quotas = quota.orderBy(F.col("source").isNull(), "source").collect()  # one row a source
    tree = splitting_tree(np.array([q["_quota"] for q in quotas], np.int64), n_shards, seed)
    ends = np.cumsum(tree, axis=0)
    # A shard takes the next run of its source's blocks: block b of pass p is the draw number p * blocks + b.
    plan = [(q["source"], [int(x) for x in ends[:, k]]) for k, q in enumerate(quotas)]
    plan_df, _ = materialize(spark.createDataFrame(plan, "source string, _ends array<long>"), "plan")
    tried = _with_source(sized.withColumn("pass", F.explode(F.expr("sequence(0L, _passes)"))), plan_df)
    draw = F.col("pass") * F.col("_blocks") + F.col("_block")
    shard = F.size(F.filter("_ends", lambda e: e <= draw))
    # The last block of the last pass is taken up to a document.
    mine = F.struct("_number", F.col("_id").alias("id"), F.col("size").alias("size"))
    whole = (F.col("pass") < F.col("_passes")) | ~F.col("_block").eqNullSafe(F.col("_edge")) | F.coalesce(mine <= F.col("_last"), F.lit(False))
    taken = tried.withColumn("shard", shard).where((F.col("shard") < n_shards) & whole)
    return taken.select("row", "size", "pass", "shard", order_number(seed + 1, F.col("_id"), F.col("pass")).alias("place"))
