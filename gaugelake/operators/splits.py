"""Train, validation and test assignments without leaks. Chance comes from md5 of a seed and an id: the same in any engine and partitioning.

All seeds of a strategy are dealt at once: rows carry the columns ``repeat`` and ``seed``, and ranks, quotas and similarities are taken within
them. Slim tables are written between the steps, so a plan stays as long as one step.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugelake.functions.columns import sample_key
from gaugelake.operators.overlap import without_entities_of
from gaugelake.operators.quantiles import grouped_quantiles, with_quantiles
from gaugelake.operators.ranks import places, running_sums
from gaugelake.operators.similarity import max_similarity_by_task
from gaugelake.tables import large, small, written

SEEDS = (13, 37, 73, 101, 137)
STRATEGIES = ("random", "group", "low_similarity")
_TASK = ("repeat", "seed")
_KEYS = ("strategy", "repeat", "seed")


def seed_tasks(spark: SparkSession, seeds: Iterable[int]) -> DataFrame:
    """(repeat, seed): a row a seed, which callers may broadcast. An expression: a list of rows would start Python workers of its own on all executors."""
    listed = F.array(*[F.lit(int(s)) for s in seeds]).cast("array<int>")
    return spark.range(1).select(F.posexplode(listed).alias("repeat", "seed")).withColumn("repeat", F.col("repeat") + 1)


def quantile_bins(df: DataFrame, value: str, max_bins: int = 10) -> DataFrame:
    """``df`` with ``bin``: linear-quantile bins from 0, closed on the right; equal edges are one.

    Null for all rows when there are under 20, or when fewer than two bins or a bin of one row would come out.
    """
    df, seen = written(df, "values")
    none = F.lit(None).cast("int")
    if seen["n"] < 20:
        return df.withColumn("bin", none)
    q = min(max_bins, max(2, seen["n"] // 20))
    cuts = grouped_quantiles(df, [], value, {f"e{k}": k / q for k in range(q + 1)})
    edges = cuts.select(F.array_distinct(F.array(*[f"e{k}" for k in range(q + 1)])).alias("_edges"))
    below = F.size(F.filter("_edges", lambda e: e < F.col(value)))
    binned = df.crossJoin(F.broadcast(edges)).withColumn("bin", (F.greatest(below, F.lit(1)) - 1).cast("int")).drop("_edges")  # one row of max_bins + 1 numbers
    binned, _ = written(binned, "bins")
    sizes = [r["count"] for r in binned.groupBy("bin").count().collect()]  # a row a bin
    return binned if len(sizes) >= 2 and min(sizes) >= 2 else binned.withColumn("bin", none)


def chance_rank(df: DataFrame, keys: list[str], id_col: str, seed: Column | int) -> DataFrame:
    """``df`` with ``chance``: the place, from 1, of each row in its group's md5 order."""
    return places(df.withColumn("_hash", sample_key(seed, F.col(id_col))), keys, ["_hash", id_col], "chance").drop("_hash")


def score_rank(df: DataFrame, score: str, id_col: str, seed: Column | int, keys: list[str] | None = None) -> DataFrame:
    """``df`` with ``place``: from 1 in its group by score, then by md5 of seed and id."""
    return places(df.withColumn("_hash", sample_key(seed, F.col(id_col))), keys or [], [score, "_hash", id_col]).drop("_hash")


def quotas(sizes: DataFrame, share: float, key: str = "bin", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, key, quota): whole numbers near share * n that sum to the rounded share of all of a group, by largest remainder. One row a stratum."""
    exact = sizes.withColumn("_exact", F.col("n") * share).withColumn("quota", F.floor("_exact"))
    group = Window.partitionBy(*keys)
    left = F.bround(F.sum("n").over(group) * F.lit(share)) - F.sum("quota").over(group)
    order = group.orderBy(F.desc(F.round(F.col("_exact") - F.col("quota"), 9)), F.col(key))
    return exact.withColumn("_more", F.row_number().over(order) <= left).select(*keys, key, (F.col("quota") + F.col("_more").cast("int")).cast("long").alias("quota"))


def stratified_split(df: DataFrame, share: float, seed: Column | int, id_col: str = "entity_id", bin_col: str = "bin", keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``chosen``: true for ``share`` of each group's rows, spread over its strata by largest remainder. Null strata are one."""
    ranked, _ = written(chance_rank(df, [*keys, bin_col], id_col, seed), "chances")
    sizes = ranked.groupBy(*keys, bin_col).agg(F.max("chance").alias("n"))
    strata, seen = written(quotas(sizes, share, bin_col, keys).withColumnsRenamed({c: f"_{c}" for c in (*keys, bin_col)}), "quotas")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, bin_col)]
    joined = ranked.join(small(strata, seen["n"]), on)
    return joined.withColumn("chosen", F.col("chance") <= F.col("quota")).drop("chance", "quota", *[f"_{c}" for c in (*keys, bin_col)])


def _random(binned: DataFrame, tasks: DataFrame) -> DataFrame:
    """(repeat, seed, entity_id, partition) of 80/10/10 by strata; the second cut takes the next seed."""
    rows = binned.select("entity_id", "bin").crossJoin(F.broadcast(tasks))  # a row a seed
    first, _ = written(stratified_split(rows, 0.8, F.col("seed"), keys=_TASK), "train")
    rest = stratified_split(first.where("NOT chosen").drop("chosen"), 0.5, F.col("seed") + 1, keys=_TASK)
    late = rest.select(*_TASK, "entity_id", F.when(F.col("chosen"), "validation").otherwise("test").alias("partition"))
    return first.where("chosen").select(*_TASK, "entity_id", F.lit("train").alias("partition")).unionByName(late)


def random_partitions(targets: DataFrame, seed: int, value: str = "target") -> DataFrame:
    """(entity_id, partition): 80/10/10, stratified by value; the second cut takes the next seed."""
    binned = quantile_bins(targets.select("entity_id", value), value)
    return _random(binned, seed_tasks(targets.sparkSession, [seed])).select("entity_id", "partition")


def group_of(group: Column, name: Column) -> Column:
    """The group, or one of the entity's own where there is none."""
    return F.when(F.trim(F.coalesce(group, F.lit(""))).isin("", "[NO_SCAFFOLD]"), F.concat(F.lit("ACYCLIC_SINGLETON::"), name.cast("string"))).otherwise(group)


def _grouped(targets: DataFrame, tasks: DataFrame, shares: tuple[float, float, float], large: float) -> DataFrame:
    """(repeat, seed, entity_id, partition), groups whole: see :func:`group_partitions`."""
    targets, seen = written(targets.select("entity_id", "grp"), "groups")
    total, all_ = float(seen["n"]), F.lit(float(seen["n"]))
    hashed = sample_key(F.col("seed"), F.col("grp"))
    unit = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("double") / float(1 << 32)
    sizes = targets.groupBy("grp").agg(F.count("*").alias("n")).crossJoin(F.broadcast(tasks)).withColumn("_hash", hashed)  # a row a seed
    sizes, _ = written(sizes.withColumn("weight", F.col("n") * (0.9 + 0.2 * unit)), "sizes")
    is_large = F.col("n") >= large * total
    item = F.struct((-F.col("weight")).alias("w"), "grp", F.col("n").cast("double").alias("n"))
    # A seed without large groups still needs its row.
    ordered = tasks.join(sizes.where(is_large).groupBy(*_TASK).agg(F.array_sort(F.collect_list(item)).alias("groups")), [*_TASK], "left")
    kind = targets.schema["grp"].dataType.simpleString()
    groups = F.coalesce("groups", F.array().cast(f"array<struct<w: double, grp: {kind}, n: double>>"))
    need = [f"({total!r}D * {s} - acc.f[{k}])" for k, s in enumerate(shares)]
    fill = [f"(acc.f[{k}] / ({total!r}D * {s}))" for k, s in enumerate(shares)]
    close = [f"({x} <= array_min(array({', '.join(fill)})) + 1e-9)" for x in fill]
    most = f"greatest({', '.join(f'CASE WHEN {x} THEN {n} ELSE double(-1e300) END' for x, n in zip(close, need, strict=True))})"
    pick = f"CASE WHEN {close[0]} AND {need[0]} >= {most} THEN 0 WHEN {close[1]} AND {need[1]} >= {most} THEN 1 ELSE 2 END"
    step = f"""transform(array({pick}), p -> named_struct('f', transform(acc.f, (v, k) -> v + CASE WHEN k = p THEN g.n ELSE double(0) END), 'out', concat(acc.out, array(struct(g.grp AS grp, p AS p)))))[0]"""
    start = f"named_struct('f', array(double(0), double(0), double(0)), 'out', cast(array() AS array<struct<grp: {kind}, p: int>>))"
    done, _ = written(ordered.withColumn("groups", groups).select(*_TASK, F.expr(f"aggregate(groups, {start}, (acc, g) -> {step})").alias("a")), "large")
    names = F.array(F.lit("train"), F.lit("validation"), F.lit("test"))
    folded = done.select(*_TASK, F.explode("a.out").alias("x")).select(*_TASK, "x.grp", F.element_at(names, F.col("x.p") + 1).alias("partition"))
    # What each partition lacks, as shares of all small groups' entities.
    lacks = [F.greatest(all_ * s - F.col("a.f").getItem(k), F.lit(0.0)) for k, s in enumerate(shares)]
    open_ = done.select(*_TASK, *[x.alias(f"_l{k}") for k, x in enumerate(lacks)])
    ahead, _ = written(running_sums(sizes.where(~is_large), [*_TASK], ["_hash", "grp"], ["n"]), "ahead")  # entities of the groups before, in md5 order
    small_total = ahead.groupBy(*_TASK).agg(F.sum("n").alias("_small"))
    dealt = ahead.join(F.broadcast(open_), [*_TASK]).join(F.broadcast(small_total), [*_TASK])  # a row a seed, twice
    share = (F.col("before_n") + F.col("n") / 2) / F.col("_small") * (F.col("_l0") + F.col("_l1") + F.col("_l2"))
    rest = dealt.select(*_TASK, "grp", F.when(share < F.col("_l0"), "train").when(share < F.col("_l0") + F.col("_l1"), "validation").otherwise("test").alias("partition"))
    return targets.join(folded.unionByName(rest), "grp").select(*_TASK, "entity_id", "partition")


def group_partitions(targets: DataFrame, seed: int, shares: tuple[float, float, float] = (0.8, 0.1, 0.1), large: float = 0.001) -> DataFrame:
    """(entity_id, partition), groups (column grp) whole.

    Groups of a share ``large`` of all entities and more go one after another, by size, a little shuffled, to the partition that is filled least for its share; near ties go
    to the one that lacks most, then to train before validation before test. There are 1 / ``large`` of them at most, folded in one row. All smaller groups follow in md5
    order: a running sum of their entities fills what each partition lacks, which a single group hardly changes.
    """
    return _grouped(targets, seed_tasks(targets.sparkSession, [seed]), shares, large).select("entity_id", "partition")


def _provisional(binned: DataFrame, tasks: DataFrame) -> DataFrame:
    """(repeat, seed, entity_id, partition): the stratified 70 % that the low-similarity strategy compares the rest with."""
    rows = binned.select("entity_id", "bin").crossJoin(F.broadcast(tasks))  # a row a seed
    chosen, _ = written(stratified_split(rows, 0.7, F.col("seed"), keys=_TASK), "provisional")
    return chosen.select(*_TASK, "entity_id", F.when(F.col("chosen"), "train").otherwise("rest").alias("partition"))


def _least_similar(sides: DataFrame, scored: DataFrame) -> DataFrame:
    """(repeat, seed, entity_id, max_similarity, partition) of the rest: the tenth of all ``sides`` with the least of ``scored`` is test, the next one validation."""
    ranked = score_rank(scored.select(*_TASK, "entity_id", "max_similarity"), "max_similarity", "entity_id", F.col("seed"), [*_TASK])
    each = sides.groupBy(*_TASK).agg(F.bround(F.lit(0.1) * F.count("*")).cast("long").alias("tenth"))
    cut = ranked.join(F.broadcast(each), [*_TASK])  # a row a seed
    part = F.when(F.col("place") <= F.col("tenth"), "test").when(F.col("place") <= 2 * F.col("tenth"), "validation").otherwise("train")
    return cut.select(*_TASK, "entity_id", "max_similarity", part.alias("partition"))


def _low_similarity(binned: DataFrame, bits: DataFrame, tasks: DataFrame) -> DataFrame:
    """(repeat, seed, entity_id, partition) of the low-similarity strategy, from one product of all blocks for all seeds."""
    sides = _provisional(binned, tasks)
    late = _least_similar(sides, max_similarity_by_task(sides, bits, [*_TASK]).where("partition = 'rest'"))
    return sides.where("partition = 'train'").unionByName(late.drop("max_similarity"))


def low_similarity_partitions(targets: DataFrame, bits: DataFrame, seed: int, value: str = "target") -> DataFrame:
    """(entity_id, partition): of a stratified 30 %, the tenth of all least like the other 70 % is test, the next tenth validation."""
    binned = quantile_bins(targets.select("entity_id", value), value)
    return _low_similarity(binned, bits, seed_tasks(targets.sparkSession, [seed])).select("entity_id", "partition")


def with_similarity(assignments: DataFrame, bits: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``assignments`` with max_similarity to the final train rows of their task (columns ``keys``); null for train."""
    return max_similarity_by_task(assignments, bits, list(keys))


def split_assignments(targets: DataFrame, bits: DataFrame, strategies: Iterable[str] = STRATEGIES, seeds: Iterable[int] = SEEDS, value: str = "target", group: str = "grp", similar: bool = True) -> DataFrame:
    """(strategy, repeat, seed, entity_id, partition, grp, max_similarity) of all strategies and seeds.

    Each strategy deals all seeds at once, and one product of all blocks of bits finds the greatest similarity to the train rows of every task; a second, small one
    adds the rows that the low-similarity strategy makes train by it. Without ``similar`` that column is not there, and only that strategy compares rows.
    """
    chosen = list(strategies)
    if unknown := sorted(set(chosen).difference(STRATEGIES)):
        raise ValueError(f"unknown strategies: {unknown}")
    tasks = seed_tasks(targets.sparkSession, seeds)
    slim, _ = written(targets.select("entity_id", F.col(value).alias("target"), F.col(group).alias("grp")), "targets")
    binned = quantile_bins(slim.select("entity_id", "target"), "target") if {"random", "low_similarity"} & set(chosen) else None
    low = _provisional if similar else lambda binned, tasks: _low_similarity(binned, bits, tasks)
    made = {"random": lambda: _random(binned, tasks), "group": lambda: _grouped(slim, tasks, (0.8, 0.1, 0.1), 0.001), "low_similarity": lambda: low(binned, tasks)}
    parts = {s: made[s]().withColumn("strategy", F.lit(s)) for s in chosen}
    every = reduce(DataFrame.unionByName, [parts[s] for s in chosen])
    columns = [*_KEYS, "entity_id", "partition", "grp"]
    with_group = lambda df: df.join(large(slim.select("entity_id", "grp")), "entity_id").select(*columns, *[c for c in df.columns if c not in columns])
    if not similar:
        return with_group(every)
    scored = with_similarity(every.select(*_KEYS, "entity_id", "partition"), bits, _KEYS)
    if "low_similarity" not in parts:
        return with_group(scored)
    # What the rest has in common with the first train rows is known by now; those of the rest that become train are few.
    late = _least_similar(parts["low_similarity"], scored.where("strategy = 'low_similarity' AND partition = 'rest'")).withColumn("strategy", F.lit("low_similarity"))
    late = with_similarity(late.withColumnRenamed("max_similarity", "_first"), bits, _KEYS)
    late = late.withColumn("max_similarity", F.when(F.col("partition") != "train", F.greatest("max_similarity", "_first"))).drop("_first")
    return with_group(scored.where("partition <> 'rest'").unionByName(late))


def holdout_manifest(obs: DataFrame, seeds: tuple[int, ...] = SEEDS, train_share: float = 0.9) -> DataFrame:
    """(heldout, repeat, seed, entity_id, partition): each source is held out in turn; no entity of it is in train or validation; the test set is the same for all seeds."""
    test, _ = written(obs.where("source IS NOT NULL AND entity_id IS NOT NULL").select(F.col("source").alias("heldout"), "entity_id").distinct(), "heldout")
    sources, counted = written(obs.select(F.col("source").alias("heldout")).where("heldout IS NOT NULL").distinct(), "sources")
    rest = obs.where("entity_id IS NOT NULL").select("entity_id", "source").distinct().join(small(sources, counted["n"]), F.col("source") != F.col("heldout")).select("heldout", "entity_id").distinct()
    fit, _ = written(without_entities_of(rest, test), "fit")
    tasks = F.broadcast(seed_tasks(obs.sparkSession, seeds))  # a row a seed
    sizes = fit.groupBy("heldout").agg(F.bround(F.lit(train_share) * F.count("*")).cast("long").alias("quota"))
    ranked = chance_rank(fit.crossJoin(tasks), ["heldout", "repeat"], "entity_id", F.col("seed")).join(small(sizes, counted["n"]), "heldout")
    fitted = ranked.select("heldout", "repeat", "seed", "entity_id", F.when(F.col("chance") <= F.col("quota"), "train").otherwise("validation").alias("partition"))
    return fitted.unionByName(test.crossJoin(tasks).select("heldout", "repeat", "seed", "entity_id", F.lit("test").alias("partition")))


def split_quality(assignments: DataFrame, targets: DataFrame) -> DataFrame:
    """For each task and partition: size, groups, target spread, similarity, and its share of the task. Medians by radix selection: a partition may be of any size."""
    keys = ["strategy", "repeat", "seed", "partition"]
    slim = assignments.select(*keys, "entity_id", "grp", "max_similarity").join(large(targets.select("entity_id", "target")), "entity_id")
    df, _ = written(slim.drop("entity_id"), "assigned")
    groups = df.groupBy(*keys, "grp").agg(F.count("*").alias("n"))  # two steps: a partition's groups are counted over many tasks
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("target").alias("target_mean"), F.stddev_samp("target").alias("target_sd"), F.min("target").alias("target_min"), F.max("target").alias("target_max")
    )
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    counted = groups.groupBy(*keys).agg(F.count("grp").alias("groups")).withColumnsRenamed({k: f"_{k}" for k in keys})
    out = out.join(counted, on).drop(*[f"_{k}" for k in keys])
    out = with_quantiles(out, df, keys, "target", {"target_median": 0.5})
    out = with_quantiles(out, df, keys, "max_similarity", {"similarity_median": 0.5})
    names = ["n", "groups", "target_mean", "target_sd", "target_median", "target_min", "target_max", "similarity_median"]
    return out.select(*keys, *names).withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy("strategy", "repeat")))  # a row a partition
