"""Tasks that hold out a source: its targets and those of the others are rebuilt apart, and no entity is on both sides."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugelake.functions.columns import slug_or_error
from gaugelake.operators.checks import ORIGINS, require_columns
from gaugelake.operators.metrics import average_ranks
from gaugelake.operators.overlap import without_entities_of
from gaugelake.operators.resolve import NEEDED, resolve_targets
from gaugelake.operators.similarity import max_similarity_by_task
from gaugelake.operators.splits import SEEDS, chance_rank, group_of, seed_tasks
from gaugelake.tables import large, small, written


def source_targets(obs: DataFrame, sources: Iterable[str] | None = None, **how) -> DataFrame:
    """(heldout, side, entity_id, targets' columns, origin) of each source in turn: side test holds the source's own observations resolved, side fit those of all
    other sources without any entity of it. One aggregation resolves both sides of all sources. ``how``: as for ``resolve_targets``."""
    require_columns(obs, NEEDED)
    known = obs.where("source IS NOT NULL AND entity_id IS NOT NULL")
    names = known.select(F.col("source").alias("heldout")).distinct()
    if sources is not None:
        wanted = sorted(set(sources))
        if not wanted:
            raise ValueError("at least one held-out source is required")
        found = {r[0] for r in names.where(F.col("heldout").isin(wanted)).collect()}  # some of a list
        if missing := [s for s in wanted if s not in found]:
            raise ValueError(f"no observations of {missing}")
        names = names.where(F.col("heldout").isin(wanted))
    test = known.withColumn("heldout", F.col("source")).join(F.broadcast(names), "heldout", "left_semi")  # a row a source
    rest = known.join(F.broadcast(names), F.col("source") != F.col("heldout"))
    both = test.withColumn("side", F.lit("test")).unionByName(without_entities_of(rest, test).withColumn("side", F.lit("fit")))
    out = resolve_targets(both, **how, keys=("heldout", "side", "entity_id"))
    return out.withColumn("origin", F.when(F.col("side") == "test", ORIGINS["test"]).otherwise(ORIGINS["fit"]))


def target_audit(obs: DataFrame, targets: DataFrame) -> DataFrame:
    """For each held-out source: its rows and entities, targets of either side before and after the primary filter, and what was left out of the test side."""
    rows = obs.groupBy(F.col("source").alias("heldout")).agg(F.count("*").alias("heldout_rows"), F.count_distinct("entity_id").alias("heldout_entities"))
    test, fit = F.col("side") == "test", F.col("side") == "fit"
    sides = targets.groupBy("heldout").agg(
        F.count_if(test).alias("test_targets_before_filter"), F.count_if(test & F.col("primary")).alias("test_targets"), F.count_if(test & F.col("conflict")).alias("test_targets_in_conflict"),
        F.count_if(test & F.col("outside_review")).alias("test_targets_outside_review"), F.count_if(fit).alias("fit_targets_before_filter"), F.count_if(fit & F.col("primary")).alias("fit_targets"),
    )
    return rows.join(sides, "heldout")


def source_holdout_tasks(obs: DataFrame, bits: DataFrame | None = None, sources: Iterable[str] | None = None, seeds: Iterable[int] = SEEDS, share: float = 0.9, strata: int = 10, group: str | None = None, **how) -> DataFrame:
    """One row for each task (heldout, repeat) and entity: partition, origin, max_similarity to the task's train rows, group and the target's columns.

    The test side is the same for all seeds. Of the fit side ``share`` is train and the rest validation, drawn by md5 within strata of equal size by target. ``bits``:
    (entity_id, bits) for similarities, null for train rows and without it; an entity without bits is an error. ``group``: a label column of ``obs``.
    """
    targets = source_targets(obs, sources, **how | ({"labels": (*how.get("labels", ()), group)} if group else {})).where("primary")
    kept = ["reliability", "n_observations", "n_sources", "sources", "value_range", "primary", "origin"]
    named = targets.withColumn("grp", group_of(F.col(group).cast("string"), F.col("entity_id")) if group else F.lit(None).cast("string"))
    slim, _ = written(named.select("heldout", "side", "entity_id", "target", "grp", *kept), "targets")
    if bits is not None and (bare := large(slim).join(large(bits), "entity_id", "left_anti").select("entity_id").limit(5).collect()):
        raise ValueError(f"no bits for {[r[0] for r in bare]}")
    tasks = F.broadcast(seed_tasks(obs.sparkSession, seeds))  # a row a seed
    fit = slim.where("side = 'fit'")
    ranked = average_ranks(fit, ["heldout"], "target", "_rank")
    sizes, seen = written(fit.groupBy("heldout").agg(F.count("*").alias("_n")), "sizes")
    binned = ranked.join(small(sizes, seen["n"]), "heldout").withColumn("_bin", F.least(F.floor((F.col("_rank") - 0.5) * strata / F.col("_n")), F.lit(strata - 1)).cast("int"))
    binned, _ = written(binned.drop("_rank", "_n"), "strata")
    upto = Window.partitionBy("heldout").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # ``strata`` rows
    whole = lambda c: F.bround(share * c).cast("long")
    quota = binned.groupBy("heldout", "_bin").agg(F.count("*").alias("_k")).withColumn("_upto", F.sum("_k").over(upto)).select("heldout", "_bin", (whole(F.col("_upto")) - whole(F.col("_upto") - F.col("_k"))).alias("_quota"))
    quota, seen = written(quota, "quotas")
    dealt = chance_rank(binned.crossJoin(tasks), ["heldout", "repeat", "_bin"], "entity_id", F.col("seed")).join(small(quota, seen["n"]), ["heldout", "_bin"])
    dealt = dealt.withColumn("partition", F.when(F.col("chance") <= F.col("_quota"), "train").otherwise("validation"))
    test = slim.where("side = 'test'").crossJoin(tasks).withColumn("partition", F.lit("test"))
    columns = ["heldout", "repeat", "seed", "entity_id", "partition", "grp", "target", *kept]
    out = dealt.select(*columns).unionByName(test.select(*columns))
    out = out.withColumn("max_similarity", F.lit(None).cast("double")) if bits is None else max_similarity_by_task(out, bits, ["heldout", "repeat"])
    strategy = F.concat(F.lit("source_holdout_"), slug_or_error(F.col("heldout")))
    return out.withColumns({"strategy": strategy, "task_id": F.concat(strategy, F.lit("_r"), F.col("repeat").cast("string"))})


def holdout_summary(tasks: DataFrame) -> DataFrame:
    """One row a task: entities of each partition, the spread of test targets, the similarity of test entities to the train rows, and the share of them in groups the fit side lacks."""
    keys = ["task_id", "heldout", "repeat", "seed"]
    test, fit = F.col("partition") == "test", F.col("partition") != "test"
    t, s = F.when(test, F.col("target")), F.when(test, F.col("max_similarity"))
    groups = tasks.groupBy(*keys, "grp").agg(F.count_if(fit).alias("_f"), F.count_if(test).alias("_t"))
    unseen = groups.groupBy(*keys).agg((F.sum(F.when(F.col("_f") == 0, F.col("_t")).otherwise(0)) / F.sum("_t")).alias("test_unseen_group_fraction"))
    out = tasks.groupBy(*keys).agg(
        *[F.count_if(F.col("partition") == p).alias(f"{p}_entities") for p in ("train", "validation", "test")], F.count_if(fit).alias("fit_entities"), F.avg(t).alias("test_target_mean"), F.stddev_samp(t).alias("test_target_sd"),
        F.avg(s).alias("test_similarity_mean"), F.median(s).alias("test_similarity_median"), F.percentile(s, F.lit(0.1)).alias("test_similarity_p10"), F.min(s).alias("test_similarity_min"),
    )
    return out.join(unseen, keys)


ASSIGNMENT = ("strategy", "repeat", "seed", "entity_id", "partition", "grp", "max_similarity")
TARGET = ("entity_id", "target", "reliability", "n_observations", "n_sources", "value_range", "primary")


def task_inputs(task: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assignments, targets): two views of one task's rows."""
    return task.select(*ASSIGNMENT), task.select(*TARGET)


def task_rows(tasks: DataFrame, structures: DataFrame, text: str = "canonical", task_ids: Iterable[str] | None = None, limit: int | None = None) -> DataFrame:
    """All rows of the tasks (in order of their ids; those named, and of these the first ``limit``) with each entity's structure text: the input of an external trainer.

    An unknown task, an entity without a structure or a task without all three partitions is an error.
    """
    names = sorted(r[0] for r in tasks.select("task_id").distinct().collect())  # a row a task
    chosen = list(task_ids) if task_ids is not None else names
    if unknown := sorted(set(chosen).difference(names)):
        raise ValueError(f"unknown tasks: {unknown}")
    if limit is not None and limit < 1:
        raise ValueError("the limit must be positive")
    rows = tasks.where(F.col("task_id").isin(chosen[:limit]))
    found = rows.join(structures.select("entity_id", F.col(text).alias("structure")), "entity_id", "left")
    if bare := found.where("structure IS NULL").select("entity_id").limit(5).collect():
        raise ValueError(f"no structure for {[r[0] for r in bare]}")
    parts = rows.groupBy("task_id").agg(F.count_distinct("partition").alias("n"), (F.count("*") - F.count_distinct("entity_id")).alias("twice"))
    if bad := parts.where("n <> 3 OR twice > 0").limit(5).collect():
        raise ValueError(f"tasks without train, validation and test rows, or with repeated entities: {[r.task_id for r in bad]}")
    return found


def with_heldout(summary: DataFrame, runs: DataFrame) -> DataFrame:
    """A summary by strategy with the source that each strategy holds out; a strategy of several sources is an error."""
    pairs = runs.select("strategy", "heldout").distinct()
    if many := pairs.groupBy("strategy").count().where("count > 1").limit(5).collect():
        raise ValueError(f"strategies of several sources: {[r.strategy for r in many]}")
    joined = summary.join(F.broadcast(pairs), "strategy", "left")  # a row a strategy
    return joined.select("heldout", *summary.columns)
