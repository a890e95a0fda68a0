"""Checks. Each returns rows (check, detail) of what is wrong; none means that all is well."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Where a target of a hold-out task comes from.
ORIGINS = {"test": "heldout_source_only", "fit": "nonheldout_sources_only"}


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    """Raise before any work when a column is missing."""
    if missing := sorted(set(names).difference(df.columns)):
        raise ValueError(f"missing columns: {missing}")


def refuse_columns(df: DataFrame, names: Iterable[str]) -> None:
    """Raise when a column that must not be there (an outcome among predictors) is."""
    if found := sorted(set(names).intersection(df.columns)):
        raise ValueError(f"forbidden columns: {found}")


def _told(df: DataFrame, check: str, *parts: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.concat_ws(" ", *[p.cast("string") for p in parts]).alias("detail"))


def union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row."""
    return _told(df.groupBy(*keys).count().where("count > 1"), f"repeated {'+'.join(keys)}", *[F.col(k) for k in keys])


def differing_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side alone."""
    left, right = (x.select(*keys).distinct() for x in (a, b))
    return union([_told(left.join(right, keys, "left_anti"), "only on the left", *map(F.col, keys)), _told(right.join(left, keys, "left_anti"), "only on the right", *map(F.col, keys))])


def inconsistent(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Groups in which a column that depends on the key has several values; a null beside a value counts as a second one."""
    kinds = [(F.count_distinct(c) + F.when((F.count(c) > 0) & (F.count(c) < F.count("*")), 1).otherwise(0)).alias(c) for c in columns]
    found = df.groupBy(key).agg(*kinds)
    return union([_told(found.where(F.col(c) > 1), f"several {c}", F.col(key)) for c in columns])


def unequal_totals(a: DataFrame, left: Column, b: DataFrame, right: Column, check: str) -> DataFrame:
    """One row when two sums differ."""
    both = a.agg(left.alias("a")).crossJoin(b.agg(right.alias("b")))  # one row each
    return _told(both.where(~F.col("a").eqNullSafe(F.col("b"))), check, F.col("a"), F.col("b"))


def not_close(df: DataFrame, key: str, a: Column, b: Column, rtol: float = 1e-10, atol: float = 1e-12) -> DataFrame:
    """Rows whose stored value strays from the derived one."""
    far = F.abs(a - b) > atol + rtol * F.abs(b)
    return _told(df.where(F.coalesce(far, a.isNull() != b.isNull())), "values differ", F.col(key))


def outside(df: DataFrame, key: str, column: str, low: float, high: float) -> DataFrame:
    return _told(df.where((F.col(column) < low) | (F.col(column) > high)), f"{column} out of range", F.col(key), F.col(column))


def split_faults(assignments: DataFrame, targets: DataFrame, group_strategies: tuple[str, ...] = ("group",)) -> DataFrame:
    """Faults of (entity_id, strategy, repeat, partition, grp, max_similarity): coverage, partitions, similarity's nulls, groups that straddle partitions."""
    task = ["strategy", "repeat"]
    sizes = assignments.groupBy(*task).agg(F.count_distinct("entity_id").alias("n"), F.count_distinct("partition").alias("parts"))
    want = targets.select("entity_id").distinct().agg(F.count("*").alias("want"))
    train = F.col("partition") == "train"
    return union(
        [
            repeated_keys(assignments, [*task, "entity_id"]),
            _told(sizes.crossJoin(want).where("n <> want"), "entities missing", *map(F.col, task)),
            _told(sizes.where("parts < 3"), "a partition is empty", *map(F.col, task)),
            _told(assignments.where(~F.col("partition").isin("train", "validation", "test")), "unknown partition", F.col("partition")),
            _told(assignments.where(train != F.col("max_similarity").isNull()), "similarity is null for train alone", F.col("entity_id")),
            outside(assignments, "entity_id", "max_similarity", 0, 1),
            _told(assignments.where(F.col("strategy").isin(*group_strategies)).groupBy(*task, "grp").agg(F.count_distinct("partition").alias("n")).where("n > 1"), "group in several partitions", *map(F.col, task), F.col("grp")),
        ]
    )


def holdout_faults(tasks: DataFrame) -> DataFrame:
    """Faults of (heldout, repeat, entity_id, partition): repeats, empty partitions, entities on both sides, a test set that changes between repeats.

    Where there are these columns, also: an origin that is not its side's, and a max_similarity that is null outside train or not null in it.
    """
    task = ["heldout", "repeat"]
    test = F.col("partition") == "test"
    # A set of ids by its size and two sums of their hashes: no task gathers the ids.
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("entity_id").cast("decimal(20,0)")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "entity_id")).alias("b"))
    sets = tasks.where(test).groupBy(*task).agg(mark.alias("ids")).groupBy("heldout").agg(F.count_distinct("ids").alias("n"))
    more = []
    if "origin" in tasks.columns:
        want = F.when(test, ORIGINS["test"]).otherwise(ORIGINS["fit"])
        more.append(_told(tasks.where(~F.col("origin").eqNullSafe(want)), "origin is another side's", *map(F.col, task), F.col("entity_id")))
    if "max_similarity" in tasks.columns:
        more.append(_told(tasks.where((F.col("partition") == "train") != F.col("max_similarity").isNull()), "similarity is null for train alone", *map(F.col, task), F.col("entity_id")))
    return union(
        [
            *more,
            repeated_keys(tasks, [*task, "entity_id"]),
            _told(tasks.groupBy(*task).agg(F.count_distinct("partition").alias("n")).where("n < 3"), "a partition is empty", *map(F.col, task)),
            _told(tasks.groupBy(*task, "entity_id").agg(F.count_distinct(test).alias("n")).where("n > 1"), "entity on both sides", *map(F.col, task), F.col("entity_id")),
            _told(sets.where("n > 1"), "test set changes", F.col("heldout")),
        ]
    )


def other_bits(bits: DataFrame, n_bits: int) -> DataFrame:
    """Rows of (entity_id, bits) that are no set of places below ``n_bits``: null, repeated, or out of range."""
    bad = F.col("bits").isNull() | (F.size(F.array_distinct("bits")) != F.size("bits")) | F.exists("bits", lambda b: b.isNull() | (b < 0) | (b >= n_bits))
    return _told(bits.where(bad), "not a set of bits", F.col("entity_id"))


def other_values(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Values of wide bit columns that are neither 0 nor 1."""
    return union([_told(df.where(~F.coalesce(F.col(f"`{c}`").isin(0, 1), F.lit(False))), f"{c} is not binary", F.col(key)) for c in columns])


def ordered_entities(df: DataFrame, columns: list[str], key: str = "entity_id") -> DataFrame:
    """``columns`` of ``df`` in order of the key; a missing column, a null among them or a repeated key is an error."""
    require_columns(df, [key, *columns])
    chosen = df.select(key, *[c for c in columns if c != key])
    nulls = chosen.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in chosen.columns]).first().asDict()
    if any(nulls.values()):
        raise ValueError(f"nulls: {({c: n for c, n in nulls.items() if n})}")
    raise_if_any(repeated_keys(chosen, [key]))
    return chosen.orderBy(key)


def source_meta_faults(meta: DataFrame, top: int = 3, least_sources: int = 3, outcomes: tuple[str, ...] = ("y_top", "y_rmse", "y_regret", "y_near_best")) -> DataFrame:
    """Faults of a meta table by held-out source: repeated runs, tasks of several sources, missing outcomes of selectable runs, tasks without exactly ``top`` top runs, too few sources."""
    require_columns(meta, ["run_id", "task_id", "heldout", "selectable", *outcomes])
    can = meta.where("selectable")
    sources = can.agg(F.count_distinct("heldout").alias("n"))
    return union(
        [
            repeated_keys(meta, ["run_id"]),
            _told(meta.groupBy("task_id").agg(F.count_distinct("heldout").alias("n")).where("n <> 1"), "task of several sources", F.col("task_id")),
            *[_told(can.where(F.col(c).isNull()), f"missing {c}", F.col("run_id")) for c in outcomes],
            _told(can.groupBy("task_id").agg(F.sum(F.col("y_top").cast("int")).alias("n")).where(F.col("n") != top), "number of top runs", F.col("task_id"), F.col("n")),
            _told(sources.where(F.col("n") < least_sources), "too few sources", F.col("n")),
        ]
    )


def raise_if_any(faults: DataFrame, report: str | None = None, limit: int = 20) -> None:
    """Write the faults, if a path is given, then raise if there are any."""
    if report:
        faults.write.mode("overwrite").json(report)
    if some := faults.limit(limit).collect():
        raise ValueError("; ".join(f"{r.check}: {r.detail}" for r in some))
