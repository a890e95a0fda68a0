"""Selectors that pick one candidate run a task, and how well they pick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def select_best(candidates: DataFrame, keys: list[str], order: list[Column], selector: str) -> DataFrame:
    """The first candidate of each group in this order, which must end with a unique column."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return candidates.withColumn("_p", place).where("_p = 1").drop("_p").withColumn("selector", F.lit(selector))


def training_best(candidates: DataFrame) -> DataFrame:
    """For each held-out source, the (model, feature_type) of least mean outcome over the other sources."""
    by_source = candidates.groupBy("heldout", "x_model", "x_feature_type").agg(F.sum("y_rmse").alias("s"), F.count("y_rmse").alias("n"))
    folds = candidates.select(F.col("heldout").alias("fold")).distinct()
    means = by_source.join(F.broadcast(folds), F.col("heldout") != F.col("fold")).groupBy("fold", "x_model", "x_feature_type").agg((F.sum("s") / F.sum("n")).alias("mean_rmse"))
    best = F.row_number().over(Window.partitionBy("fold").orderBy("mean_rmse", "x_model", "x_feature_type"))
    return means.withColumn("_p", best).where("_p = 1").select(F.col("fold").alias("heldout"), "x_model", "x_feature_type")


def source_rate(candidates: DataFrame, outcome: str = "y_near_best") -> DataFrame:
    """``candidates`` with ``probability``: how often the candidate's (model, feature_type) had the outcome on the other sources' tasks. The plainest meta model: it never sees the
    source it is asked about."""
    by_source = candidates.where(F.col(outcome).isNotNull()).groupBy("heldout", "x_model", "x_feature_type").agg(F.sum(F.col(outcome).cast("double")).alias("s"), F.count("*").alias("n"))
    folds = candidates.select(F.col("heldout").alias("fold")).distinct()
    rates = by_source.join(F.broadcast(folds), F.col("heldout") != F.col("fold")).groupBy("fold", "x_model", "x_feature_type").agg((F.sum("s") / F.sum("n")).alias("probability"))
    return candidates.join(F.broadcast(rates.withColumnRenamed("fold", "heldout")), ["heldout", "x_model", "x_feature_type"], "left")  # sources x models x features


def selected_candidates(candidates: DataFrame, fixed: dict[str, tuple[str, str]]) -> DataFrame:
    """One row for each selector and task: probability (where there is one), validation error, oracle, training sources' best, and fixed ones."""
    task, run = ["task_id"], F.asc("run_id")
    parts = [
        select_best(candidates, task, [F.asc("x_validation_rmse"), run], "validation_rmse"),
        select_best(candidates, task, [F.asc("y_rmse"), run], "oracle"),
        select_best(candidates.join(F.broadcast(training_best(candidates)), ["heldout", "x_model", "x_feature_type"]), task, [run], "training_source_best"),
    ]
    if "probability" in candidates.columns:
        parts.append(select_best(candidates, task, [F.desc("probability"), F.asc("x_validation_rmse"), run], "meta"))
    for name, (model, features) in sorted(fixed.items()):
        parts.append(select_best(candidates.where((F.col("x_model") == model) & (F.col("x_feature_type") == features)), task, [run], name))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def selection_summary(selected: DataFrame, by_source: bool = False) -> DataFrame:
    """How a selector does, over all tasks or for each held-out source."""
    keys = ["heldout", "selector"] if by_source else ["selector"]
    return selected.groupBy(*keys).agg(
        F.count_distinct("task_id").alias("tasks"), F.avg("y_rmse").alias("mean_rmse"), F.avg("y_regret").alias("mean_regret"), F.median("y_regret").alias("median_regret"),
        F.avg(F.col("y_top").cast("double")).alias("top_rate"), F.avg(F.col("y_near_best").cast("double")).alias("near_best_rate"),
    )


def selection_grains(selected: DataFrame) -> DataFrame:
    """Both grains in one pass; heldout is ALL over all tasks."""
    return selection_summary(selected.withColumn("heldout", F.explode(F.array(F.lit("ALL"), F.col("heldout")))), by_source=True)


def paired(selected: DataFrame, candidate: str, reference: str, column: str) -> DataFrame:
    """(heldout, task_id, difference): candidate minus reference on the same task."""
    side = lambda s, n: selected.where(F.col("selector") == s).select("heldout", "task_id", F.col(column).alias(n))
    return side(candidate, "a").join(side(reference, "b"), ["heldout", "task_id"]).select("heldout", "task_id", (F.col("a") - F.col("b")).alias("difference"))


def source_folds(frame: DataFrame, source: str = "heldout") -> DataFrame:
    """Each row once for each fold, with is_test: whether its source is the fold's."""
    folds = frame.select(F.col(source).alias("fold")).distinct()
    return frame.crossJoin(F.broadcast(folds)).withColumn("is_test", F.col(source) == F.col("fold"))  # as many folds as sources
