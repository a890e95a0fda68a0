"""Prediction errors: labels, bins, and summaries by run, group of runs and entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.functions.columns import share, threshold_name
from gaugelake.operators.quantiles import with_quantiles

THRESHOLDS = (0.5, 1.0, 2.0)


def with_residuals(predictions: DataFrame) -> DataFrame:
    """residual (truth - predicted), absolute_error and squared_error."""
    gap = F.col("truth") - F.col("predicted")
    return predictions.withColumns({"residual": gap, "absolute_error": F.abs(gap), "squared_error": gap * gap})


def failure_labels(residuals: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """A 0/1 flag for each threshold (strictly above), the error's direction and its bin (closed on the left)."""
    e, r = F.col("absolute_error"), F.col("residual")
    flags = {threshold_name(t): (e > t).cast("byte") for t in sorted(set(thresholds))}
    direction = F.when(r > 0, "underprediction").when(r < 0, "overprediction").when(r == 0, "exact")
    edges = F.when(e < 0.5, "0.0-<0.5").when(e < 1.0, "0.5-<1.0").when(e < 2.0, "1.0-<2.0").when(e >= 2.0, ">=2.0")
    return residuals.withColumns(flags | {"error_direction": direction, "absolute_error_bin": edges})


def _rates(thresholds: tuple[float, ...]) -> list:
    return [F.avg(F.col(threshold_name(t)).cast("double")).alias(threshold_name(t, "failure_rate_gt_")) for t in sorted(set(thresholds))]


def run_summary(labeled: DataFrame, keys: tuple[str, ...] = ("run_id", "model", "feature_type", "strategy", "repeat"), thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """One row a run. ``keys`` beside run_id must not vary within a run (see checks.inconsistent); grouping by all keeps the shuffle at one."""
    e, r = F.col("absolute_error"), F.col("residual")
    out = labeled.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(r).alias("mean_residual"), F.stddev_samp(r).alias("residual_sd"), F.sqrt(F.avg("squared_error")).alias("rmse"), F.avg(e).alias("mae"),
        F.max(e).alias("max_error"), share(r > 0).alias("underprediction_rate"), share(r < 0).alias("overprediction_rate"), *_rates(thresholds),
    )
    return with_quantiles(out, labeled, list(keys), "absolute_error", {"median_error": 0.5, "p90_error": 0.9, "p95_error": 0.95})  # a run's rows may be many


def group_summary(runs: DataFrame, primary: float = 1.0) -> DataFrame:
    """Runs of one strategy, feature type and model over their repeats."""
    rate = threshold_name(primary, "failure_rate_gt_")
    return runs.groupBy("strategy", "feature_type", "model").agg(
        F.count_distinct("repeat").alias("repeats"), F.sum("n").alias("n"), F.avg("rmse").alias("mean_rmse"), F.stddev_samp("rmse").alias("sd_rmse"), F.avg("mae").alias("mean_mae"),
        F.avg("median_error").alias("mean_median_error"), F.avg(rate).alias("mean_failure_rate"), F.stddev_samp(rate).alias("sd_failure_rate"),
    )


def entity_summary(labeled: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, include_dummy: bool = False) -> DataFrame:
    """How hard each entity is over all runs that hold it out; dummy models don't count unless asked for."""
    df = labeled if include_dummy else labeled.where("model <> 'dummy'")
    return df.withColumn("task", F.concat_ws("_r", "strategy", F.col("repeat").cast("string"))).groupBy("entity_id").agg(
        F.count("*").alias("evaluations"), F.count_distinct("task").alias("tasks"), F.count_distinct("model").alias("models"), F.count_distinct("feature_type").alias("feature_types"),
        F.avg("residual").alias("mean_residual"), F.avg("absolute_error").alias("mean_error"), F.median("absolute_error").alias("median_error"),
        F.percentile("absolute_error", F.lit(0.9)).alias("p90_error"), F.max("absolute_error").alias("max_error"), *_rates(thresholds),
    )
