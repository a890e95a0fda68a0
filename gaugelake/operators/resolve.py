"""Repeated measurements resolved into one robust target for each entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugelake.functions.columns import finite_or_null, first_by, joined_set
from gaugelake.operators.checks import require_columns

NEEDED = ("observation_id", "entity_id", "source", "value")


def eligible(obs: DataFrame) -> DataFrame:
    """Observations with an entity and a finite value; a column ``eligible``, where there is one, must be true (null is false)."""
    require_columns(obs, NEEDED)
    df = obs.withColumn("value", finite_or_null(F.col("value").try_cast("double"))).where("entity_id IS NOT NULL AND value IS NOT NULL")
    return df.where(F.coalesce("eligible", F.lit(False))) if "eligible" in obs.columns else df


def entity_summary(obs: DataFrame, conflict_over: float = 1.0, labels: tuple[str, ...] = (), flags: tuple[str, ...] = ()) -> DataFrame:
    """One descriptive row for each entity; ``labels`` take their first value that is not null by observation_id, ``flags`` are true if any is."""
    out = eligible(obs).groupBy("entity_id").agg(
        *[first_by(F.col(c), F.col("observation_id")).alias(c) for c in labels],
        F.count("*").alias("n_observations"),
        F.count_distinct("source").alias("n_sources"),
        joined_set(F.col("source")).alias("sources"),
        F.avg("value").alias("value_mean"),
        F.median("value").alias("value_median"),
        F.stddev_samp("value").alias("value_sd"),
        F.min("value").alias("value_min"),
        F.max("value").alias("value_max"),
        *[F.bool_or(c).alias(f"any_{c}") for c in flags],
    )
    spread = F.col("value_max") - F.col("value_min")
    return out.withColumns({"value_range": spread, "conflict": spread > conflict_over})


def resolve_targets(
    obs: DataFrame,
    consistent_max: float = 0.5,
    conflict_min: float = 1.0,
    review_min: float = -15.0,
    review_max: float = 2.5,
    labels: tuple[str, ...] = (),
    counted: tuple[str, ...] = (),
    keys: tuple[str, ...] = ("entity_id",),
) -> DataFrame:
    """The median of each entity's eligible values, with spread, reliability class and benchmark flags.

    Classes: single_observation; consistent (range up to ``consistent_max``); moderate (up to ``conflict_min``); conflict. A primary target is
    neither in conflict nor outside the review range. ``counted``: columns whose values, not null, are counted.
    ``keys``: what an entity's values are resolved by; further keys beside entity_id give an entity several targets.
    """
    if consistent_max < 0 or conflict_min <= consistent_max or review_min >= review_max:
        raise ValueError("thresholds must be non-negative and in order")
    # The deviations need the median first. Both passes share one shuffle by entity.
    centred = eligible(obs).withColumn("_deviation", F.abs(F.col("value") - F.median("value").over(Window.partitionBy(*keys))))
    out = centred.groupBy(*keys).agg(
        *[first_by(F.col(c), F.col("observation_id")).alias(c) for c in labels],
        F.count("*").alias("n_observations"),
        F.count_distinct("source").alias("n_sources"),
        joined_set(F.col("source")).alias("sources"),
        F.median("value").alias("target"),
        F.avg("value").alias("value_mean"),
        F.stddev_samp("value").alias("value_sd"),
        F.min("value").alias("value_min"),
        F.percentile("value", F.lit(0.25)).alias("value_q25"),
        F.percentile("value", F.lit(0.75)).alias("value_q75"),
        F.max("value").alias("value_max"),
        F.median("_deviation").alias("value_mad"),
        *[F.count(c).alias(f"n_with_{c}") for c in counted],
    )
    out = out.withColumns({"value_range": F.col("value_max") - F.col("value_min"), "value_iqr": F.col("value_q75") - F.col("value_q25")})
    conflict, outside = F.col("value_range") > conflict_min, (F.col("target") < review_min) | (F.col("target") > review_max)
    reliability = F.when(F.col("n_observations") == 1, "single_observation").when(F.col("value_range") <= consistent_max, "consistent")
    reason = F.when(conflict & outside, "conflict_and_outside_review").when(conflict, "conflict").when(outside, "outside_review").otherwise("included")
    return out.withColumns(
        {
            "conflict": conflict,
            "outside_review": outside,
            "reliability": reliability.when(F.col("value_range") <= conflict_min, "moderate").otherwise("conflict"),
            "primary": ~(conflict | outside),
            "exclusion_reason": reason,
        }
    )


def reliability_summary(targets: DataFrame) -> DataFrame:
    """Entities and observations of each class, and its percent of all entities."""
    out = targets.groupBy("reliability").agg(F.count("*").alias("entities"), F.sum("n_observations").alias("observations"), F.median("value_range").alias("median_range"), F.count_if("primary").alias("primary_entities"))
    return out.withColumn("percent", 100 * F.col("entities") / F.sum("entities").over(Window.partitionBy()))  # one row a class


def target_report(targets: DataFrame) -> DataFrame:
    """Counts of classes and of exclusion reasons in one table."""
    kinds = [targets.groupBy(F.lit(k).alias("kind"), F.col(k).alias("value")).agg(F.count("*").alias("entities")) for k in ("reliability", "exclusion_reason")]
    return kinds[0].unionByName(kinds[1])
