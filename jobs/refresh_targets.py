"""Incremental job: new measurement files become resolved targets.

    python -m jobs.refresh_targets --events IN --output OUT --checkpoint MARK --config jobs/refresh_targets.json

A file stream takes the event files that its checkpoint doesn't know, and ends when there are none left. Each batch's observations are kept by day and
batch; the targets of the days it touches, and of no others, are resolved anew from all their observations. Both tables are written by dynamic partition
overwrite, so a batch that runs again after a failure replaces its own rows. OUT/observations and OUT/targets are Parquet by day.
"""

from __future__ import annotations

import logging
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gaugelake.functions.columns import finite_or_null
from gaugelake.operators.resolve import resolve_targets
from jobs.config import main

log = logging.getLogger("refresh_targets")

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
DEFAULTS: dict[str, Any] = {"consistent_max": 0.5, "conflict_min": 1.0, "review_min": -15.0, "review_max": 2.5, "files_per_batch": 64, "salts": 8}
OBSERVATIONS = "observation_id long, entity_id string, source string, value double, grp long, batch long, day date"
TARGETS = (
    "entity_id string, grp long, n_observations long, n_sources long, sources string, target double, value_mean double, value_sd double, value_min double, value_q25 double, value_q75 double, "
    "value_max double, value_mad double, value_range double, value_iqr double, conflict boolean, outside_review boolean, reliability string, `primary` boolean, exclusion_reason string, day date"
)


def observed(events: DataFrame) -> DataFrame:
    """Events as measurements of a user on a day: the logarithm of a positive value, by event type."""
    day = F.to_date("ts")
    value = finite_or_null(F.when(F.col("value") > 0, F.ln("value")))
    entity = F.concat(F.col("user_id").cast("string"), F.lit("-"), day.cast("string"))
    return events.select(F.col("event_id").alias("observation_id"), entity.alias("entity_id"), F.col("event_type").alias("source"), value.alias("value"), (F.col("user_id") % 20).alias("grp"), day.alias("day"))


def as_pattern(path: str) -> str:
    """The path as a pattern that fits it alone: a file stream takes a single file, too, then. Patterns stay as they are."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def _overwrite(df: DataFrame, path: str, salts: int, *by: str) -> None:
    """Partitions that ``df`` has rows of are replaced, others stay. A day's rows are dealt over several tasks."""
    dealt = df.repartition(*by, F.pmod(F.xxhash64("entity_id"), F.lit(salts)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)


def refresh(spark: SparkSession, batch: DataFrame, number: int, output: str, config: dict[str, Any]) -> dict[str, int]:
    """One batch: its observations in place, then the targets of its days. Returns what it read and wrote."""
    read, kept = Observation(), Observation()
    rows = observed(batch.observe(read, F.count(F.lit(1)).alias("n"))).where("day IS NOT NULL").withColumn("batch", F.lit(number).cast("long"))
    _overwrite(rows, f"{output}/observations", config["salts"], "day", "batch")
    every = spark.read.schema(OBSERVATIONS).parquet(f"{output}/observations")
    touched = every.where(F.col("batch") == number).select("day").distinct()  # a row a day
    mine = every.join(touched, "day", "left_semi")
    # Files that are delivered twice bring the same observations again. Without an id they can't be told apart, and all count.
    named = F.col("observation_id").isNotNull()
    mine = mine.where(named).dropDuplicates(["observation_id"]).unionByName(mine.where(~named))
    limits = {k: config[k] for k in ("consistent_max", "conflict_min", "review_min", "review_max")}
    targets = resolve_targets(mine, **limits, labels=("grp",), keys=("entity_id", "day"))
    _overwrite(targets.observe(kept, F.count(F.lit(1)).alias("n")), f"{output}/targets", config["salts"], "day")
    return {"read": dict(read.get).get("n", 0), "targets": dict(kept.get).get("n", 0)}


def run(spark: SparkSession, events: str, output: str, checkpoint: str, config: dict[str, Any] | None = None) -> dict[str, int]:
    """Takes all files under ``events`` that ``checkpoint`` doesn't know; returns the sums of batches, rows read and targets written.

    A null time gives no observation; a value that isn't positive or finite is kept as null and not resolved. Without new files nothing is written.
    """
    config = DEFAULTS | (config or {})
    total = {"batches": 0, "read": 0, "targets": 0}

    def each(batch: DataFrame, number: int) -> None:
        done = refresh(batch.sparkSession, batch, number, output, config)
        log.info("batch %d: %d events read from %s, %d targets written to %s/targets", number, done["read"], events, done["targets"], output)
        total.update(batches=total["batches"] + 1, read=total["read"] + done["read"], targets=total["targets"] + done["targets"])

    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(as_pattern(events))
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    log.info("%d new batches, %d events, %d targets", total["batches"], total["read"], total["targets"])
    return total


def read_targets(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(TARGETS).parquet(f"{output}/targets")


if __name__ == "__main__":
    main(run, DEFAULTS, "refresh targets", {"events": "folder of event files (Parquet)", "output": "where tables are written", "checkpoint": "the stream's mark"})
