"""Session settings that the operators assume."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: UTC and ANSI keep results equal across machines; adaptive execution splits skewed joins and merges small partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "gaugelake", **extra: str) -> SparkSession:
    """A session with :data:`SETTINGS`; ``extra`` holds more settings, with ``__`` for each dot."""
    cores = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app).master(master or f"local[{cores}]")
    settings = SETTINGS | {"spark.sql.shuffle.partitions": cores, "spark.driver.memory": "12g"}
    settings |= {key.replace("__", "."): value for key, value in extra.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
