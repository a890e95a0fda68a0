"""Windowed counts of observations as they come in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.functions.columns import finite_or_null


def source_rollup(stream: DataFrame, time_col: str = "ts", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """For each tumbling window and source: observations, finite values, their sum and extremes. Works on streams (with a watermark) and tables alike."""
    df = stream.withColumn("_t", F.col(time_col).cast("timestamp"))
    df = df.withWatermark("_t", late) if stream.isStreaming else df
    v = finite_or_null(F.col("value"))
    out = df.groupBy(F.window("_t", window).alias("w"), "source").agg(F.count("*").alias("n"), F.count(v).alias("finite"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"))
    return out.select(F.col("w.start").alias("window_start"), "source", "n", "finite", "total", "least", "most")
