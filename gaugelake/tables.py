"""Work tables: Parquet in the folder that driver and executors share, where lineage ends and which a lost executor doesn't touch."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast: their number is always checked first.
FEW = 100_000


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a new folder where that is unset and all tasks run on this machine (tests), else an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gaugelake-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_folder(spark)}/gaugelake-{what}-{uuid.uuid4().hex[:12]}"


_written: set[str] = set()


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _written.discard(path)


@atexit.register
def _at_end() -> None:
    """Work tables go with the program; without a session only local ones can."""
    spark = SparkSession.getActiveSession()
    for path in list(_written):
        if spark is not None and spark.sparkContext._jsc is not None:
            remove(spark, path)
        elif re.match("file:|/", path):
            shutil.rmtree(re.sub("^file:/*", "/", path), ignore_errors=True)


def written(df: DataFrame, what: str, **seen: Column) -> tuple[DataFrame, dict[str, Any]]:
    """``df`` as a work table, with its row count ``n`` and further aggregates, which the write itself observes."""
    spark, watch = df.sparkSession, Observation()
    path = new_path(spark, what)
    _written.add(path)
    df.observe(watch, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in seen.items()]).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), {"n": 0} | dict(watch.get)


def large(df: DataFrame) -> DataFrame:
    """``df``, whose rows grow with the input, as a side of a join that sorts and merges.

    Without it Spark sizes a work table by its compressed files, and a table of under 10 MB there may be collected and hashed by the driver at twenty times that.
    """
    return df.hint("merge")


def small(df: DataFrame, n: int, most: int = FEW) -> DataFrame:
    """``df`` to be broadcast if its ``n`` rows, which have been counted, are few; else merged as a large one."""
    return F.broadcast(df) if n <= most else large(df)
