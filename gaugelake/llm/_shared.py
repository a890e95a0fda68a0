"""What the training-data operators share: work folders, salted lookups and connected components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space, everywhere in this subpackage.
SPACE = r"[ \t-\r]+"
#: Rows of a hot key are dealt over so many tasks.
SALTS = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where that is unset and all run on this machine (tests)."""
    sc = spark.sparkContext
    if where := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return where.rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="gaugelake-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir().rstrip("/")


_made: set[str] = set()


def _delete(path: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    elif re.match("file:|/", path):  # the session has been stopped
        shutil.rmtree(re.sub("^file:/*", "/", path), ignore_errors=True)
    else:
        return
    _made.discard(path)


@atexit.register
def _clean() -> None:
    for path in list(_made):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001, PERF203  the others can still go
            continue


def work_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, deleted when the program ends."""
    path = f"{shared_dir(spark)}/gaugelake-{what}-{uuid.uuid4().hex[:12]}"
    _made.add(path)
    return path


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session: their Python workers import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    archive = Path(tempfile.mkdtemp(prefix="gaugelake-")) / "gaugelake.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((root / "gaugelake").rglob("*.py")):
            out.write(path, path.relative_to(root))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def discard(*paths: str) -> None:
    """Delete work tables that no later plan reads."""
    for path in paths:
        _delete(path)


def work_tables() -> set[str]:
    """Paths of all work tables there are now."""
    return set(_made)


def materialize(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a compressed table in the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    path = work_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join ``many`` with ``one``, which has at most one row a key and far fewer rows: its rows are copied ``salts`` times, so a hot key's rows in ``many`` spread over as many tasks."""
    salt = "_salt"
    rest = [F.col(c) for c in many.columns if c not in keys] or [F.lit(0)]
    left = many.withColumn(salt, F.pmod(F.xxhash64(*rest), F.lit(salts)).cast("int"))
    right = one.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, salt], how).drop(salt)


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step: each node links to the least node it knows. A hub's edges are dealt over several tasks."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = salted_join(both, least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    low = large.groupBy("u").agg(F.min("v").alias("m"))  # a node's links all lead down
    small = salted_join(large, low, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return small.union(low.select("u", F.col("m").alias("v"))).distinct()


#: Links that one task settles: 16 MB.
FEW_LINKS = 1_000_000


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place that each of n places reaches by links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        np.minimum.at(root, before[i], low)
        np.minimum.at(root, before[j], low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def _in_one_task(links: DataFrame) -> DataFrame:
    """``(node, component)`` of few links, by one task."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = [np.array([batch.column(0).to_numpy(), batch.column(1).to_numpy()]) for batch in batches]
        if held:
            nodes, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
            at = at.reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[forest(len(nodes), at[0], at[1])])], ["node", "component"])

    ship(links.sparkSession)
    return links.coalesce(1).mapInArrow(run, "node long, component long")


def connected_components(edges: DataFrame, max_rounds: int = 60, few: int = FEW_LINKS) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (columns u, v): the least node reachable.

    Up to ``few`` links are settled by one task, at once, which spares small tables the rounds; more of them, of any number, by rounds over all tasks.
    Either way gives the same rows:
    Alternating large-star and small-star steps, O(log^2 n) rounds; each round's edges are a table in the shared folder.
    Hub nodes meet only partial minima and salted joins whose other side has one row a key.
    """
    links = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def settled(df: DataFrame) -> tuple[DataFrame, str, dict]:
        """Written, with its size and a sum of its rows' hashes, which the write itself observes."""
        seen = Observation()
        out, where = materialize(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")), "edges")
        return out, where, dict(seen.get)

    links, path, before = settled(links)
    if not before.get("n") or before["n"] <= few:
        return _in_one_task(links)
    for _ in range(max_rounds):
        links, new, after = settled(_stars(links))
        discard(path)
        path = new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
