"""Writers that check what they wrote, refuse to repeat rows, and swap whole tables, in any file system that Spark writes to.

Swaps rename folders. On an object store, which has no atomic rename, write to a new path and publish that path instead.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from gaugelake.operators.unify import union_loose
from gaugelake.tables import small, written


def fingerprint(columns: list[str]) -> dict[str, Column]:
    """Aggregates that two bags of rows share if they are equal, and by chance one in 2 ** 64 times and less if they aren't: rows, and the sum and the xor of two hashes of each row."""
    cells = [F.col(f"`{c}`") for c in columns]
    total = F.coalesce(F.sum(F.xxhash64(*cells).cast("decimal(20,0)")), F.lit(0)).cast("string")
    return {"n": F.count(F.lit(1)), "total": total, "mixed": F.coalesce(F.bit_xor(F.xxhash64(F.lit(1), *cells)), F.lit(0).cast("long"))}


def _mark(df: DataFrame, columns: list[str]) -> tuple:
    return tuple(df.agg(*[c.alias(k) for k, c in fingerprint(columns).items()]).first())


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as bags of rows, columns by place, by their fingerprints: each side is read once, and no row is shuffled.

    Where numbers of two types, or maps, meet, rows themselves are compared; columns of otherwise different types are unequal.
    """
    kinds = [(x.dataType, y.dataType) for x, y in zip(a.schema.fields, b.schema.fields)]
    if len(a.columns) != len(b.columns) or any(x != y and not (isinstance(x, NumericType) and isinstance(y, NumericType)) for x, y in kinds):
        return False
    if any(x != y or "map<" in x.simpleString() for x, y in kinds):
        return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()
    return _mark(a, a.columns) == _mark(b.toDF(*a.columns), a.columns)


def write_table(df: DataFrame, path: str, csv_path: str | None = None, gzip: bool = False) -> int:
    """zstd Parquet, and CSV if asked for. Returns the number of rows.

    The write observes the fingerprint of what it writes, which that of the files must equal; the CSV must have as many rows. Columns of maps have no fingerprint.
    """
    spark, watch = df.sparkSession, Observation()
    marked = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    seen = df.observe(watch, *[c.alias(k) for k, c in fingerprint(marked).items()]) if marked else df
    seen.write.mode("overwrite").option("compression", "zstd").parquet(path)
    back = spark.read.parquet(path)
    n, *rest = _mark(back, marked) if marked else (back.count(),)
    wrote = {"n": 0, "total": "0", "mixed": 0} | dict(watch.get if marked else {"n": n})
    if marked and (n, *rest) != tuple(wrote[k] for k in ("n", "total", "mixed")):
        raise ValueError(f"{path} holds {n} rows, which aren't the {wrote['n']} that were written")
    if csv_path:
        df.write.mode("overwrite").option("header", True).option("compression", "gzip" if gzip else "none").csv(csv_path)
        if (m := spark.read.option("header", True).option("multiLine", True).csv(csv_path).count()) != n:
            raise ValueError(f"CSV has {m} rows, Parquet {n}")
    return n


def ids_read_back(df: DataFrame, paths: list[str], id_col: str) -> list[str]:
    """Paths whose ids differ from those of ``df``."""
    return [p for p in paths if not same_rows(df.select(id_col), df.sparkSession.read.parquet(p).select(id_col))]


def write_partitioned(parts: list[DataFrame], path: str, key: str, max_rows: int = 1_000_000, max_bytes: int | None = None) -> None:
    """The loose union of ``parts`` by ``key``: a key's rows lie in its folder, in files of ``max_rows`` at most."""
    df = union_loose(parts)
    if not df.limit(1).count():
        raise ValueError("nothing to write")
    df.repartition(key).write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", max_rows).partitionBy(key).parquet(path)
    if max_bytes:
        files = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
        if large := [r.path for r in files.where(F.col("length") >= max_bytes).select("path").limit(5).collect()]:
            raise ValueError(f"too large: {large}")


def _files(spark: SparkSession, path: str):
    """(file system, path in it)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def swap(spark: SparkSession, staged: str, target: str) -> None:
    """Put a finished folder in place of another; the old one comes back if that fails."""
    system, old = _files(spark, target)
    _, new = _files(spark, staged)
    head, _, name = target.rstrip("/").rpartition("/")
    _, backup = _files(spark, f"{head}/.{name}-{uuid.uuid4().hex[:8]}")
    there = system.exists(old)
    if there and not system.rename(old, backup):
        raise OSError(f"{target} can't be moved")
    if not (system.exists(new) and system.rename(new, old)):
        if there:
            system.rename(backup, old)
        raise OSError(f"{staged} can't take the place of {target}")
    if there:
        system.delete(backup, True)


def append_runs(spark: SparkSession, new: DataFrame, target: str, key: str = "run_id", idempotent: bool = False, by: str | None = None) -> str:
    """Add rows of new runs to a table, or make it. Runs that are there already are refused; with ``idempotent``, all of them there is a no-op.

    An append writes files of the new runs alone. Only new columns make the whole table be written anew and swapped. ``by``: a column by whose values a new table
    lies in folders, so that :func:`rebuild` can replace those of some values. Returns "created", "appended" or "unchanged".
    """
    system, where = _files(spark, target)
    parts = [by] if by else []
    if not system.exists(where):
        new.write.option("compression", "zstd").partitionBy(*parts).parquet(target)
        return "created"
    there, ids = spark.read.parquet(target), new.select(key).distinct()
    known, total = ids.join(there.select(key).distinct(), key, "left_semi").count(), ids.count()
    if known and idempotent and known == total:
        return "unchanged"
    if known:
        raise ValueError(f"{known} of {total} runs are in the table already")
    if dict(there.dtypes) == dict(new.dtypes):
        new.select(*there.columns).write.mode("append").option("compression", "zstd").partitionBy(*parts).parquet(target)
        return "appended"
    staged = f"{target}-{uuid.uuid4().hex[:8]}"
    union_loose([there, new]).write.option("compression", "zstd").partitionBy(*parts).parquet(staged)
    swap(spark, staged, target)
    return "appended"


def rebuild(spark: SparkSession, target: str, touched: DataFrame, by: str, how: Callable[[DataFrame], DataFrame]) -> int:
    """Replace the rows of the values of ``by`` in ``touched`` by ``how`` of them, which keeps their columns: ranks within a task after its runs were appended.

    ``target`` lies in folders by ``by``; those of other values are neither read nor written (dynamic partition overwrite), and a call that runs twice has the
    same result if ``how`` has. Returns the number of rows written.
    """
    values, seen = written(touched.select(by).distinct(), "touched")
    own = spark.read.parquet(target).join(small(values, seen["n"]), by, "left_semi")
    made, wrote = written(how(own), "rebuilt")
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(by).parquet(target)
    return wrote["n"]


def merged_report(before: dict, new: dict) -> dict:
    """A report of all runs: counts add up, records of skipped and failed runs are joined (of one run the last), requested names are united, and it fails if either did."""
    out = before | new
    for key in {**before, **new}:
        a, b = before.get(key), new.get(key)
        if key in ("skipped_runs", "failed_runs"):
            out[key] = sorted({r["run_id"]: r for r in [*(a or []), *(b or [])]}.values(), key=lambda r: r["run_id"])
        elif isinstance(a, list) and isinstance(b, list):
            out[key] = sorted({*a, *b})
        elif isinstance(a, int) and isinstance(b, int) and not isinstance(a, bool):
            out[key] = a + b
    if "fail" in (before.get("status"), new.get("status")):
        out["status"] = "fail"
    return out


def write_report(report: dict, path: str) -> None:
    """JSON with sorted keys; numbers that are not finite are null."""

    def plain(x):
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        x = x.item() if hasattr(x, "item") else x
        return None if isinstance(x, float) and not math.isfinite(x) else x

    Path(path).write_text(json.dumps(plain(report), indent=2, sort_keys=True) + "\n")


class StaleMarker:
    """A file that says a table has changed since what is built on it was built."""

    def __init__(self, path: str):
        self.path = Path(path)

    def set(self, why: str) -> None:
        write_report({"why": why}, str(self.path))

    def clear(self) -> None:
        self.path.unlink(missing_ok=True)

    def refuse(self) -> None:
        if self.path.exists():
            raise RuntimeError(f"stale: {json.loads(self.path.read_text())['why']}")


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``df`` with columns cast leniently before it is written."""
    return df.select(*[F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])
