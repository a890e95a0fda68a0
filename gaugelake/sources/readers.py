"""Readers: schemas are given, never guessed."""

from __future__ import annotations

import csv
import hashlib
import json
import shutil
import urllib.request
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gaugelake.sources.streams import digests, first_lines, invalid_lines, lines_after, listing


def csv_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 if all files are valid in it, else Latin-1. All tasks test the lines; no file is held whole."""
    return "ISO-8859-1" if invalid_lines(spark, path).limit(1).count() else "UTF-8"


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None, skip_lines: int = 0, encoding: str | None = None) -> DataFrame:
    """A CSV file, or a folder of them, with a header after ``skip_lines`` lines; columns by name. Without a schema all columns are strings.

    With ``skip_lines`` the files share the first one's header, a row ends with its line, and one without text is left out; columns that the header lacks are an error.
    """
    encoding = encoding or csv_encoding(spark, path)
    if not skip_lines:
        reader = (spark.read.schema(schema) if schema else spark.read).option("header", True).option("encoding", encoding).option("mode", "PERMISSIVE")
        return reader.csv(path)
    files = listing(spark, path).where("length > 0").orderBy("path").limit(1).collect()
    head = first_lines(files[0].path, skip_lines + 1)[skip_lines:] if files else []
    if not head:
        return spark.createDataFrame([], schema or StructType())
    header = [c.strip() for c in next(csv.reader([head[0].decode(encoding).lstrip("\ufeff")]))]
    kinds = {f.name: f.dataType for f in schema.fields} if schema else {}
    if missing := sorted(set(kinds).difference(header)):
        raise ValueError(f"missing columns: {missing}")
    text = F.regexp_replace(F.decode("line", encoding), "\r$", "")
    lines = lines_after(spark, path, skip_lines + 1).select(text.alias("line")).where("line <> ''")
    row = F.from_csv("line", StructType([StructField(c, kinds.get(c, StringType())) for c in header]).simpleString())
    return lines.select(row.alias("r")).select(*[F.col(f"r.`{c}`").alias(c) for c in (kinds or header)])


def read_sources(specs: list[tuple[str, str, StructType, int | None]], spark: SparkSession) -> dict[str, DataFrame]:
    """Each (name, path, schema, expected rows); raises when a count is not the expected one."""
    out = {}
    for name, path, schema, expected in specs:
        out[name] = read_csv(spark, path, schema)
        if expected is not None and (n := out[name].count()) != expected:
            raise ValueError(f"{name} has {n} rows, not {expected}")
    return out


def read_parquet(spark: SparkSession, *paths: str, columns: list[str] | None = None, merge: bool = False) -> DataFrame:
    """Parquet files or partitioned folders; ``columns`` alone are read."""
    df = spark.read.option("mergeSchema", merge).parquet(*paths)
    return df.select(*columns) if columns else df


def file_digest(path: str | Path, kind: str = "md5") -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, kind).hexdigest()


def download(url: str, target: str, size: int | None = None, md5: str | None = None, force: bool = False) -> Path:
    """The file behind ``url`` under ``target``, which appears only when its size and MD5 are right; one that is there already, and right, is kept."""
    path = Path(target)

    def right(p: Path) -> bool:
        return (size is None or p.stat().st_size == size) and (md5 is None or file_digest(p) == md5)

    if path.exists() and not force and right(path):
        return path
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    try:
        with urllib.request.urlopen(url) as source, part.open("wb") as out:  # noqa: S310
            shutil.copyfileobj(source, out, 1 << 20)
        if not right(part):
            raise ValueError(f"{url}: size or MD5 is another one")
        part.replace(path)
    finally:
        part.unlink(missing_ok=True)
    return path


def read_report(path: str | Path) -> dict:
    return json.loads(Path(path).read_text())


def read_lock(spark: SparkSession, path: str) -> DataFrame:
    """(package, version) of lines name==version; comments and other lines are left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v LIKE '%==%' AND v NOT LIKE '#%'")
    pair = F.split("v", "==", 2)
    return lines.select(pair[0].alias("package"), pair[1].alias("version"), F.lower(pair[0]).alias("_k")).orderBy("_k").drop("_k")


def path_size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files in a folder, wherever they are stored."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def file_inventory(spark: SparkSession, root: str, exclude: tuple[str, ...] = (".git/", "__pycache__/", ".egg-info/", ".pyc", ".pyo"), max_bytes: int | None = None, include: tuple[str, ...] = ()) -> DataFrame:
    """(path, length, sha256) of every file under ``root``, in order of its path; raises when one is larger than ``max_bytes``.

    Contents are hashed where they are read, in chunks, and those of files that are left out are not read. exclude: parts of a path (those with a slash end a folder's name, the others the path) that leave a file out. include: files, or folders with a slash behind
    them, that alone are taken.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/") + "/"
    full = F.substring(F.col("path"), len(base), 1 << 30)  # with the slash before the name
    listed = listing(spark, root, empty=True).withColumn("name", F.substring(F.col("path"), len(base) + 1, 1 << 30))
    for part in exclude:
        listed = listed.where(~(full.contains(part if part.startswith(".") and part != ".git/" else "/" + part) if part.endswith("/") else full.endswith(part)))
    if include:
        listed = listed.where(any_of([F.col("name").startswith(p) if p.endswith("/") else F.col("name") == p for p in include]))
    if max_bytes is not None and (large := listed.where(F.col("length") >= max_bytes).limit(5).collect()):
        raise ValueError(f"too large: {[r.name for r in large]}")
    return digests(listed).select(F.substring(F.col("path"), len(base) + 1, 1 << 30).alias("path"), "length", "sha256").orderBy("path")


def any_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def inventory_totals(listed: DataFrame) -> DataFrame:
    """(files, bytes) of an inventory."""
    return listed.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in any store that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_shards(spark: SparkSession, folders: list[str], marker: str = "_SUCCESS", order: list[str] | None = None, unique: list[str] | None = None) -> DataFrame:
    """The union of finished shards, in order of ``order``; raises when one lacks its marker or ``unique`` columns repeat."""
    if missing := [f for f in folders if not exists(spark, f"{f}/{marker}")]:
        raise ValueError(f"unfinished shards: {missing}")
    df = spark.read.option("mergeSchema", True).parquet(*folders)
    if unique and (twice := df.groupBy(*unique).count().where("count > 1").limit(5).collect()):
        raise ValueError(f"repeated {'+'.join(unique)}: {[tuple(r)[:-1] for r in twice]}")
    return df.orderBy(*order) if order else df
