"""Files as streams: executors read them a few megabytes at a time, so no file is held whole, whatever its size, and none passes the driver."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import IO
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 4 << 20


def open_stream(path: str) -> IO[bytes]:
    """A file's bytes as they are stored, from the start: a local path, or a URI of a store that Arrow's file systems know."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    system, inner = (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)
    return system.open_input_stream(inner, compression=None)


def listing(spark: SparkSession, *paths: str, empty: bool = False) -> DataFrame:
    """(path, length) of files, and of all files below folders. Contents are not read, and tasks get like shares of the bytes.

    Spark's scans leave empty files out. With ``empty`` they are told from the driver's index of files, which every scan makes, and added.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    listed = found.select("path", "length")
    if not empty:
        return listed
    every = [(unquote(p).replace("file:///", "file:/", 1),) for p in found.inputFiles()]
    return listed.unionByName(spark.createDataFrame(every, "path string").join(listed, "path", "left_anti").withColumn("length", F.lit(0).cast("long")))


def digests(files: DataFrame, kinds: tuple[str, ...] = ("sha256",)) -> DataFrame:
    """(path, length, a column of each of ``kinds``) of (path, length), as :func:`listing` has them.

    A digest can't be put together from parts: one task folds a file, chunk by chunk, all kinds in one pass. An empty file has the digest of nothing. A file that
    is not as long as it was listed has changed meanwhile and is an error.
    """

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            made: list[list[str]] = [[] for _ in kinds]
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kept, seen = [hashlib.new(k) for k in kinds], 0
                with open_stream(path) as stream:
                    while chunk := stream.read(CHUNK):
                        seen += len(chunk)
                        for k in kept:
                            k.update(chunk)
                if seen != length:
                    raise ValueError(f"{path} changed while it was read: {seen} bytes, {length} listed")
                for column, k in zip(made, kept):
                    column.append(k.hexdigest())
            columns = [batch.column(0), batch.column(1), *[pa.array(c, pa.string()) for c in made]]
            yield pa.RecordBatch.from_arrays(columns, ["path", "length", *kinds])

    return files.select("path", "length").mapInArrow(fold, ", ".join(["path string, length long", *[f"`{k}` string" for k in kinds]]))


def invalid_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of the lines that are no valid UTF-8. No character of several bytes holds a line's end, so files are cut at lines and tested by all tasks."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("path"))
    return lines.where(~F.is_valid_utf8("value")).select("path", F.col("value").cast("binary").alias("value"))


def first_lines(path: str, n: int) -> list[bytes]:
    """The first ``n`` lines of a file, without their ends; fewer if it has fewer."""
    with open_stream(path) as stream:
        held, more = b"", True
        while more and held.count(b"\n") < n:
            chunk = stream.read(1 << 16)
            held, more = held + chunk, bool(chunk)
    return [x.removesuffix(b"\r") for x in held.split(b"\n")[:n]]


def lines_after(spark: SparkSession, path: str, skip: int) -> DataFrame:
    """(line binary): the lines of each file behind its first ``skip``; empty ones are left out.

    A task reads its pieces of files one after another, and the first piece of a file starts with its preamble, which must be shorter than a piece.
    """
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("value").cast("binary").alias("line"), meta["file_path"].alias("path"), meta["file_block_start"].alias("start"))

    def drop(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        at, left = None, 0
        for batch in batches:
            keep = []
            for k, (path, start) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if (path, start) != at:
                    at, left = (path, start), skip if start == 0 else 0
                if left:
                    left -= 1
                else:
                    keep.append(k)
            kept = batch.column(0).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.filter(pc.greater(pc.binary_length(kept), 0))], ["line"])

    return lines.mapInArrow(drop, "line binary")


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, rows, row_groups, columns) of the Parquet files below ``path``, from their footers: no column is read."""
    files = listing(spark, path).where(F.col("path").endswith(".parquet"))

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                local = "/" + path[5:].lstrip("/") if path.startswith("file:") else path
                system, inner = (fs.LocalFileSystem(), local) if "://" not in local else fs.FileSystem.from_uri(local)
                with system.open_input_file(inner) as f:
                    meta = pq.read_metadata(f)
                found.append((meta.num_rows, meta.num_row_groups, len(meta.schema.to_arrow_schema())))
            rows, groups, columns = ([x[k] for x in found] for k in range(3))
            made = [pa.array(rows, pa.int64()), pa.array(groups, pa.int64()), pa.array(columns, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["path", "length", "rows", "row_groups", "columns"])

    return files.mapInArrow(read, "path string, length long, rows long, row_groups long, columns long")
