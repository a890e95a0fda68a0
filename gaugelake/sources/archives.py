"""CSV members of tar archives as a Spark source: a partition for each member, read as a stream by the task that has it.

A compressed archive can't be entered in its middle, so a task reads the stream up to its member; nothing is unpacked to a disk, and no member is held whole.
"""

from __future__ import annotations

import csv
import io
import json
import tarfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from gaugelake.sources.streams import CHUNK, digests, listing, open_stream
from gaugelake.tables import written

#: Rows of a batch that a task hands to Spark.
BATCH = 8192


class Member(InputPartition):
    def __init__(self, task: str, name: str):
        self.task, self.name = task, name


class Forward(io.RawIOBase):
    """A member of a streamed archive as a file that can only be read on; the archive's own objects don't say that they can't be wound back."""

    def __init__(self, member):
        self.member = member

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        chunk = self.member.read(len(buffer))
        buffer[: len(chunk)] = chunk
        return len(chunk)


class MemberReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns = [f.name for f in schema.fields]
        self.path, self.skip = options["path"], int(options.get("skiplines", options.get("skipLines", "0")))
        self.members = json.loads(options["members"])

    def partitions(self) -> list[InputPartition]:
        return [Member(task, name) for task, name in sorted(self.members.items())]

    def read(self, partition: Member) -> Iterator:
        import pyarrow as pa

        with open_stream(self.path) as stream, tarfile.open(fileobj=stream, mode="r|*") as tar:
            found = next((m for m in tar if m.isfile() and m.name == partition.name), None)
            if found is None:
                raise ValueError(f"{partition.name} is not in the archive")
            text = io.TextIOWrapper(io.BufferedReader(Forward(tar.extractfile(found)), CHUNK), "utf-8-sig", newline="")
            for _ in range(self.skip):
                text.readline()
            rows = csv.reader(text)
            header = next(rows, [])
            wanted = self.columns[1:]
            if missing := sorted(set(wanted).difference(header)):
                raise ValueError(f"{partition.name} has no columns {missing}")
            places, held = [header.index(c) for c in wanted], []

            def batch() -> pa.RecordBatch:
                cells = [[(r[p] or None) if p < len(r) else None for r in held] for p in places]
                arrays = [pa.array([partition.task] * len(held), pa.string()), *[pa.array(c, pa.string()) for c in cells]]
                return pa.RecordBatch.from_arrays(arrays, self.columns)

            for row in rows:
                if row:
                    held.append(row)
                if len(held) == BATCH:
                    yield batch()
                    held = []
            if held:
                yield batch()


class TarCsv(DataSource):
    """Format tar_csv. Options: path; members, JSON of task to member; skipLines before each member's header. Schema: task, then names of the header, all strings."""

    @classmethod
    def name(cls) -> str:
        return "tar_csv"

    def reader(self, schema: StructType) -> DataSourceReader:
        return MemberReader(schema, dict(self.options))


def archive_members(spark: SparkSession, archive: str) -> DataFrame:
    """(path, member, length) of the files in a tar archive, compressed or not; one task reads its headers as they stream by."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_stream(path) as stream, tarfile.open(fileobj=stream, mode="r|*") as tar:
                    found = [(m.name, m.size) for m in tar if m.isfile()]
                arrays = [pa.array([path] * len(found), pa.string()), pa.array([m for m, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["path", "member", "length"])

    return listing(spark, archive).mapInArrow(read, "path string, member string, length long")


def read_archive(spark: SparkSession, archive: str, members: dict[str, tuple[str, int]], schema: StructType, skip_lines: int = 1, md5: str | None = None, id_col: str | None = None) -> DataFrame:
    """The CSV members of a tar archive as one work table with a column task. members: task to (member, expected rows).

    Raises when the archive's digest is another one, a member is missing or has other than the expected rows, a value can't be cast, or, with ``id_col``, an id
    stands twice. An empty cell is null, a row shorter than the header ends in nulls, and columns beyond ``schema`` are left out.
    """
    if md5 and digests(listing(spark, archive), ("md5",)).first().md5 != md5:
        raise ValueError("the archive's MD5 is another one")
    wanted = spark.createDataFrame([(m,) for m, _ in members.values()], "member string")
    if missing := wanted.join(archive_members(spark, archive), "member", "left_anti").orderBy("member").limit(5).collect():
        raise ValueError(f"{', '.join(r.member for r in missing)} is not in the archive")
    spark.dataSource.register(TarCsv)
    texts = StructType([StructField("task", StringType()), *[StructField(f.name, StringType()) for f in schema.fields]])
    names = json.dumps({task: member for task, (member, _) in members.items()})
    read = spark.read.format("tar_csv").schema(texts).option("members", names).option("skipLines", skip_lines).load(archive)
    rows, _ = written(read.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields], "task"), "archive")
    counts = {r.task: r.n for r in rows.groupBy("task").agg(F.count("*").alias("n")).collect()}  # a row a member
    for task, (member, expected) in sorted(members.items()):
        if counts.get(task, 0) != expected:
            raise ValueError(f"{member} has {counts.get(task, 0)} rows, not {expected}")
    if id_col and (twice := rows.groupBy(id_col).count().where("count > 1").limit(5).collect()):
        raise ValueError(f"repeated ids: {[r[0] for r in twice]}")
    return rows
