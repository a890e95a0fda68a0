"""Token ids of a table of documents as binary files in ascending order of their ids, and their way back.

A shard file holds whole documents: a directory (document ids, places) and one directly addressable code of all their
token ids. Documents are range-partitioned by id, so shards in order of (partition, segment) are the corpus in order.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugelake.llm._shared import materialize, ship
from gaugelake.llm.direct_codes import DirectCodes, pack
from gaugelake.llm.pretokens import IdEncoder, kept

#: Ids after which a shard file is closed; a longer document stands whole in its own file.
SHARD_IDS = 2_000_000
_DIRECTORY = struct.Struct("<4sQ")


def shard_bytes(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One shard: directory of documents, then the code."""
    lengths = np.array([len(x) for x in ids], "<u8")
    known = np.array([x is not None for x in doc_ids], "u1")
    numbers = np.array([x or 0 for x in doc_ids], "<i8")
    head = _DIRECTORY.pack(b"GLTF", len(doc_ids)) + numbers.tobytes() + known.tobytes() + np.concatenate([np.zeros(1, "<u8"), np.cumsum(lengths, dtype="<u8")]).tobytes()
    return head + pack(np.concatenate(ids) if ids else np.zeros(0, "u2"))


class Shard:
    """A shard's documents by number, and any of its token ids by place."""

    def __init__(self, data: bytes):
        magic, n = _DIRECTORY.unpack_from(data)
        if magic != b"GLTF":
            raise ValueError("not a token file")
        at = _DIRECTORY.size
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.known = np.frombuffer(data, "u1", n, at + 8 * n).astype(bool)
        self.starts = np.frombuffer(data, "<u8", n + 1, at + 9 * n).astype(np.int64)
        self.codes = DirectCodes(memoryview(data)[at + 9 * n + 8 * (n + 1) :])

    def ids(self, i: int) -> np.ndarray:
        return self.codes.between(int(self.starts[i]), int(self.starts[i + 1]))


def _filesystem(folder: str):
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write ``docs`` under ``folder`` (shared by all executors) and return the manifest: part, segment, path, n_docs, n_tokens, base.

    base: ids in all shards before it. Each text's ids are followed by ``end_id``; a null text is empty. Order: ascending id, null first;
    rows of one id by a hash of their text. Files appear under their final name at once, so a task that runs again replaces its own.
    An empty table gives no file and an empty manifest. Other columns are not written.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = kept(IdEncoder, tokenizer_path, True)
        filesystem, place = _filesystem(folder)
        filesystem.create_dir(place, recursive=True)
        part, end, segment = TaskContext.get().partitionId(), np.array([end_id], encoder.dtype), 0
        names: list = []
        ids: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal names, ids, size, segment
            path, own = f"{place}/part-{part:06d}-{segment:05d}.gltf", uuid.uuid4().hex
            with filesystem.open_output_stream(f"{path}.{own}") as out:
                out.write(shard_bytes(names, ids))
            filesystem.move(f"{path}.{own}", path)
            row = {"part": [part], "segment": [segment], "path": [path], "n_docs": [len(names)], "n_tokens": [size]}
            names, ids, size, segment = [], [], 0, segment + 1
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int64()), ("segment", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, code in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                names.append(doc_id)
                ids.append(np.concatenate([np.frombuffer(code, encoder.dtype), end]))
                size += len(ids[-1])
                if size >= shard_ids:
                    yield close()
        if names:
            yield close()

    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("hash"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "id", "hash").sortWithinPartitions("id", "hash")  # by the hash too: rows without an id spread
    manifest, _ = materialize(dealt.mapInArrow(run, "part long, segment long, path string, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = manifest.groupBy("part").agg(F.sum("n_tokens").alias("t")).select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("_part_base"))  # one row a partition
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("_in_part", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(totals, "part")
    return based.select("part", "segment", "path", "n_docs", "n_tokens", (F.col("_part_base") + F.col("_in_part")).alias("base"))


def read_token_files(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document in the files: ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        filesystem, _ = _filesystem(folder)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with filesystem.open_input_file(path) as file:
                    shard = Shard(file.read())
                for a in range(0, len(shard.doc_ids), 500):
                    some = range(a, min(a + 500, len(shard.doc_ids)))
                    ids = [shard.ids(i).astype("<u4", copy=False).tobytes() for i in some]
                    columns = [
                        pa.array([int(shard.doc_ids[i]) if shard.known[i] else None for i in some], pa.int64()),
                        pa.array([base + int(shard.starts[i]) for i in some], pa.int64()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "base").repartition(parts, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
