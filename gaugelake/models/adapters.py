"""Adapters for libraries that may be missing: rows go to a Python function in Arrow batches, failures come back as statuses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = "structure_status string, canonical string, parent string, parent_key string, group_text string, charge int, heavy_atoms int, weight double"


def standardize(df: DataFrame, column: str, parse: Callable[[str], dict]) -> DataFrame:
    """``df`` with the record of ``parse`` for each distinct text: statuses missing, invalid (ValueError), error (anything else) and ok; and entity_id, the parent's key or SMILES:parent.

    Each distinct text is parsed once.
    """
    names = [f.split(" ")[0] for f in RECORD.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
        fields = [(n, kinds[f.split(" ")[1]]) for n, f in zip(names, RECORD.split(", "), strict=True)]
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                try:
                    rows.append({"structure_status": "ok"} | parse(text))
                except ValueError:
                    rows.append({"structure_status": "invalid_smiles"})
                except Exception:  # noqa: BLE001  one bad row does not end the others
                    rows.append({"structure_status": "standardization_error"})
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r.get(n) for r in rows], k) for n, k in fields)], ["_text", *names])

    text = F.nullif(F.trim(F.col(column)), F.lit(""))
    parsed = df.select(text.alias("_text")).where("_text IS NOT NULL").distinct().mapInArrow(run, f"_text string, {RECORD}")
    out = df.withColumn("_text", text).join(parsed, "_text", "left").drop("_text")
    name = F.coalesce(F.nullif(F.col("parent_key"), F.lit("")), F.concat(F.lit("SMILES:"), F.nullif(F.col("parent"), F.lit(""))))
    return out.withColumns({"structure_status": F.coalesce("structure_status", F.lit("missing_smiles")), "entity_id": F.when(F.col("structure_status") == "ok", name)})


def featurize(df: DataFrame, column: str, compute: Callable[[str], tuple[list[float | None], list[int], list[tuple[str, str]]]]) -> DataFrame:
    """``df`` (entity_id, column) with descriptors, set bits and failures (descriptor, reason); a text that can't be computed has a failure of its own."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.struct([("descriptor", pa.string()), ("reason", pa.string())]))]
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                try:
                    values, bits, failures = compute(text)
                except Exception as e:  # noqa: BLE001
                    values, bits, failures = [], [], [("all", str(e)[:200])]
                rows.append((values, bits, [{"descriptor": d, "reason": r} for d, r in failures]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds))], ["entity_id", "descriptors", "bits", "failures"])

    kind = df.schema["entity_id"].dataType.simpleString()
    return df.select("entity_id", F.col(column).alias("_text")).mapInArrow(run, f"entity_id {kind}, descriptors array<double>, bits array<int>, failures array<struct<descriptor: string, reason: string>>")
