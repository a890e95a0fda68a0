"""Audits and reports of whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugelake.functions.columns import finite_or_null
from gaugelake.operators.checks import union
from gaugelake.operators.quantiles import with_quantiles
from gaugelake.tables import written


def source_validation(obs: DataFrame, expected: dict[str, int] | None = None) -> DataFrame:
    """For each source: rows, finite and missing values, distinct entities and the spread; with ``expected`` row counts, whether they are met."""
    v = finite_or_null(F.col("value"))
    out = obs.groupBy("source").agg(
        F.count("*").alias("n"), F.count(v).alias("finite"), (F.count("*") - F.count(v)).alias("missing"), F.count_distinct("entity_id").alias("entities"), F.min(v).alias("value_min"), F.max(v).alias("value_max")
    )
    out = with_quantiles(out, obs.select("source", v.alias("value")), ["source"], "value", {"value_median": 0.5})  # few sources, each of any size
    if not expected:
        return out
    table = F.create_map(*[F.lit(x) for pair in sorted(expected.items()) for x in pair])
    return out.withColumn("as_expected", F.col("n").eqNullSafe(F.try_element_at(table, F.col("source"))))


def feature_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, non_null, missing_share, distinct_values, kind) of each column.

    Each column is counted by value first, in partial sums, so neither a row nor a set of values is copied for each distinct count; the scan reads that column alone.
    """
    kinds = dict(df.dtypes)
    parts = []
    for c in columns:
        values = df.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
        n, there = F.sum("n"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0))
        kind = "categorical" if kinds[c] in ("string", "boolean") else "numeric"
        parts.append(values.agg(F.lit(c).alias("feature"), there.alias("non_null"), (1 - F.try_divide(there, n)).alias("missing_share"), F.count("v").alias("distinct_values"), F.lit(kind).alias("kind")))
    return union(parts)


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of one value at most."""
    return feature_audit(df, columns).where("distinct_values <= 1").select("feature")


def bit_density(bits: DataFrame, n_bits: int) -> DataFrame:
    """Rows, set bits, and the part of all bits that is set."""
    return bits.agg(F.count("*").alias("n"), F.sum(F.size("bits")).alias("set_bits"), (F.sum(F.size("bits")) / (F.count("*") * n_bits)).alias("density"))


def id_digest(df: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """(keys, n, digest): SHA-256 of a group's sorted ids, one a line; null ids are left out.

    A digest can't be put together from parts. A group's ids are sorted within its partition, and folded into it as they stream by: a task holds one batch of ids,
    whatever the group's size. A group without an id has the digest of nothing.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "n long, digest string"])
    group = F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"})
    rows = df.select(*keys, group.alias("_group"), F.col(id_col).cast("string").alias("_id")).repartition("_group").sortWithinPartitions("_group", F.asc_nulls_last("_id"))
    names = [*keys, "n", "digest"]

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        held, last, n, some, kept = None, None, 0, False, hashlib.sha256()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*held.columns, pa.array([n], pa.int64()), pa.array([kept.hexdigest()])], names)

        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            groups, ids = batch.column(len(keys)), batch.column(len(keys) + 1)
            edges = [0, *(pc.indices_nonzero(pc.not_equal(groups.slice(1), groups.slice(0, size - 1))).to_numpy() + 1).tolist(), size]
            for a, b in zip(edges, edges[1:]):
                if groups[a].as_py() != last:
                    if held is not None:
                        yield made()
                    held, last, n, some, kept = batch.slice(a, 1).select(keys), groups[a].as_py(), 0, False, hashlib.sha256()
                there = ids.slice(a, b - a).drop_null()
                if len(there):
                    kept.update((("\n" if some else "") + "\n".join(there.to_pylist())).encode())
                    some = True
                n += b - a
        if held is not None:
            yield made()

    return rows.mapInArrow(fold, schema)


def flatten_report(report: Any, path: str = "") -> list[tuple[str, Any]]:
    """(metric, value) of a nested report: dotted paths; items of a list repeat its path, but objects add their place; an empty list is one value, an empty object none."""
    if isinstance(report, dict):
        return [pair for k, v in report.items() for pair in flatten_report(v, f"{path}.{k}" if path else str(k))]
    if isinstance(report, list):
        if not report:
            return [(path, "[]")]
        return [pair for k, v in enumerate(report) for pair in flatten_report(v, f"{path}.{k}" if isinstance(v, dict) else path)]
    return [(path, report)]


def flattened(reports: DataFrame, id_col: str, column: str) -> DataFrame:
    """(id, metric, value) of a table of nested reports, JSON texts of up to 16 MB in ``column``: what ``flatten_report`` gives of each, values as strings.

    A round opens one level of all reports at once; there are as many rounds as the deepest report has levels. A null report gives no row; a text that is no JSON is an error.
    """
    spark, leaves = reports.sparkSession, []
    level = reports.where(F.col(column).isNotNull()).select(F.col(id_col), F.lit("").alias("metric"), F.parse_json(F.col(column)).alias("v"))
    dot = lambda name: F.concat(F.col("metric"), F.when(F.col("metric") != "", ".").otherwise(""), name)
    while True:
        kind = F.schema_of_variant("v")
        marked, seen = written(level.withColumn("_open", kind.startswith("OBJECT") | (kind.startswith("ARRAY") & (F.to_json("v") != "[]"))), "reports", open=F.count_if("_open"))
        value = F.coalesce(F.when(F.schema_of_variant("v").startswith("ARRAY"), "[]"), F.variant_get("v", "$", "string"))
        leaves.append(marked.where("NOT _open").select(id_col, "metric", value.alias("value")))
        if not seen.get("open"):
            return union(leaves)
        items = marked.where("_open").select(id_col, "metric", F.col("v").alias("_v"))
        items = items.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        inner = F.when(F.schema_of_variant("value").startswith("OBJECT"), F.concat("metric", F.lit("."), F.col("pos").cast("string"))).otherwise(F.col("metric"))
        level = items.select(id_col, F.when(F.col("key").isNotNull(), dot(F.col("key"))).otherwise(inner).alias("metric"), F.col("value").alias("v"))


def split_report(quality: DataFrame, column: str = "similarity_median") -> DataFrame:
    """For each strategy the mean, least and greatest of its repeats' test medians; ``quality``: rows of ``splits.split_quality``."""
    test = quality.where("partition = 'test'")
    return test.groupBy("strategy").agg(F.count_distinct("repeat").alias("repeats"), F.avg(column).alias("mean_of_medians"), F.min(column).alias("least_median"), F.max(column).alias("greatest_median"))


def dataset_summary(validation: DataFrame) -> DataFrame:
    """Rows of ``source_validation`` as (source, metric, value): a nested report by source, flat."""
    names = [c for c in validation.columns if c != "source"]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])
    return validation.select("source", F.explode(pairs).alias("p")).select("source", "p.metric", "p.value")


def experiment_summary(runs: DataFrame) -> DataFrame:
    """What a table of runs holds: runs, tasks, models, feature types, strategies and repeats."""
    return runs.agg(
        F.count_distinct("run_id").alias("runs"), F.count_distinct(F.concat_ws("_r", "strategy", F.col("repeat").cast("string"))).alias("tasks"), F.count_distinct("model").alias("models"),
        F.count_distinct("feature_type").alias("feature_types"), F.count_distinct("strategy").alias("strategies"), F.count_distinct("repeat").alias("repeats"),
    )


def last_records(records: DataFrame, key: str, order: str) -> DataFrame:
    """Of the records of one key the last by ``order``."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return records.withColumn("_p", place).where("_p = 1").drop("_p")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n, columns) of each."""
    parts = [df.agg(F.lit(name).alias("table"), F.count("*").alias("n"), F.lit(len(df.columns)).alias("columns")) for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
