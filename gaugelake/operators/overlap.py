"""Overlap between sources, hold-outs by entity, and audits against another set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.functions.columns import joined_list, joined_set
from gaugelake.tables import large


def source_overlap(obs: DataFrame) -> DataFrame:
    """Entities shared by each two sources, pairs that share none included, and the percent of the smaller one."""
    held = obs.where("entity_id IS NOT NULL AND source IS NOT NULL").select("source", "entity_id").distinct()
    sizes = held.groupBy("source").agg(F.count("*").alias("n"))
    a = sizes.select(F.col("source").alias("source_left"), F.col("n").alias("entities_left"))
    b = sizes.select(F.col("source").alias("source_right"), F.col("n").alias("entities_right"))
    pairs = a.join(b, F.col("source_left") < F.col("source_right"))  # a row a source on either side
    # A row for each entity with its sources, then for each two of them: no entity meets another.
    sets = held.groupBy("entity_id").agg(F.array_sort(F.collect_set("source")).alias("s")).where("size(s) > 1")
    both = sets.select(F.explode("s").alias("source_left"), "s").select("source_left", F.explode(F.filter("s", lambda x: x > F.col("source_left"))).alias("source_right"))
    shared = both.groupBy("source_left", "source_right").agg(F.count("*").alias("shared"))
    out = pairs.join(shared, ["source_left", "source_right"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return out.withColumn("percent_of_smaller", 100 * F.col("shared") / F.least("entities_left", "entities_right"))


def without_entities_of(obs: DataFrame, heldout: DataFrame) -> DataFrame:
    """Rows of ``obs`` (keys heldout, entity_id) whose entity is not in ``heldout``: no measurement of a held-out entity is left. Null entities stay."""
    return obs.join(large(heldout.select("heldout", "entity_id").distinct()), ["heldout", "entity_id"], "left_anti")


def restricted_to(features: DataFrame, targets: DataFrame, key: str = "entity_id", exact: bool = False) -> DataFrame:
    """Features of the targets' entities. ``exact``: a target without features, or with several rows of them, is an error."""
    wanted = targets.select(key).distinct()
    found = features.join(wanted, key, "left_semi")
    if exact:
        counts = wanted.join(found.groupBy(key).agg(F.count("*").alias("_n")), key, "left")
        if bad := counts.where("_n IS NULL OR _n > 1").select(key).limit(5).collect():
            raise ValueError(f"no features, or several rows of them: {[r[0] for r in bad]}")
    return found


def internal_overlap(master: DataFrame) -> DataFrame:
    """For each entity its rows, sources and value range."""
    return master.where("entity_id IS NOT NULL").groupBy("entity_id").agg(
        F.count("*").alias("internal_observations"),
        F.count_distinct("source").alias("internal_sources"),
        joined_set(F.col("source"), ";").alias("internal_source_names"),
        F.median("value").alias("internal_median"),
    )


def overlap_audit(external: DataFrame, master: DataFrame) -> DataFrame:
    """``external`` with what is known of each entity in ``master``; zeros and an empty string where nothing is."""
    found = external.join(internal_overlap(master), "entity_id", "left")
    found = found.withColumn("in_internal", F.col("internal_observations").isNotNull())
    return found.fillna(0, ["internal_observations", "internal_sources"]).fillna("", ["internal_source_names"])


def existence(df: DataFrame, ids: DataFrame, name: str, key: str = "entity_id") -> DataFrame:
    """``df`` with a flag whether its key is in ``ids``."""
    marked = ids.select(key).distinct().withColumn(name, F.lit(True))
    return df.join(marked, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def exclusion_list(audit: DataFrame) -> DataFrame:
    """For each external entity that is known inside: its external ids and tasks."""
    return audit.where("in_internal").groupBy("entity_id").agg(
        F.count("*").alias("external_rows"), joined_list(F.col("external_id").cast("string"), ";").alias("external_ids"), joined_set(F.col("task"), ";").alias("tasks"), F.min("internal_observations").alias("internal_observations")
    )


def task_summary(audit: DataFrame) -> DataFrame:
    """For each task of the audit: rows, known and unknown entities, and its values."""
    return audit.groupBy("task").agg(
        F.count("*").alias("n"), F.count_if("in_internal").alias("known"), F.count_if(~F.col("in_internal")).alias("unknown"),
        F.min("value").alias("value_min"), F.max("value").alias("value_max"), F.avg("value").alias("value_mean"), F.median("value").alias("value_median"),
    )
