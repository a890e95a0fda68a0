"""Batch job: labelled documents become training tasks that hold out a source each, without leaks.

    python -m jobs.document_holdouts --documents DOCS --labels LABELS --output OUT --config jobs/document_holdouts.json

Copies of a text are repeated measurements of one entity: they are resolved into one target, and those whose labels disagree are left out. Each source is held out
in turn; an entity that it has is on no other side. OUT/tasks (by heldout), OUT/overlap and OUT/summary are Parquet. A run replaces the tables of the run before:
held-out sources that there are no more go with them.
"""

from __future__ import annotations

import logging
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gaugelake.operators.overlap import source_overlap
from gaugelake.operators.resolve import resolve_targets
from gaugelake.operators.splits import group_of, holdout_manifest
from gaugelake.tables import small, written
from jobs.config import main

log = logging.getLogger("document_holdouts")

DEFAULTS: dict[str, Any] = {"seeds": [13, 37], "train_share": 0.9, "conflict_min": 0.5, "group_words": 5}
TASKS = "repeat int, seed int, entity_id string, partition string, grp string, lang string, target double, n_observations long, n_sources long, heldout string"


#: Labels (an id and a number each) that may be broadcast, so that only labelled texts are read through; with more of them texts become digests before they meet.
MOST_LABELS = 2_000_000


def plain(text: Column) -> Column:
    """A text as its copies share it: A-Z as a-z, and single spaces between words."""
    ascii_ = F.octet_length(text) == F.char_length(text)  # there lower() is the same, and much faster
    low = F.when(ascii_, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.trim(F.regexp_replace(low, r"[\t-\r][ \t-\r]*| [ \t-\r]+", " "))  # a single space stays


def labelled(documents: DataFrame, labels: DataFrame, group_words: int) -> DataFrame:
    """Observations: the quality of each labelled text, whose entity is the text's digest and whose group its first words'."""
    rated = labels.select("doc_id", F.col("quality").cast("double").alias("value")).where("doc_id IS NOT NULL")
    few = rated.count() <= MOST_LABELS
    docs = documents.select("doc_id", "lang", "source", "text").where(F.col("text").rlike(r"[^ \t-\r]"))  # has a word
    met = docs.join(F.broadcast(rated), "doc_id") if few else docs
    slim = met.withColumn("t", plain(F.col("text"))).drop("text")
    digests = {"entity_id": F.sha2("t", 256), "grp": F.sha2(F.substring_index("t", " ", group_words), 256)}
    keyed = slim.select("doc_id", "lang", "source", *[d.alias(c) for c, d in digests.items()], *(["value"] if few else []))
    return (keyed if few else keyed.join(rated, "doc_id")).withColumnRenamed("doc_id", "observation_id")


def run(spark: SparkSession, documents: str, labels: str, output: str, config: dict[str, Any] | None = None) -> dict[str, int]:
    """Writes the three tables and returns how many rows were read and written. Texts that are null or blank, and documents without a label, take no part."""
    config = DEFAULTS | (config or {})
    counts: dict[str, int] = {}

    def watched(df: DataFrame, name: str) -> DataFrame:
        seen[name] = Observation()
        return df.observe(seen[name], F.count(F.lit(1)).alias("n"))

    def save(df: DataFrame, name: str, *by: str) -> None:
        # Sources may be hot: their rows are dealt by entity too.
        dealt = df.repartition(*by, F.pmod(F.xxhash64("entity_id"), F.lit(8))) if by else df
        watched(dealt, name).write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(f"{output}/{name}")

    seen: dict[str, Observation] = {}
    docs = spark.read.parquet(documents).select("doc_id", "text", "lang", "source")
    rated = spark.read.parquet(labels).select("doc_id", "quality")
    obs, size = written(labelled(docs, rated, config["group_words"]), "observations")
    counts["observations"] = size["n"]
    log.info("%d labelled documents read from %s and %s", size["n"], documents, labels)
    targets = resolve_targets(obs, consistent_max=0.0, conflict_min=config["conflict_min"], labels=("grp", "lang")).where("primary")
    targets, size = written(targets.select("entity_id", group_of(F.col("grp"), F.col("entity_id")).alias("grp"), "lang", "target", "n_observations", "n_sources"), "targets")
    usable = obs.join(targets.select("entity_id"), "entity_id", "left_semi")
    manifest = holdout_manifest(usable, tuple(config["seeds"]), config["train_share"])
    save(manifest.join(small(targets, size["n"]), "entity_id").select("heldout", "repeat", "seed", "entity_id", "partition", "grp", "lang", "target", "n_observations", "n_sources"), "tasks", "heldout")
    tasks = read_tasks(spark, output)
    save(source_overlap(usable), "overlap")
    summary = tasks.groupBy("heldout", "repeat", "partition").agg(F.count("*").alias("entities"), F.avg("target").alias("mean_target"))
    save(summary, "summary")
    counts |= {name: dict(o.get).get("n", 0) for name, o in seen.items()}
    for name in ("tasks", "overlap", "summary"):
        log.info("%d rows written to %s/%s", counts[name], output, name)
    return counts


def read_tasks(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(TASKS).parquet(f"{output}/tasks")


if __name__ == "__main__":
    main(run, DEFAULTS, "document hold-outs", {"documents": "documents (Parquet)", "labels": "their labels (Parquet)", "output": "where tables are written"})
