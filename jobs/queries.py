"""The jobs as queries: each runs its job twice into one new folder and returns the output as it stands then, beside the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake.tables import new_path
from jobs import document_holdouts, refresh_targets


def job1_refresh_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "job1")
    for _ in range(2):
        refresh_targets.run(spark, f"{sf_dir}/events.parquet", f"{out}/tables", f"{out}/checkpoint")
    found = refresh_targets.read_targets(spark, f"{out}/tables")
    numbers = ["target", "value_mean", "value_sd", "value_min", "value_q25", "value_q75", "value_max", "value_mad", "value_range", "value_iqr"]
    return found.withColumns({c: F.round(c, 6) for c in numbers} | {"day": F.col("day").cast("string")})


_JOB1_SQL = """
WITH e AS (
    SELECT event_id AS observation_id, user_id || '-' || strftime(ts, '%Y-%m-%d') AS entity_id, strftime(ts, '%Y-%m-%d') AS day, event_type AS source, user_id % 20 AS grp, ln(value) AS value FROM events WHERE ts IS NOT NULL AND value > 0 AND isfinite(value)
), c AS (
    SELECT *, abs(value - median(value) OVER (PARTITION BY entity_id)) AS dev FROM e WHERE entity_id IS NOT NULL
), a AS (
    SELECT entity_id, day, min_by(grp, observation_id) AS grp, count(*) AS n_observations, count(DISTINCT source) AS n_sources, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, median(value) AS target, avg(value) AS value_mean,
        stddev_samp(value) AS value_sd, min(value) AS value_min, quantile_cont(value, 0.25) AS value_q25, quantile_cont(value, 0.75) AS value_q75, max(value) AS value_max, median(dev) AS value_mad FROM c GROUP BY entity_id, day
), f AS (
    SELECT *, value_max - value_min AS value_range, value_q75 - value_q25 AS value_iqr, value_max - value_min > 1 AS conflict, target < -15 OR target > 2.5 AS outside_review FROM a
)
SELECT entity_id, grp::BIGINT AS grp, n_observations::BIGINT AS n_observations, n_sources::BIGINT AS n_sources, sources, conflict, outside_review, day,
    CASE WHEN n_observations = 1 THEN 'single_observation' WHEN value_range <= 0.5 THEN 'consistent' WHEN value_range <= 1 THEN 'moderate' ELSE 'conflict' END AS reliability, NOT (conflict OR outside_review) AS "primary",
    CASE WHEN conflict AND outside_review THEN 'conflict_and_outside_review' WHEN conflict THEN 'conflict' WHEN outside_review THEN 'outside_review' ELSE 'included' END AS exclusion_reason,
    """ + ", ".join(f"round({c}, 6) AS {c}" for c in ("target", "value_mean", "value_sd", "value_min", "value_q25", "value_q75", "value_max", "value_mad", "value_range", "value_iqr")) + " FROM f"  # fmt: skip


def job2_document_holdouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "job2")
    for _ in range(2):
        document_holdouts.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out)
    return document_holdouts.read_tasks(spark, out).withColumns({c: F.col(c).cast("long") for c in ("repeat", "seed")})


_JOB2_SQL = r"""
WITH d AS (
    SELECT doc_id, lang, source, trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+', ' ', 'g'), ' ') AS t FROM documents WHERE text IS NOT NULL
), o AS (
    SELECT d.doc_id, lang, source, sha256(t) AS entity_id, sha256(array_to_string(string_split(t, ' ')[1:5], ' ')) AS grp, quality::DOUBLE AS value FROM d JOIN labels ON d.doc_id = labels.doc_id WHERE t <> '' AND quality IS NOT NULL
), g AS (
    SELECT entity_id, min_by(grp, doc_id) AS grp, min_by(lang, doc_id) FILTER (lang IS NOT NULL) AS lang, median(value) AS target, count(*) AS n_observations, count(DISTINCT source) AS n_sources FROM o GROUP BY entity_id HAVING max(value) - min(value) <= 0.5
), u AS (
    SELECT DISTINCT entity_id, source FROM o WHERE entity_id IN (SELECT entity_id FROM g)
), te AS (
    SELECT source AS heldout, entity_id FROM u WHERE source IS NOT NULL
), tr AS (
    SELECT DISTINCT h.heldout, u.entity_id FROM u, (SELECT DISTINCT heldout FROM te) AS h WHERE u.source <> h.heldout AND NOT EXISTS (SELECT 1 FROM te WHERE te.heldout = h.heldout AND te.entity_id = u.entity_id)
), s AS (
    SELECT * FROM (VALUES (1, 13), (2, 37)) AS t(repeat, seed)
), m AS (
    SELECT heldout, repeat, seed, entity_id, CASE WHEN row_number() OVER (PARTITION BY heldout, repeat ORDER BY md5(seed || ':' || entity_id)) <= round_even(0.9 * count(*) OVER (PARTITION BY heldout, repeat), 0) THEN 'train' ELSE 'validation' END AS partition FROM tr, s
    UNION ALL SELECT heldout, repeat, seed, entity_id, 'test' FROM te, s
)
SELECT heldout, repeat::BIGINT AS repeat, seed::BIGINT AS seed, m.entity_id, partition, grp, lang, target, n_observations::BIGINT AS n_observations, n_sources::BIGINT AS n_sources FROM m JOIN g ON m.entity_id = g.entity_id
"""


def queries() -> dict:
    return {f.__name__: f for f in (job1_refresh_targets, job2_document_holdouts)}


def oracle_sql() -> dict[str, str]:
    return {"job1_refresh_targets": _JOB1_SQL, "job2_document_holdouts": _JOB2_SQL}
