"""The audit's queries, bound to the driver's tables, and for each the DuckDB SQL that must give the same rows.

observations: events as repeated measurements of (user, day) by event type. bits: components of embeddings above 0.1. predictions: three simple models
(all, user group, weekday) fitted on four fifths of the other sources, for each held-out source and two repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from gaugelake.functions.columns import esol, sample_key, slug
from gaugelake.operators import bootstrap, metrics, overlap, reports, residuals, resolve, selection, similarity, splits, tasks, unify
from gaugelake.streaming.rollup import source_rollup
from gaugelake.tables import written

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _tidy(df: DataFrame) -> DataFrame:
    """Doubles to six places, whole numbers as long: sums don't depend on their order then."""
    out = []
    for c, kind in df.dtypes:
        column = F.col(c)
        if kind in ("double", "float"):
            column = F.round(column.cast("double"), 6)
        elif kind in ("int", "smallint", "tinyint") or kind.startswith("decimal"):
            column = column.cast("long")
        out.append(column.alias(c))
    return df.select(*out)


def _query(sql: str = "") -> Callable:
    def add(f: Callable) -> Callable:
        name = f.__name__
        _QUERIES[name] = lambda spark, sf_dir: _tidy(f(spark, sf_dir))
        if sql:
            _SQL[name] = _typed(sql)
        return f

    return add


def _typed(sql: str) -> str:
    """d(x): a double to six places; n(x): a long. As macros would need a connection, they are written out."""
    out, k = [], 0
    while k < len(sql):
        if sql[k : k + 2] in ("d(", "n(") and not (k and (sql[k - 1].isalnum() or sql[k - 1] == "_")):
            depth, j = 1, k + 2
            while depth:
                depth += {"(": 1, ")": -1}.get(sql[j], 0)
                j += 1
            inner = _typed(sql[k + 2 : j - 1])
            out.append(f"round(({inner})::DOUBLE, 6)" if sql[k] == "d" else f"({inner})::BIGINT")
            k = j
        else:
            out.append(sql[k])
            k += 1
    return "".join(out)


# ---- inputs


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    day = F.to_date("ts")
    return e.select(
        F.col("event_id").alias("observation_id"), F.concat(F.col("user_id").cast("string"), F.lit("-"), day.cast("string")).alias("entity_id"), F.col("event_type").alias("source"),
        F.when(F.col("value") > 0, F.ln("value")).alias("value"), (F.col("user_id") % 20).alias("grp"), F.weekday("ts").alias("weekday"), "ts", "props",
    )


_OBS = """obs AS (
    SELECT event_id AS observation_id, user_id || '-' || strftime(ts, '%Y-%m-%d') AS entity_id, event_type AS source, CASE WHEN value > 0 THEN ln(value) END AS value,
        user_id % 20 AS grp, isodow(ts) - 1 AS weekday, ts, props FROM events
)"""
_TARGETS = f"""{_OBS}, el AS (
    SELECT *, abs(value - median(value) OVER (PARTITION BY entity_id)) AS dev FROM obs WHERE value IS NOT NULL AND isfinite(value)
), agg AS (
    SELECT entity_id, min_by(grp, observation_id) AS grp, count(*) AS n_observations, count(DISTINCT source) AS n_sources, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, median(value) AS target,
        avg(value) AS value_mean, stddev_samp(value) AS value_sd, min(value) AS value_min, quantile_cont(value, 0.25) AS value_q25, quantile_cont(value, 0.75) AS value_q75, max(value) AS value_max,
        median(dev) AS value_mad, count(props) AS n_with_props FROM el GROUP BY entity_id
), tg AS (
    SELECT *, value_max - value_min AS value_range, value_q75 - value_q25 AS value_iqr, value_max - value_min > 1 AS conflict, target < -15 OR target > 2.5 AS outside_review,
        CASE WHEN n_observations = 1 THEN 'single_observation' WHEN value_max - value_min <= 0.5 THEN 'consistent' WHEN value_max - value_min <= 1 THEN 'moderate' ELSE 'conflict' END AS reliability FROM agg
), targets AS (
    SELECT *, NOT (conflict OR outside_review) AS "primary", CASE WHEN conflict AND outside_review THEN 'conflict_and_outside_review' WHEN conflict THEN 'conflict' WHEN outside_review THEN 'outside_review' ELSE 'included' END AS exclusion_reason FROM tg
)"""


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_targets(observations(spark, sf_dir), labels=("grp",), counted=("props",))


def bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("entity_id"), similarity.set_bits(F.col("embedding"), 0.1).alias("bits"), F.col("label").cast("string").alias("grp"), F.element_at("embedding", 1).cast("double").alias("target"))


_BITS = """vb AS (
    SELECT vec_id AS entity_id, label, embedding[1]::DOUBLE AS target, list_filter(range(64), lambda i: embedding[i + 1] > CAST(0.1 AS FLOAT)) AS bits FROM embeddings
), post AS (SELECT entity_id, len(bits) AS nb, unnest(bits) AS bit FROM vb)"""


def _two_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every row as a query against all rows."""
    b = bits(spark, sf_dir)
    return b, b


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, model, feature_type, strategy, repeat, seed, heldout, entity_id, truth, predicted, sigma)."""
    obs = observations(spark, sf_dir).where("value IS NOT NULL").select("observation_id", "source", "grp", "weekday", "value")
    heldout = obs.select(F.col("source").alias("heldout")).distinct()
    repeats = spark.createDataFrame([(1, 13), (2, 37)], "repeat int, seed int")
    fit = obs.crossJoin(F.broadcast(repeats)).where(F.substring(sample_key(F.col("seed"), F.col("observation_id")), 1, 1) < "d").join(F.broadcast(heldout), F.col("source") != F.col("heldout"))
    sums = fit.groupBy("heldout", "repeat", "seed", "grp", "weekday").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"), F.count("*").alias("c"))
    scored = obs.withColumn("heldout", F.col("source"))
    models = {"dummy": [], "group": ["grp"], "weekday": ["weekday"]}
    for model, by in models.items():  # each row meets all models' means in one pass: sources x repeats x (1, 20 groups, 7 days)
        keys = ["heldout", *([] if model == "dummy" else ["repeat", "seed"]), *by]
        mean = F.sum("s") / F.sum("c")
        made = F.struct(F.lit(model).alias("model"), mean.alias("predicted"), F.sqrt(F.greatest(F.sum("ss") / F.sum("c") - F.pow(mean, 2), F.lit(0.0))).alias("sigma"))
        scored = scored.join(F.broadcast(sums.groupBy("heldout", "repeat", "seed", *by).agg(made.alias(f"_{model}"))), keys, "inner" if model == "dummy" else "left")
    rows = scored.select("heldout", "repeat", "seed", F.col("observation_id").alias("entity_id"), F.col("value").alias("truth"), F.explode(F.array(*[f"_{m}" for m in models])).alias("m")).where("m IS NOT NULL")
    out = rows.select("heldout", "repeat", "seed", "entity_id", "truth", "m.predicted", "m.sigma", "m.model")
    run = F.concat_ws("_", F.concat(F.lit("source_"), slug(F.col("heldout"))), F.concat(F.lit("r"), F.col("repeat").cast("string")), F.lit("mean"), "model")
    named = out.withColumns({"feature_type": F.lit("mean"), "strategy": F.concat(F.lit("source_"), slug(F.col("heldout"))), "run_id": run})
    return written(named, "predictions")[0]  # read by every step that follows


_PRED = f"""{_OBS}, ov AS (SELECT observation_id, source, grp, weekday, value FROM obs WHERE value IS NOT NULL),
rp AS (SELECT * FROM (VALUES (1, 13), (2, 37)) AS t(repeat, seed)),
fit AS (SELECT h.heldout, repeat, seed, grp, weekday, value FROM ov, rp, (SELECT DISTINCT source AS heldout FROM ov) AS h WHERE h.heldout <> source AND substr(md5(seed || ':' || observation_id), 1, 1) < 'd'),
m AS (
    SELECT heldout, repeat, seed, 'dummy' AS model, NULL AS grp, NULL AS weekday, avg(value) AS predicted, stddev_pop(value) AS sigma FROM fit GROUP BY ALL
    UNION ALL SELECT heldout, repeat, seed, 'group', grp, NULL, avg(value), stddev_pop(value) FROM fit GROUP BY heldout, repeat, seed, grp
    UNION ALL SELECT heldout, repeat, seed, 'weekday', NULL, weekday, avg(value), stddev_pop(value) FROM fit GROUP BY heldout, repeat, seed, weekday
),
pred AS (
    SELECT m.heldout, repeat, seed, observation_id AS entity_id, value AS truth, predicted, sigma, model, 'mean' AS feature_type,
        'source_' || trim(regexp_replace(lower(m.heldout), '[^a-z0-9]+', '_', 'g'), '_') AS strategy,
        'source_' || trim(regexp_replace(lower(m.heldout), '[^a-z0-9]+', '_', 'g'), '_') || '_r' || repeat || '_mean_' || model AS run_id
    FROM ov JOIN m ON ov.source = m.heldout AND (m.grp IS NULL OR m.grp = ov.grp) AND (m.weekday IS NULL OR m.weekday = ov.weekday)
),
lab AS (SELECT *, truth - predicted AS residual, abs(truth - predicted) AS e FROM pred)"""
_RUNS = f"""{_PRED}, runs AS (
    SELECT run_id, model, feature_type, strategy, repeat, count(*) AS n, avg(residual) AS mean_residual, stddev_samp(residual) AS residual_sd, sqrt(avg(e * e)) AS rmse, avg(e) AS mae, median(e) AS median_error,
        quantile_cont(e, 0.9) AS p90_error, quantile_cont(e, 0.95) AS p95_error, max(e) AS max_error, avg((residual > 0)::INT) AS underprediction_rate, avg((residual < 0)::INT) AS overprediction_rate,
        avg((e > 0.5)::INT) AS r05, avg((e > 1)::INT) AS r10, avg((e > 2)::INT) AS r20 FROM lab GROUP BY ALL
)"""
_SEL = f"""{_RUNS}, cand AS (
    SELECT *, strategy || '_r' || repeat AS task_id, replace(strategy, 'source_', '') AS heldout, mae AS vr,
        rmse - min(rmse) OVER w AS regret, rank() OVER (w ORDER BY rmse) AS rk FROM runs WINDOW w AS (PARTITION BY strategy, repeat)
), tb AS (
    SELECT f.heldout, c.model, row_number() OVER (PARTITION BY f.heldout ORDER BY avg(c.rmse), c.model) AS p FROM cand c JOIN (SELECT DISTINCT heldout FROM cand) f ON c.heldout <> f.heldout GROUP BY f.heldout, c.model
), sel AS (
    SELECT * EXCLUDE p FROM (SELECT *, 'validation_rmse' AS selector, row_number() OVER (PARTITION BY task_id ORDER BY vr, run_id) AS p FROM cand) WHERE p = 1
    UNION ALL SELECT * EXCLUDE p FROM (SELECT *, 'oracle' AS selector, row_number() OVER (PARTITION BY task_id ORDER BY rmse, run_id) AS p FROM cand) WHERE p = 1
    UNION ALL SELECT c.*, 'training_source_best' FROM cand c JOIN tb ON c.heldout = tb.heldout AND c.model = tb.model AND p = 1
    UNION ALL SELECT *, 'fixed_group' FROM cand WHERE model = 'group'
)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(residuals.run_summary(residuals.failure_labels(residuals.with_residuals(predictions(spark, sf_dir)))), "runs")[0]


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    task = F.concat_ws("_r", "strategy", F.col("repeat").cast("string"))
    named = runs.select("run_id", task.alias("task_id"), F.regexp_replace("strategy", "source_", "").alias("heldout"), F.col("model").alias("x_model"), F.col("feature_type").alias("x_feature_type"), F.col("mae").alias("x_validation_rmse"), F.col("rmse").alias("y_rmse"), F.lit(True).alias("selectable"))
    return written(tasks.ranked_outcomes(named), "candidates")[0]


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(selection.selected_candidates(_candidates(spark, sf_dir), {"fixed_group": ("group", "mean")}), "selected")[0]


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    joined = labels.join(d, "doc_id").where("quality IS NOT NULL")
    return joined.select(F.lit("length").alias("model"), "source", F.col("quality").alias("label"), (F.floor(F.col("n_chars") / 100) / (F.floor(F.col("n_chars") / 100) + 10.0)).alias("probability"))


_SCORES = """sc AS (SELECT 'length' AS model, source, quality AS label, floor(n_chars / 100) / (floor(n_chars / 100) + 10.0::DOUBLE) AS p FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)"""

# ---- resolution and overlap


@_query(f"""WITH {_TARGETS} SELECT entity_id, grp, n(n_observations) AS n_observations, n(n_sources) AS n_sources, sources, d(target) AS target, d(value_mean) AS value_mean, d(value_sd) AS value_sd, d(value_min) AS value_min, d(value_q25) AS value_q25,
    d(value_q75) AS value_q75, d(value_max) AS value_max, d(value_mad) AS value_mad, n(n_with_props) AS n_with_props, d(value_range) AS value_range, d(value_iqr) AS value_iqr, conflict, outside_review, reliability, "primary", exclusion_reason FROM targets""")
def resolve_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _targets(spark, sf_dir)


@_query(f"""WITH {_OBS} SELECT entity_id, min_by(grp, observation_id) AS grp, n(count(*)) AS n_observations, n(count(DISTINCT source)) AS n_sources, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, d(avg(value)) AS value_mean, d(median(value)) AS value_median,
    d(stddev_samp(value)) AS value_sd, d(min(value)) AS value_min, d(max(value)) AS value_max, bool_or(observation_id % 7 = 0) AS any_seventh, d(max(value) - min(value)) AS value_range, max(value) - min(value) > 1 AS conflict FROM obs WHERE value IS NOT NULL GROUP BY entity_id""")
def entity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).withColumn("seventh", F.col("observation_id") % 7 == 0)
    return resolve.entity_summary(obs, labels=("grp",), flags=("seventh",))


@_query(f"""WITH {_TARGETS} SELECT reliability, n(count(*)) AS entities, n(sum(n_observations)) AS observations, d(median(value_range)) AS median_range, n(count(*) FILTER ("primary")) AS primary_entities, d(100.0 * count(*) / sum(count(*)) OVER ()) AS percent FROM targets GROUP BY reliability""")
def reliability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.reliability_summary(_targets(spark, sf_dir))


@_query(f"""WITH {_TARGETS} SELECT 'reliability' AS kind, reliability AS value, n(count(*)) AS entities FROM targets GROUP BY reliability UNION ALL SELECT 'exclusion_reason', exclusion_reason, n(count(*)) FROM targets GROUP BY exclusion_reason""")
def target_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.target_report(_targets(spark, sf_dir))


@_query(f"""WITH {_TARGETS} SELECT n((SELECT count(*) FROM el)) AS eligible, n(sum(n_observations)) AS resolved, (SELECT count(*) FROM el) = sum(n_observations) AS conserved FROM targets""")
def conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resolve.eligible(observations(spark, sf_dir)).agg(F.count("*").alias("eligible"))
    total = _targets(spark, sf_dir).agg(F.sum("n_observations").alias("resolved"))
    return rows.crossJoin(total).withColumn("conserved", F.col("eligible") == F.col("resolved"))


@_query(f"""WITH {_OBS}, h AS (SELECT DISTINCT source, entity_id FROM obs), s AS (SELECT source, count(*) AS k FROM h GROUP BY source), j AS (SELECT x.source AS l, y.source AS r, count(*) AS k FROM h x JOIN h y ON x.entity_id = y.entity_id AND x.source < y.source GROUP BY ALL)
    SELECT a.source AS source_left, b.source AS source_right, n(a.k) AS entities_left, n(b.k) AS entities_right, n(coalesce(j.k, 0)) AS shared, d(100.0 * coalesce(j.k, 0) / least(a.k, b.k)) AS percent_of_smaller
    FROM s a JOIN s b ON a.source < b.source LEFT JOIN j ON l = a.source AND r = b.source""")
def source_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.source_overlap(observations(spark, sf_dir))


@_query(f"""WITH {_OBS} SELECT source, n(count(*)) AS n, n(count(value)) AS finite, n(count(*) - count(value)) AS missing, n(count(DISTINCT entity_id)) AS entities, d(min(value)) AS value_min, d(median(value)) AS value_median, d(max(value)) AS value_max FROM obs GROUP BY source""")
def source_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.source_validation(observations(spark, sf_dir))


PARTIES = StructType([StructField(*f) for f in (("source", StringType()), ("record_id", StringType()), ("name", StringType()), ("nation", LongType()), ("balance", DoubleType()), ("segment", StringType()))])


@_query("""SELECT 'customer' AS source, printf('customer:%07d', c_custkey) AS record_id, trim(c_name) AS name, n(c_nationkey) AS nation, d(-c_acctbal) AS balance, c_mktsegment AS segment FROM customer
    UNION ALL SELECT 'supplier', s_suppkey::VARCHAR, s_name, n(s_nationkey), d(s_acctbal), NULL FROM supplier""")
def unify_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = unify.Mapping("customer", {"name": lambda df: F.trim("c_name"), "nation": "c_nationkey", "balance": lambda df: -F.col("c_acctbal"), "segment": "c_mktsegment"}, row_col="c_custkey")
    s = unify.Mapping("supplier", {"record_id": "s_suppkey", "name": "s_name", "nation": "s_nationkey", "balance": "s_acctbal", "segment": "s_segment"})
    return unify.unify([(spark.read.parquet(f"{sf_dir}/customer.parquet"), c), (spark.read.parquet(f"{sf_dir}/supplier.parquet"), s)], PARTIES)


@_query("""SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment, NULL::VARCHAR AS s_name FROM customer UNION ALL SELECT s_suppkey, NULL, NULL, s_name FROM supplier""")
def union_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return unify.union_loose([c, spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"), "s_name")])


@_query(f"""WITH {_OBS}, h AS (SELECT DISTINCT source AS heldout, entity_id FROM obs) SELECT s.heldout, n(count(*)) AS n, n(count(DISTINCT o.entity_id)) AS entities FROM obs o JOIN (SELECT DISTINCT source AS heldout FROM obs) s ON o.source <> s.heldout
    WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.heldout = s.heldout AND h.entity_id = o.entity_id) GROUP BY s.heldout""")
def antijoin_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).select("observation_id", "source", "entity_id")
    held = obs.select(F.col("source").alias("heldout"), "entity_id")
    rest = obs.join(F.broadcast(held.select("heldout").distinct()), F.col("source") != F.col("heldout"))
    return overlap.without_entities_of(rest, held).groupBy("heldout").agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("entities"))


@_query("""SELECT label, n(count(*)) AS n FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY label""")
def semijoin_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("entity_id"), "label")
    ids = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select(F.col("doc_id").alias("entity_id"))
    return overlap.restricted_to(e, ids).groupBy("label").agg(F.count("*").alias("n"))


def _external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All purchases as an external set, half of their entities renamed so that they are unknown."""
    obs = observations(spark, sf_dir).where("source = 'purchase'")
    name = F.when(F.col("observation_id") % 2 == 0, F.col("entity_id")).otherwise(F.concat(F.lit("new-"), F.col("entity_id")))
    return obs.select(F.col("observation_id").alias("external_id"), name.alias("entity_id"), F.when(F.col("weekday") < 3, "early").otherwise("late").alias("task"), "value")


_AUDIT = f"""{_OBS}, ex AS (SELECT observation_id AS external_id, CASE WHEN observation_id % 2 = 0 THEN entity_id ELSE 'new-' || entity_id END AS entity_id, CASE WHEN weekday < 3 THEN 'early' ELSE 'late' END AS task, value FROM obs WHERE source = 'purchase'),
    inside AS (SELECT entity_id, count(*) AS k, count(DISTINCT source) AS s, string_agg(DISTINCT source, ';' ORDER BY source) AS names, median(value) AS med FROM obs GROUP BY entity_id),
    audit AS (SELECT ex.*, coalesce(k, 0) AS k, coalesce(s, 0) AS s, coalesce(names, '') AS names, med, k IS NOT NULL AS known FROM ex LEFT JOIN inside USING (entity_id))"""


@_query(f"""WITH {_AUDIT} SELECT entity_id, external_id, task, d(value) AS value, n(k) AS internal_observations, n(s) AS internal_sources, names AS internal_source_names, d(med) AS internal_median, known AS in_internal FROM audit""")
def existence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_audit(_external(spark, sf_dir), observations(spark, sf_dir))


@_query(f"""WITH {_AUDIT} SELECT entity_id, n(count(*)) AS external_rows, string_agg(external_id::VARCHAR, ';' ORDER BY external_id::VARCHAR) AS external_ids, string_agg(DISTINCT task, ';' ORDER BY task) AS tasks, n(min(k)) AS internal_observations FROM audit WHERE known GROUP BY entity_id""")
def exclusion_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.exclusion_list(overlap.overlap_audit(_external(spark, sf_dir), observations(spark, sf_dir)))


@_query(f"""WITH {_AUDIT} SELECT task, n(count(*)) AS n, n(count(*) FILTER (known)) AS known, n(count(*) FILTER (NOT known)) AS unknown, d(min(value)) AS value_min, d(max(value)) AS value_max, d(avg(value)) AS value_mean, d(median(value)) AS value_median FROM audit GROUP BY task""")
def external_task_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.task_summary(overlap.overlap_audit(_external(spark, sf_dir), observations(spark, sf_dir)))


# ---- similarity and splits

_NEAR = f"""{_BITS}, q AS (SELECT * FROM post), t AS (SELECT * FROM post),
    sim AS (SELECT q.entity_id AS query, t.entity_id AS candidate, count(*)::DOUBLE / (any_value(q.nb) + any_value(t.nb) - count(*)) AS s FROM q JOIN t ON q.bit = t.bit AND q.entity_id <> t.entity_id GROUP BY q.entity_id, t.entity_id)"""


@_query(f"""WITH {_NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, candidate) AS p FROM sim)
    SELECT v.entity_id AS query, coalesce(candidate, (SELECT min(entity_id) FROM vb)) AS nearest, d(coalesce(s, 0)::FLOAT) AS similarity FROM vb v LEFT JOIN r ON v.entity_id = r.query AND p = 1""")
def nearest_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.nearest_neighbour(*_two_sets(spark, sf_dir), others=True)


@_query(f"""WITH {_NEAR} SELECT v.entity_id, d(coalesce(max(s), 0)) AS max_similarity FROM vb v LEFT JOIN sim ON v.entity_id = query GROUP BY v.entity_id""")
def max_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.max_similarity(*_two_sets(spark, sf_dir), others=True)


_BINNED = """{src}, ed AS (SELECT list_distinct(quantile_cont(target, [k / 10.0 FOR k IN range(11)])) AS e FROM {t}), bn AS (SELECT entity_id, target, greatest(len(list_filter(e, lambda x: x < target)), 1) - 1 AS bin FROM {t}, ed)"""


@_query(f"""WITH {_BINNED.format(src=_TARGETS, t='targets')} SELECT entity_id, d(target) AS target, n(bin) AS bin FROM bn""")
def quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.quantile_bins(_targets(spark, sf_dir).select("entity_id", "target"), "target")


@_query(f"""WITH {_TARGETS} SELECT entity_id, row_number() OVER (ORDER BY md5('13:' || entity_id)) <= (SELECT round_even(0.8 * count(*), 0) FROM targets) AS chosen FROM targets""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _targets(spark, sf_dir).select("entity_id", F.lit(0).alias("bin"))
    return splits.stratified_split(t, 0.8, 13).select("entity_id", "chosen")


def _stratified(src: str, t: str, share: str, seed: int, name: str) -> str:
    return f"""{name}z AS (SELECT bin, count(*) AS k, floor(count(*) * {share}) AS f, count(*) * {share} - floor(count(*) * {share}) AS rest FROM {t} GROUP BY bin),
    {name}q AS (SELECT bin, f + (row_number() OVER (ORDER BY round(rest, 9) DESC, bin) <= (SELECT round_even(sum(k) * {share}, 0) - sum(f) FROM {name}z))::INT AS quota FROM {name}z),
    {name} AS (SELECT {t}.*, row_number() OVER (PARTITION BY {t}.bin ORDER BY md5('{seed}:' || entity_id)) <= quota AS chosen FROM {t} JOIN {name}q ON {t}.bin = {name}q.bin)"""


_SPLIT = f"{_BINNED.format(src=_TARGETS, t='targets')}, {_stratified('', 'bn', '0.8::DOUBLE', 13, 's1')}, r1 AS (SELECT entity_id, bin FROM s1 WHERE NOT chosen), {_stratified('', 'r1', '0.5::DOUBLE', 14, 's2')}, parts AS (SELECT entity_id, 'train' AS partition FROM s1 WHERE chosen UNION ALL SELECT entity_id, CASE WHEN chosen THEN 'validation' ELSE 'test' END FROM s2)"


@_query(f"""WITH {_SPLIT} SELECT entity_id, partition FROM parts""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.random_partitions(_targets(spark, sf_dir), 13)


@_query(f"""WITH {_SPLIT}, j AS (SELECT partition, grp, target FROM parts JOIN targets USING (entity_id))
    SELECT 'random' AS strategy, n(1) AS repeat, n(13) AS seed, partition, n(count(*)) AS n, n(count(DISTINCT grp)) AS groups, d(avg(target)) AS target_mean, d(stddev_samp(target)) AS target_sd, d(median(target)) AS target_median, d(min(target)) AS target_min, d(max(target)) AS target_max,
    NULL::DOUBLE AS similarity_median, d(count(*)::DOUBLE / sum(count(*)) OVER ()) AS fraction FROM j GROUP BY partition""")
def split_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, _ = written(_targets(spark, sf_dir), "targets")
    a = splits.random_partitions(t, 13).join(t.select("entity_id", "grp"), "entity_id")
    a = a.withColumns({"strategy": F.lit("random"), "repeat": F.lit(1), "seed": F.lit(13), "max_similarity": F.lit(None).cast("double")})
    return splits.split_quality(a, t)


@_query("""WITH RECURSIVE g AS (
    SELECT label::VARCHAR AS grp, count(*) AS n, count(*) * (0.9::DOUBLE + 0.2::DOUBLE * (('0x' || substr(md5('13:' || label), 1, 8))::BIGINT / 4294967296.0::DOUBLE)) AS w FROM embeddings GROUP BY label
), o AS (
    SELECT grp, n::DOUBLE AS n, row_number() OVER (ORDER BY w DESC, grp) AS k, (sum(n) OVER ())::DOUBLE AS total FROM g
), f AS (
    SELECT 0::BIGINT AS k, 0::DOUBLE AS a, 0::DOUBLE AS b, 0::DOUBLE AS c, ''::VARCHAR AS grp, -1 AS p
    UNION ALL SELECT k, a + CASE p WHEN 0 THEN n ELSE 0 END, b + CASE p WHEN 1 THEN n ELSE 0 END, c + CASE p WHEN 2 THEN n ELSE 0 END, grp, p FROM (
        SELECT *, CASE WHEN ca AND na >= most THEN 0 WHEN cb AND nb >= most THEN 1 ELSE 2 END AS p FROM (
            SELECT *, greatest(CASE WHEN ca THEN na ELSE -1e300 END, CASE WHEN cb THEN nb ELSE -1e300 END, CASE WHEN cc THEN nc ELSE -1e300 END) AS most FROM (
                SELECT *, fa <= least(fa, fb, fc) + 1e-9 AS ca, fb <= least(fa, fb, fc) + 1e-9 AS cb, fc <= least(fa, fb, fc) + 1e-9 AS cc FROM (
                    SELECT o.k, o.grp, o.n, a, b, c, a / (total * 0.8::DOUBLE) AS fa, b / (total * 0.1::DOUBLE) AS fb, c / (total * 0.1::DOUBLE) AS fc, total * 0.8::DOUBLE - a AS na, total * 0.1::DOUBLE - b AS nb, total * 0.1::DOUBLE - c AS nc
                    FROM f JOIN o ON o.k = f.k + 1))))
) SELECT vec_id AS entity_id, CASE p WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS partition FROM embeddings JOIN f ON f.grp = label::VARCHAR""")
def scaffold_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.group_partitions(bits(spark, sf_dir), 13)


@_query("""SELECT 'straddling' AS fault, n(0) AS groups, n(count(DISTINCT label)) AS all_groups FROM embeddings""")
def scaffold_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bits(spark, sf_dir)
    per = splits.group_partitions(b, 13).join(b.select("entity_id", "grp"), "entity_id").groupBy("grp").agg(F.count_distinct("partition").alias("k"))
    return per.agg(F.lit("straddling").alias("fault"), F.count_if(F.col("k") > 1).alias("groups"), F.count("*").alias("all_groups"))


_LOW = f"""{_BINNED.format(src=_BITS, t='vb')}, {_stratified('', 'bn', '0.7::DOUBLE', 13, 's1')},
    sim AS (SELECT q.entity_id, max(i::DOUBLE / (q.nb + t.nb - i)) AS s FROM (SELECT a.entity_id, b.entity_id AS c, any_value(a.nb) AS nb, count(*) AS i FROM post a JOIN post b ON a.bit = b.bit JOIN s1 x ON x.entity_id = a.entity_id AND NOT x.chosen JOIN s1 y ON y.entity_id = b.entity_id AND y.chosen GROUP BY a.entity_id, b.entity_id) q
        JOIN (SELECT DISTINCT entity_id AS c, nb FROM post) t ON q.c = t.c GROUP BY q.entity_id),
    o AS (SELECT entity_id, row_number() OVER (ORDER BY coalesce(s, 0), md5('13:' || entity_id)) AS p, round_even((SELECT count(*) FROM vb) * 0.1::DOUBLE, 0) AS tenth FROM s1 LEFT JOIN sim USING (entity_id) WHERE NOT chosen)"""


@_query(f"""WITH {_LOW} SELECT entity_id, 'train' AS partition FROM s1 WHERE chosen UNION ALL SELECT entity_id, CASE WHEN p <= tenth THEN 'test' WHEN p <= 2 * tenth THEN 'validation' ELSE 'train' END FROM o""")
def low_similarity_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bits(spark, sf_dir)
    return splits.low_similarity_partitions(b, b, 13)


_HOLD = f"""{_OBS}, te AS (SELECT DISTINCT source AS heldout, entity_id FROM obs), tr AS (SELECT DISTINCT h.heldout, o.entity_id FROM obs o, (SELECT DISTINCT source AS heldout FROM obs) h WHERE o.source <> h.heldout AND NOT EXISTS (SELECT 1 FROM te WHERE te.heldout = h.heldout AND te.entity_id = o.entity_id)),
    sd AS (SELECT * FROM (VALUES (1, 13), (2, 37), (3, 73), (4, 101), (5, 137)) AS t(repeat, seed)),
    man AS (SELECT heldout, repeat, seed, entity_id, CASE WHEN row_number() OVER (PARTITION BY heldout, repeat ORDER BY md5(seed || ':' || entity_id)) <= round_even(0.9 * count(*) OVER (PARTITION BY heldout, repeat), 0) THEN 'train' ELSE 'validation' END AS partition FROM tr, sd
        UNION ALL SELECT heldout, repeat, seed, entity_id, 'test' FROM te, sd)"""


@_query(f"""WITH {_HOLD} SELECT heldout, n(repeat) AS repeat, n(seed) AS seed, entity_id, partition FROM man""")
def holdout_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.holdout_manifest(observations(spark, sf_dir))


@_query(f"""WITH {_HOLD} SELECT heldout, n(repeat) AS repeat, n(count(*) FILTER (partition = 'train')) AS train, n(count(*) FILTER (partition = 'validation')) AS validation, n(count(*) FILTER (partition = 'test')) AS test, n(count(DISTINCT entity_id)) AS entities FROM man GROUP BY heldout, repeat""")
def holdout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = splits.holdout_manifest(observations(spark, sf_dir))
    return m.groupBy("heldout", "repeat").agg(*[F.count_if(F.col("partition") == p).alias(p) for p in ("train", "validation", "test")], F.count_distinct("entity_id").alias("entities"))


# ---- errors, tasks and metrics


@_query(f"""WITH {_PRED} SELECT run_id, entity_id, d(residual) AS residual, d(e) AS absolute_error, d(e * e) AS squared_error, d(predicted - 1.96 * sigma) AS lower_95, d(predicted + 1.96 * sigma) AS upper_95 FROM lab""")
def residual_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = metrics.interval(residuals.with_residuals(predictions(spark, sf_dir)))
    return df.select("run_id", "entity_id", "residual", "absolute_error", "squared_error", "lower_95", "upper_95")


@_query(f"""WITH {_PRED} SELECT run_id, entity_id, n((e > 0.5)::INT) AS q_abs_error_gt_0p5, n((e > 1)::INT) AS q_abs_error_gt_1p0, n((e > 2)::INT) AS q_abs_error_gt_2p0, CASE WHEN residual > 0 THEN 'underprediction' WHEN residual < 0 THEN 'overprediction' ELSE 'exact' END AS error_direction FROM lab""")
def failure_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = residuals.failure_labels(residuals.with_residuals(predictions(spark, sf_dir)))
    return df.select("run_id", "entity_id", "q_abs_error_gt_0p5", "q_abs_error_gt_1p0", "q_abs_error_gt_2p0", "error_direction")


@_query(f"""WITH {_PRED} SELECT model, CASE WHEN e < 0.5 THEN '0.0-<0.5' WHEN e < 1 THEN '0.5-<1.0' WHEN e < 2 THEN '1.0-<2.0' ELSE '>=2.0' END AS absolute_error_bin, n(count(*)) AS n FROM lab GROUP BY ALL""")
def error_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = residuals.failure_labels(residuals.with_residuals(predictions(spark, sf_dir)))
    return df.groupBy("model", "absolute_error_bin").agg(F.count("*").alias("n"))


_RUN_COLUMNS = "d(mean_residual) AS mean_residual, d(residual_sd) AS residual_sd, d(rmse) AS rmse, d(mae) AS mae, d(median_error) AS median_error, d(p90_error) AS p90_error, d(p95_error) AS p95_error, d(max_error) AS max_error, d(underprediction_rate) AS underprediction_rate, d(overprediction_rate) AS overprediction_rate, d(r05) AS failure_rate_gt_0p5, d(r10) AS failure_rate_gt_1p0, d(r20) AS failure_rate_gt_2p0"


@_query(f"""WITH {_RUNS} SELECT run_id, model, feature_type, strategy, n(repeat) AS repeat, n(n) AS n, {_RUN_COLUMNS} FROM runs""")
def run_failure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir)


@_query(f"""WITH {_RUNS} SELECT strategy, feature_type, model, n(count(DISTINCT repeat)) AS repeats, n(sum(n)) AS n, d(avg(rmse)) AS mean_rmse, d(stddev_samp(rmse)) AS sd_rmse, d(avg(mae)) AS mean_mae, d(avg(median_error)) AS mean_median_error, d(avg(r10)) AS mean_failure_rate, d(stddev_samp(r10)) AS sd_failure_rate FROM runs GROUP BY strategy, feature_type, model""")
def group_failure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residuals.group_summary(_runs(spark, sf_dir))


@_query(f"""WITH {_PRED} SELECT entity_id, n(count(*)) AS evaluations, n(count(DISTINCT strategy || '_r' || repeat)) AS tasks, n(count(DISTINCT model)) AS models, n(count(DISTINCT feature_type)) AS feature_types, d(avg(residual)) AS mean_residual, d(avg(e)) AS mean_error, d(median(e)) AS median_error, d(quantile_cont(e, 0.9)) AS p90_error, d(max(e)) AS max_error,
    d(avg((e > 0.5)::INT)) AS failure_rate_gt_0p5, d(avg((e > 1)::INT)) AS failure_rate_gt_1p0, d(avg((e > 2)::INT)) AS failure_rate_gt_2p0 FROM lab WHERE model <> 'dummy' GROUP BY entity_id""")
def entity_failure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residuals.entity_summary(residuals.failure_labels(residuals.with_residuals(predictions(spark, sf_dir))))


_DESC = "(SELECT entity_id, n_with_props::DOUBLE AS props, value_sd AS spread FROM targets)"
_TASK = f"""{_SPLIT}, j AS (SELECT p.partition <> 'test' AS fit, t.* FROM parts p JOIN targets t USING (entity_id)), gs AS (SELECT grp, count(*) FILTER (fit) AS f, count(*) FILTER (NOT fit) AS t FROM j GROUP BY grp)"""


@_query(f"""WITH {_TASK} SELECT 'random' AS strategy, n(1) AS repeat, n(13) AS seed, n(count(*) FILTER (fit)) AS x_fit_entities, n(count(*) FILTER (NOT fit)) AS x_test_entities, n(count(DISTINCT grp) FILTER (fit)) AS x_fit_groups, n(count(DISTINCT grp) FILTER (NOT fit)) AS x_test_groups,
    d(avg(target) FILTER (fit)) AS x_fit_target_mean, d(stddev_samp(target) FILTER (fit)) AS x_fit_target_sd, d(median(target) FILTER (fit)) AS x_fit_target_median, d(quantile_cont(target, 0.75) FILTER (fit) - quantile_cont(target, 0.25) FILTER (fit)) AS x_fit_target_iqr,
    d(avg((reliability = 'single_observation')::INT) FILTER (fit)) AS x_fit_single_observation_fraction, d(avg(n_observations) FILTER (fit)) AS x_fit_mean_observations, d(avg((n_sources > 1)::INT) FILTER (fit)) AS x_fit_multiple_source_fraction,
    d((SELECT sum(CASE WHEN f = 0 THEN t ELSE 0 END)::DOUBLE / sum(t) FROM gs)) AS x_test_unseen_group_fraction FROM j""")
def task_meta_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, _ = written(_targets(spark, sf_dir), "targets")
    a = splits.random_partitions(t, 13).join(t.select("entity_id", "grp"), "entity_id").withColumns({"strategy": F.lit("random"), "repeat": F.lit(1), "seed": F.lit(13), "max_similarity": F.lit(None).cast("double")})
    out = tasks.task_features(a, t, t.select("entity_id", F.col("n_with_props").cast("double").alias("props")), ("props",))
    names = ["entities", "groups", "target_mean", "target_sd", "target_median", "target_iqr", "single_observation_fraction", "mean_observations", "multiple_source_fraction"]
    return out.select("strategy", "repeat", "seed", *[f"x_fit_{n}" for n in names], "x_test_entities", "x_test_groups", "x_test_unseen_group_fraction")


@_query(f"""WITH {_TASK}, a AS (SELECT avg(n_with_props) FILTER (NOT fit) AS mt, avg(n_with_props) FILTER (fit) AS mf, stddev_samp(n_with_props) FILTER (fit) AS sf FROM j) SELECT d(mf) AS x_fit_props_mean, d(mt) AS x_test_props_mean, d(CASE WHEN sf > 0 THEN (mt - mf) / sf END) AS x_shift_props_smd FROM a""")
def smd_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, _ = written(_targets(spark, sf_dir), "targets")
    a = splits.random_partitions(t, 13).join(t.select("entity_id", "grp"), "entity_id").withColumns({"strategy": F.lit("random"), "repeat": F.lit(1), "seed": F.lit(13), "max_similarity": F.lit(None).cast("double")})
    return tasks.task_features(a, t, t.select("entity_id", F.col("n_with_props").cast("double").alias("props")), ("props",)).select("x_fit_props_mean", "x_test_props_mean", "x_shift_props_smd")


@_query(f"""WITH {_SEL} SELECT run_id, task_id, heldout, model AS x_model, feature_type AS x_feature_type, d(vr) AS x_validation_rmse, d(rmse) AS y_rmse, TRUE AS selectable, d(regret) AS y_regret, n(rk) AS y_rank, n((rk <= 3)::INT) AS y_top, n((regret <= 0.1)::INT) AS y_near_best FROM cand""")
def rank_regret_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir)


@_query("""SELECT event_id, props->>'$.k' AS x_hp_k FROM events""")
def hyperparameter_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props")
    return tasks.json_columns(e, "props", tasks.json_keys(e, "props")).drop("props")


@_query(f"""WITH {_RUNS}, x AS (SELECT *, strategy || '_r' || repeat AS task_id FROM runs), y AS (SELECT run_id, rmse - min(rmse) OVER (PARTITION BY task_id) AS g, rank() OVER (PARTITION BY task_id ORDER BY rmse) AS k FROM x WHERE model <> 'dummy')
    SELECT run_id, task_id, model AS x_model, CASE model WHEN 'dummy' THEN 'baseline' ELSE 'neighbours' END AS x_model_class, feature_type AS x_feature_type, d(rmse) AS y_rmse, d(g) AS y_regret, d(k) AS y_rank, d((k <= 3)::INT) AS y_top, d((g <= 0.1)::INT) AS y_near_best, n(x_n) AS x_test_entities
    FROM (SELECT *, n AS x_n FROM x) LEFT JOIN y USING (run_id)""")
def meta_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    results = runs.select("run_id", "model", "feature_type", "strategy", "repeat", F.lit(0).alias("seed"))
    outcomes = runs.select("run_id", F.col("rmse").alias("y_rmse"))
    per_task = runs.groupBy("strategy", "repeat").agg(F.max("n").alias("x_test_entities")).select("strategy", "repeat", F.lit(0).alias("seed"), "x_test_entities", F.concat_ws("_r", "strategy", F.col("repeat").cast("string")).alias("task_id"))
    made = unify.by_role(tasks.meta_table(results, outcomes, per_task), ["run_id", "task_id"])
    return made.withColumns({c: F.col(c).cast("double") for c in ("y_rank", "y_top", "y_near_best")})  # with nulls: doubles compare alike everywhere


_RANKS = "SELECT *, rank() OVER (PARTITION BY run_id ORDER BY truth) + (count(*) OVER (PARTITION BY run_id, truth) - 1) / 2 AS rt, rank() OVER (PARTITION BY run_id ORDER BY predicted) + (count(*) OVER (PARTITION BY run_id, predicted) - 1) / 2 AS rp FROM lab"


@_query(f"""WITH {_PRED}, k AS ({_RANKS}) SELECT run_id, n(count(*)) AS n, d(sqrt(avg(e * e))) AS rmse, d(avg(e)) AS mae, d(1 - sum(e * e) / (var_pop(truth) * count(*))) AS r2, d(CASE WHEN count(DISTINCT truth) > 1 AND count(DISTINCT predicted) > 1 THEN corr(rt, rp) END) AS spearman FROM k GROUP BY run_id""")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.regression_metrics(predictions(spark, sf_dir), ["run_id"])


@_query(f"""WITH {_PRED}, k AS ({_RANKS}) SELECT run_id, d(corr(rt, rp)) AS spearman FROM k WHERE model <> 'dummy' GROUP BY run_id""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.regression_metrics(predictions(spark, sf_dir).where("model <> 'dummy'"), ["run_id"]).select("run_id", "spearman")


@_query(f"""WITH {_SCORES}, r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS k FROM sc) SELECT 'length' AS model, n(count(*)) AS n, n(sum(label)) AS positives, d((sum(k) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label)))) AS roc_auc FROM r""")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.classification_metrics(_scores(spark, sf_dir), ["model"]).select("model", "n", "positives", "roc_auc")


@_query(f"""WITH {_SCORES}, g AS (SELECT p, sum(label) AS pos, count(*) AS k FROM sc GROUP BY p), c AS (SELECT pos, sum(pos) OVER (ORDER BY p DESC) / sum(k) OVER (ORDER BY p DESC) AS prec FROM g) SELECT 'length' AS model, d(sum(pos * prec) / sum(pos)) AS average_precision FROM c""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.classification_metrics(_scores(spark, sf_dir), ["model"]).select("model", "average_precision")


_CLIP = "least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16)"


@_query(f"""WITH {_SCORES} SELECT model, d(avg((p - label) ** 2)) AS brier, d(avg(-CASE WHEN label = 1 THEN ln({_CLIP}) ELSE ln(1 - {_CLIP}) END)) AS log_loss FROM sc GROUP BY model""")
def brier_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.classification_metrics(_scores(spark, sf_dir), ["model"]).select("model", "brier", "log_loss")


@_query(f"""WITH {_SCORES}, s2 AS (SELECT source, label, p FROM sc UNION ALL SELECT 'ALL', label, p FROM sc), r AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY p) + (count(*) OVER (PARTITION BY source, p) - 1) / 2 AS k FROM s2)
    SELECT source, n(count(*)) AS n, n(sum(label)) AS positives, d(CASE WHEN sum(label) BETWEEN 1 AND count(*) - 1 THEN (sum(k) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) END) AS roc_auc, d(avg((p - label) ** 2)) AS brier FROM r GROUP BY source""")
def discrimination_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.discrimination(_scores(spark, sf_dir)).select("source", "n", "positives", "roc_auc", "brier")


@_query(f"""WITH {_PRED} SELECT run_id, d(avg(ln(greatest(sigma, 1e-12)) + 0.5 * ln(2 * pi()) + 0.5 * ((truth - predicted) / greatest(sigma, 1e-12)) ** 2)) AS nll, d(avg(sigma)) AS mean_sigma, d(avg((abs(truth - predicted) / greatest(sigma, 1e-12) <= 1.96)::INT)) AS coverage_95 FROM lab GROUP BY run_id""")
def gaussian_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.gaussian_nll(predictions(spark, sf_dir), ["run_id"])


# ---- selection and uncertainty


@_query(f"""WITH {_SEL} SELECT selector, heldout, task_id, run_id, model AS x_model, d(rmse) AS y_rmse, d(regret) AS y_regret FROM sel""")
def select_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir).select("selector", "heldout", "task_id", "run_id", "x_model", "y_rmse", "y_regret")


_SUMMARY = "n(count(DISTINCT task_id)) AS tasks, d(avg(rmse)) AS mean_rmse, d(avg(regret)) AS mean_regret, d(median(regret)) AS median_regret, d(avg((rk <= 3)::INT)) AS top_rate, d(avg((regret <= 0.1)::INT)) AS near_best_rate"


@_query(f"""WITH {_SEL} SELECT selector, {_SUMMARY} FROM sel GROUP BY selector""")
def selection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.selection_summary(_selected(spark, sf_dir))


@_query(f"""WITH {_SEL} SELECT coalesce(heldout, 'ALL') AS heldout, selector, {_SUMMARY} FROM sel GROUP BY GROUPING SETS ((selector), (heldout, selector))""")
def selection_fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.selection_grains(_selected(spark, sf_dir))


@_query(f"""WITH {_SEL} SELECT a.heldout, a.task_id, d(a.regret - b.regret) AS difference FROM sel a JOIN sel b ON a.task_id = b.task_id AND a.selector = 'validation_rmse' AND b.selector = 'fixed_group'""")
def paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.paired(_selected(spark, sf_dir), "validation_rmse", "fixed_group", "y_regret")


def _boot(source: str, keys: str, iterations: int) -> str:
    k = f"{keys}, " if keys else ""
    on = " AND ".join(["t._k = c._k", *([f"t.{keys} = c.{keys}"] if keys else [])])
    part = f"PARTITION BY {keys} " if keys else ""
    return f"""cl AS ({source}), cn AS (SELECT *, row_number() OVER ({part}ORDER BY cluster) - 1 AS _k, count(*) OVER ({part}) AS _n FROM cl),
    dr AS (SELECT {k}i AS iteration, ('0x' || substr(md5('7:' || i || ':' || _k), 1, 13))::BIGINT % _n AS _k FROM cn, range({iterations}) AS r(i)),
    bm AS (SELECT t.*, c.* EXCLUDE (_k, _n, cluster{', ' + keys if keys else ''}) FROM dr t JOIN cn c ON {on})"""


@_query(f"""WITH {_SEL}, {_boot('SELECT selector, heldout AS cluster, sum(regret) AS s, count(regret) AS c FROM sel GROUP BY selector, heldout', 'selector', 2000)}, mm AS (SELECT selector, iteration, sum(s) / sum(c) AS m FROM bm GROUP BY selector, iteration)
    SELECT selector, d((SELECT sum(s) / sum(c) FROM cl WHERE cl.selector = mm.selector)) AS estimate, n((SELECT count(*) FROM cl WHERE cl.selector = mm.selector)) AS clusters, d(quantile_cont(m, 0.025)) AS lower_95, d(quantile_cont(m, 0.975)) AS upper_95 FROM mm GROUP BY selector""")
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap.cluster_bootstrap(_selected(spark, sf_dir), ["selector"], "heldout", "y_regret", 2000, 7)


@_query(f"""WITH {_SEL}, df AS (SELECT a.heldout, a.regret - b.regret AS x FROM sel a JOIN sel b ON a.task_id = b.task_id AND a.selector = 'validation_rmse' AND b.selector = 'fixed_group'), {_boot('SELECT heldout AS cluster, avg(x) AS m, sum(x) AS s, count(x) AS c FROM df GROUP BY heldout', '', 2000)}, mm AS (SELECT iteration, avg(m) AS b FROM bm GROUP BY iteration)
    SELECT 'validation_rmse' AS selector, d((SELECT avg(x) FROM df)) AS paired_difference, n((SELECT count(*) FROM cl)) AS clusters, d(quantile_cont(b, 0.025)) AS lower_95, d(quantile_cont(b, 0.975)) AS upper_95, d(avg((b < -1e-12)::INT)) AS probability_better FROM mm""")
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.paired(_selected(spark, sf_dir), "validation_rmse", "fixed_group", "y_regret").withColumn("selector", F.lit("validation_rmse"))
    return bootstrap.paired_bootstrap(rows, ["selector"], "heldout", iterations=2000, seed=7)


@_query(f"""WITH {_SEL} SELECT fold, n(count(*)) AS n, n(count(*) FILTER (heldout = fold)) AS test FROM cand, (SELECT DISTINCT heldout AS fold FROM cand) GROUP BY fold""")
def source_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.source_folds(_candidates(spark, sf_dir)).groupBy("fold").agg(F.count("*").alias("n"), F.count_if("is_test").alias("test"))


# ---- reports


_LINE = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()


@_query(" UNION ALL ".join(f"SELECT '{c}' AS feature, n(count({c})) AS non_null, d(1 - count({c}) / count(*)) AS missing_share, n(count(DISTINCT {c})) AS distinct_values, '{'categorical' if c in ('l_returnflag', 'l_linestatus') else 'numeric'}' AS kind FROM lineitem" for c in _LINE))
def feature_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.feature_audit(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), _LINE)


@_query(f"""WITH {_BITS} SELECT n(count(*)) AS n, n(sum(len(bits))) AS set_bits, d(sum(len(bits)) / (count(*) * 64)) AS density FROM vb""")
def bit_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.bit_density(bits(spark, sf_dir), 64)


@_query(f"""WITH {_TARGETS} SELECT reliability, n(count(*)) AS n, sha256(string_agg(entity_id, chr(10) ORDER BY entity_id)) AS digest FROM targets GROUP BY reliability""")
def id_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.id_digest(_targets(spark, sf_dir), "entity_id", ["reliability"])


#: The driver's tables and the number of their columns.
TABLES = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6, "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4}


@_query(" UNION ALL ".join(f"""SELECT '{t}' AS "table", n(count(*)) AS n, n({k}) AS columns FROM {t}""" for t, k in TABLES.items()))
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.table_counts({t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES})


@_query("""SELECT vec_id AS entity_id, d(0.16 - 1.5 * embedding[1]::DOUBLE - 0.01 * embedding[2]::DOUBLE + 0.5 * embedding[3]::DOUBLE - 1.5 * embedding[4]::DOUBLE) AS predicted FROM embeddings""")
def fixed_equation(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: F.element_at("embedding", k).cast("double")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("entity_id"), esol(at(1), at(2), at(3), at(4)).alias("predicted"))


@_query(f"""WITH {_NEAR}, c AS (SELECT query, candidate, round(i / sqrt(nq * nt), 12) AS cosine FROM (SELECT q.entity_id AS query, t.entity_id AS candidate, count(*)::DOUBLE AS i, any_value(q.nb) AS nq, any_value(t.nb) AS nt FROM q JOIN t ON q.bit = t.bit AND q.entity_id <> t.entity_id GROUP BY q.entity_id, t.entity_id)),
    k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, candidate) AS p FROM c), w AS (SELECT query, 1 / greatest(1 - cosine, 1e-9) AS w, target FROM k JOIN vb ON k.candidate = vb.entity_id WHERE p <= 5)
    SELECT query AS entity_id, d(sum(w * target) / sum(w)) AS predicted FROM w GROUP BY query""")
def knn_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugelake.models.neighbours import knn_predict

    queries, train = _two_sets(spark, sf_dir)
    return knn_predict(queries, train, k=5, others=True)


@_query(f"""WITH {_OBS} SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, source, n(count(*)) AS n, n(count(value)) AS finite, d(sum(value)) AS total, d(min(value)) AS least, d(max(value)) AS most FROM obs GROUP BY ALL""")
def source_rollup_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = source_rollup(observations(spark, sf_dir))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@_query()
def grid_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugelake.models.grid import run_grid

    b = bits(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("entity_id"), "embedding"), "entity_id")
    frame = b.select("entity_id", "target", *[F.element_at("embedding", k).cast("double").alias(f"f{k}") for k in range(2, 10)])
    parts = splits.random_partitions(b, 13)
    return run_grid(frame.join(parts, "entity_id"), [f"f{k}" for k in range(2, 10)], ["dummy", "ridge", "elastic_net"], "embedding", "random", 1, 13)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from gaugelake.plans import studies  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from gaugelake.plans import studies  # noqa: F401

    return dict(_SQL)
