"""More of the audit's queries: hold-out tasks with rebuilt targets, task features, experiment grids, meta models and harmonised sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake.models import experiments, linear, meta
from gaugelake.models.regressors import DESCRIPTORS, candidates
from gaugelake.operators import checks, holdouts, reports, selection, splits, tasks
from gaugelake.operators.checks import union
from gaugelake.plans.audit import _BINNED, _BITS, _LOW, _OBS, _SEL, _SQL, _SUMMARY, _candidates, _query, _stratified, bits, observations
from gaugelake.sources.harmonise import COLUMNS, TYPES, harmonise

# ---- hold-out tasks

_SEEDS = "(VALUES (1, 13), (2, 37), (3, 73), (4, 101), (5, 137)) AS t(repeat, seed)"
_SIDES = f"""{_OBS}, nm AS (SELECT DISTINCT source AS heldout FROM obs), ho AS (
    SELECT source AS heldout, 'test' AS side, obs.* FROM obs UNION ALL
    SELECT heldout, 'fit', obs.* FROM obs, nm WHERE source <> heldout AND NOT EXISTS (SELECT 1 FROM obs AS t WHERE t.source = heldout AND t.entity_id = obs.entity_id)
), ha AS (
    SELECT heldout, side, entity_id, min_by(grp, observation_id) AS grp, count(*) AS n_observations, count(DISTINCT source) AS n_sources, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, median(value) AS target,
        max(value) - min(value) AS value_range FROM ho WHERE value IS NOT NULL AND isfinite(value) GROUP BY heldout, side, entity_id
), ht AS (
    SELECT *, value_range > 1 AS conflict, target < -15 OR target > 2.5 AS outside_review, NOT (value_range > 1 OR target < -15 OR target > 2.5) AS "primary",
        CASE side WHEN 'test' THEN 'heldout_source_only' ELSE 'nonheldout_sources_only' END AS origin,
        CASE WHEN n_observations = 1 THEN 'single_observation' WHEN value_range <= 0.5 THEN 'consistent' WHEN value_range <= 1 THEN 'moderate' ELSE 'conflict' END AS reliability FROM ha
)"""
_HOLDOUT = f"""{_SIDES}, sd AS (SELECT * FROM {_SEEDS}), fr AS (
    SELECT *, rank() OVER (PARTITION BY heldout ORDER BY target) + (count(*) OVER (PARTITION BY heldout, target) - 1) / 2 AS rk, count(*) OVER (PARTITION BY heldout) AS n FROM ht WHERE side = 'fit' AND "primary"
), fb AS (
    SELECT *, least(floor((rk - 0.5) * 10 / n), 9) AS bin FROM fr
), fk AS (
    SELECT heldout, bin, k, sum(k) OVER (PARTITION BY heldout ORDER BY bin) AS upto FROM (SELECT heldout, bin, count(*) AS k FROM fb GROUP BY heldout, bin)
), fp AS (
    SELECT fb.heldout, repeat, seed, entity_id, row_number() OVER (PARTITION BY fb.heldout, repeat, fb.bin ORDER BY md5(seed || ':' || entity_id)) <= round_even(0.9::DOUBLE * upto, 0) - round_even(0.9::DOUBLE * (upto - k), 0) AS train
    FROM fb JOIN fk ON fb.heldout = fk.heldout AND fb.bin = fk.bin, sd
), hm AS (
    SELECT p.heldout, repeat, seed, p.entity_id, CASE WHEN train THEN 'train' ELSE 'validation' END AS partition, h.* EXCLUDE (heldout, entity_id) FROM fp AS p JOIN ht AS h ON p.heldout = h.heldout AND p.entity_id = h.entity_id AND h.side = 'fit'
    UNION ALL SELECT heldout, repeat, seed, entity_id, 'test', ht.* EXCLUDE (heldout, entity_id) FROM ht, sd WHERE side = 'test' AND "primary"
), mb AS (
    SELECT DISTINCT entity_id, hour(ts) * 12 + minute(ts) // 5 AS bit FROM obs
), mn AS (
    SELECT entity_id, bit, count(*) OVER (PARTITION BY entity_id) AS nb FROM mb
), hb AS (
    SELECT heldout, repeat, entity_id, partition, bit, nb FROM hm JOIN mn USING (entity_id)
), hs AS (
    SELECT heldout, repeat, entity_id, max(i / (nq + nt - i)) AS s FROM (
        SELECT q.heldout, q.repeat, q.entity_id, t.entity_id AS c, count(*)::DOUBLE AS i, any_value(q.nb) AS nq, any_value(t.nb) AS nt FROM hb AS q JOIN hb AS t
        ON q.heldout = t.heldout AND q.repeat = t.repeat AND q.bit = t.bit AND q.partition <> 'train' AND t.partition = 'train' GROUP BY q.heldout, q.repeat, q.entity_id, t.entity_id) GROUP BY heldout, repeat, entity_id
), hx AS (
    SELECT hm.*, CASE WHEN partition <> 'train' THEN coalesce(s, 0) END AS max_similarity, 'source_holdout_' || hm.heldout AS strategy, 'source_holdout_' || hm.heldout || '_r' || hm.repeat AS task_id
    FROM hm LEFT JOIN hs ON hm.heldout = hs.heldout AND hm.repeat = hs.repeat AND hm.entity_id = hs.entity_id
)"""


def _minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, bits): the five-minute marks of the day at which an entity was observed."""
    return observations(spark, sf_dir).groupBy("entity_id").agg(F.collect_set((F.hour("ts") * 12 + F.floor(F.minute("ts") / 5)).cast("int")).alias("bits"))


def _holdouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdouts.source_holdout_tasks(observations(spark, sf_dir), _minutes(spark, sf_dir), group="grp")


@_query(f"""WITH {_HOLDOUT} SELECT task_id, strategy, heldout, n(repeat) AS repeat, n(seed) AS seed, entity_id, partition, grp::VARCHAR AS grp, d(max_similarity) AS max_similarity, d(target) AS target, reliability, n(n_observations) AS n_observations, n(n_sources) AS n_sources,
    sources, d(value_range) AS value_range, "primary", origin FROM hx""")
def source_holdout_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _holdouts(spark, sf_dir)


@_query(f"""WITH {_HOLDOUT}, gu AS (SELECT task_id, grp, count(*) FILTER (partition <> 'test') AS f, count(*) FILTER (partition = 'test') AS t FROM hx GROUP BY task_id, grp), un AS (SELECT task_id, sum(CASE WHEN f = 0 THEN t ELSE 0 END)::DOUBLE / sum(t) AS u FROM gu GROUP BY task_id)
    SELECT task_id, heldout, n(repeat) AS repeat, n(seed) AS seed, n(count(*) FILTER (partition = 'train')) AS train_entities, n(count(*) FILTER (partition = 'validation')) AS validation_entities, n(count(*) FILTER (partition = 'test')) AS test_entities,
    n(count(*) FILTER (partition <> 'test')) AS fit_entities, d(avg(target) FILTER (partition = 'test')) AS test_target_mean, d(stddev_samp(target) FILTER (partition = 'test')) AS test_target_sd, d(avg(max_similarity) FILTER (partition = 'test')) AS test_similarity_mean,
    d(median(max_similarity) FILTER (partition = 'test')) AS test_similarity_median, d(quantile_cont(max_similarity, 0.1) FILTER (partition = 'test')) AS test_similarity_p10, d(min(max_similarity) FILTER (partition = 'test')) AS test_similarity_min,
    d(any_value(u)) AS test_unseen_group_fraction FROM hx JOIN un USING (task_id) GROUP BY task_id, heldout, repeat, seed""")
def source_holdout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdouts.holdout_summary(_holdouts(spark, sf_dir))


@_query(f"""WITH {_SIDES}, rw AS (SELECT source AS heldout, count(*) AS r, count(DISTINCT entity_id) AS e FROM obs GROUP BY source) SELECT heldout, n(any_value(r)) AS heldout_rows, n(any_value(e)) AS heldout_entities, n(count(*) FILTER (side = 'test')) AS test_targets_before_filter,
    n(count(*) FILTER (side = 'test' AND "primary")) AS test_targets, n(count(*) FILTER (side = 'test' AND conflict)) AS test_targets_in_conflict, n(count(*) FILTER (side = 'test' AND outside_review)) AS test_targets_outside_review,
    n(count(*) FILTER (side = 'fit')) AS fit_targets_before_filter, n(count(*) FILTER (side = 'fit' AND "primary")) AS fit_targets FROM ht JOIN rw USING (heldout) GROUP BY heldout""")
def holdout_target_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    return holdouts.target_audit(obs, holdouts.source_targets(obs))


# ---- task features with similarity

_SPLIT_SEEDS = tuple(enumerate(splits.SEEDS, 1))
_LOW_SPLIT = "SELECT entity_id, 'train' AS partition FROM s1 WHERE chosen UNION ALL SELECT entity_id, CASE WHEN p <= tenth THEN 'test' WHEN p <= 2 * tenth THEN 'validation' ELSE 'train' END FROM o"


def _of_seed(strategy: str, seed: int) -> str:
    """The assignments of this seed; the constants they come from are those of seed 13."""
    if strategy == "low_similarity":
        return f"WITH {_LOW.replace(chr(39) + '13:' + chr(39), chr(39) + f'{seed}:' + chr(39))} {_LOW_SPLIT}"
    if strategy == "group":
        return _SQL["scaffold_split"].replace("'13:'", f"'{seed}:'")
    first, second = _stratified("", "bn", "0.8::DOUBLE", seed, "s1"), _stratified("", "r1", "0.5::DOUBLE", seed + 1, "s2")
    return f"""WITH {_BINNED.format(src=_BITS, t='vb')}, {first}, r1 AS (SELECT entity_id, bin FROM s1 WHERE NOT chosen), {second}
        SELECT entity_id, 'train' AS partition FROM s1 WHERE chosen UNION ALL SELECT entity_id, CASE WHEN chosen THEN 'validation' ELSE 'test' END FROM s2"""


_EVERY = " UNION ALL ".join(f"SELECT '{strategy}' AS strategy, {r} AS repeat, {seed} AS seed, entity_id, partition FROM ({_of_seed(strategy, seed)})" for strategy in splits.STRATEGIES for r, seed in _SPLIT_SEEDS)
_DESCRIBED = f"""lo AS ({_EVERY}), {_BITS}, pa AS (
    SELECT q.entity_id, t.entity_id AS c, count(*)::DOUBLE / (any_value(q.nb) + any_value(t.nb) - count(*)) AS s FROM post AS q JOIN post AS t ON q.bit = t.bit GROUP BY q.entity_id, t.entity_id
), ls AS (
    SELECT q.strategy, q.repeat, q.entity_id, max(s) AS s FROM lo AS q JOIN pa ON q.entity_id = pa.entity_id AND q.partition <> 'train' JOIN lo AS t ON t.entity_id = pa.c AND t.partition = 'train' AND q.strategy = t.strategy AND q.repeat = t.repeat
    GROUP BY q.strategy, q.repeat, q.entity_id
), tv AS (
    SELECT lo.*, CASE WHEN partition <> 'train' THEN coalesce(s, 0) END AS sim, partition <> 'test' AS fit, embedding[1]::DOUBLE AS target, embedding[2]::DOUBLE AS mass, embedding[3]::DOUBLE AS area, label::VARCHAR AS grp, e.vec_id % 3 AS ns, e.vec_id % 4 AS no
    FROM lo JOIN embeddings AS e ON lo.entity_id = e.vec_id LEFT JOIN ls ON lo.strategy = ls.strategy AND lo.repeat = ls.repeat AND lo.entity_id = ls.entity_id
), tg AS (
    SELECT strategy, repeat, sum(CASE WHEN f = 0 THEN t ELSE 0 END)::DOUBLE / sum(t) AS u FROM (SELECT strategy, repeat, grp, count(*) FILTER (fit) AS f, count(*) FILTER (NOT fit) AS t FROM tv GROUP BY strategy, repeat, grp) GROUP BY strategy, repeat
)"""


def _all_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All strategies and seeds of the embeddings' bits."""
    b = bits(spark, sf_dir)
    return splits.split_assignments(b, b)


def _summary_sql(x: str, prefix: str, where: str) -> str:
    made = {"mean": f"avg({x})", "sd": f"stddev_samp({x})", "median": f"median({x})", "q25": f"quantile_cont({x}, 0.25)", "q75": f"quantile_cont({x}, 0.75)", "min": f"min({x})", "max": f"max({x})"}
    return ", ".join(f"d({f} FILTER ({where})) AS {prefix}_{n}" for n, f in made.items())


def _descriptor_sql(name: str) -> str:
    side = {"fit": "fit", "test": "NOT fit"}
    made = [f"d({f}({name}) FILTER ({w})) AS x_{s}_{name}_{n}" for s, w in side.items() for n, f in (("mean", "avg"), ("sd", "stddev_samp"))]
    return ", ".join([*made, f"d((avg({name}) FILTER (NOT fit) - avg({name}) FILTER (fit)) / stddev_samp({name}) FILTER (fit)) AS x_shift_{name}_smd"])


@_query(f"""WITH {_DESCRIBED} SELECT strategy, n(repeat) AS repeat, n(seed) AS seed, strategy || '_r' || repeat AS task_id, n(count(*) FILTER (fit)) AS x_fit_entities, n(count(*) FILTER (NOT fit)) AS x_test_entities, n(count(DISTINCT grp) FILTER (fit)) AS x_fit_groups,
    n(count(DISTINCT grp) FILTER (NOT fit)) AS x_test_groups, {_summary_sql('target', 'x_fit_target', 'fit')}, d(quantile_cont(target, 0.75) FILTER (fit) - quantile_cont(target, 0.25) FILTER (fit)) AS x_fit_target_iqr,
    d(avg((no = 1)::INT) FILTER (fit)) AS x_fit_single_observation_fraction, d(avg(no) FILTER (fit)) AS x_fit_mean_observations, d(avg((ns > 1)::INT) FILTER (fit)) AS x_fit_multiple_source_fraction, {_summary_sql('sim', 'x_test_similarity', 'NOT fit')},
    d(quantile_cont(sim, 0.1) FILTER (NOT fit)) AS x_test_similarity_p10, {", ".join(f"d(avg((sim < {b})::INT) FILTER (NOT fit)) AS x_test_similarity_below_{str(b).replace('.', 'p')}" for b in (0.3, 0.5, 0.7))},
    {_descriptor_sql('mass')}, {_descriptor_sql('area')}, d(any_value(u)) AS x_test_unseen_group_fraction FROM tv JOIN tg USING (strategy, repeat) GROUP BY strategy, repeat, seed""")
def task_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = lambda k: F.element_at("embedding", k).cast("double")
    no = F.col("vec_id") % 4
    targets = e.select(F.col("vec_id").alias("entity_id"), at(1).alias("target"), F.when(no == 1, "single_observation").otherwise("consistent").alias("reliability"), no.alias("n_observations"), (F.col("vec_id") % 3).alias("n_sources"))
    return tasks.task_features(_all_splits(spark, sf_dir), targets, e.select(F.col("vec_id").alias("entity_id"), at(2).alias("mass"), at(3).alias("area")), ("mass", "area"), strict=True)


@_query(f"""WITH {_DESCRIBED}, md AS (SELECT strategy, repeat, median(sim) AS m FROM tv WHERE partition = 'test' GROUP BY strategy, repeat) SELECT strategy, n(count(DISTINCT repeat)) AS repeats, d(avg(m)) AS mean_of_medians, d(min(m)) AS least_median, d(max(m)) AS greatest_median FROM md GROUP BY strategy""")
def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.split_report(splits.split_quality(_all_splits(spark, sf_dir), bits(spark, sf_dir)))


# ---- experiment grids

_EMBEDDED = f"""{_BINNED.format(src=_BITS, t='vb')}, {_stratified('', 'bn', '0.8::DOUBLE', 13, 's1')}, r1 AS (SELECT entity_id, bin FROM s1 WHERE NOT chosen), {_stratified('', 'r1', '0.5::DOUBLE', 14, 's2')},
    parts AS (SELECT entity_id, 'train' AS partition FROM s1 WHERE chosen UNION ALL SELECT entity_id, CASE WHEN chosen THEN 'validation' ELSE 'test' END FROM s2)"""
_GRID = f"""{_EMBEDDED}, pts AS (SELECT entity_id, partition, embedding[1]::DOUBLE AS y, embedding[2]::DOUBLE AS x1, embedding[3]::DOUBLE AS x2 FROM parts JOIN embeddings ON entity_id = vec_id),
ph AS (SELECT * FROM (VALUES ('tune'), ('test')) AS t(phase)),
fr AS (SELECT phase, pts.* FROM pts, ph WHERE partition = 'train' OR (phase = 'test' AND partition = 'validation')),
sr AS (SELECT phase, pts.* FROM pts, ph WHERE partition = CASE phase WHEN 'tune' THEN 'validation' ELSE 'test' END),
st AS (SELECT phase, count(*) AS n, avg(x1) AS m1, stddev_pop(x1) AS d1, avg(x2) AS m2, stddev_pop(x2) AS d2, avg(y) AS my, median(y) AS med FROM fr GROUP BY phase),
fz AS (SELECT phase, entity_id, y, my, (x1 - m1) / d1 AS z1, (x2 - m2) / d2 AS z2 FROM fr JOIN st USING (phase)),
sz AS (SELECT phase, entity_id, y, my, med, (x1 - m1) / d1 AS z1, (x2 - m2) / d2 AS z2 FROM sr JOIN st USING (phase)),
mo AS (SELECT phase, sum(z1 * z1) AS s11, sum(z2 * z2) AS s22, sum(z1 * z2) AS s12, sum(z1 * (y - my)) AS b1, sum(z2 * (y - my)) AS b2 FROM fz GROUP BY phase),
al AS (SELECT * FROM (VALUES (1, 0.1::DOUBLE), (2, 1.0::DOUBLE), (3, 10.0::DOUBLE), (4, 100.0::DOUBLE)) AS t(candidate, a)),
kn AS (SELECT s.phase, s.entity_id, s.y, f.y AS fy, sqrt((s.z1 - f.z1) ** 2 + (s.z2 - f.z2) ** 2) AS dist FROM sz AS s JOIN fz AS f ON s.phase = f.phase),
kr AS (SELECT *, row_number() OVER (PARTITION BY phase, entity_id ORDER BY dist) AS p FROM kn),
ks AS (SELECT * FROM (VALUES (1, 5), (2, 11), (3, 25)) AS t(candidate, k)),
pr AS (
    SELECT phase, entity_id, y, 'dummy' AS model, candidate, CASE candidate WHEN 1 THEN my ELSE med END AS predicted FROM sz, (VALUES (1), (2)) AS t(candidate)
    UNION ALL SELECT phase, entity_id, y, 'ridge', candidate, my + z1 * ((s22 + a) * b1 - s12 * b2) / ((s11 + a) * (s22 + a) - s12 * s12) + z2 * ((s11 + a) * b2 - s12 * b1) / ((s11 + a) * (s22 + a) - s12 * s12) FROM sz JOIN mo USING (phase), al
    UNION ALL SELECT phase, entity_id, any_value(y), 'knn', candidate, CASE WHEN min(dist) < 1e-12 THEN avg(fy) FILTER (dist < 1e-12) ELSE sum(fy / greatest(dist, 1e-12)) / sum(1 / greatest(dist, 1e-12)) END FROM kr JOIN ks ON p <= k GROUP BY phase, entity_id, candidate
),
ev AS (SELECT model, candidate, sqrt(avg((y - predicted) ** 2)) AS rmse, avg(abs(y - predicted)) AS mae FROM pr WHERE phase = 'tune' GROUP BY model, candidate),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY rmse, mae, candidate) AS place FROM ev) WHERE place = 1),
te AS (SELECT 'random_r1_{DESCRIPTORS}_' || pr.model AS run_id, pr.model, pr.candidate, entity_id, y AS truth, predicted, be.rmse AS validation_rmse, be.mae AS validation_mae FROM pr JOIN be ON pr.model = be.model AND pr.candidate = be.candidate WHERE phase = 'test')"""


def _grid(spark: SparkSession, sf_dir: str, models: tuple[str, ...], places: range) -> experiments.Experiments:
    """Experiments on embeddings: the first component from those at ``places`` (from 1)."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    b = bits(spark, sf_dir)
    features = e.select(F.col("vec_id").alias("entity_id"), *[F.element_at("embedding", k).cast("double").alias(f"f{k}") for k in places])
    assignments = splits.random_partitions(b, 13).withColumns({"strategy": F.lit("random"), "repeat": F.lit(1), "seed": F.lit(13)})
    return experiments.run_experiments(b.select("entity_id", "target"), assignments, {DESCRIPTORS: features}, models)


_CHECKED = ("dummy", "ridge", "knn")


@_query(f"""WITH {_GRID} SELECT run_id, model, entity_id, d(truth) AS truth, d(predicted) AS predicted, d(truth - predicted) AS residual, d(abs(truth - predicted)) AS absolute_error FROM te""")
def experiment_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir, _CHECKED, range(2, 4)).predictions.select("run_id", "model", "entity_id", "truth", "predicted", "residual", "absolute_error")


@_query(f"""WITH {_GRID}, sz2 AS (SELECT count(*) FILTER (partition = 'train') AS a, count(*) FILTER (partition = 'validation') AS v, count(*) FILTER (partition = 'test') AS t FROM parts)
    SELECT run_id, model, n(any_value(a)) AS n_train, n(any_value(v)) AS n_validation, n(any_value(t)) AS n_test, n(2) AS features_after, d(any_value(validation_rmse)) AS validation_rmse, d(any_value(validation_mae)) AS validation_mae,
    d(sqrt(avg((truth - predicted) ** 2))) AS test_rmse, d(avg(abs(truth - predicted))) AS test_mae, d(1 - sum((truth - predicted) ** 2) / (var_pop(truth) * count(*))) AS test_r2 FROM te, sz2 GROUP BY run_id, model""")
def experiment_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("run_id", "model", "n_train", "n_validation", "n_test", "features_after", "validation_rmse", "validation_mae", "test_rmse", "test_mae", "test_r2")
    return _grid(spark, sf_dir, _CHECKED, range(2, 4)).results.select(*names)


@_query(f"""WITH {_GRID} SELECT 'random_r1_{DESCRIPTORS}_' || model AS run_id, n(candidate) AS candidate, d(rmse) AS validation_rmse, d(mae) AS validation_mae FROM ev""")
def experiment_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir, _CHECKED, range(2, 4)).tuning.select("run_id", "candidate", "validation_rmse", "validation_mae")


@_query()
def experiment_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every model but the fixed equation, on all features."""
    models = ("dummy", "ridge", "elastic_net", "random_forest", "extra_trees", "hist_gradient_boosting", "svr", "mlp", "knn", "xgboost", "ngboost")
    return _grid(spark, sf_dir, models, range(2, 65)).results.select("run_id", "model", "n_train", "n_test", "features_after", "best_parameters", "validation_rmse", "test_rmse", "test_mae", "test_r2", "test_spearman", "test_gaussian_nll")


# ---- linear fits of any size

_RANDOM = " UNION ALL ".join(f"SELECT {r} AS repeat, {seed} AS seed, entity_id, partition FROM ({_of_seed('random', seed)})" for r, seed in _SPLIT_SEEDS)
_ALPHAS = ", ".join(f"({k}, 'alpha={c['alpha']}', {c['alpha']}::DOUBLE)" for k, c in enumerate(candidates("ridge"), 1))
_RIDGE = f"""RECURSIVE an AS ({_RANDOM}), ft AS (
    SELECT phase, an.*, embedding[1]::DOUBLE AS y, embedding, partition = 'train' OR (partition = 'validation' AND phase = 'test') AS fit FROM an JOIN embeddings ON vec_id = entity_id, (VALUES ('tune'), ('test')) AS t(phase) WHERE phase = 'test' OR partition <> 'test'
), lg AS (
    SELECT repeat, phase, entity_id, partition, fit, y, unnest(range(2, 65)) AS j, unnest(embedding[2:64])::DOUBLE AS v FROM ft
), sc AS (
    SELECT repeat, phase, j, avg(v) AS m, stddev_pop(v) AS s FROM lg WHERE fit GROUP BY repeat, phase, j
), zz AS (
    SELECT lg.*, CASE WHEN s > 1e-12 THEN (v - m) / s ELSE 0 END AS z FROM lg JOIN sc ON lg.repeat = sc.repeat AND lg.phase = sc.phase AND lg.j = sc.j
), ym AS (
    SELECT repeat, phase, avg(y) AS my FROM ft WHERE fit GROUP BY repeat, phase
), gm AS (
    SELECT a.repeat, a.phase, a.j AS i, b.j AS j, sum(a.z * b.z) AS g FROM zz AS a JOIN zz AS b ON a.repeat = b.repeat AND a.phase = b.phase AND a.entity_id = b.entity_id AND a.fit AND b.fit GROUP BY a.repeat, a.phase, a.j, b.j
    UNION ALL SELECT zz.repeat, zz.phase, j, 65, sum(z * (y - my)) FROM zz JOIN ym ON zz.repeat = ym.repeat AND zz.phase = ym.phase WHERE fit GROUP BY zz.repeat, zz.phase, j
), gj AS (
    SELECT repeat, phase, candidate, parameters, 2 AS k, i, j, g + CASE WHEN i = j THEN alpha ELSE 0 END AS v FROM gm, (VALUES {_ALPHAS}) AS t(candidate, parameters, alpha)
    UNION ALL SELECT repeat, phase, candidate, parameters, k + 1, i, j, CASE WHEN i = k THEN above / corner ELSE v - own * above / corner END FROM (
        SELECT *, max(CASE WHEN i = k THEN v END) OVER (PARTITION BY repeat, phase, candidate, j) AS above, max(CASE WHEN j = k THEN v END) OVER (PARTITION BY repeat, phase, candidate, i) AS own,
            max(CASE WHEN i = k AND j = k THEN v END) OVER (PARTITION BY repeat, phase, candidate) AS corner FROM gj WHERE k <= 64)
), wt AS (
    SELECT repeat, phase, candidate, parameters, i AS j, v AS w FROM gj WHERE k = 65 AND j = 65
), pr AS (
    SELECT zz.repeat, zz.phase, candidate, parameters, entity_id, any_value(y) AS y, any_value(my) + sum(z * w) AS predicted FROM zz JOIN wt ON zz.repeat = wt.repeat AND zz.phase = wt.phase AND zz.j = wt.j JOIN ym ON zz.repeat = ym.repeat AND zz.phase = ym.phase
    WHERE NOT fit GROUP BY zz.repeat, zz.phase, candidate, parameters, entity_id
), ev AS (
    SELECT repeat, phase, candidate, parameters, count(*) AS n, sqrt(avg((y - predicted) ** 2)) AS rmse, avg(abs(y - predicted)) AS mae FROM pr GROUP BY repeat, phase, candidate, parameters
), be AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repeat ORDER BY rmse, mae, candidate) AS p FROM ev WHERE phase = 'tune') WHERE p = 1
)"""


def _linear_frame(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Random splits of all seeds, with the first component as the target and all others as features."""
    e, b = spark.read.parquet(f"{sf_dir}/embeddings.parquet"), bits(spark, sf_dir)
    names = [f"f{k}" for k in range(2, 65)]
    wide = e.select(F.col("vec_id").alias("entity_id"), F.element_at("embedding", 1).cast("double").alias("target"), *[F.element_at("embedding", k).cast("double").alias(f"f{k}") for k in range(2, 65)])
    parts = splits.split_assignments(b, b, ["random"], similar=False).select("repeat", "entity_id", "partition")
    return parts.join(wide, "entity_id"), names


@_query(f"""WITH {_RIDGE} SELECT n(repeat) AS repeat, phase, n(candidate) AS candidate, parameters, n(j) AS feature, d(w) AS weight FROM wt""")
def ridge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge on 63 features, for every seed, both phases and all candidates."""
    frame, names = _linear_frame(spark, sf_dir)
    part = F.col("partition")
    both = frame.withColumn("phase", F.explode(F.when(part == "test", F.array(F.lit("test"))).otherwise(F.array(F.lit("tune"), F.lit("test")))))
    keys = ["repeat", "phase"]
    rows, _ = linear.standardised(both, keys, names, (part == "train") | ((part == "validation") & (F.col("phase") == "test")))
    fits = linear.fit_linear(rows, keys, names, "target", candidates("ridge"))
    return fits.select(*keys, "candidate", "parameters", F.posexplode("weights").alias("feature", "weight")).withColumn("feature", F.col("feature") + 2)


@_query(f"""WITH {_RIDGE} SELECT n(be.repeat) AS repeat, be.parameters AS best_parameters, d(be.rmse) AS validation_rmse, d(be.mae) AS validation_mae, n(ev.n) AS n_test, d(ev.rmse) AS test_rmse, d(ev.mae) AS test_mae
    FROM be JOIN ev ON be.repeat = ev.repeat AND be.candidate = ev.candidate AND ev.phase = 'test'""")
def ridge_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, names = _linear_frame(spark, sf_dir)
    return linear.run_linear(frame, ["repeat"], names, candidates("ridge"))[1]


@_query()
def elastic_net_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, names = _linear_frame(spark, sf_dir)
    return linear.run_linear(frame, ["repeat"], names, candidates("elastic_net"))[1]


# ---- meta models and their selector

_META = f"""{_SEL}, mr AS (SELECT f.heldout, c.model, avg((c.regret <= 0.1)::INT) AS probability FROM cand AS c JOIN (SELECT DISTINCT heldout FROM cand) AS f ON c.heldout <> f.heldout GROUP BY f.heldout, c.model),
ms AS (SELECT * EXCLUDE p FROM (SELECT cand.*, 'meta' AS selector, probability, row_number() OVER (PARTITION BY task_id ORDER BY probability DESC, vr, run_id) AS p FROM cand JOIN mr ON cand.heldout = mr.heldout AND cand.model = mr.model) WHERE p = 1)"""


@_query(f"""WITH {_META} SELECT selector, heldout, task_id, run_id, model AS x_model, d(probability) AS probability, d(rmse) AS y_rmse, d(regret) AS y_regret FROM ms""")
def meta_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = selection.source_rate(_candidates(spark, sf_dir))
    return selection.selected_candidates(rated, {}).where("selector = 'meta'").select("selector", "heldout", "task_id", "run_id", "x_model", "probability", "y_rmse", "y_regret")


@_query(f"""WITH {_META} SELECT selector, {_SUMMARY} FROM ms GROUP BY selector""")
def meta_selection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.selection_summary(selection.selected_candidates(selection.source_rate(_candidates(spark, sf_dir)), {}).where("selector = 'meta'"))


@_query()
def meta_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-source probabilities of the four meta models."""
    scored = meta.out_of_source(_candidates(spark, sf_dir), outcome="y_near_best")
    return scored.select("run_id", "task_id", "heldout", "meta_model", "probability", "probability_lower_95", "probability_upper_95", "y_near_best", "y_regret")


@_query()
def meta_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta.importances(_candidates(spark, sf_dir), outcome="y_near_best")


@_query()
def meta_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = meta.ablations(_candidates(spark, sf_dir), outcome="y_near_best")
    return scored.select("run_id", "task_id", "ablation", "probability", "y_near_best")


# ---- harmonised sources


def _raw(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The driver's tables in the shape of the five raw files."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    s = lambda c: F.col(c).cast("string")
    whole = lambda c: F.round(c).cast("long").cast("string")
    return {
        "AqSolDB": read("part").select(F.col("p_partkey").alias("source_row"), s("p_partkey").alias("ID"), F.col("p_name").alias("Name"), F.col("p_type").alias("SMILES"), F.col("p_brand").alias("InChI"), whole("p_retailprice").alias("Solubility"), s("p_size").alias("SD"), F.col("p_brand").alias("Group")),
        "Delaney": read("supplier").select(F.col("s_suppkey").alias("source_row"), F.col("s_name").alias("Compound ID"), F.concat(F.lit("  "), "s_name", F.lit(" ")).alias("smiles"), whole("s_acctbal").alias("measured log solubility in mols per litre"), s("s_nationkey").alias("ESOL predicted log solubility in mols per litre")),
        "AQUA": read("region").select((F.col("r_regionkey") + 1).alias("source_row"), F.col("r_name").alias("smiles"), s("r_regionkey").alias("logS")),
        "PHYSPROP": read("nation").select((F.col("n_nationkey") + 1).alias("source_row"), F.col("n_name").alias("smiles"), F.when(F.col("n_nationkey") % 2 == 0, "none").otherwise(s("n_nationkey")).alias("logS")),
        "OCHEM": read("customer").select(
            F.col("c_custkey").alias("source_row"), F.col("c_name").alias("SMILES"), F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("E"), s("c_custkey"))).alias("EXTERNALID"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("C"), s("c_custkey"))).alias("CASRN"),
            F.col("c_mktsegment").alias("NAME"), whole("c_acctbal").alias("Water solubility {measured, converted}"), whole("c_acctbal").alias("Water solubility {measured}"), F.lit("-log(mol/L)").alias("UNIT {Water solubility}"), s("c_nationkey").alias("Temperature"), F.lit("C").alias("UNIT {Temperature}"),
        ),
    }


def _harmonised_sql() -> str:
    plain = {"target_original_unit": "'log10(mol/L)'", "conversion_rule": "'identity'", "endpoint_definition": "'not provided in repository'"}
    base = lambda name, file, row, target: {"observation_id": f"printf('{name}:%07d', {row})", "source_dataset": f"'{name}'", "source_file": f"'{file}'", "source_row": f"n({row})", "target_source_column": f"'{target}'"}
    price, balance, customer = "round(p_retailprice)::BIGINT", "round(s_acctbal)::BIGINT", "round(c_acctbal)::BIGINT"
    parts = {
        "part": base("AqSolDB", "AqSolDB.csv", "p_partkey", "Solubility") | plain | {"source_record_id": "p_partkey::VARCHAR", "original_smiles": "p_type", "source_inchi": "p_brand", "molecule_name": "p_name", "log_s": f"d({price})", "target_original_value": f"({price})::VARCHAR", "measurement_sd": "d(p_size)", "source_group": "p_brand"},
        "supplier": base("Delaney", "Delaney.csv", "s_suppkey", "measured log solubility in mols per litre") | plain | {"source_record_id": "s_name", "original_smiles": "s_name", "molecule_name": "s_name", "log_s": f"d({balance})", "target_original_value": f"({balance})::VARCHAR", "endpoint_definition": "'aqueous solubility; repository gives no pH metadata'", "reference_prediction": "d(s_nationkey)"},
        "region": base("AQUA", "aqua_org.csv", "(r_regionkey + 1)", "logS") | plain | {"source_record_id": "printf('AQUA-%07d', r_regionkey + 1)", "original_smiles": "r_name", "log_s": "d(r_regionkey)", "target_original_value": "r_regionkey::VARCHAR"},
        "nation": base("PHYSPROP", "phys_org.csv", "(n_nationkey + 1)", "logS") | plain | {"source_record_id": "printf('PHYSPROP-%07d', n_nationkey + 1)", "original_smiles": "n_name", "log_s": "d(CASE WHEN n_nationkey % 2 = 1 THEN n_nationkey END)", "target_original_value": "CASE WHEN n_nationkey % 2 = 0 THEN 'none' ELSE n_nationkey::VARCHAR END"},
        "customer": base("OCHEM", "ochem_all.csv", "c_custkey", "Water solubility {measured, converted}") | {
            "source_record_id": "CASE WHEN c_custkey % 3 = 1 THEN 'E' || c_custkey WHEN c_custkey % 2 = 0 THEN 'C' || c_custkey ELSE printf('OCHEM-%07d', c_custkey) END", "original_smiles": "c_name", "molecule_name": "c_mktsegment", "casrn": "CASE WHEN c_custkey % 2 = 0 THEN 'C' || c_custkey END",
            "log_s": f"d(-({customer}))", "target_original_value": f"({customer})::VARCHAR", "target_original_unit": "'-log(mol/L)'", "conversion_rule": "'log_s = -1 * converted_minus_log10_molar'", "endpoint_definition": "'water solubility; intrinsic/apparent status not provided'",
            "temperature": "d(c_nationkey)", "temperature_unit": "'C'",
        },
    }
    kind = {"string": "VARCHAR", "long": "BIGINT", "double": "DOUBLE"}
    empty = {c: f"NULL::{kind[TYPES.get(c, 'string')]}" for c in COLUMNS}
    return " UNION ALL ".join(f"SELECT {', '.join(f'{(empty | made)[c]} AS {c}' for c in COLUMNS)} FROM {table}" for table, made in parts.items())


@_query(_harmonised_sql())
def harmonised_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union([harmonise(df, name) for name, df in _raw(spark, sf_dir).items()])


# ---- reports and checks

_DAYS = """WITH e AS (SELECT event_type, user_id, ts::DATE AS day, value FROM events WHERE event_type IS NOT NULL), dd AS (
    SELECT event_type, day, count(*) AS k, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS p FROM e GROUP BY event_type, day)"""


@_query(f"""{_DAYS}
    SELECT event_type AS report, 'events.n' AS metric, count(*)::VARCHAR AS value FROM e GROUP BY event_type UNION ALL
    SELECT event_type, 'events.with_value', (count(value) > 0)::VARCHAR FROM e GROUP BY event_type UNION ALL
    SELECT event_type, 'users', u::VARCHAR FROM (SELECT DISTINCT event_type, user_id AS u FROM e WHERE user_id < 10) UNION ALL
    SELECT event_type, 'users', '[]' FROM e GROUP BY event_type HAVING count_if(user_id < 10) = 0 UNION ALL
    SELECT event_type, 'days.' || p || '.day', day::VARCHAR FROM dd UNION ALL
    SELECT event_type, 'days.' || p || '.events.n', k::VARCHAR FROM dd UNION ALL
    SELECT event_type, 'days.' || p || '.faults', '[]' FROM dd UNION ALL
    SELECT DISTINCT event_type, 'reviewed', NULL FROM e""")
def nested_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested report of each event type (as many as a table of kinds has; a list of days in each), flat."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type IS NOT NULL").withColumn("day", F.to_date("ts"))
    daily = events.groupBy("event_type", "day").agg(F.count("*").alias("n"), F.count("value").alias("v"), F.collect_set(F.when(F.col("user_id") < 10, F.col("user_id"))).alias("u"))
    day = F.struct(F.col("day").cast("string").alias("day"), F.struct("n").alias("events"), F.array().cast("array<int>").alias("faults"))
    whole = daily.groupBy("event_type").agg(
        F.struct(F.sum("n").alias("n"), (F.sum("v") > 0).alias("with_value")).alias("events"), F.array_distinct(F.flatten(F.collect_set("u"))).alias("users"), F.array_sort(F.collect_list(day)).alias("days")
    )
    text = F.to_json(F.struct("events", "users", "days", F.lit(None).cast("int").alias("reviewed"), F.create_map().cast("map<string,int>").alias("notes")), {"ignoreNullFields": "false"})
    return reports.flattened(whole.select(F.col("event_type").alias("report"), text.alias("body")), "report", "body")


_PLANTED = """WITH v AS (SELECT vec_id AS e, label AS g, vec_id % 100 AS r FROM embeddings), a0 AS (
    SELECT e, g, CASE WHEN e % 97 = 5 THEN 'dev' WHEN r < 80 THEN 'train' WHEN r < 90 THEN 'validation' ELSE 'test' END AS p FROM v WHERE e % 103 <> 6
), a1 AS (
    SELECT *, CASE WHEN p = 'train' THEN CASE WHEN e % 89 = 3 THEN 0.5::DOUBLE END WHEN e % 83 = 7 THEN NULL WHEN e % 83 = 8 THEN 1.25::DOUBLE ELSE 0.25::DOUBLE END AS s FROM a0
), a AS (SELECT * FROM a1 UNION ALL SELECT * FROM a1 WHERE e % 101 = 4), h AS (
    SELECT 'h' || e % 3 AS t, e, CASE WHEN e % 9 < 3 THEN 'test' WHEN e % 9 < 8 THEN 'train' ELSE 'validation' END AS p,
        CASE WHEN (e % 9 < 3) <> (e % 53 = 9) THEN 'heldout_source_only' ELSE 'nonheldout_sources_only' END AS o FROM v WHERE e % 3 > 0 OR e % 9 < 8
), m AS (SELECT e, e // 7 AS k, e % 7 < 3 + CASE WHEN e // 7 % 5 = 1 THEN 1 ELSE 0 END AS top, e % 61 = 2 AS bare FROM v)"""


@_query(f"""{_PLANTED}, mm AS (SELECT * FROM m UNION ALL SELECT * FROM m WHERE e % 67 = 3)
    SELECT 'splits' AS part, 'repeated strategy+repeat+entity_id' AS "check", 'group 1 ' || e AS detail FROM a GROUP BY e HAVING count(*) > 1 UNION ALL
    SELECT 'splits', 'entities missing', 'group 1' FROM a HAVING count(DISTINCT e) <> (SELECT count(DISTINCT e) FROM v) UNION ALL
    SELECT 'splits', 'a partition is empty', 'group 1' FROM a HAVING count(DISTINCT p) < 3 UNION ALL
    SELECT 'splits', 'unknown partition', p FROM a WHERE p = 'dev' UNION ALL
    SELECT 'splits', 'similarity is null for train alone', e::VARCHAR FROM a WHERE (p = 'train') <> (s IS NULL) UNION ALL
    SELECT 'splits', 'max_similarity out of range', e || ' ' || s FROM a WHERE s > 1 UNION ALL
    SELECT 'splits', 'group in several partitions', concat_ws(' ', 'group 1', g) FROM a GROUP BY g HAVING count(DISTINCT p) > 1 UNION ALL
    SELECT 'holdouts', 'origin is another side''s', t || ' 1 ' || e FROM h WHERE (p = 'test') <> (o = 'heldout_source_only') UNION ALL
    SELECT 'holdouts', 'a partition is empty', t || ' 1' FROM h GROUP BY t HAVING count(DISTINCT p) < 3 UNION ALL
    SELECT 'meta', 'repeated run_id', e::VARCHAR FROM mm GROUP BY e HAVING count(*) > 1 UNION ALL
    SELECT 'meta', 'missing y_rmse', e::VARCHAR FROM mm WHERE bare UNION ALL
    SELECT 'meta', 'number of top runs', concat_ws(' ', k, sum(top::INT)) FROM mm GROUP BY k HAVING sum(top::INT) <> 3 UNION ALL
    SELECT 'meta', 'too few sources', '2' FROM mm HAVING count(DISTINCT k % 2) < 3 UNION ALL
    SELECT 'meta', 'task of several sources', k::VARCHAR FROM mm GROUP BY k HAVING count(DISTINCT CASE WHEN e % 71 = 9 THEN 1 - k % 2 ELSE k % 2 END) > 1 UNION ALL
    SELECT 'bits', 'not a set of bits', e::VARCHAR FROM v WHERE e % 79 BETWEEN 1 AND 3 UNION ALL
    SELECT 'values', 'values differ', e::VARCHAR FROM v WHERE e % 73 IN (0, 1) UNION ALL
    SELECT 'keys', 'only on the left', e::VARCHAR FROM v WHERE e % 59 = 1 AND e % 47 <> 1 UNION ALL
    SELECT 'keys', 'only on the right', e::VARCHAR FROM v WHERE e % 47 = 1 AND e % 59 <> 1 UNION ALL
    SELECT 'groups', 'several parity', concat_ws(' ', g) FROM v GROUP BY g HAVING count(DISTINCT e % 2) > 1 UNION ALL
    SELECT 'totals', 'rows lost', count(*) || ' ' || count(*) FILTER (e % 43 <> 1) FROM v HAVING count(*) FILTER (e % 43 = 1) > 0""")
def planted_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors' ids as split, hold-out, meta and feature tables with planted faults, and what the checks say of them."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("entity_id"), F.col("label").alias("grp"))
    e, x = F.col("entity_id"), F.expr
    part = F.when(e % 97 == 5, "dev").when(e % 100 < 80, "train").when(e % 100 < 90, "validation").otherwise("test")
    sets = v.where("entity_id % 103 <> 6").select("entity_id", F.lit("group").alias("strategy"), F.lit(1).alias("repeat"), part.alias("partition"), "grp")
    likeness = x("CASE WHEN partition = 'train' THEN CASE WHEN entity_id % 89 = 3 THEN 0.5D END WHEN entity_id % 83 = 7 THEN NULL WHEN entity_id % 83 = 8 THEN 1.25D ELSE 0.25D END")
    sets = sets.withColumn("max_similarity", likeness)
    sets = sets.unionByName(sets.where("entity_id % 101 = 4"))
    held = v.where("entity_id % 3 > 0 OR entity_id % 9 < 8").select(
        F.concat(F.lit("h"), e % 3).alias("heldout"), F.lit(1).alias("repeat"), "entity_id", F.when(e % 9 < 3, "test").when(e % 9 < 8, "train").otherwise("validation").alias("partition"),
        F.when((e % 9 < 3) != (e % 53 == 9), checks.ORIGINS["test"]).otherwise(checks.ORIGINS["fit"]).alias("origin"),
    )
    task = x("entity_id div 7")
    runs = v.select(
        e.alias("run_id"), task.alias("task_id"), F.when(e % 71 == 9, 1 - task % 2).otherwise(task % 2).alias("heldout"), F.lit(True).alias("selectable"), (e % 7 < 3 + F.when(task % 5 == 1, 1).otherwise(0)).alias("y_top"),
        F.when(e % 61 != 2, 1.0).alias("y_rmse"), F.lit(0.0).alias("y_regret"), F.lit(True).alias("y_near_best"),
    )
    runs = runs.unionByName(runs.where("run_id % 67 = 3"))
    bits = v.select("entity_id", x("CASE entity_id % 79 WHEN 1 THEN array(0, 0) WHEN 2 THEN array(0, 64) WHEN 3 THEN NULL ELSE array(0, 63) END").alias("bits"))
    values = v.select("entity_id", F.lit(0.1).alias("a"), x("CASE entity_id % 73 WHEN 0 THEN 0.1001D WHEN 1 THEN NULL ELSE 0.1D + 1e-13D END").alias("b"))
    found = {
        "splits": checks.split_faults(sets, v), "holdouts": checks.holdout_faults(held), "meta": checks.source_meta_faults(runs), "bits": checks.other_bits(bits, 64),
        "values": checks.not_close(values, "entity_id", F.col("a"), F.col("b")), "keys": checks.differing_keys(v.where("entity_id % 47 <> 1"), v.where("entity_id % 59 <> 1"), ["entity_id"]),
        "groups": checks.inconsistent(v.withColumn("parity", e % 2), "grp", ["parity"]), "totals": checks.unequal_totals(v, F.count("*"), v.where("entity_id % 43 <> 1"), F.count("*"), "rows lost"),
    }
    return union([df.select(F.lit(name).alias("part"), "check", "detail") for name, df in found.items()])
