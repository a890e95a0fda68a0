"""Splits, errors, metrics, selection and models on hand-made rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugelake.models import adapters, grid
from gaugelake.models.laplace import laplace_probabilities
from gaugelake.operators import bootstrap, checks, metrics, reports, residuals, selection, similarity, splits, tasks


def test_nearest_neighbour_by_hand(spark):
    bits = "entity_id long, bits array<int>"
    train = spark.createDataFrame([(10, [0, 2]), (11, [1, 2])], bits)
    got = similarity.nearest_neighbour(spark.createDataFrame([(1, [0, 2]), (2, [0]), (3, []), (4, [5])], bits), train).collect()
    assert {r["query"]: (r.nearest, r.similarity) for r in got} == {1: (10, 1.0), 2: (10, 0.5), 3: (10, 0.0), 4: (10, 0.0)}


@pytest.mark.parametrize("values", [[float(k % 5) for k in range(60)], [k / 7 for k in range(200)], [1.0] * 40, [1.0, 2.0] * 5])
def test_quantile_bins_equal_pandas(spark, values):
    import pandas as pd

    got = {r.k: r.bin for r in splits.quantile_bins(spark.createDataFrame(list(enumerate(values)), "k int, v double"), "v").collect()}
    n = len(values)
    want = pd.qcut(pd.Series(values), min(10, max(2, n // 20)), labels=False, duplicates="drop") if n >= 20 and len(set(values)) > 1 else None
    if want is None or want.nunique() < 2 or want.value_counts().min() < 2:
        assert set(got.values()) == {None}
    else:
        assert [got[k] for k in range(n)] == want.tolist()


def test_chance_rank_equals_a_plain_window(spark):
    from gaugelake.functions.columns import sample_key
    from pyspark.sql import Window

    df = spark.range(500).select(F.col("id").alias("entity_id"), (F.col("id") % 3).alias("bin"))
    plain = df.withColumn("want", F.row_number().over(Window.partitionBy("bin").orderBy(sample_key(5, F.col("entity_id")))))
    assert splits.chance_rank(plain, ["bin"], "entity_id", 5).where("chance <> want").count() == 0


def _targets(spark):
    rows = [(f"m{k:02d}", -8 + 9 * k / 59, f"s{k // 3}") for k in range(60)]
    return spark.createDataFrame(rows, "entity_id string, target double, grp string")


def test_partitions_have_their_sizes_and_no_leaks(spark):
    r, targets = random.Random(5), _targets(spark)
    bits = spark.createDataFrame([(f"m{k:02d}", sorted(r.sample(range(64), 8))) for k in range(60)], "entity_id string, bits array<int>")
    for name, parts in (("random", splits.random_partitions(targets, 13)), ("group", splits.group_partitions(targets, 13)), ("low", splits.low_similarity_partitions(targets, bits, 13))):
        a = splits.with_similarity(parts.join(targets.select("entity_id", "grp"), "entity_id").withColumns({"strategy": F.lit(name), "repeat": F.lit(1), "seed": F.lit(13)}), bits).cache()
        sizes = {x["partition"]: x["count"] for x in a.groupBy("partition").count().collect()}
        assert sum(sizes.values()) == 60 and abs(sizes["train"] - 48) <= 3 and abs(sizes["test"] - 6) <= 3
        assert checks.split_faults(a, targets).collect() == []
        assert abs(sum(x.fraction for x in splits.split_quality(a, targets).collect()) - 1) < 1e-9
    assert splits.group_of(F.lit(" "), F.lit("x")) is not None


def test_holdout_has_no_shared_entity(spark):
    rows = [(f"o{k}", "AB"[k % 2], f"m{k}") for k in range(60)] + [("x", "A", "shared"), ("y", "B", "shared"), ("z", "A", None)]
    m = splits.holdout_manifest(spark.createDataFrame(rows, "observation_id string, source string, entity_id string"), (1, 2)).cache()
    assert checks.holdout_faults(m).collect() == []
    assert m.where("heldout = 'A' AND entity_id = 'shared' AND partition <> 'test'").count() == 0
    broken = m.unionByName(m.where("partition = 'test'").limit(1))
    assert checks.holdout_faults(broken).count() > 0


def test_error_bounds(spark):
    df = spark.createDataFrame([("r", "m", "f", "s", 1, "a", 1.0, 0.5), ("r", "m", "f", "s", 1, "b", 1.0, 0.0), ("r", "m", "f", "s", 1, "c", 0.0, 3.0), ("r", "m", "f", "s", 1, "d", 2.0, 2.0)], "run_id string, model string, feature_type string, strategy string, repeat int, entity_id string, truth double, predicted double")
    labeled = residuals.failure_labels(residuals.with_residuals(df))
    got = {r.entity_id: (r.q_abs_error_gt_0p5, r.q_abs_error_gt_1p0, r.absolute_error_bin, r.error_direction) for r in labeled.collect()}
    assert got == {"a": (0, 0, "0.5-<1.0", "underprediction"), "b": (1, 0, "1.0-<2.0", "underprediction"), "c": (1, 1, ">=2.0", "overprediction"), "d": (0, 0, "0.0-<0.5", "exact")}
    run = residuals.run_summary(labeled).first()
    assert run.n == 4 and run.rmse == pytest.approx(np.sqrt((0.25 + 1 + 9) / 4)) and run.underprediction_rate == 0.5 and run.failure_rate_gt_1p0 == 0.25
    assert residuals.group_summary(residuals.run_summary(labeled)).first().sd_rmse is None
    assert residuals.entity_summary(labeled.withColumn("model", F.lit("dummy"))).count() == 0


def test_ranks_skip_what_may_not_be_selected(spark):
    df = spark.createDataFrame([("t", "a", 1.0, True), ("t", "b", 1.05, True), ("t", "c", 1.05, True), ("t", "d", 1.05, True), ("t", "e", 2.0, True), ("t", "x", 0.1, False), ("t", "n", None, True)], "task_id string, run_id string, y_rmse double, selectable boolean")
    got = {r.run_id: (r.y_rank, r.y_top, r.y_near_best) for r in tasks.ranked_outcomes(df).collect()}
    assert got == {"a": (1, 1, 1), "b": (2, 1, 1), "c": (2, 1, 1), "d": (2, 1, 1), "e": (5, 0, 0), "x": (None, None, None), "n": (None, None, None)}


def test_metrics_by_hand_and_brute_force(spark):
    r = random.Random(2)
    rows = [("g", r.choice([0, 1]), r.choice([0.1, 0.25, 0.25, 0.7, 0.9]) if k % 2 else r.random()) for k in range(120)] + [("one", 1, 0.5)]
    got = {x.k: x for x in metrics.classification_metrics(spark.createDataFrame(rows, "k string, label int, probability double"), ["k"]).collect()}
    pos, neg = ([p for k, y, p in rows if k == "g" and y == v] for v in (1, 0))
    assert got["g"].roc_auc == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]))
    ap = sum(sum(p >= t for p in pos) / sum(p >= t for p in pos + neg) * pos.count(t) for t in set(pos)) / len(pos)
    assert got["g"].average_precision == pytest.approx(ap) and got["one"].roc_auc is None
    table = [("a", float(k % 7) - 3, float((k * 5) % 11) - 5) for k in range(40)] + [("b", 1.0, 2.0), ("b", 1.0, 3.0)]
    m = {x.k: x for x in metrics.regression_metrics(spark.createDataFrame(table, "k string, truth double, predicted double"), ["k"]).collect()}
    import pandas as pd

    own = pd.DataFrame(table, columns=["k", "t", "p"]).query("k == 'a'")
    assert m["a"].spearman == pytest.approx(own.t.rank().corr(own.p.rank())) and m["b"].spearman is None and m["b"].r2 is None
    one = spark.createDataFrame([("a", 0.0, 1.0, 0.0)], "k string, truth double, predicted double, sigma double")
    assert metrics.gaussian_nll(one, ["k"]).first().coverage_95 == 0.0


def test_selectors_and_bootstraps(spark):
    rows = [(f"{h}{t}{m}", f"{h}{t}", h, m, "f", v, y, y - 1.0, 1, 0) for h in "AB" for t in (1, 2) for m, v, y in (("x", 0.1, 2.0), ("y", 0.2, 1.0))]
    c = spark.createDataFrame(rows, "run_id string, task_id string, heldout string, x_model string, x_feature_type string, x_validation_rmse double, y_rmse double, y_regret double, y_top int, y_near_best int")
    s = selection.selected_candidates(c.withColumn("probability", F.lit(0.5)), {"fixed_x": ("x", "f")}).cache()
    picks = {(r.selector, r.task_id): r.x_model for r in s.collect()}
    assert picks["validation_rmse", "A1"] == "x" and picks["oracle", "A1"] == picks["training_source_best", "B2"] == "y" and picks["meta", "A1"] == "x" and picks["fixed_x", "A2"] == "x" and len(picks) == 20
    summary = {r.selector: r for r in selection.selection_summary(s).collect()}
    assert summary["oracle"].mean_regret == 0 and summary["fixed_x"].tasks == 4
    assert {r.heldout for r in selection.selection_grains(s).collect()} == {"ALL", "A", "B"}
    b = {r.selector: r for r in bootstrap.cluster_bootstrap(s, ["selector"], "heldout", "y_regret", 50, 3).collect()}
    assert (b["fixed_x"].estimate, b["fixed_x"].lower_95, b["fixed_x"].upper_95, b["fixed_x"].clusters) == (1.0, 1.0, 1.0, 2)
    uneven = spark.createDataFrame([("k", "a", 1.0)] * 9 + [("k", "b", -9.0)], "k string, c string, difference double")
    p = bootstrap.paired_bootstrap(uneven, ["k"], "c", iterations=400).first()
    assert p.paired_difference == pytest.approx(0.0) and 0.5 < p.probability_better < 0.9 and p.lower_95 == -9.0
    pooled = bootstrap.cluster_bootstrap(uneven, ["k"], "c", "difference", 400).first()
    assert pooled.estimate == pytest.approx(0.0) and pooled.upper_95 == 1.0
    assert bootstrap.paired_bootstrap(uneven.repartition(7), ["k"], "c", iterations=400).first() == p


def test_reports(spark):
    assert reports.flatten_report({"a": 1, "b": {"c": ["x", "y"], "d": []}, "e": [{"f": 2}], "g": {}}) == [("a", 1), ("b.c", "x"), ("b.c", "y"), ("b.d", "[]"), ("e.0.f", 2)]
    df = spark.createDataFrame([(1, "a", None), (2, "a", None)], "x int, y string, z double")
    assert {(r.feature, r.non_null, r.distinct_values, r.kind) for r in reports.feature_audit(df, df.columns).collect()} == {("x", 2, 2, "numeric"), ("y", 2, 1, "categorical"), ("z", 0, 0, "numeric")}
    assert {r.feature for r in reports.constant_columns(df, df.columns).collect()} == {"y", "z"}
    j = spark.createDataFrame([('{"a": 1, "b": [1, 2]}',), ('{"c": null}',), (None,)], "p string")
    keys = tasks.json_keys(j, "p")
    assert keys == ["a", "b", "c"] and [r.x_hp_b for r in tasks.json_columns(j, "p", keys).collect()] == ["[1,2]", None, None]
    assert {r.role for r in tasks.data_dictionary(spark, spark.createDataFrame([(1, 2, 3)], "x_a int, y_b int, c int")).collect()} == {"predictor", "outcome", "identifier"}


def test_laplace_mean_lies_in_its_interval():
    x = np.array([[0, 1], [1, 0], [2, 1], [3, 2], [4, 1], [5, 3]], float)
    mean, low, high = laplace_probabilities(-2.0, np.array([1.0, 0.2]), x, x[:3], 1.0)
    assert ((low <= mean) & (mean <= high) & (low > 0) & (high < 1)).all()


def test_grid_goes_on_after_a_failure(spark):
    r = np.random.default_rng(1)
    rows = [(k, float(2 * a - b), "train" if k < 40 else "validation" if k < 50 else "test", float(a), float(b), None if k == 3 else 0.5) for k, (a, b) in enumerate(r.normal(size=(60, 2)))]
    frame = spark.createDataFrame(rows, "entity_id int, target double, partition string, f1 double, f2 double, flat double")
    grid.EXTRA["broken"] = ([{}], lambda **_: 1 / 0)
    got = {x.model: x for x in grid.run_grid(frame, ["f1", "f2", "flat"], ["dummy", "ridge", "broken"], "toy", "random", 1, 13).collect()}
    assert got["ridge"].test_rmse < 0.2 < got["dummy"].test_rmse and "division" in got["broken"].failure and got["ridge"].run_id == "random_r1_toy_ridge"


def test_adapters_report_each_status(spark):
    def parse(text):
        if text == "bad":
            raise ValueError(text)
        if text == "boom":
            raise RuntimeError(text)
        return {"canonical": text.lower(), "parent": text.lower(), "parent_key": "" if text == "C" else f"K-{text}"}

    df = spark.createDataFrame([(t,) for t in ("A", " A ", "C", "bad", "boom", "", None)], "smiles string")
    got = [(r.smiles, r.structure_status, r.entity_id) for r in adapters.standardize(df, "smiles", parse).collect()]
    assert set(got) == {("A", "ok", "K-A"), (" A ", "ok", "K-A"), ("C", "ok", "SMILES:c"), ("bad", "invalid_smiles", None), ("boom", "standardization_error", None), ("", "missing_smiles", None), (None, "missing_smiles", None)} and len(got) == 7
    made = adapters.featurize(spark.createDataFrame([(1, "ok"), (2, "no")], "entity_id int, s string"), "s", lambda t: ([1.0, None], [3], [("d2", "nan")]) if t == "ok" else 1 / 0).collect()
    assert {(r.entity_id, tuple(r.bits), r.failures[0].descriptor) for r in made} == {(1, (3,), "d2"), (2, (), "all")}
