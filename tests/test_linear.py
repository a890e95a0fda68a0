"""Fits from summed products against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugelake.models import linear, regressors


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 7)) * np.array([1, 10, 0.1, 1, 1, 1e4, 1]) + np.array([0, 5, 0, 0, 0, 1e6, 0])
    x[:, 3] = 2.5  # of one value
    y = x[:, 0] - 0.2 * x[:, 1] + r.normal(size=300) + 100
    return x, y


def frame(spark, x, y, blanks=()):
    rows = [(k % 2 or None, f"e{k}", ("train", "train", "validation", "test")[k // 2 % 4], float(y[k]), *[None if (k, j) in blanks else float(v) for j, v in enumerate(x[k])]) for k in range(len(y))]
    names = [f"f{j}" for j in range(x.shape[1])]
    return spark.createDataFrame(rows, "task int, entity_id string, partition string, target double, " + ", ".join(f"{n} double" for n in names)).repartition(5), names


def test_standardised_fills_with_medians(spark, data):
    x, y = data
    blanks = {(k, 1) for k in range(0, 300, 7)} | {(k, 4) for k in range(300) if k % 2 == 0}
    df, names = frame(spark, x, y, blanks)
    rows, scales = linear.standardised(df, ["task"], names, F.col("partition") == "train")
    got = {r.entity_id: r.z for r in rows.collect()}
    for odd in (0, 1):
        mine = [k for k in range(300) if k % 2 == odd]
        fit = [k for k in mine if k // 2 % 4 in (0, 1)]
        a = x.copy()
        for j in (1, 4):
            known = [x[k, j] for k in fit if (k, j) not in blanks]
            for k in mine:
                if (k, j) in blanks:
                    a[k, j] = np.median(known) if known else 0.0
        sd = a[fit].std(axis=0)
        want = np.where(sd > 1e-9, (a - a[fit].mean(axis=0)) / np.where(sd > 1e-9, sd, 1), 0)
        assert np.allclose([got[f"e{k}"] for k in mine], want[mine], atol=1e-6)
    assert scales.count() == 2


def test_ridge_elastic_net_and_selection(spark, data):
    x, y = data
    df, names = frame(spark, x, y)
    for model in ("ridge", "elastic_net"):
        tried = regressors.candidates(model)
        predictions, results = linear.run_linear(df, ["task"], names, tried)
        got = {r.task: r for r in results.collect()}
        held = {r.entity_id: r.predicted for r in predictions.collect()}
        for odd in (0, 1):
            at = {p: [k for k in range(300) if k % 2 == odd and k // 2 % 4 in s] for p, s in (("train", (0, 1)), ("validation", (2,)), ("test", (3,)))}
            score = lambda fit, asked, c: regressors.errors(y[asked], regressors.fit(model, regressors.DESCRIPTORS, c, x[fit], y[fit], 0)[0](x[asked])[0])
            best = min(tried, key=lambda c: score(at["train"], at["validation"], c)[:2])
            assert got[odd or None].best_parameters == ", ".join(f"{n}={v}" for n, v in sorted(best.items()))
            assert got[odd or None].test_rmse == pytest.approx(score(at["train"] + at["validation"], at["test"], best)[0], rel=1e-4)
            assert got[odd or None].n_test == len(at["test"]) and all(f"e{k}" in held for k in at["test"])


def test_logistic_meets_its_condition(spark, data):
    x, y = data
    df, names = frame(spark, x, y > y.mean())
    rows, _ = linear.standardised(df.withColumn("label", F.col("target").cast("int")), ["task"], names, F.lit(True))
    fits = {r.task: r for r in linear.fit_logistic(rows, ["task"], names, "label", c=0.7).collect()}
    for task, fit in fits.items():
        mine = rows.where(F.col("task").eqNullSafe(F.lit(task))).collect()
        z, label, w = np.array([r.z for r in mine]), np.array([r.label for r in mine]), np.array(fit.weights)
        gap = label - 1 / (1 + np.exp(-(fit.intercept + z @ w)))
        assert abs(gap.sum()) < 1e-5 and np.allclose(z.T @ gap, w / 0.7, atol=1e-5)
    assert len(fits) == 2


def test_empty_and_single_rows(spark):
    df = spark.createDataFrame([], "task int, entity_id string, partition string, target double, f0 double")
    predictions, results = linear.run_linear(df, ["task"], ["f0"], [{"alpha": 1.0}])
    assert predictions.count() == results.count() == 0
    one = spark.createDataFrame([(1, "a", "train", 2.0, 1.0), (1, "b", "validation", 3.0, None), (1, "c", "test", None, 1.0), (1, "d", "test", 2.5, float("nan"))], df.schema)
    assert [(r.n_test, r.test_rmse) for r in linear.run_linear(one, ["task"], ["f0"], [{"alpha": 1.0}])[1].collect()] == [(1, 0.0)]
