"""Grids of regressors: candidates are scored on validation rows, the best is fitted again on train and validation, and scored once on test rows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, StandardScaler, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.tables import written

#: Adapters for other libraries register here: name to (candidates, factory of an estimator).
EXTRA: dict[str, tuple[list[dict], Callable]] = {}


def candidates(model: str) -> list[dict]:
    """The parameters that are tried."""
    if model in EXTRA:
        return EXTRA[model][0]
    return {
        "dummy": [{"strategy": "mean"}, {"strategy": "median"}],
        "ridge": [{"regParam": a} for a in (0.01, 0.1, 1.0)],
        "elastic_net": [{"regParam": a, "elasticNetParam": m} for a in (0.01, 0.1) for m in (0.2, 0.8)],
        "random_forest": [{"numTrees": 50, "maxDepth": d} for d in (5, 10)],
        "gbt": [{"maxIter": 20, "maxDepth": d} for d in (3, 5)],
    }[model]


def _pipeline(model: str, features: list[str], params: dict, seed: int) -> Pipeline:
    filled = [f"_{f}" for f in features]
    steps = [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_all"), VarianceThresholdSelector(varianceThreshold=0.0, featuresCol="_all", outputCol="_kept")]
    column = "_kept"
    if model in ("ridge", "elastic_net"):
        steps.append(StandardScaler(withMean=True, inputCol="_kept", outputCol="_scaled"))
        column = "_scaled"
    shared = {"featuresCol": column, "labelCol": "target", "predictionCol": "predicted"}
    if model in EXTRA:
        return Pipeline(stages=[*steps, EXTRA[model][1](**shared, **params)])
    made = {"ridge": LinearRegression, "elastic_net": LinearRegression, "random_forest": RandomForestRegressor, "gbt": GBTRegressor}[model]
    return Pipeline(stages=[*steps, made(**shared, **params, **({"seed": seed} if model in ("random_forest", "gbt") else {}))])


def _predict(model: str, features: list[str], params: dict, fit: DataFrame, test: DataFrame, seed: int) -> DataFrame:
    if model == "dummy":
        value = fit.agg((F.avg if params["strategy"] == "mean" else F.median)("target").alias("predicted"))
        return test.crossJoin(F.broadcast(value))  # one row
    return _pipeline(model, features, params, seed).fit(fit).transform(test)


def _errors(df: DataFrame) -> dict:
    gap = F.col("target") - F.col("predicted")
    r = df.agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"), F.sum(gap * gap).alias("sse"), (F.var_pop("target") * F.count("*")).alias("sst"), F.count("*").alias("n")).first()
    return {"rmse": r.rmse, "mae": r.mae, "r2": 1 - r.sse / r.sst if r.sst else None, "n": r.n}


def run_grid(frame: DataFrame, features: list[str], models: list[str], feature_type: str, strategy: str, repeat: int, seed: int) -> DataFrame:
    """One row a model: best parameters, validation and test errors. frame: entity_id, target, partition, features. A model that fails is told in ``failure``; the others go on."""
    frame, _ = written(frame, "frame")
    side = {p: frame.where(F.col("partition") == p) for p in ("train", "validation", "test")}
    rows = []
    for model in models:
        run = f"{strategy}_r{repeat}_{feature_type}_{model}"
        try:
            tried = [(params, _errors(_predict(model, features, params, side["train"], side["validation"], seed))) for params in candidates(model)]
            params, val = min(tried, key=lambda t: (t[1]["rmse"], t[1]["mae"]))
            test = _errors(_predict(model, features, params, side["train"].unionByName(side["validation"]), side["test"], seed))
            rows.append((run, model, feature_type, strategy, repeat, seed, json.dumps(params, sort_keys=True), val["rmse"], val["mae"], val["r2"], test["rmse"], test["mae"], test["r2"], test["n"], None))
        except Exception as e:  # noqa: BLE001  the failure is part of the result
            rows.append((run, model, feature_type, strategy, repeat, seed, None, None, None, None, None, None, None, None, str(e)[:500]))
    names = "run_id string, model string, feature_type string, strategy string, repeat int, seed int, best_parameters string, validation_rmse double, validation_mae double, validation_r2 double, test_rmse double, test_mae double, test_r2 double, n_test long, failure string"
    out = frame.sparkSession.createDataFrame(rows, names)
    return out
