"""Meta models and dense neighbours."""

import numpy as np
import pytest

from gaugelake.models.meta import ablations, out_of_source, predictors
from gaugelake.models.neighbours import knn_dense


def test_out_of_source_predictions(spark):
    r = np.random.default_rng(2)
    rows = [(f"r{k}", "ABC"[k % 3], float(x), None if k % 11 == 0 else float(z), "uv"[k % 2], int(x > 0), 1.0) for k, (x, z) in enumerate(r.normal(size=(90, 2)))]
    frame = spark.createDataFrame(rows, "run_id string, heldout string, x_a double, x_b double, x_c string, y_top int, y_rmse double")
    assert predictors(frame) == (["x_a", "x_b"], ["x_c"])
    got = out_of_source(frame, ("logistic",)).collect()
    assert len(got) == 90 and np.mean([(g.probability > 0.5) == bool(g.y_top) for g in got]) > 0.9
    without = ablations(frame, {"all": ("x_a", "x_b", "x_c"), "no_a": ("x_b", "x_c")}, "logistic").collect()
    hit = {a: np.mean([(g.probability > 0.5) == bool(g.y_top) for g in without if g.ablation == a]) for a in ("all", "no_a")}
    assert hit["all"] > 0.9 > hit["no_a"]
    with pytest.raises(ValueError, match="missing"):
        out_of_source(frame.drop("y_top"))


def test_dense_neighbours_equal_numpy(spark):
    r = np.random.default_rng(3)
    x, y = r.normal(size=(60, 3)), r.normal(size=60)
    frame = spark.createDataFrame([(k, *map(float, x[k]), float(y[k])) for k in range(60)], "entity_id int, f1 double, f2 double, f3 double, target double")
    got = {p.entity_id: p.predicted for p in knn_dense(frame.where("entity_id < 10"), frame.where("entity_id >= 10"), ["f1", "f2", "f3"], 4).collect()}
    for k in range(10):
        d = np.sqrt(((x[10:] - x[k]) ** 2).sum(axis=1))
        near = np.argsort(d)[:4]
        assert got[k] == pytest.approx((y[10:][near] / d[near]).sum() / (1 / d[near]).sum())
