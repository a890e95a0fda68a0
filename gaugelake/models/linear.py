"""Linear fits of tasks of any size: sums of products travel, rows don't.

Each task of the cluster adds up its own rows into a matrix of products (a Gram matrix) for each fit; partial matrices are summed entry by entry, so no fit's
rows come together anywhere. Ridge and elastic net need one such pass whatever their parameters, logistic regression one a Newton step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelake.operators.quantiles import grouped_quantiles
from gaugelake.tables import small, written

#: Fits whose matrices a task holds before it hands them on.
HELD = 256


def _label(keys: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"})


def standardised(frame: DataFrame, keys: list[str], features: list[str], fit: Column) -> tuple[DataFrame, DataFrame]:
    """(frame with ``z`` and ``fit``, keys with median, mean and sd of each feature), all from the rows that ``fit`` marks.

    Nulls and values that are not finite take their feature's median in the fit, 0 where it has none; a feature of one value becomes 0 throughout.
    """
    finite = [F.when(~F.isnan(F.col(f).cast("double")) & (F.abs(F.col(f).cast("double")) < float("inf")), F.col(f).cast("double")) for f in features]
    rest = [c for c in frame.columns if c not in features]
    rows = frame.select(*rest, F.array(*finite).alias("x"), fit.alias("fit"))
    rows, seen = written(rows, "vectors", bare=F.count_if(F.exists("x", lambda v: v.isNull())))
    p, fitted = len(features), rows.where("fit")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    named = lambda df: df.withColumnsRenamed({k: f"_{k}" for k in keys})
    medians = named(rows.select(*keys).distinct()).withColumn("median", F.lit(None).cast("array<double>"))
    if seen.get("bare"):
        long = fitted.select(*keys, F.posexplode("x").alias("f", "v"))
        found = grouped_quantiles(long, [*keys, "f"], "v", {"m": 0.5}).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("f", "m"))).alias("m"))  # an entry a feature
        filled = F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
        medians, count = written(named(found).select(*[f"_{k}" for k in keys], filled.alias("median")), "medians")
        zeros = F.array(*[F.lit(0.0)] * p)
        joined = rows.join(small(medians, count["n"]), on, "left")
        rows, _ = written(joined.withColumn("x", F.zip_with("x", F.coalesce("median", zeros), lambda v, m: F.coalesce(v, m))).drop(*[f"_{k}" for k in keys], "median"), "filled")
        fitted = rows.where("fit")
    at = [F.element_at("x", i + 1) for i in range(p)]
    scales, count = written(named(fitted.groupBy(*keys).agg(F.array(*[F.avg(c) for c in at]).alias("mean"), F.array(*[F.stddev_pop(c) for c in at]).alias("sd"))), "scales")
    centred = F.zip_with("x", "mean", lambda x, m: x - m)
    z = F.zip_with(centred, "sd", lambda c, s: F.when(s > 1e-12, c / s).otherwise(0.0))
    out = rows.join(small(scales, count["n"]), on).withColumn("z", z).drop("x", "mean", "sd", *[f"_{k}" for k in keys])
    same = [scales[f"_{k}"].eqNullSafe(medians[f"_{k}"]) for k in keys]
    told = scales.join(medians, same, "left").select(*[scales[f"_{k}"].alias(k) for k in keys], "median", "mean", "sd")
    return written(out, "standardised")[0], told


def _summed(rows: DataFrame, keys: list[str], columns: list[str], matrix) -> dict[str, np.ndarray]:
    """By fit, the sum over its rows of ``matrix(label, *columns)``, whose entries are added up over all tasks. As many entries as fits times features squared."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[str, np.ndarray] = {}

        def handed() -> Iterator:
            for label, m in held.items():
                flat = m.ravel()
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(flat)), pa.array(range(len(flat)), pa.int32()), pa.array(flat, pa.float64())], ["label", "at", "v"])
            held.clear()

        for batch in batches:
            labels = np.array(batch.column(0).to_pylist(), object)
            parts = []
            for c in range(1, batch.num_columns):
                column = batch.column(c)
                parts.append(column.flatten().to_numpy().reshape(batch.num_rows, -1) if pa.types.is_list(column.type) else column.to_numpy(zero_copy_only=False))
            for label in set(labels):
                mine = labels == label
                m = matrix(label, *[x[mine] for x in parts])
                held[label] = held[label] + m if label in held else m
            if len(held) > HELD:
                yield from handed()
        yield from handed()

    shaped = rows.select(_label(keys).alias("label"), *columns)
    sums = shaped.mapInArrow(run, "label string, at int, v double").groupBy("label", "at").agg(F.sum("v").alias("v"))
    out: dict[str, list] = {}
    for r in sums.collect():
        out.setdefault(r.label, []).append((r["at"], r.v))
    return {label: np.array([v for _, v in sorted(entries)]) for label, entries in out.items()}


def grams(rows: DataFrame, keys: list[str], target: str, p: int) -> dict[str, np.ndarray]:
    """By fit, the products of (1, z, target) over the rows with ``fit`` and a target."""

    def matrix(_: str, z: np.ndarray, y: np.ndarray) -> np.ndarray:
        a = np.column_stack([np.ones(len(y)), z, y])
        return a.T @ a

    found = _summed(rows.where(F.col("fit") & F.col(target).isNotNull()), keys, ["z", F.col(target).cast("double").alias("y")], matrix)
    return {label: m.reshape(p + 2, p + 2) for label, m in found.items()}


def ridge(gram: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """(intercept, weights): least squares with ``alpha`` times the squared weights, the intercept free."""
    n, s, y = gram[0, 0], gram[0, 1:-1], gram[0, -1]
    products = gram[1:-1, 1:-1] - np.outer(s, s) / n
    w = np.linalg.solve(products + alpha * np.eye(len(s)), gram[1:-1, -1] - s * y / n)
    return float(y / n - w @ s / n), w


def elastic_net(gram: np.ndarray, alpha: float, l1_ratio: float, rounds: int = 10_000, tolerance: float = 1e-10) -> tuple[float, np.ndarray]:
    """(intercept, weights): half the mean squared error, ``alpha`` times a mix of absolute and squared weights; coordinate descent on the products."""
    n, s, y = gram[0, 0], gram[0, 1:-1], gram[0, -1]
    products, right = (gram[1:-1, 1:-1] - np.outer(s, s) / n) / n, (gram[1:-1, -1] - s * y / n) / n
    w = np.zeros(len(s))
    for _ in range(rounds):
        moved = 0.0
        for j in np.flatnonzero(np.diag(products) > 0):
            rho = right[j] - products[j] @ w + products[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha * l1_ratio, 0) / (products[j, j] + alpha * (1 - l1_ratio))
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < tolerance:
            break
    return float(y / n - w @ s / n), w


def fit_linear(rows: DataFrame, keys: list[str], features: list[str], target: str, candidates: list[dict]) -> DataFrame:
    """(keys, candidate, parameters, intercept, weights) of each fit and candidate: {alpha} is ridge, {alpha, l1_ratio} elastic net. rows: as ``standardised`` gives them.

    A row a fit and candidate comes to the driver, with a weight a feature.
    """
    labels = rows.select(_label(keys).alias("label"), *keys).distinct()
    found = []
    for label, gram in grams(rows, keys, target, len(features)).items():
        for k, c in enumerate(candidates, 1):
            intercept, w = elastic_net(gram, c["alpha"], c["l1_ratio"]) if "l1_ratio" in c else ridge(gram, c["alpha"])
            found.append((label, k, ", ".join(f"{n}={v}" for n, v in sorted(c.items())), intercept, [float(x) for x in w]))
    made = rows.sparkSession.createDataFrame(found, "label string, candidate int, parameters string, intercept double, weights array<double>")
    return written(labels.join(made, "label").drop("label"), "weights")[0]


def fit_logistic(rows: DataFrame, keys: list[str], features: list[str], label: str, c: float = 1.0, rounds: int = 50, tolerance: float = 1e-8) -> DataFrame:
    """(keys, intercept, weights) of logistic regressions with squared weights over 2 c, by Newton steps: one pass of gradients and curvatures a round, all fits at once."""
    p, used = len(features), rows.where(F.col("fit") & F.col(label).isNotNull())
    w: dict[str, np.ndarray] = {}
    penalty = np.array([0.0, *[1 / c] * p])
    for _ in range(rounds):
        known = dict(w)

        def matrix(name: str, z: np.ndarray, y: np.ndarray, known=known) -> np.ndarray:
            a = np.column_stack([np.ones(len(y)), z])
            chance = 1 / (1 + np.exp(-np.clip(a @ known.get(name, np.zeros(a.shape[1])), -500, 500)))
            curve = (a * (chance * (1 - chance))[:, None]).T @ a
            return np.column_stack([curve, a.T @ (y - chance)])

        moved = 0.0
        for name, flat in _summed(used, keys, ["z", F.col(label).cast("double").alias("y")], matrix).items():
            m, old = flat.reshape(p + 1, p + 2), w.get(name, np.zeros(p + 1))
            step = np.linalg.lstsq(m[:, :-1] + np.diag(penalty), m[:, -1] - penalty * old, rcond=None)[0]
            w[name] = old + step
            moved = max(moved, float(np.abs(step).max()))
        if moved < tolerance:
            break
    labels = rows.select(_label(keys).alias("label"), *keys).distinct()
    made = rows.sparkSession.createDataFrame([(n, float(v[0]), [float(x) for x in v[1:]]) for n, v in w.items()], "label string, intercept double, weights array<double>")
    return written(labels.join(made, "label").drop("label"), "weights")[0]


def predicted(rows: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with intercept + z . weights as ``predicted``, once for each row of ``weights`` of its fit."""
    held, seen = written(weights.withColumnsRenamed({k: f"_{k}" for k in keys}), "fits")
    dot = F.aggregate(F.zip_with("z", "weights", lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    joined = rows.join(small(held, seen["n"]), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return joined.withColumn("predicted", F.col("intercept") + dot).drop("intercept", "weights", *[f"_{k}" for k in keys])


def run_linear(frame: DataFrame, keys: list[str], features: list[str], candidates: list[dict], target: str = "target") -> tuple[DataFrame, DataFrame]:
    """(predictions, results) of the candidates on tasks of any size: each is fitted on train rows and scored on validation rows, the best (rmse, then mae, then the first) is
    fitted again on both and scored once on test rows.

    frame: keys, entity_id, partition, target, features. A task without one of the three partitions has no result.
    """
    part = F.col("partition")
    phases = F.when(part == "train", F.array(F.lit("tune"), F.lit("test"))).when(part == "validation", F.array(F.lit("tune"), F.lit("test"))).otherwise(F.array(F.lit("test")))
    both = frame.select(*keys, "entity_id", "partition", F.col(target).cast("double").alias("truth"), *features, F.explode(phases).alias("phase"))
    fit = (part == "train") | ((part == "validation") & (F.col("phase") == "test"))
    rows, _ = standardised(both, [*keys, "phase"], features, fit)
    weights = fit_linear(rows, [*keys, "phase"], features, "truth", candidates)
    scored = predicted(rows.where("NOT fit AND truth IS NOT NULL"), weights, [*keys, "phase"])
    gap = F.col("truth") - F.col("predicted")
    errors = [F.count("*").alias("n"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae")]
    tuned = scored.where("phase = 'tune'").groupBy(*keys, "candidate", "parameters").agg(*errors)
    best = tuned.groupBy(*keys).agg(F.min(F.struct("rmse", "mae", "candidate", "parameters")).alias("b"))
    best, seen = written(best.select(*keys, "b.candidate", F.col("b.parameters").alias("best_parameters"), F.col("b.rmse").alias("validation_rmse"), F.col("b.mae").alias("validation_mae")), "best")
    renamed = best.withColumnsRenamed({k: f"_{k}" for k in keys} | {"candidate": "_candidate"})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("candidate") == F.col("_candidate")]
    test = scored.where("phase = 'test'").join(small(renamed, seen["n"]), on).select(*keys, "entity_id", "truth", "predicted", "best_parameters", "validation_rmse", "validation_mae")
    test, _ = written(test, "predictions")
    results = test.groupBy(*keys, "best_parameters", "validation_rmse", "validation_mae").agg(F.count("*").alias("n_test"), F.sqrt(F.avg(gap * gap)).alias("test_rmse"), F.avg(F.abs(gap)).alias("test_mae"))
    return test.select(*keys, "entity_id", "truth", "predicted"), results
