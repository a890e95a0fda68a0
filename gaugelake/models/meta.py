"""Classifiers that say which candidate runs will be among a task's best, fitted without the source they are asked about.

Each fold (a held-out source) and model is one group of rows that a worker fits: as many groups as sources times models times sets of predictors, and a
meta table has one row a run.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.models.laplace import fit_logistic, laplace_probabilities, posterior_sd, sigmoid
from gaugelake.models.trees import Boosting, Forest
from gaugelake.operators.checks import refuse_columns, require_columns

MODELS = ("logistic", "bayesian_logistic_laplace", "random_forest", "hist_gradient_boosting")
C = 1.0
SEED = 20260309
# Predictors of the candidate, of validation, and the sets of the ablations (everything is what neither names).
CANDIDATE = ("x_model", "x_model_class", "x_feature_type", "x_features_after_preprocessing")
VALIDATION = ("x_validation_rmse", "x_validation_mae", "x_validation_r2", "x_validation_spearman")
ABLATIONS = ("hgb_identity_only", "hgb_identity_validation", "hgb_task_chemistry_no_validation", "hgb_full")


def predictors(df: DataFrame, leave_out: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns that start with x_."""
    kinds = dict(df.dtypes)
    named = sorted(c for c in df.columns if c.startswith("x_") and c not in leave_out)
    return [c for c in named if kinds[c] not in ("string", "boolean")], [c for c in named if kinds[c] in ("string", "boolean")]


def ablation_sets(df: DataFrame) -> dict[str, tuple[str, ...]]:
    """The predictors of each ablation: the candidate's identity alone, with validation results, with all but these, and all."""
    every = [c for pair in predictors(df) for c in pair]
    own, val = [c for c in every if c in CANDIDATE], [c for c in every if c in VALIDATION]
    rest = [c for c in every if c not in VALIDATION]
    return dict(zip(ABLATIONS, map(tuple, (own, own + val, rest, every)), strict=True))


class Design:
    """Numbers of a table's predictors, as the fitted rows say: medians for missing numbers and a flag for columns that miss some, scaled; the most
    frequent level for missing categories, a column for each known level; unknown levels have none."""

    def __init__(self, numbers: np.ndarray, levels: np.ndarray, numeric: list[str], categorical: list[str]):
        seen = np.isfinite(numbers)
        self.medians = np.array([np.median(c[s]) if s.any() else 0.0 for c, s in zip(numbers.T, seen.T, strict=True)])
        self.flags = np.flatnonzero(~seen.all(axis=0))
        plain = self._plain(numbers)
        self.mean, sd = plain.mean(axis=0), plain.std(axis=0)
        self.sd = np.where(sd > 0, sd, 1.0)
        self.levels, self.usual = [], []
        for column in levels.T:
            known, times = np.unique([v for v in column if v is not None], return_counts=True)
            self.levels.append(known.tolist())
            self.usual.append(known[times.argmax()] if len(known) else None)
        self.names = [*numeric, *(f"{numeric[k]}_missing" for k in self.flags), *(f"{c}_{v}" for c, vs in zip(categorical, self.levels, strict=True) for v in vs)]

    def _plain(self, numbers: np.ndarray) -> np.ndarray:
        seen = np.isfinite(numbers)
        return np.hstack([np.where(seen, numbers, self.medians), (~seen[:, self.flags]).astype(float)])

    def __call__(self, numbers: np.ndarray, levels: np.ndarray) -> np.ndarray:
        parts = [(self._plain(numbers) - self.mean) / self.sd]
        for column, known, usual in zip(levels.T, self.levels, self.usual, strict=True):
            filled = [usual if v is None else v for v in column]
            parts.append(np.array([[float(v == k) for k in known] for v in filled]).reshape(len(filled), len(known)))
        return np.hstack(parts)


def _fitted(model: str, x: np.ndarray, y: np.ndarray, asked: np.ndarray, seed: int) -> tuple:
    """(probability, lower, upper, importance of each column, its standard deviation) of ``asked``; None where a model has none."""
    if model in ("logistic", "bayesian_logistic_laplace"):
        intercept, weights = fit_logistic(x, y, C)
        if model == "logistic":
            return sigmoid(intercept + asked @ weights), None, None, weights, None
        return *laplace_probabilities(intercept, weights, x, asked, C), weights, posterior_sd(intercept, weights, x, C)
    if model == "random_forest":
        forest = Forest(500, "sqrt", 5, seed=seed).fit(x, y)
        return forest.predict(asked), None, None, forest.importances(x.shape[1]), None
    if model == "hist_gradient_boosting":
        return Boosting(250, 0.05, 15, l2=1.0, min_rows=10, patience=None, classify=True, seed=seed).fit(x, y).predict(asked), None, None, None, None
    raise ValueError(f"unknown meta model: {model}")


_SCORED = "fold string, meta_model string, predictor_set string, run_id string, probability double, probability_lower_95 double, probability_upper_95 double, feature string, importance double, posterior_sd double"


def _groups(frame: DataFrame, models: Iterable[str], sets: dict[str, tuple[str, ...]], outcome: str, source: str, seed: int) -> DataFrame:
    """Scored runs and importances (rows without a run) of every fold, model and set of predictors."""
    require_columns(frame, [outcome, source, "run_id"])
    kinds = dict(frame.dtypes)
    for names in sets.values():
        refuse_columns(frame.select(*names), [c for c in frame.columns if c.startswith("y_")])
    ready = frame.where(F.col(outcome).isNotNull() & F.col(source).isNotNull())
    every = sorted({c for names in sets.values() for c in names})
    numeric, categorical = [c for c in every if kinds[c] not in ("string", "boolean")], [c for c in every if kinds[c] in ("string", "boolean")]
    rows = ready.select(
        F.col("run_id").cast("string").alias("run_id"), F.col(source).cast("string").alias("source"), F.col(outcome).cast("double").alias("y"),
        F.array(*[F.col(c).cast("double") for c in numeric]).cast("array<double>").alias("numbers"), F.array(*[F.col(c).cast("string") for c in categorical]).cast("array<string>").alias("levels"),
    )
    folds = rows.select(F.col("source").alias("fold")).distinct()
    made = frame.sparkSession.createDataFrame([(m, s) for m in models for s in sets], "meta_model string, predictor_set string")
    dealt = rows.crossJoin(F.broadcast(folds)).crossJoin(F.broadcast(made))  # as many copies as sources times models

    def run(group):
        import pandas as pd

        group = group.sort_values("run_id", kind="stable")  # the same rows in the same order on every cluster
        fold, model, chosen = group["fold"].iloc[0], group["meta_model"].iloc[0], group["predictor_set"].iloc[0]
        own = [k for k, c in enumerate(numeric) if c in sets[chosen]], [k for k, c in enumerate(categorical) if c in sets[chosen]]
        numbers = np.array([[np.nan if r[k] is None else r[k] for k in own[0]] for r in group["numbers"]], float).reshape(len(group), len(own[0]))
        levels = np.array([[r[k] for k in own[1]] for r in group["levels"]], object).reshape(len(group), len(own[1]))
        test, y = (group["source"] == fold).to_numpy(), group["y"].to_numpy()
        design = Design(numbers[~test], levels[~test], [numeric[k] for k in own[0]], [categorical[k] for k in own[1]])
        number = sorted(group["source"].unique()).index(fold) + 1
        p, low, high, importance, sd = _fitted(model, design(numbers[~test], levels[~test]), y[~test], design(numbers[test], levels[test]), seed + number)
        none = lambda v, n: np.full(n, np.nan) if v is None else v
        n, k = int(test.sum()), len(design.names) if importance is not None else 0
        out = pd.DataFrame({"run_id": group["run_id"][test].tolist(), "probability": p, "probability_lower_95": none(low, n), "probability_upper_95": none(high, n)})
        if k:
            out = pd.concat([out, pd.DataFrame({"feature": design.names, "importance": importance, "posterior_sd": none(sd, k)})], ignore_index=True)
        out = out.assign(fold=fold, meta_model=model, predictor_set=chosen)
        return out.reindex(columns=[f.split(" ")[0] for f in _SCORED.split(", ")]).astype(object).where(lambda d: d.notna(), None)

    return dealt.groupBy("fold", "meta_model", "predictor_set").applyInPandas(run, _SCORED)


def out_of_source(frame: DataFrame, models: tuple[str, ...] = MODELS, outcome: str = "y_top", source: str = "heldout", leave_out: tuple[str, ...] = (), seed: int = SEED) -> DataFrame:
    """Rows of ``frame`` with the probability (and, for the Laplace model, its interval) that each model gives them after it was fitted on all other sources."""
    require_columns(frame, [outcome, source, "run_id"])
    numeric, categorical = predictors(frame, leave_out)
    scored = _groups(frame, models, {"all": (*numeric, *categorical)}, outcome, source, seed).where("run_id IS NOT NULL")
    return frame.join(scored.select("run_id", "meta_model", "probability", "probability_lower_95", "probability_upper_95"), "run_id")


def importances(frame: DataFrame, models: tuple[str, ...] = MODELS, outcome: str = "y_top", source: str = "heldout", seed: int = SEED) -> DataFrame:
    """(fold, meta_model, feature, importance, absolute_importance, posterior_sd): weights of scaled predictors, or the gain of a forest's cuts on each."""
    numeric, categorical = predictors(frame)
    found = _groups(frame, models, {"all": (*numeric, *categorical)}, outcome, source, seed).where("run_id IS NULL")
    return found.select("fold", "meta_model", "feature", "importance", F.abs("importance").alias("absolute_importance"), "posterior_sd")


def ablations(frame: DataFrame, sets: dict[str, tuple[str, ...]] | None = None, model: str = "hist_gradient_boosting", outcome: str = "y_top", source: str = "heldout", seed: int = SEED) -> DataFrame:
    """Out-of-source predictions of one model by each set of predictors (those of :func:`ablation_sets` by default); column ablation names it."""
    scored = _groups(frame, (model,), sets or ablation_sets(frame), outcome, source, seed).where("run_id IS NOT NULL")
    return frame.join(scored.select("run_id", F.col("predictor_set").alias("ablation"), "probability"), "run_id")
