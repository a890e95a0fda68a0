"""Trainers that are other programs: one process a task, on the executors, with results kept so that an interrupted run goes on where it stopped.

A task's rows become three CSV files in a scratch folder of its own; the program trains on them, then predicts validation and test rows. What comes back
is checked before anything is kept. Finished tasks are Parquet shards by task in a folder that all machines share, each with a marker that holds
the settings it was made with: equal settings are not run again.
"""

from __future__ import annotations

import json
import os
import re
import subprocess
import time
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path
from tempfile import TemporaryDirectory

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake.models.regressors import errors
from gaugelake.operators import metrics, residuals
from gaugelake.sources.readers import exists, read_shards
from gaugelake.tables import written

MARKER = "_complete.json"


@dataclass(frozen=True)
class Trainer:
    """train, predict: commands, a word an item; {train} {validation} {test} {input} {output} {model} {seed} and any setting stand for values.

    model_file: what training must leave in its output folder. settings: what the marker records. parameters: what the results record.
    environment: added to that of the child process.
    """

    name: str
    feature_type: str
    train: Sequence[str]
    predict: Sequence[str]
    model_file: str
    settings: dict
    parameters: dict
    environment: dict | None = None
    n_features: int | None = None


def child_environment(more: dict | None = None) -> dict:
    """The environment of a child process: this one's, one thread for each numerical library, scratch folders of its own."""
    threads = dict.fromkeys(("OMP_NUM_THREADS", "MKL_NUM_THREADS", "OPENBLAS_NUM_THREADS"), "1")
    return {**os.environ, **threads, **(more or {})}


def _call(command: Sequence[str], values: dict, where: Path, environment: dict | None) -> float:
    # Only the known names in braces stand for values: programs and their arguments may hold any other braces.
    known = re.compile("{(" + "|".join(map(re.escape, values)) + ")}")
    words = [known.sub(lambda m: str(values[m[1]]), w) for w in command]
    start = time.perf_counter()
    done = subprocess.run(words, cwd=where, env=child_environment(environment), capture_output=True, text=True, check=False)  # noqa: S603
    if done.returncode:
        raise RuntimeError(f"{words[0]} ended with {done.returncode}: {done.stderr[-800:]}")
    return time.perf_counter() - start


def predicted_values(path: Path, column: str, expected: int) -> np.ndarray:
    """A column of a CSV file of predictions; as many rows as were asked for, all of them finite."""
    import pandas as pd

    found = pd.read_csv(path)
    if column not in found:
        raise ValueError(f"{path.name} has no column {column}")
    if len(found) != expected:
        raise ValueError(f"{path.name} has {len(found)} rows, not {expected}")
    values = pd.to_numeric(found[column], errors="coerce").to_numpy(float)
    if not np.isfinite(values).all():
        raise ValueError(f"{path.name} holds values that are not finite")
    return values


_ROW = "task_id string, strategy string, repeat int, seed int, heldout string, entity_id string, partition string, truth double, predicted double, train_seconds double, predict_seconds double, reason string"


def _train_task(trainer: Trainer):
    names = [f.split(" ")[0] for f in _ROW.split(", ")]

    def run(frame):
        import pandas as pd

        try:
            return trained(frame)
        except Exception as e:  # noqa: BLE001  told in the task's only row, so that other tasks' rows stay
            return pd.DataFrame([dict.fromkeys(names) | {"task_id": frame["task_id"].iloc[0], "reason": f"{type(e).__name__}: {e}"[:1000]}])

    def trained(frame):
        with TemporaryDirectory(prefix="gaugelake-task-") as scratch:  # one process's own
            where = Path(scratch)
            frame = frame.sort_values("entity_id", kind="stable")
            side = {p: frame[frame["partition"] == p] for p in ("train", "validation", "test")}
            values = {"seed": int(frame["seed"].iloc[0]), "output": str(where / "training"), **trainer.settings}
            for p, rows in side.items():
                values[p] = str(where / f"{p}.csv")
                rows[["structure", "target"]].to_csv(values[p], index=False)
            trained = _call(trainer.train, values, where, trainer.environment)
            model = where / "training" / trainer.model_file
            if not model.exists():
                raise FileNotFoundError(f"training left no {trainer.model_file}")
            parts = []
            for p in ("validation", "test"):
                asked, out = where / f"asked_{p}.csv", where / f"predicted_{p}.csv"
                side[p][["structure", "entity_id"]].to_csv(asked, index=False)
                took = _call(trainer.predict, values | {"input": str(asked), "output": str(out), "model": str(model)}, where, trainer.environment)
                parts.append(side[p].assign(predicted=predicted_values(out, "target", len(side[p])), predict_seconds=took))
            import pandas as pd

            made = pd.concat(parts).assign(train_seconds=trained).rename(columns={"target": "truth"})
            return made.assign(reason=None)[names]

    return run


def _marker(spark: SparkSession, folder: str, settings: dict | None = None) -> dict | None:
    """A shard's settings, or None where it is not finished; with ``settings``, writes them."""
    path = f"{folder}/{MARKER}"
    if settings is not None:
        spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return settings
    if not exists(spark, path):
        return None
    return json.loads(spark.read.text(path).first()[0])


def run_external(tasks: DataFrame, trainer: Trainer, folder: str, force: bool = False) -> list[str]:
    """Train every task of ``tasks`` (see ``holdouts.task_rows``) that has no finished shard of equal settings under ``folder``; returns the ids of those that ran.

    All pending tasks run in parallel, and each finished one becomes a shard with a marker. Tasks that fail leave none; the call then ends with an error that
    names them, after all others' shards are kept, and the next call takes up the failed ones alone.
    """
    spark = tasks.sparkSession
    ids = sorted(r[0] for r in tasks.select("task_id").distinct().collect())  # a row a task
    pending = [t for t in ids if force or _marker(spark, f"{folder}/{t}") != trainer.settings]
    if not pending:
        return []
    columns = ["task_id", "strategy", "repeat", "seed", F.col("heldout") if "heldout" in tasks.columns else F.lit(None).cast("string").alias("heldout"), F.col("entity_id").cast("string").alias("entity_id"), "partition", "structure", "target"]
    rows = tasks.where(F.col("task_id").isin(pending)).select(*columns)
    made, _ = written(rows.repartition(len(pending), "task_id").groupBy("task_id").applyInPandas(_train_task(trainer), _ROW), "trained")
    failed = {r.task_id: r.reason for r in made.where("reason IS NOT NULL").select("task_id", "reason").collect()}  # a row a task
    for t in (t for t in pending if t not in failed):
        made.where(F.col("task_id") == t).drop("reason").write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{t}/rows")
        _marker(spark, f"{folder}/{t}", trainer.settings)
    if failed:
        raise RuntimeError(f"failed tasks: {failed}")
    return pending


def collect_external(spark: SparkSession, trainer: Trainer, folder: str, task_ids: Sequence[str], sizes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, predictions, tuning) of finished tasks, as the experiment runner has them; an unfinished task is an error.

    sizes: (task_id, n_train, n_validation, n_test).
    """
    if missing := [t for t in task_ids if not exists(spark, f"{folder}/{t}/{MARKER}")]:
        raise RuntimeError(f"unfinished tasks: {missing}")
    rows = read_shards(spark, [f"{folder}/{t}/rows" for t in task_ids], unique=["task_id", "entity_id"])
    run = F.concat_ws("_", "strategy", F.concat(F.lit("r"), F.col("repeat").cast("string")), F.lit(trainer.feature_type), F.lit(trainer.name))
    named = rows.withColumns({"run_id": run, "model": F.lit(trainer.name), "feature_type": F.lit(trainer.feature_type), "sigma": F.lit(None).cast("double")})
    ids = ["run_id", "task_id", "heldout", "model", "feature_type", "strategy", "repeat", "seed"]
    test = metrics.interval(residuals.with_residuals(named.where("partition = 'test'")))
    predictions = test.select(*ids, "entity_id", "truth", "predicted", "sigma", "residual", "absolute_error", "squared_error", "lower_95", "upper_95").orderBy("run_id", "entity_id")
    scores = [metrics.regression_metrics(named.where(F.col("partition") == p), ["run_id"]).select("run_id", *[F.col(c).alias(f"{n}_{c}") for c in ("rmse", "mae", "r2", "spearman")]) for p, n in (("validation", "validation"), ("test", "test"))]
    took = named.groupBy(*ids).agg(F.max("train_seconds").alias("tuning_seconds"), F.max(F.when(F.col("partition") == "test", F.col("predict_seconds"))).alias("test_predict_seconds"), F.sum(F.when(F.col("partition") == "validation", 1)).alias("_v"))
    parameters = F.lit(json.dumps(trainer.parameters | trainer.settings, sort_keys=True))
    results = took.join(scores[0], "run_id").join(scores[1], "run_id").join(F.broadcast(sizes.select("task_id", "n_train", "n_validation", "n_test")), "task_id")  # a row a task
    results = results.drop("_v").withColumns({"best_parameters": parameters, "n_final_fit": F.col("n_train"), "features_before": F.lit(None).cast("int"), "features_after": F.lit(trainer.n_features).cast("int"), "final_fit_seconds": F.col("tuning_seconds")})
    tuning = results.select("run_id", "task_id", "heldout", F.lit(1).alias("candidate"), F.col("best_parameters").alias("parameters"), *[f"validation_{c}" for c in ("rmse", "mae", "r2", "spearman")], F.col("tuning_seconds").alias("fit_and_predict_seconds"))
    return results.orderBy("run_id"), predictions, tuning.orderBy("run_id")


def output_names(design: str, complete: bool) -> dict[str, str]:
    """Names of the three tables; those of some tasks only say so."""
    suffix = "" if complete else "_partial"
    return {k: f"{design}_{k}{suffix}" for k in ("results", "predictions", "tuning")}


__all__ = ["MARKER", "Trainer", "child_environment", "collect_external", "errors", "output_names", "predicted_values", "run_external"]
