"""Command line: each step reads Parquet tables, checks them, writes its tables and a report, then fails if a check did.

    python -m gaugelake.plans.cli targets --observations OBS --output DIR
"""

from __future__ import annotations

import argparse
import importlib
import json
import platform
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gaugelake.models import adapters, experiments
from gaugelake.models import external as external_runs
from gaugelake.models import meta as meta_models
from gaugelake.operators import bootstrap, checks, metrics, overlap, reports, residuals, resolve, selection, similarity, splits, tasks
from gaugelake.operators import holdouts as held
from gaugelake.operators.checks import union
from gaugelake.session import build_session
from gaugelake.sources import archives, harmonise, readers, streams, writers
from gaugelake.tables import written


def _save(df: DataFrame, args: argparse.Namespace, name: str) -> DataFrame:
    path = f"{args.output}/{name}"
    writers.write_table(df, path, None if args.no_csv else f"{path}.csv")
    return df.sparkSession.read.parquet(path)


def targets(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    obs = readers.read_parquet(spark, args.observations)
    out = _save(resolve.resolve_targets(obs, args.consistent_max, args.conflict_min, args.review_min, args.review_max), args, "targets")
    _save(resolve.reliability_summary(out), args, "reliability")
    _save(overlap.source_overlap(obs), args, "source_overlap")
    _save(reports.source_validation(obs), args, "validation")
    eligible = resolve.eligible(obs)
    return checks.union([checks.repeated_keys(out, ["entity_id"]), checks.unequal_totals(eligible, F.count("*"), out, F.sum("n_observations"), "observations lost")])


def split(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    known, bits = readers.read_parquet(spark, args.targets).where("primary"), readers.read_parquet(spark, args.bits)
    if not known.limit(1).count():
        raise ValueError("no primary targets to split")
    out = _save(splits.split_assignments(known, bits, args.strategies, args.seeds), args, "split_assignments")
    _save(reports.split_report(_save(splits.split_quality(out, known), args, "split_quality")), args, "split_report")
    return checks.split_faults(out, known)


def holdouts(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    obs = readers.read_parquet(spark, args.observations)
    bits = readers.read_parquet(spark, args.bits) if args.bits else None
    group = "grp" if "grp" in obs.columns else None
    out = _save(held.source_holdout_tasks(obs, bits, args.sources, tuple(args.seeds), group=group), args, "holdout_tasks")
    _save(held.holdout_summary(out), args, "holdout_summary")
    _save(held.target_audit(obs, held.source_targets(obs, args.sources)), args, "holdout_target_audit")
    return checks.holdout_faults(out if bits is not None else out.drop("max_similarity"))


def failures(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    labeled = residuals.failure_labels(residuals.with_residuals(readers.read_parquet(spark, args.predictions)), tuple(args.thresholds))
    labeled = _save(labeled, args, "prediction_failures")
    runs = _save(residuals.run_summary(labeled, thresholds=tuple(args.thresholds)), args, "run_summary")
    _save(residuals.group_summary(runs, args.primary_threshold), args, "group_summary")
    _save(residuals.entity_summary(labeled, tuple(args.thresholds)), args, "entity_summary")
    _save(metrics.regression_metrics(labeled, ["run_id"]), args, "metrics")
    return checks.union([checks.repeated_keys(labeled, ["run_id", "entity_id"]), checks.inconsistent(labeled, "run_id", ["model", "feature_type", "strategy", "repeat"])])


def select(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    frame = tasks.ranked_outcomes(readers.read_parquet(spark, args.candidates))
    chosen = _save(selection.selected_candidates(frame, json.loads(args.fixed)), args, "selected")
    _save(selection.selection_summary(chosen), args, "selection")
    _save(selection.selection_summary(chosen, by_source=True), args, "selection_by_source")
    _save(bootstrap.cluster_bootstrap(chosen, ["selector"], "heldout", "y_regret", args.iterations), args, "uncertainty")
    return checks.repeated_keys(chosen, ["selector", "task_id"])


def audit(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    found = _save(overlap.overlap_audit(readers.read_parquet(spark, args.external), readers.read_parquet(spark, args.observations)), args, "overlap_audit")
    _save(overlap.exclusion_list(found), args, "exclusions")
    return checks.repeated_keys(found, ["external_id"])


def import_archive(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """An external test set from its archive: inputs and labels apart, features, and what of it is known inside, exactly and nearly.

    The archive is downloaded if it isn't there (or with --force-download) and --url is given. A structure that can't be parsed, or stands twice, is a fault.
    """
    if args.url:
        readers.download(args.url, args.archive, args.bytes, args.md5, args.force_download)
    members = {task: (name, rows) for task, (name, rows) in json.loads(args.members).items()}
    schema = StructType.fromDDL("ID string, Name string, SMILES string, Solubility double")
    raw = archives.read_archive(spark, args.archive, members, schema, args.skip_lines, args.md5, "ID").withColumnsRenamed({"ID": "external_id", "Name": "compound_name", "SMILES": "original_smiles", "Solubility": "value"})
    parsed, _ = written(adapters.standardize(raw, "original_smiles", _named(args.parser)), "parsed")
    bad = parsed.where("structure_status <> 'ok'").select(F.lit("structure not parsed").alias("check"), F.col("external_id").alias("detail"))
    checks.raise_if_any(checks.union([bad, checks.repeated_keys(parsed, ["entity_id"])]), f"{args.output}/input_faults")
    inputs = _save(parsed.drop("value"), args, "inputs")
    labels = _save(parsed.select("external_id", "task", "value", F.lit(True).alias("locked_for_model_selection")), args, "labels")
    compute = _named(args.compute)(radius=args.radius, n_bits=args.bits, chirality=not args.ignore_chirality)
    made = _save(adapters.featurize(inputs, "parent", compute), argparse.Namespace(**vars(args) | {"no_csv": True}), "features")
    targets = readers.read_parquet(spark, args.targets).where("primary").select("entity_id")
    inside = overlap.restricted_to(readers.read_parquet(spark, args.internal_bits).select("entity_id", "bits"), targets, exact=True)
    near = similarity.nearest_neighbour(made.select("entity_id", "bits"), inside).select(F.col("query").alias("entity_id"), F.col("nearest").alias("nearest_target"), F.col("similarity").alias("max_similarity"))
    found = overlap.overlap_audit(inputs.join(labels.select("external_id", "value"), "external_id"), readers.read_parquet(spark, args.observations))
    found = overlap.existence(found.join(near, "entity_id", "left"), targets, "in_targets").withColumn("nearest_is_equal", F.coalesce(F.col("max_similarity") >= 1 - 1e-12, F.lit(False)))
    audited = _save(found, args, "overlap_audit")
    _save(overlap.exclusion_list(audited.where("in_targets")), args, "exclusions")
    _save(overlap.task_summary(audited), args, "task_summary")
    digest = streams.digests(streams.listing(spark, args.archive), ("md5", "sha256")).first().asDict()
    counts = audited.agg(F.count("*").alias("rows"), F.count_if("in_internal").alias("known"), F.count_if("in_targets").alias("in_targets"), F.count_if("nearest_is_equal").alias("nearest_is_equal")).first().asDict()
    _reported(spark, args, "import_report", {"archive": digest, "external": counts, "labels_apart": True})
    return checks.union([checks.differing_keys(inputs, made, ["entity_id"]), checks.other_bits(made.where("size(failures) = 0"), args.bits)])


def _reported(spark: SparkSession, args: argparse.Namespace, name: str, report: dict) -> None:
    """A report as JSON, and flat as a table (metric, value)."""
    Path(args.output).mkdir(parents=True, exist_ok=True)
    writers.write_report(report, f"{args.output}/{name}.json")
    body = spark.createDataFrame([(name, Path(f"{args.output}/{name}.json").read_text())], "report string, body string")
    _save(reports.flattened(body, "report", "body"), args, name)


def inventory(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Checksums of the files below a folder and, where they are named, row counts of tables (from footers), what the runs hold, and locked packages: one manifest."""
    out = _save(readers.file_inventory(spark, args.root, max_bytes=args.max_bytes, include=tuple(args.include)), args, "checksums")
    totals = _save(readers.inventory_totals(out), args, "totals").first().asDict()
    manifest = {"generated_at": datetime.now(timezone.utc).isoformat(), "python": platform.python_version(), "spark": spark.version, "checksums": totals | {"algorithm": "SHA-256"}, "max_bytes": args.max_bytes}
    faults = [checks.repeated_keys(out, ["path"])]
    if args.tables:
        counts = [streams.footers(spark, path).agg(F.lit(name).alias("table"), F.sum("rows").alias("n"), F.max("columns").alias("columns")) for name, _, path in (t.partition("=") for t in args.tables)]
        manifest["tables"] = {r.table: {"rows": r.n, "columns": r.columns} for r in _save(union(counts), args, "table_counts").collect()}  # a row a table
    if args.runs:
        results, predictions = (readers.read_parquet(spark, f"{args.runs}/{t}") for t in ("model_results", "test_predictions"))
        manifest["experiment"] = _save(reports.experiment_summary(results), args, "experiment").first().asDict()
        faults += [checks.repeated_keys(results, ["run_id"]), checks.repeated_keys(predictions, ["run_id", "entity_id"]), checks.differing_keys(results, predictions, ["run_id"])]
    if args.lock:
        manifest["packages"] = {r.package: r.version for r in readers.read_lock(spark, args.lock).collect()}
    _reported(spark, args, "manifest", manifest)
    return checks.union(faults)


def _named(text: str):
    """The object behind module:name."""
    module, _, name = text.partition(":")
    return getattr(importlib.import_module(module), name)


def master(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Five raw files to observations with structures, summaries, and targets."""
    raw = harmonise.load_sources(spark, args.raw)
    parsed = adapters.standardize(raw, "original_smiles", _named(args.parser))
    ok = (F.col("structure_status") == "ok") & F.col("log_s").isNotNull()
    obs = parsed.withColumns({"source": F.col("source_dataset"), "value": F.col("log_s"), "eligible": ok, "grp": F.col("group_text")})
    obs = _save(obs, args, "observations")
    _save(resolve.entity_summary(obs, labels=("grp",)), args, "entity_summary")
    validation = _save(reports.source_validation(obs), args, "validation")
    _save(reports.dataset_summary(validation), args, "dataset_summary")
    _save(overlap.source_overlap(obs), args, "source_overlap")
    out = _save(resolve.resolve_targets(obs, labels=("grp", "parent")), args, "targets")
    return checks.union([checks.repeated_keys(obs, ["observation_id"]), checks.repeated_keys(out, ["entity_id"])])


def features(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Descriptors and bit sets of the targets' structures, and what failed."""
    known = readers.read_parquet(spark, args.targets).where("primary").select("entity_id", args.structure)
    compute = _named(args.compute)(radius=args.radius, n_bits=args.bits, chirality=not args.ignore_chirality)
    out = _save(adapters.featurize(known, args.structure, compute), argparse.Namespace(**vars(args) | {"no_csv": True}), "features")
    _save(out.select("entity_id", F.explode("failures").alias("f")).select("entity_id", "f.descriptor", "f.reason"), args, "feature_failures")
    return checks.union([checks.differing_keys(known, out, ["entity_id"]), checks.repeated_keys(out, ["entity_id"]), checks.other_bits(out.where("size(failures) = 0"), args.bits)])


def _experiments(spark: SparkSession, args: argparse.Namespace, targets: DataFrame, assignments: DataFrame) -> experiments.Experiments:
    tables = {name: readers.read_parquet(spark, path) for name, _, path in (f.partition("=") for f in args.features)}
    return experiments.run_experiments(targets, assignments, tables, args.models, args.strategies, args.repeats)


def _published(spark: SparkSession, args: argparse.Namespace, made: experiments.Experiments) -> DataFrame:
    """Write a call's report, then write or append its runs. With failed runs the tables stay as they are, and the faults end the command."""
    report = made.report()
    path = Path(f"{args.output}/report.json")
    path.parent.mkdir(parents=True, exist_ok=True)
    if args.append and path.exists():
        report = writers.merged_report(readers.read_report(path), report)
    writers.write_report(report, str(path))
    faults = made.failures.select(F.concat(F.lit("failed "), "run_id").alias("check"), F.col("reason").alias("detail"))
    if faults.limit(1).count():
        return faults
    for name, table in (("model_results", made.results), ("test_predictions", made.predictions), ("tuning", made.tuning)):
        if args.append:
            writers.append_runs(spark, table, f"{args.output}/{name}")
        else:
            writers.write_table(table, f"{args.output}/{name}")
    return faults


def baselines(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Experiments within splits."""
    made = _experiments(spark, args, readers.read_parquet(spark, args.targets), readers.read_parquet(spark, args.assignments))
    return _published(spark, args, made)


def _known_and_outcomes(results: DataFrame, runs: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """(what is known of each run before the test, with a column for each parameter; its outcomes)."""
    errors = [F.col(f"validation_{c}").alias(f"x_validation_{c}") for c in ("rmse", "mae", "r2", "spearman")]
    known = results.select("run_id", "model", "feature_type", "strategy", "repeat", "seed", *errors, F.col("features_after").alias("x_features_after_preprocessing"), "best_parameters")
    known = known.join(runs.select("run_id", *more), "run_id") if more else known
    known = tasks.json_columns(known, "best_parameters", tasks.json_keys(known, "best_parameters")).drop("best_parameters")
    return known, runs.select("run_id", F.col("rmse").alias("y_rmse"), F.col("mae").alias("y_mae"), F.col("failure_rate_gt_1p0").alias("y_primary_failure_rate"))


def meta_dataset(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The meta table of the runs within splits, with their failure summaries and a data dictionary. A task of which no run may be selected is a fault."""
    labeled = residuals.failure_labels(residuals.with_residuals(readers.read_parquet(spark, f"{args.runs}/test_predictions")), tuple({*args.thresholds, 1.0}))
    labeled = _save(labeled, args, "prediction_failures")
    thresholds = tuple({*args.thresholds, 1.0})
    runs = _save(residuals.run_summary(labeled, thresholds=thresholds), args, "run_summary")
    _save(residuals.group_summary(runs, args.primary_threshold), args, "group_summary")
    _save(residuals.entity_summary(labeled, thresholds), args, "entity_summary")
    descriptors = readers.read_parquet(spark, args.descriptors)
    names = tuple(c for c in descriptors.columns if c != "entity_id")
    results = readers.read_parquet(spark, f"{args.runs}/model_results")
    checks.raise_if_any(checks.differing_keys(results, runs, ["run_id"]), f"{args.output}/incomplete")
    used = readers.read_parquet(spark, args.assignments).join(results.select("strategy", "repeat").distinct(), ["strategy", "repeat"], "left_semi")
    per_task = tasks.task_features(used, readers.read_parquet(spark, args.targets), descriptors, names, strict=True)
    known, outcomes = _known_and_outcomes(results, runs)
    out = _save(tasks.meta_table(known, outcomes, per_task), args, "within_meta")
    _save(tasks.data_dictionary(spark, out), args, "data_dictionary")
    bare = out.groupBy("task_id").agg(F.count_if("selectable").alias("n")).where("n = 0").select(F.lit("no run to select").alias("check"), F.col("task_id").alias("detail"))
    return checks.union([checks.repeated_keys(out, ["run_id"]), bare])


def holdout_runs(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Experiments on hold-out tasks, with failures, group summary by source, and the meta table of all runs there are."""
    rows = readers.read_parquet(spark, args.tasks)
    failed = []
    # A fit side's targets differ between sources: each source is a call of its own.
    for name in sorted(r[0] for r in rows.select("heldout").distinct().collect()):  # a row a source
        own = rows.where(F.col("heldout") == name)
        first = own.where(F.col("repeat") == own.agg(F.min("repeat")).first()[0])
        made = _experiments(spark, args, held.task_inputs(first)[1], own)
        failed.append(_published(spark, args, made))
        args = argparse.Namespace(**vars(args) | {"append": True})
    labeled = residuals.failure_labels(readers.read_parquet(spark, f"{args.output}/test_predictions"))
    runs = residuals.run_summary(labeled, keys=("run_id", "model", "feature_type", "strategy", "repeat", "heldout"))
    _save(held.with_heldout(residuals.group_summary(runs), runs), args, "group_summary")
    descriptors = readers.read_parquet(spark, args.descriptors)
    names = tuple(c for c in descriptors.columns if c != "entity_id")
    each = [rows.where(F.col("heldout") == n) for n in sorted(r[0] for r in rows.select("heldout").distinct().collect())]
    per_task = union([tasks.task_features(held.task_inputs(own)[0], held.task_inputs(own.where("repeat = 1"))[1], descriptors, names) for own in each])
    known, outcomes = _known_and_outcomes(readers.read_parquet(spark, f"{args.output}/model_results"), runs, "heldout")
    source = tasks.rebuilt_meta(known, outcomes, per_task)
    out = _save(source, args, "source_meta")
    if args.base_meta:
        out = _save(tasks.combined_meta(readers.read_parquet(spark, args.base_meta), source), args, "meta")
    _save(tasks.data_dictionary(spark, out), args, "data_dictionary")
    return checks.union([*failed, checks.repeated_keys(out, ["run_id"])])


def external(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """An external trainer's tasks: those that are not finished run, then all are collected."""
    rows = held.task_rows(readers.read_parquet(spark, args.tasks), readers.read_parquet(spark, args.structures), args.structure, args.task_ids, args.task_limit)
    settings = {"epochs": args.epochs, "patience": args.patience, "batch_size": args.batch_size}
    trainer = _named(args.trainer)(settings)
    cache = f"{args.output}/cache"
    external_runs.run_external(rows, trainer, cache, args.force)
    ids = sorted(r[0] for r in rows.select("task_id").distinct().collect())  # a row a task
    sizes = rows.groupBy("task_id").agg(*[F.count_if(F.col("partition") == p).alias(f"n_{p}") for p in ("train", "validation", "test")])
    every = readers.read_parquet(spark, args.tasks).select("task_id").distinct().count()
    made = external_runs.collect_external(spark, trainer, cache, ids, sizes)
    for name, table in zip(external_runs.output_names(args.design, every == len(ids)).values(), made, strict=True):
        _save(table, args, name)
    if args.append_canonical:
        for name, table in zip(("model_results", "test_predictions", "tuning"), made, strict=True):
            writers.append_runs(spark, table, f"{args.append_canonical}/{name}", idempotent=True)
    return checks.repeated_keys(made[0], ["run_id"])


def meta(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Meta models that never see the source they are asked about, their selector, ablations, importances and uncertainty."""
    if args.iterations < 100:
        raise ValueError("at least 100 bootstrap iterations")
    every = readers.read_parquet(spark, args.meta)
    faults = checks.source_meta_faults(every)
    checks.raise_if_any(faults, f"{args.output}/input_faults")
    frame = every.where("selectable")
    scored = _save(meta_models.out_of_source(frame), args, "predictions")
    _save(meta_models.importances(frame), args, "importances")
    ablated = _save(meta_models.ablations(frame), args, "ablation_predictions")
    told = metrics.discrimination(scored.select(F.col("meta_model").alias("model"), F.col("heldout").alias("source"), F.col("y_top").cast("int").alias("label"), "probability"))
    _save(told, args, "discrimination")
    chosen = [selection.selected_candidates(frame, json.loads(args.fixed))]
    for column, table in (("meta_model", scored), ("ablation", ablated)):
        for name in sorted(r[0] for r in table.select(column).distinct().collect()):  # four of each
            own = table.where(F.col(column) == name).select(*frame.columns, "probability")
            order = [F.desc("probability"), F.asc("x_validation_rmse"), F.asc("run_id")]
            chosen.append(selection.select_best(own, ["task_id"], order, f"{column}_{name}").drop("probability"))
    selected = _save(union(chosen), args, "selected_candidates")
    _save(selection.selection_grains(selected), args, "selection")
    _save(bootstrap.cluster_bootstrap(selected, ["selector"], "heldout", "y_regret", args.iterations), args, "uncertainty")
    names = sorted(r[0] for r in selected.select("selector").distinct().collect())  # a row a selector
    learned = [n for n in names if n.startswith("meta_model_")]
    pairs = [(a, b) for a in learned for b in names if b != "oracle" and b not in learned and not b.startswith("ablation_")]
    both = [selection.paired(selected, a, b, "y_regret").withColumns({"candidate": F.lit(a), "comparator": F.lit(b)}) for a, b in pairs]
    _save(bootstrap.paired_bootstrap(union(both), ["candidate", "comparator"], "heldout", iterations=args.iterations), args, "paired_comparisons")
    _save(reports.feature_audit(frame, sorted(c for c in frame.columns if c.startswith("x_"))), args, "feature_audit")
    return checks.repeated_keys(selected, ["selector", "task_id"])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gaugelake", description=__doc__.splitlines()[0])
    sub = top.add_subparsers(dest="step", required=True)

    def step(f, *paths: str) -> argparse.ArgumentParser:
        p = sub.add_parser(f.__name__, help=f"write the tables of {f.__name__}")
        for name in (*paths, "output"):
            p.add_argument(f"--{name}", required=True)
        p.add_argument("--no-csv", action="store_true")
        p.set_defaults(run=f)
        return p

    t = step(targets, "observations")
    for name, value in (("consistent-max", 0.5), ("conflict-min", 1.0), ("review-min", -15.0), ("review-max", 2.5)):
        t.add_argument(f"--{name}", type=float, default=value)
    s = step(split, "targets", "bits")
    s.add_argument("--strategies", nargs="+", default=["random", "group", "low_similarity"])
    h = step(holdouts, "observations")
    h.add_argument("--sources", nargs="+")
    h.add_argument("--bits", help="bit sets of the entities, for similarities")
    for p in (s, h):
        p.add_argument("--seeds", nargs="+", type=int, default=list(splits.SEEDS))
    f = step(failures, "predictions")
    f.add_argument("--thresholds", nargs="+", type=float, default=list(residuals.THRESHOLDS))
    f.add_argument("--primary-threshold", type=float, default=1.0)
    d = step(meta_dataset, "runs", "assignments", "targets", "descriptors")
    d.add_argument("--thresholds", nargs="+", type=float, default=list(residuals.THRESHOLDS))
    d.add_argument("--primary-threshold", type=float, default=1.0)
    c = step(select, "candidates")
    c.add_argument("--fixed", default="{}", help='JSON: selector to [model, feature type]')
    c.add_argument("--iterations", type=int, default=2000)
    step(audit, "external", "observations")
    i = step(inventory, "root")
    i.add_argument("--max-bytes", type=int, default=95_000_000)
    i.add_argument("--include", nargs="*", default=[])
    i.add_argument("--tables", nargs="*", default=[], help="name=path of Parquet tables to count")
    i.add_argument("--runs", help="folder of model_results and test_predictions")
    i.add_argument("--lock", help="a file of package==version lines")
    k = step(import_archive, "archive", "observations", "targets", "internal_bits")
    k.add_argument("--members", required=True, help="JSON: task to [member, rows]")
    k.add_argument("--skip-lines", type=int, default=1)
    k.add_argument("--md5")
    k.add_argument("--url")
    k.add_argument("--bytes", type=int)
    k.add_argument("--force-download", action="store_true")
    k.add_argument("--parser", default="gaugelake.models.structures:parse", help="module:function of a structure's text")
    m = step(master, "raw")
    m.add_argument("--parser", default="gaugelake.models.structures:parse", help="module:function of a structure's text")
    g = step(features, "targets")
    g.add_argument("--structure", default="parent")
    for p in (g, k):
        p.add_argument("--radius", type=int, default=2)
        p.add_argument("--bits", type=int, default=2048)
        p.add_argument("--ignore-chirality", action="store_true")
        p.add_argument("--compute", default="gaugelake.models.structures:features", help="module:function that makes a function of a structure's text")
    b, r = step(baselines, "targets", "assignments"), step(holdout_runs, "tasks", "descriptors")
    for p in (b, r):
        p.add_argument("--features", nargs="+", required=True, help="name=path of each feature table")
        p.add_argument("--models", nargs="+", default=["dummy", "ridge", "random_forest", "extra_trees"])
        p.add_argument("--append", action="store_true")
    b.add_argument("--strategies", nargs="+", default=["random"])
    b.add_argument("--repeats", nargs="+", type=int, default=[1])
    r.set_defaults(strategies=None, repeats=None)
    r.add_argument("--base-meta")
    x = step(external, "tasks", "structures", "trainer")
    x.add_argument("--design", choices=["within", "source"], default="within")
    x.add_argument("--structure", default="parent")
    for name, value in (("epochs", 30), ("patience", 5), ("batch-size", 64)):
        x.add_argument(f"--{name}", type=int, default=value)
    x.add_argument("--task-limit", type=int)
    x.add_argument("--task-ids", nargs="+")
    x.add_argument("--force", action="store_true")
    x.add_argument("--append-canonical", help="folder of the tables to append to")
    q = step(meta, "meta")
    q.add_argument("--fixed", default="{}", help="JSON: selector to [model, feature type]")
    q.add_argument("--iterations", type=int, default=2000)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    faults = args.run(spark or build_session(), args)
    checks.raise_if_any(faults, f"{args.output}/faults")


if __name__ == "__main__":
    main()
