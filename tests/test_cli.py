"""The command line, step by step over one folder."""

import random

import pytest
from pyspark.sql import functions as F

from gaugelake.plans.cli import main


def test_steps_write_their_tables(spark, tmp_path):
    r, out = random.Random(1), str(tmp_path / "out")
    obs = [(f"o{k}", "AB"[k % 2], f"m{k // 2 if k % 5 else k + 500}", r.gauss(-2, 0.3), f"g{k % 9}") for k in range(160)]
    spark.createDataFrame(obs, "observation_id string, source string, entity_id string, value double, grp string").write.parquet(str(tmp_path / "obs"))
    main(["targets", "--observations", str(tmp_path / "obs"), "--output", out], spark)
    known = spark.read.parquet(f"{out}/targets").withColumn("grp", F.substring("entity_id", -1, 1))
    known.write.parquet(str(tmp_path / "targets"))
    known.select("entity_id", F.array(F.length("entity_id"), F.ascii(F.substring("entity_id", -1, 1))).alias("bits")).write.parquet(str(tmp_path / "bits"))
    main(["split", "--targets", str(tmp_path / "targets"), "--bits", str(tmp_path / "bits"), "--output", out, "--seeds", "13", "--no-csv"], spark)
    assert spark.read.parquet(f"{out}/split_quality").count() == 9
    main(["holdouts", "--observations", str(tmp_path / "obs"), "--output", out, "--seeds", "1", "2", "--no-csv"], spark)
    p = [(f"{s}_{m}", m, "f", s, 1, f"e{k}", r.random(), r.random()) for s in ("s1", "s2") for m in ("x", "y") for k in range(10)]
    preds = spark.createDataFrame(p, "run_id string, model string, feature_type string, strategy string, repeat int, entity_id string, truth double, predicted double")
    preds.write.parquet(str(tmp_path / "preds"))
    main(["failures", "--predictions", str(tmp_path / "preds"), "--output", out, "--no-csv"], spark)
    runs = spark.read.parquet(f"{out}/run_summary")
    runs.select("run_id", F.col("strategy").alias("task_id"), F.col("strategy").alias("heldout"), F.col("model").alias("x_model"), F.col("feature_type").alias("x_feature_type"), F.col("mae").alias("x_validation_rmse"), F.col("rmse").alias("y_rmse"), F.lit(True).alias("selectable")).write.parquet(str(tmp_path / "cand"))
    main(["select", "--candidates", str(tmp_path / "cand"), "--output", out, "--fixed", '{"fixed_x": ["x", "f"]}', "--iterations", "20", "--no-csv"], spark)
    assert {x.selector for x in spark.read.parquet(f"{out}/selection").collect()} == {"validation_rmse", "oracle", "training_source_best", "fixed_x"}
    ext = spark.createDataFrame([("x", "m1", "t", 1.0), ("x", "zz", "t", 2.0)], "external_id string, entity_id string, task string, value double")
    ext.write.parquet(str(tmp_path / "ext"))
    with pytest.raises(ValueError, match="repeated external_id"):
        main(["audit", "--external", str(tmp_path / "ext"), "--observations", str(tmp_path / "obs"), "--output", out, "--no-csv"], spark)
    assert spark.read.parquet(f"{out}/exclusions").count() == 1 and spark.read.json(f"{out}/faults").count() == 1
    main(["inventory", "--root", str(tmp_path / "ext"), "--output", out, "--no-csv"], spark)


def parse_text(text):
    if text.startswith("?"):
        raise ValueError(text)
    return {"canonical": text, "parent": text, "parent_key": f"K{text}", "group_text": text[:1], "charge": 0, "heavy_atoms": len(text), "weight": 1.0}


def make_compute(radius, n_bits, chirality):
    return lambda text: ([float(len(text))], sorted({ord(c) % n_bits for c in text}), [])


def test_import_and_manifest(spark, tmp_path):
    import hashlib
    import json
    import sys

    from test_sources import _tar

    sys.modules["gl_stand_in"] = sys.modules[__name__]
    out, archive = str(tmp_path / "out"), tmp_path / "set.tar.gz"
    head = b"made by hand\nID,Name,SMILES,Solubility\n"
    _tar(archive, {"d/tight.csv": head + b"1,a,CCO,-1\n2,b,NNN,-2\n", "d/loose.csv": head + b"3,c,CO,-3\n", "d/broken.csv": head + b"4,d,?,-3\n"})
    spark.createDataFrame([("o1", "A", "KCCO", -1.1), ("o2", "B", "KCCO", -1.3), ("o3", "A", "KOO", 0.0)], "observation_id string, source string, entity_id string, value double").write.parquet(str(tmp_path / "obs"))
    spark.createDataFrame([("KCCO", True), ("KOO", True), ("KCO", False)], "entity_id string, primary boolean").write.parquet(str(tmp_path / "targets"))
    spark.createDataFrame([("KCCO", [3, 15]), ("KOO", [15]), ("KCO", [3])], "entity_id string, bits array<int>").write.parquet(str(tmp_path / "bits"))
    run = ["import_archive", "--archive", str(archive), "--observations", str(tmp_path / "obs"), "--targets", str(tmp_path / "targets"), "--internal_bits", str(tmp_path / "bits"), "--output", out]
    run += ["--parser", "gl_stand_in:parse_text", "--compute", "gl_stand_in:make_compute", "--bits", "64", "--md5", hashlib.md5(archive.read_bytes()).hexdigest(), "--members"]
    main([*run, '{"tight": ["d/tight.csv", 2], "loose": ["d/loose.csv", 1]}'], spark)
    found = {r.external_id: r for r in spark.read.parquet(f"{out}/overlap_audit").collect()}
    assert (found["1"].in_internal, found["1"].internal_sources, found["1"].in_targets, found["1"].nearest_is_equal, found["1"].nearest_target) == (True, 2, True, True, "KCCO")
    assert (found["2"].in_internal, found["2"].max_similarity, found["2"].nearest_target) == (False, 0.0, "KCCO") and (found["3"].in_targets, found["3"].nearest_is_equal, found["3"].nearest_target) == (False, True, "KCCO")
    assert "value" not in spark.read.parquet(f"{out}/inputs").columns and spark.read.parquet(f"{out}/labels").count() == 3
    assert [r.external_ids for r in spark.read.parquet(f"{out}/exclusions").collect()] == ["1"] and spark.read.parquet(f"{out}/task_summary").count() == 2
    assert json.loads((tmp_path / "out/import_report.json").read_text())["external"] == {"rows": 3, "known": 1, "in_targets": 1, "nearest_is_equal": 2}
    with pytest.raises(ValueError, match="structure not parsed: 4"):
        main([*run, '{"bad": ["d/broken.csv", 1]}'], spark)
    runs = tmp_path / "runs"
    spark.createDataFrame([("r1", "m", "f", "random", 1), ("r2", "n", "f", "random", 1)], "run_id string, model string, feature_type string, strategy string, repeat int").write.parquet(str(runs / "model_results"))
    spark.createDataFrame([("r1", "e1"), ("r2", "e1"), ("r1", "e2")], "run_id string, entity_id string").write.parquet(str(runs / "test_predictions"))
    (tmp_path / "lock.txt").write_text("b==2\n# a==1\nA==1.0\n")
    step = ["inventory", "--root", str(tmp_path / "obs"), "--output", out, "--tables", f"results={runs}/model_results", f"obs={tmp_path}/obs", "--runs", str(runs), "--lock", str(tmp_path / "lock.txt")]
    main(step, spark)
    flat = {r.metric: r.value for r in spark.read.parquet(f"{out}/manifest").collect()}
    assert flat["tables.results.rows"] == "2" and flat["tables.obs.columns"] == "4" and flat["experiment.models"] == "2" and flat["packages.A"] == "1.0" and int(flat["checksums.files"]) >= 2
    spark.createDataFrame([("r9", "e1")], "run_id string, entity_id string").write.mode("append").parquet(str(runs / "test_predictions"))
    with pytest.raises(ValueError, match="only on the right: r9"):
        main(step, spark)


def test_commands_from_raw_files_to_meta_models(spark, tmp_path):
    import sys

    sys.modules["gl_stand_in"] = sys.modules[__name__]
    r, raw, out = random.Random(4), tmp_path / "raw", str(tmp_path / "out")
    raw.mkdir()
    names = [f"{a}{b}{c}" for a in "CNOS" for b in "abcde" for c in "vwxyz"]
    value = {n: -6 + ord(n[0]) / 20 + ord(n[2]) / 50 for n in names}
    share = lambda k: [n for i, n in enumerate(names) if i % 5 != k]
    line = lambda n: round(value[n] + r.gauss(0, 0.05), 3)
    (raw / "AqSolDB.csv").write_text("ID,SMILES,Solubility\n" + "".join(f"{n},{n},{line(n)}\n" for n in names[:40]) + "bad,?,1\n")
    (raw / "Delaney.csv").write_text("Compound ID,smiles,measured log solubility in mols per litre\n" + "".join(f"{n},{n},{line(n)}\n" for n in names[30:70]))
    (raw / "aqua_org.csv").write_text("smiles,logS\n" + "".join(f"{n},{line(n)}\n" for n in names[60:]))
    (raw / "phys_org.csv").write_text("smiles,logS\n" + "".join(f"{n},{line(n)}\n" for n in share(0)[:30]))
    (raw / "ochem_all.csv").write_text('SMILES,"Water solubility {measured, converted}"\n' + "".join(f"{n},{-line(n)}\n" for n in share(1)[40:]))
    main(["master", "--raw", str(raw), "--output", out, "--parser", "gl_stand_in:parse_text", "--no-csv"], spark)
    targets = spark.read.parquet(f"{out}/targets")
    assert targets.count() == 100 and spark.read.parquet(f"{out}/observations").where("structure_status = 'invalid_smiles'").count() == 1 and spark.read.parquet(f"{out}/dataset_summary").count() > 20
    main(["features", "--targets", f"{out}/targets", "--output", out, "--bits", "64", "--compute", "gl_stand_in:make_compute", "--no-csv"], spark)
    made = spark.read.parquet(f"{out}/features")
    dense = made.select("entity_id", F.ascii(F.substring("entity_id", 2, 1)).cast("double").alias("f1"), F.ascii(F.substring("entity_id", 4, 1)).cast("double").alias("f2"))
    dense.write.parquet(str(tmp_path / "dense"))
    made.select("entity_id", "bits").write.parquet(str(tmp_path / "bits"))
    main(["split", "--targets", f"{out}/targets", "--bits", str(tmp_path / "bits"), "--output", out, "--seeds", "13", "--strategies", "random", "--no-csv"], spark)
    table = f"rdkit_descriptors={tmp_path / 'dense'}"
    within = ["baselines", "--targets", f"{out}/targets", "--assignments", f"{out}/split_assignments", "--features", table, "--output", f"{out}/within"]
    main([*within, "--models", "dummy", "ridge"], spark)
    main([*within, "--models", "knn", "--append"], spark)
    assert spark.read.parquet(f"{out}/within/model_results").count() == 3
    with pytest.raises(ValueError, match="already"):
        main([*within, "--models", "knn", "--append"], spark)
    main(["meta_dataset", "--runs", f"{out}/within", "--assignments", f"{out}/split_assignments", "--targets", f"{out}/targets", "--descriptors", str(tmp_path / "dense"), "--output", f"{out}/within", "--no-csv"], spark)
    table_of = spark.read.parquet(f"{out}/within/within_meta")
    assert table_of.count() == 3 and table_of.where("y_rank = 1").count() == 1 and {"x_fit_target_median", "x_test_similarity_p10", "x_shift_f1_smd", "x_hp_alpha"} <= set(table_of.columns)
    assert table_of.where("x_model = 'dummy' AND (y_rank IS NOT NULL OR selectable)").count() == 0 and spark.read.parquet(f"{out}/within/data_dictionary").count() == len(table_of.columns)
    main(["holdouts", "--observations", f"{out}/observations", "--bits", str(tmp_path / "bits"), "--output", out, "--seeds", "1", "--sources", "AqSolDB", "Delaney", "AQUA", "--no-csv"], spark)
    assert spark.read.parquet(f"{out}/holdout_summary").count() == 3
    runs = ["holdout_runs", "--tasks", f"{out}/holdout_tasks", "--descriptors", str(tmp_path / "dense"), "--features", table, "--output", f"{out}/held", "--models", "dummy", "ridge", "knn", "elastic_net", "hist_gradient_boosting", "--no-csv"]
    main(runs, spark)
    meta = spark.read.parquet(f"{out}/held/source_meta")
    assert meta.count() == 15 and meta.where("y_top = 1").count() == 9 and spark.read.parquet(f"{out}/held/group_summary").where("heldout IS NULL").count() == 0
    main(["meta", "--meta", f"{out}/held/source_meta", "--output", f"{out}/meta", "--iterations", "100", "--fixed", '{"fixed_ridge": ["ridge", "rdkit_descriptors"]}', "--no-csv"], spark)
    selectors = {x.selector for x in spark.read.parquet(f"{out}/meta/selected_candidates").collect()}
    assert {"oracle", "fixed_ridge", "meta_model_logistic", "meta_model_bayesian_logistic_laplace", "ablation_hgb_full"} <= selectors and spark.read.parquet(f"{out}/meta/importances").count() > 30
    pairs = {(x.candidate, x.comparator) for x in spark.read.parquet(f"{out}/meta/paired_comparisons").collect()}
    assert ("meta_model_logistic", "fixed_ridge") in pairs and len(pairs) == 4 * 3 and spark.read.parquet(f"{out}/meta/feature_audit").where("feature = 'x_model'").first().distinct_values == 4
    with pytest.raises(ValueError, match="100"):
        main(["meta", "--meta", f"{out}/held/source_meta", "--output", f"{out}/meta", "--iterations", "10"], spark)
    sys.modules["gl_trainer"] = __import__("test_experiments")
    main(["external", "--tasks", f"{out}/holdout_tasks", "--structures", f"{out}/targets", "--trainer", "gl_trainer:make_trainer", "--output", f"{out}/program", "--task-limit", "1", "--no-csv"], spark)
    assert spark.read.parquet(f"{out}/program/within_results_partial").count() == 1
