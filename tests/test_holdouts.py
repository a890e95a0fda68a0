"""Hold-out tasks with rebuilt targets, checks of meta tables, harmonised sources and structures by a stand-in."""

import pytest
from pyspark.sql import functions as F

from gaugelake.functions.columns import slug_or_error, threshold_name, utc_now
from gaugelake.models import structures
from gaugelake.operators import checks, holdouts, metrics, ranks, reports, similarity, tasks
from gaugelake.sources import harmonise, readers, writers

OBS = "observation_id string, source string, entity_id string, value double, grp string"


@pytest.fixture(scope="module")
def obs(spark):
    rows = [(f"o{k}", "AB"[k % 2], f"m{k}", float(k % 9) - 6, f"g{k % 5}") for k in range(80)]
    rows += [("x", "A", "shared", -1.0, "g1"), ("y", "B", "shared", -1.2, "g1"), ("z", "A", None, -1.0, "g1"), ("w", "B", "far", 9.0, "g2"), ("v", "B", "far", 9.1, "g2"), ("u", "A", "torn", -1.0, None), ("t", "A", "torn", -5.0, None)]
    return spark.createDataFrame(rows, OBS).cache()


def test_targets_are_rebuilt_on_either_side(obs):
    t = {(r.heldout, r.side, r.entity_id): r for r in holdouts.source_targets(obs).collect()}
    assert t["A", "test", "shared"].target == -1.0 and ("A", "fit", "shared") not in t and t["B", "test", "shared"].target == -1.2
    assert t["A", "fit", "far"].outside_review and t["A", "test", "torn"].conflict and t["A", "fit", "m1"].origin == "nonheldout_sources_only"
    audit = {r.heldout: r for r in holdouts.target_audit(obs, holdouts.source_targets(obs)).collect()}
    assert (audit["A"].heldout_rows, audit["A"].test_targets_before_filter, audit["A"].test_targets_in_conflict, audit["A"].fit_targets_before_filter) == (44, 42, 1, 41)
    with pytest.raises(ValueError, match="no observations"):
        holdouts.source_targets(obs, ["C"])


def test_tasks_are_whole(spark, obs):
    bits = obs.where("entity_id IS NOT NULL").groupBy("entity_id").agg(F.collect_set((F.abs(F.hash("entity_id")) % 7).cast("int")).alias("bits"))
    made = holdouts.source_holdout_tasks(obs, bits, seeds=(1, 2), group="grp").cache()
    assert checks.holdout_faults(made).collect() == []
    sizes = {(r.task_id, r.partition): r["count"] for r in made.groupBy("task_id", "partition").count().collect()}
    assert abs(sizes["source_holdout_a_r1", "train"] - 36) <= 1 and sizes["source_holdout_a_r1", "test"] == 41
    assert made.where("partition = 'train' AND repeat = 1").exceptAll(made.where("partition = 'train' AND repeat = 2")).count() > 0
    summary = {r.task_id: r for r in holdouts.holdout_summary(made).collect()}
    assert summary["source_holdout_b_r2"].test_entities == sizes["source_holdout_b_r2", "test"] and 0 <= summary["source_holdout_b_r2"].test_similarity_min <= 1
    for broken, what in ((made.withColumn("origin", F.lit("heldout_source_only")), "origin"), (made.withColumn("max_similarity", F.lit(0.5)), "similarity"), (made.where("NOT (partition = 'test' AND repeat = 2 AND entity_id = 'm2')"), "changes")):
        assert any(what in r.check for r in checks.holdout_faults(broken).collect())
    assignments, targets = holdouts.task_inputs(made)
    assert assignments.columns == list(holdouts.ASSIGNMENT) and targets.columns == list(holdouts.TARGET)
    with pytest.raises(ValueError, match="no bits"):
        holdouts.source_holdout_tasks(obs, bits.where("entity_id <> 'm2'"), seeds=(1,))


def test_no_growing_table_goes_to_the_driver(obs, monkeypatch):
    """Small as all tables are here, only those that are broadcast by name are: a work table's compressed size says little of its rows."""
    faults, real = [], holdouts.written

    def planned(df, what, **seen):
        plan = df._jdf.queryExecution()
        if plan.executedPlan().toString().count("BroadcastHashJoin") > plan.optimizedPlan().toString().count("strategy=broadcast"):
            faults.append(what)
        return real(df, what, **seen)

    for module in (holdouts, metrics, ranks, similarity):
        monkeypatch.setattr(module, "written", planned)
    bits = obs.where("entity_id IS NOT NULL").groupBy("entity_id").agg(F.collect_set((F.abs(F.hash("entity_id")) % 7).cast("int")).alias("bits"))
    monkeypatch.setattr(similarity, "SUBSET_COST", 0)  # small sets meet in their subsets, as large tables do
    planned(holdouts.source_holdout_tasks(obs, bits, seeds=(1, 2), group="grp"), "tasks")
    assert faults == []


def _meta(spark, more=()):
    rows = [(f"r{s}{k}", f"t{s}", s, True, m, 0.1 * k, 1.0 + k, int(k < 3)) for s in "ABC" for k, m in enumerate(("svr", "knn", "mlp", "ridge"))]
    return spark.createDataFrame([*rows, *more], "run_id string, task_id string, heldout string, selectable boolean, x_model string, y_regret double, y_rmse double, y_top int").withColumn("y_near_best", F.lit(1))


def test_meta_tables_are_checked_and_combined(spark):
    good = _meta(spark)
    assert checks.source_meta_faults(good).collect() == []
    for bad, what in ((_meta(spark, [("rA0", "tD", "D", True, "svr", 0.0, 1.0, 1)]), "repeated"), (good.where("heldout <> 'C'"), "too few"), (good.withColumn("y_top", F.lit(1)), "number of top"), (good.withColumn("y_rmse", F.lit(None).cast("double")), "missing y_rmse"), (good.withColumn("task_id", F.lit("t")), "several sources")):
        assert any(what in r.check for r in checks.source_meta_faults(bad).collect())
    base = good.withColumn("run_id", F.concat(F.lit("w"), "run_id")).drop("heldout")
    both = tasks.combined_meta(base, good)
    assert both.columns[:4] == ["run_id", "task_id", "heldout", "selectable"] and both.where("heldout = 'not_applicable'").count() == 12
    with pytest.raises(ValueError, match="both designs"):
        tasks.combined_meta(good, good)
    told = {r.column: r for r in tasks.data_dictionary(spark, both).collect()}
    assert told["y_top"].uses_test_targets and told["x_model"].recommended and told["x_evaluation_design"].description and told["run_id"].role == "identifier"
    per = spark.createDataFrame([("s", 1, 1, "s_r1", 5)], "strategy string, repeat int, seed int, task_id string, x_test_entities int")
    results = spark.createDataFrame([("a", "svr", "f", "s", 1, 1), ("b", "knn", "f", "s", 1, 1)], "run_id string, model string, feature_type string, strategy string, repeat int, seed int")
    outcomes = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "run_id string, y_rmse double")
    assert {r.run_id: r.y_rank for r in tasks.rebuilt_meta(results, outcomes, per).collect()} == {"a": 2, "b": 1}
    with pytest.raises(ValueError, match="incomplete"):
        tasks.rebuilt_meta(results, outcomes.limit(1), per)


def test_small_checks(spark):
    bits = spark.createDataFrame([("a", [0, 3]), ("b", [0, 0]), ("c", [9]), ("d", None)], "entity_id string, bits array<int>")
    assert {r.detail for r in checks.other_bits(bits, 8).collect()} == {"b", "c", "d"}
    wide = spark.createDataFrame([("a", 0, 1), ("b", 2, 1), ("c", 1, None)], "entity_id string, p int, q int")
    assert sorted(tuple(r) for r in checks.other_values(wide, "entity_id", ["p", "q"]).collect()) == [("p is not binary", "b"), ("q is not binary", "c")]
    assert [r.entity_id for r in checks.ordered_entities(wide.orderBy(F.desc("p")), ["p"]).collect()] == ["a", "b", "c"]
    with pytest.raises(ValueError, match="nulls"):
        checks.ordered_entities(wide, ["q"])
    with pytest.raises(ValueError, match="repeated"):
        checks.ordered_entities(wide.union(wide.limit(1)), ["p"])
    assert reports.flatten_report({"a": [1, {"b": 2}], "c": [[1, 2], [3]], "d": [], "e": {}, "f": {"g": "x"}}) == [("a", 1), ("a.1.b", 2), ("c", 1), ("c", 2), ("c", 3), ("d", "[]"), ("f.g", "x")]
    records = spark.createDataFrame([("r1", 1, "old"), ("r1", 2, "new"), ("r2", 1, "x")], "run_id string, n int, reason string")
    assert {r.reason for r in reports.last_records(records, "run_id", "n").collect()} == {"new", "x"}
    assert spark.range(1).select(utc_now().alias("t")).first().t.endswith("+00:00") and threshold_name(0.5) == "q_abs_error_gt_0p5"
    with pytest.raises(Exception, match="no letter"):
        spark.createDataFrame([("!!",)], "s string").select(slug_or_error(F.col("s"))).collect()
    runs = spark.createDataFrame([("r", "s1", "A"), ("q", "s1", "B")], "run_id string, strategy string, heldout string")
    with pytest.raises(ValueError, match="several sources"):
        holdouts.with_heldout(spark.createDataFrame([("s1", 1)], "strategy string, n int"), runs)
    assert holdouts.with_heldout(spark.createDataFrame([("s1", 1)], "strategy string, n int"), runs.limit(1)).first().heldout == "A"
    flat = reports.dataset_summary(spark.createDataFrame([("A", 3, 1.5)], "source string, n int, value_min double")).collect()
    assert {(r.source, r.metric, r.value) for r in flat} == {("A", "n", 3.0), ("A", "value_min", 1.5)}


def test_raw_files_are_harmonised(spark, tmp_path):
    (tmp_path / "AqSolDB.csv").write_text("ID,Name,SMILES,InChI,InChIKey,Solubility,SD,Ocurrences,Group\nA-1,water,O,I,K,-1.5,0.1,3,G1\nA-2,x,C,,,none,,,\n")
    (tmp_path / "Delaney.csv").write_text("Compound ID,measured log solubility in mols per litre,ESOL predicted log solubility in mols per litre,smiles\nethane,-0.5,-0.7, CC \n")
    for name in ("aqua_org.csv", "phys_org.csv"):
        (tmp_path / name).write_text("smiles,logS\nC,-3\n")
    head = "SMILES,CASRN,EXTERNALID,NAME,Water solubility {measured},UNIT {Water solubility},\"Water solubility {measured, converted}\",Temperature,UNIT {Temperature}"
    (tmp_path / "ochem_all.csv").write_bytes((head + "\nCC,1-2,E9,n\xe4me,10,mg/L,2.5,25,C\nCCC,3-4,,x,5,mg/L,-1,,\nCCCC,,,y,5,mg/L,bad,,\n").encode("latin-1"))
    got = {r.observation_id: r for r in harmonise.load_sources(spark, str(tmp_path), {"AqSolDB": 2}).collect()}
    assert list(next(iter(got.values())).asDict()) == harmonise.COLUMNS and len(got) == 8
    a, o = got["AqSolDB:0000001"], [got[f"OCHEM:000000{k}"] for k in (1, 2, 3)]
    assert (a.log_s, a.measurement_sd, a.replicate_count, a.source_record_id, a.conversion_rule) == (-1.5, 0.1, 3.0, "A-1", "identity") and got["AqSolDB:0000002"].log_s is None
    assert (got["Delaney:0000001"].original_smiles, got["Delaney:0000001"].reference_prediction, got["AQUA:0000001"].source_record_id) == ("CC", -0.7, "AQUA-0000001")
    assert [(x.log_s, x.source_record_id) for x in o] == [(-2.5, "E9"), (1.0, "3-4"), (None, "OCHEM-0000003")]
    assert (o[0].molecule_name, o[0].temperature, o[0].target_original_unit, o[0].target_original_value) == ("n\xe4me", 25.0, "mg/L", "10")
    with pytest.raises(ValueError, match="rows"):
        harmonise.load_sources(spark, str(tmp_path), {"AqSolDB": 3})
    assert set(harmonise.HARMONISERS) == {"AqSolDB", "Delaney", "AQUA", "PHYSPROP", "OCHEM"}


class _Atom:
    def __init__(self, aromatic):
        self.aromatic = aromatic

    def GetIsAromatic(self):  # noqa: N802
        return self.aromatic


class _Molecule:
    def __init__(self, text):
        self.text = text

    def GetNumHeavyAtoms(self):  # noqa: N802
        return len(self.text)

    def GetAtoms(self):  # noqa: N802
        return [_Atom(c.islower()) for c in self.text]

    def GetOnBits(self):  # noqa: N802
        return [0, len(self.text)]


class _Tool:
    _descList = [("n", lambda m: len(m.text)), ("bad", lambda m: 1 / 0)]  # noqa: N815, RUF012
    MolFromSmiles = staticmethod(lambda t: None if t == "?" else _Molecule(t if t != "H" else ""))  # noqa: N815
    MolToSmiles = staticmethod(lambda m: m.text)
    MolToInchiKey = staticmethod(lambda m: 1 / 0)
    GetFormalCharge = staticmethod(lambda m: 0)
    FragmentParent = staticmethod(lambda m: _Molecule(m.text.split(".")[0]))
    MurckoScaffoldSmiles = staticmethod(lambda mol: "c" if "c" in mol.text else "")
    MolWt = staticmethod(lambda m: 10.0 * len(m.text))
    GenMACCSKeys = staticmethod(lambda m: m)
    GetMorganGenerator = staticmethod(lambda radius, fpSize, includeChirality: _Tool())  # noqa: N803
    GetFingerprint = staticmethod(lambda m: m)


TOOLS = dict.fromkeys(("chem", "descriptors", "keys", "fingerprints", "standardize", "scaffolds"), _Tool)


def test_structures_by_a_stand_in():
    assert structures.parse("Ccc.O", TOOLS) == {"canonical": "Ccc.O", "parent": "Ccc", "parent_key": None, "group_text": "c", "charge": 0, "heavy_atoms": 3, "weight": 30.0}
    assert structures.features(tools=TOOLS)("Cc") == ([2.0, None], [0, 2], [("bad", "division by zero")]) and structures.features(kind="maccs", tools=TOOLS)("C")[1] == [0, 1]
    assert structures.aromatic_proportion("CCcc", TOOLS) == 0.5 and structures.aromatic_proportion("H", TOOLS) == 0.0
    for f in (lambda: structures.parse("?", TOOLS), lambda: structures.features(tools=TOOLS)("?"), lambda: structures.aromatic_proportion("?", TOOLS)):
        with pytest.raises(ValueError, match="no structure"):
            f()
    with pytest.raises(RuntimeError, match="RDKit"):
        structures.library()


def test_files_and_reports(spark, tmp_path):
    source = tmp_path / "a.bin"
    source.write_bytes(b"12345")
    target, digest = tmp_path / "d/b.bin", readers.file_digest(source)
    assert readers.download(source.as_uri(), str(target), 5, digest).read_bytes() == b"12345"
    source.write_bytes(b"other")
    assert readers.download(source.as_uri(), str(target), 5, digest).read_bytes() == b"12345"
    with pytest.raises(ValueError, match="MD5"):
        readers.download(source.as_uri(), str(target), 5, digest, force=True)
    assert target.read_bytes() == b"12345" and not list(target.parent.glob("*.part")) and readers.path_size(spark, str(tmp_path)) >= 10
    a = {"status": "pass", "completed_runs": 2, "requested_models": ["svr"], "skipped_runs": [{"run_id": "a", "reason": "old"}], "failed_runs": []}
    b = {"status": "fail", "completed_runs": 1, "requested_models": ["knn"], "skipped_runs": [{"run_id": "a", "reason": "new"}], "failed_runs": [{"run_id": "z", "reason": "x"}]}
    merged = writers.merged_report(a, b)
    assert merged["completed_runs"] == 3 and merged["status"] == "fail" and merged["skipped_runs"] == [{"run_id": "a", "reason": "new"}] and merged["requested_models"] == ["knn", "svr"]
    for name, ids in (("s1", [3, 1]), ("s2", [2])):
        spark.createDataFrame([(i,) for i in ids], "k int").write.parquet(str(tmp_path / name))
    both = [str(tmp_path / "s1"), str(tmp_path / "s2")]
    assert [r.k for r in readers.read_shards(spark, both, order=["k"], unique=["k"]).collect()] == [1, 2, 3]
    with pytest.raises(ValueError, match="repeated k"):
        readers.read_shards(spark, [*both, both[0]], unique=["k"])
    with pytest.raises(ValueError, match="unfinished"):
        readers.read_shards(spark, [str(tmp_path / "d")])
