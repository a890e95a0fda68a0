"""Resolution, unification and overlap on hand-made rows."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from gaugelake.functions.columns import esol, finite_or_null, number_or_null, slug, threshold_name
from gaugelake.operators import checks, overlap, resolve, unify

OBS = "observation_id string, source string, entity_id string, value double, eligible boolean, grp string"


@pytest.fixture
def obs(spark):
    rows = [
        ("o1", "A", "single", -2.0, True, "g"), ("o2", "A", "close", -1.0, True, None), ("o3", "B", "close", -1.4, True, "g2"), ("o4", "B", "near", 0.0, True, "g"), ("o5", "A", "near", 0.8, True, "g"),
        ("o6", "A", "far", 0.0, True, "g"), ("o7", "C", "far", 1.5, True, "g"), ("o8", "A", "low", -20.0, True, "g"), ("o9", "A", "far", float("nan"), True, "g"), ("p1", "A", "far", float("inf"), True, "g"),
        ("p2", "A", "single", 9.0, False, "g"), ("p3", "A", "single", 9.0, None, "g"), ("p4", "A", None, 1.0, True, "g"), ("p5", None, "close", None, True, "g"),
    ]
    return spark.createDataFrame(rows, OBS)


def test_targets_classes_and_reasons(obs):
    got = {r.entity_id: r for r in resolve.resolve_targets(obs, labels=("grp",), counted=("grp",)).collect()}
    assert {k: v.reliability for k, v in got.items()} == {"single": "single_observation", "close": "consistent", "near": "moderate", "far": "conflict", "low": "single_observation"}
    assert {k: v.exclusion_reason for k, v in got.items()} == {"single": "included", "close": "included", "near": "included", "far": "conflict", "low": "outside_review"}
    close = got["close"]
    assert (close.target, close.sources, close.n_sources, close.grp, close.n_with_grp) == (-1.2, "A|B", 2, "g2", 1)
    assert close.value_mad == pytest.approx(0.2) and close.value_q25 == pytest.approx(-1.3) and got["single"].value_sd is None
    assert got["far"].n_observations == 2 and not got["far"].primary
    assert sum(r.n_observations for r in got.values()) == resolve.eligible(obs).count()


def test_thresholds_are_checked(obs):
    for bad in ({"consistent_max": -1}, {"conflict_min": 0.1}, {"review_min": 3.0}):
        with pytest.raises(ValueError, match="thresholds"):
            resolve.resolve_targets(obs, **bad)
    with pytest.raises(ValueError, match="missing columns"):
        resolve.resolve_targets(obs.drop("value"))


def test_summary_and_reports(obs):
    targets = resolve.resolve_targets(obs)
    got = {r.reliability: r for r in resolve.reliability_summary(targets).collect()}
    assert got["single_observation"].entities == 2 and got["single_observation"].percent == pytest.approx(40.0)
    assert {(r.kind, r.value): r.entities for r in resolve.target_report(targets).collect()}["exclusion_reason", "included"] == 3
    summary = {r.entity_id: r for r in resolve.entity_summary(obs.withColumn("flag", F.col("observation_id") == "o7"), flags=("flag",)).collect()}
    assert summary["far"].conflict and summary["far"].any_flag and not summary["near"].conflict


def test_overlap_keeps_pairs_that_share_nothing(obs):
    got = {(r.source_left, r.source_right): (r.shared, r.percent_of_smaller) for r in overlap.source_overlap(obs).collect()}
    assert got == {("A", "B"): (2, 100.0), ("A", "C"): (1, 100.0), ("B", "C"): (0, 0.0)}


def test_holdout_and_audit(spark, obs):
    held = spark.createDataFrame([("A", "single"), ("A", "far"), ("A", None)], "heldout string, entity_id string")
    rest = obs.withColumn("heldout", F.lit("A"))
    assert {r.entity_id for r in overlap.without_entities_of(rest, held).collect()} == {"close", "near", "low", None}
    external = spark.createDataFrame([("x1", "far", "t", 1.0), ("x2", "far", "t", 2.0), ("x3", "new", "t", 3.0)], "external_id string, entity_id string, task string, value double")
    audit = overlap.overlap_audit(external, obs)
    assert {r.external_id: (r.in_internal, r.internal_observations, r.internal_source_names) for r in audit.collect()} == {"x1": (True, 4, "A;C"), "x2": (True, 4, "A;C"), "x3": (False, 0, "")}
    assert [(r.entity_id, r.external_ids, r.external_rows) for r in overlap.exclusion_list(audit).collect()] == [("far", "x1;x2", 2)]
    assert {r.external_id: r.there for r in overlap.existence(external, obs, "there").collect()} == {"x1": True, "x2": True, "x3": False}
    assert overlap.restricted_to(obs, external).count() == 4


def test_unify_fills_what_is_missing(spark):
    schema = StructType([StructField("source", StringType()), StructField("record_id", StringType()), StructField("text", StringType()), StructField("value", DoubleType())])
    odd = spark.createDataFrame([(1, " ", "C", "1.5"), (2, "7", None, "x")], "n int, id string, `CAS{a,b}.1` string, `v.x` string")
    made = unify.conform(odd, schema, unify.Mapping("S", {"record_id": lambda d: unify.first_filled(F.col("id")), "text": "CAS{a,b}.1", "value": lambda d: -number_or_null(F.col("`v.x`"))}, row_col="n"))
    assert [tuple(r) for r in made.orderBy("n" if "n" in made.columns else "record_id").collect()] == [("S", "7", None, None), ("S", "S:0000001", "C", -1.5)]
    assert unify.union_loose([odd.select("n"), odd.select("n", "id")]).count() == 4
    wide = spark.createDataFrame([(1, 2, 3, 4)], "y_b int, x_b int, run_id int, x_a int")
    assert unify.by_role(wide, ["run_id"]).columns == ["run_id", "x_a", "x_b", "y_b"]
    inputs, labels = unify.without_outcome(wide, "y_b", ["run_id"])
    assert "y_b" not in inputs.columns and labels.first().locked_for_model_selection


def test_columns(spark):
    row = spark.range(1).select(slug(F.lit(" A-b  C! ")).alias("s"), finite_or_null(F.lit(float("inf"))).alias("i"), finite_or_null(F.lit(2.0)).alias("f"), number_or_null(F.lit("x")).alias("x"), esol(F.lit(2.0), F.lit(100.0), F.lit(2.0), F.lit(0.5)).alias("e")).first()
    assert (row.s, row.i, row.f, row.x) == ("a_b_c", None, 2.0, None) and row.e == pytest.approx(-3.59)
    assert threshold_name(0.5) == "q_abs_error_gt_0p5"


def test_checks_name_what_is_wrong(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, None, 3.0), (2, "c", 4.0), (3, "d", 5.0)], "k int, c string, v double")
    assert [r.detail for r in checks.repeated_keys(df, ["k"]).orderBy("detail").collect()] == ["1", "2"]
    assert {r.detail for r in checks.inconsistent(df, "k", ["c"]).collect()} == {"1", "2"}
    assert checks.differing_keys(df, df.where("k < 3"), ["k"]).count() == 1
    assert checks.not_close(df, "k", F.col("v"), F.col("v") + 1e-13).count() == 0 and checks.not_close(df, "k", F.col("v"), F.col("v") * 1.1).count() == 5
    assert checks.unequal_totals(df, F.sum("v"), df, F.sum("v") + 1, "sum").count() == 1
    with pytest.raises(ValueError, match="repeated"):
        checks.raise_if_any(checks.repeated_keys(df, ["k"]))
    with pytest.raises(ValueError, match="forbidden"):
        checks.refuse_columns(df, ["v"])
