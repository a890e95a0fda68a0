"""The two jobs on copies of small tables: growing input, runs that repeat, and each edge of the data."""

import datetime
import hashlib
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from gaugelake.operators.resolve import resolve_targets
from jobs import document_holdouts, queries, refresh_targets
from jobs.config import load

SF = "/root/testdata/sf0.001"
EVENT = refresh_targets.EVENTS


def events(spark, start, n, days, seed=1):
    r = random.Random(seed)
    at = lambda d: datetime.datetime(2024, 1, d, r.randrange(24))
    rows = [(start + k if k % 29 else None, at(r.choice(days)) if k % 17 else None, r.randrange(12) if k % 13 else None, r.choice("abc"), r.choice([0.0, -1.0, float("nan"), float("inf"), None, *[r.random() * 9 + 0.1] * 9]), "{}") for k in range(n)]
    return spark.createDataFrame(rows, EVENT)


def shaped(df):
    return sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in df.collect())


def whole(spark, df):
    obs = refresh_targets.observed(df).where("day IS NOT NULL")
    obs = obs.where("observation_id IS NOT NULL").dropDuplicates(["observation_id"]).unionByName(obs.where("observation_id IS NULL"))
    return resolve_targets(obs, labels=("grp",), keys=("entity_id", "day"))


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_only_new_files_and_touched_days_are_taken(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("events", "out", "mark"))
    first, second = events(spark, 0, 300, [1, 2, 3]), events(spark, 1000, 90, [3, 4], 2)
    first.repartition(3).write.parquet(source)
    done = refresh_targets.run(spark, source, out, mark, {"files_per_batch": 2})
    assert done["read"] == 300 and done["batches"] >= 2
    names = refresh_targets.read_targets(spark, out).columns
    assert shaped(refresh_targets.read_targets(spark, out)) == shaped(whole(spark, first).select(*names))
    before = files(f"{out}/targets")
    assert refresh_targets.run(spark, source, out, mark) == {"batches": 0, "read": 0, "targets": 0} and files(f"{out}/targets") == before
    second.coalesce(1).write.mode("append").parquet(source)
    first.where("event_id IS NOT NULL").limit(40).coalesce(1).write.mode("append").parquet(source)  # delivered twice
    done = refresh_targets.run(spark, source, out, mark)
    assert done["read"] == 130
    every = first.unionByName(second)
    assert shaped(refresh_targets.read_targets(spark, out)) == shaped(whole(spark, every).select(*names))
    third = events(spark, 5000, 20, [4], 3)
    before = files(f"{out}/targets")
    third.coalesce(1).write.mode("append").parquet(source)
    assert refresh_targets.run(spark, source, out, mark)["batches"] == 1
    after = files(f"{out}/targets")
    assert {p for p in before if "day=2024-01-04" not in p} == {p for p in after if "day=2024-01-04" not in p}
    assert shaped(refresh_targets.read_targets(spark, out)) == shaped(whole(spark, every.unionByName(third)).select(*names))


def test_a_batch_that_runs_again_replaces_its_rows(spark, tmp_path):
    out = str(tmp_path / "out")
    batch = events(spark, 0, 120, [1, 2])
    for _ in range(2):
        refresh_targets.refresh(spark, batch, 7, out, refresh_targets.DEFAULTS)
    assert spark.read.schema(refresh_targets.OBSERVATIONS).parquet(f"{out}/observations").count() == batch.where("ts IS NOT NULL").count()
    assert shaped(refresh_targets.read_targets(spark, out)) == shaped(whole(spark, batch).select(*refresh_targets.read_targets(spark, out).columns))


def test_document_tasks_hold_sources_out_without_leaks(spark, tmp_path):
    r = random.Random(4)
    pool = [" ".join(r.choices("alpha beta gamma delta epsilon zeta".split(), k=r.randint(1, 12))) for _ in range(60)]
    docs = [(k, r.choice([t, t.upper(), f"  {t}\n"]), r.choice(["en", None]), r.choice(["a", "b", "c", "C c", None]), "x") for k, t in enumerate(r.choices(pool, k=240))]
    docs += [(500, None, "en", "a", "x"), (501, " \t\n", "en", "a", "x"), (None, "alpha", "en", "a", "x")]
    labels = [(k, r.choice([0, 1, None]) if k % 5 else 1, 0) for k in range(230)] + [(500, 1, 1), (501, 1, 1), (9999, 1, 0)]
    d, lab, out = (str(tmp_path / n) for n in ("docs", "labels", "out"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, target string").write.parquet(d)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(lab)
    spark.createDataFrame([("gone", 1)], "heldout string, repeat int").write.partitionBy("heldout").parquet(f"{out}/tasks")  # of a run before
    counts = document_holdouts.run(spark, d, lab, out)
    tasks = document_holdouts.read_tasks(spark, out)
    first = shaped(tasks)
    assert counts["tasks"] == len(first) > 0 and {x.heldout for x in tasks.select("heldout").distinct().collect()} == {"a", "b", "c", "C c"}
    sides = tasks.groupBy("heldout", "repeat", "entity_id").agg(F.collect_set("partition").alias("p"))
    assert sides.where("size(p) > 1").count() == 0
    obs = document_holdouts.labelled(spark.read.parquet(d), spark.read.parquet(lab), 5).where("value IS NOT NULL")
    leaks = tasks.where("partition <> 'test'").join(obs.select("entity_id", F.col("source").alias("heldout")), ["entity_id", "heldout"])
    assert leaks.count() == 0 and obs.groupBy("entity_id").agg((F.max("value") - F.min("value")).alias("v")).where("v > 0").join(tasks, "entity_id").count() == 0
    assert document_holdouts.run(spark, d, lab, out) == counts and shaped(document_holdouts.read_tasks(spark, out)) == first
    assert spark.read.parquet(f"{out}/summary").agg(F.sum("entities")).first()[0] == len(first)


def test_empty_input_and_settings(spark, tmp_path):
    d, lab, out = (str(tmp_path / n) for n in ("docs", "labels", "out"))
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(d)
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(lab)
    assert document_holdouts.run(spark, d, lab, out)["tasks"] == 0
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"seeds": [5]}))
    assert load(spark, str(config), document_holdouts.DEFAULTS)["seeds"] == [5] and load(spark, None, {"a": 1}) == {"a": 1}
    for job in ("refresh_targets", "document_holdouts"):
        load(spark, f"{os.path.dirname(queries.__file__)}/{job}.json", getattr(queries, job).DEFAULTS)
    config.write_text('{"nothing": 1}')
    with pytest.raises(ValueError, match="unknown"):
        load(spark, str(config), document_holdouts.DEFAULTS)
    assert refresh_targets.as_pattern("/a/b.parquet/") == "/a/b.parque[t]" and refresh_targets.as_pattern("/a/*.x") == "/a/*.x"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_registered_queries_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, f in queries.queries().items():
        got = f(spark, SF)
        made = con.execute(queries.oracle_sql()[name])
        columns, order = [c[0] for c in made.description], sorted(got.columns)
        assert sorted(columns) == order
        assert sorted(repr(tuple(r[columns.index(c)] for c in order)) for r in made.fetchall()) == sorted(repr(tuple(r[c] for c in order)) for r in got.collect())


@pytest.mark.parametrize("most", [0, 2_000_000])
def test_only_labelled_texts_are_read_through(spark, monkeypatch, most):
    """Texts are made plain once, after they met their labels where these are few; whatever the number of labels, the digests are those of the plain rule."""
    monkeypatch.setattr(document_holdouts, "MOST_LABELS", most)
    texts = ["Ab  cD", " Ab\tcd\r\n", "\x0b\x0c", "", None, "ÄB É x Y", "a b c d e f", "A B c\n\nd E g", "a  ", "\x1cQ \x85 İ", "x\n y", "one two three four five", "K"]
    docs = spark.createDataFrame([(k, t, "en", "a") for k, t in enumerate(texts)] + [(99, "no label", "en", "a")], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(len(texts))] + [(0, 1), (None, 1), (777, 1)], "doc_id long, quality int")
    made = document_holdouts.labelled(docs, labels, 5)
    got = sorted((x.observation_id, x.entity_id, x.grp, x.value) for x in made.collect())
    want = []
    for k, text in enumerate(texts):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        t = re.sub("[ \t-\r]+", " ", low).strip(" ")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want += [(k, sha(t), sha(" ".join(t.split(" ")[:5])), float(v)) for v in ([k % 2, 1] if k == 0 else [k % 2]) if t]
    assert got == sorted(want)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
    join = plan.index("Join Inner")
    assert (plan.index("regexp_replace") < join) == (most > 0)  # above the join, or below it
