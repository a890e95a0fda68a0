"""The draws of the splitting tree decide op2's rows and the order in which the pipeline packs."""

import random

import duckdb
import numpy as np
import pytest

from gaugelake.llm import mixing, queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    rows = [(k, " ".join(["w"] * r.randint(0, 60)), "en", r.choice(["a", "b", "b", "b", "ä", None]), 0) for k in range(900)] + [(901, None, "en", "b", 0), (None, "no id here", "en", "a", 0)]
    path = tmp_path_factory.mktemp("mix")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_op2_is_what_the_tree_deals(spark, folder, monkeypatch):
    got = queries.op2_mix_sources(spark, folder).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    key = lambda x: (repr(x[0]), *x[1:])
    want = con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({queries.oracle_sql()['op2_mix_sources']})").fetchall()
    assert sorted(map(key, got)) == sorted(map(key, want)) and {x.taken // x.size for x in got if x.size} == {1, 2}
    monkeypatch.setattr(mixing, "splitting_tree", lambda quotas, n, seed: np.zeros((n, len(quotas)), np.int64))
    assert {x.taken for x in queries.op2_mix_sources(spark, folder).collect()} == {0}


def test_pipeline_packs_shards_in_shuffled_order(spark, folder):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    draws = sorted(mixing.mix_sources(docs)[1].collect(), key=lambda d: (d.shard, d.place))
    got = [x.doc_id for x in corpus_pipeline.mixture(spark, docs, folder).collect()]
    assert got == [d.row.doc_id for d in draws] and len({d.shard for d in draws}) > 30
    twice = {i for i in got if got.count(i) == 2}
    assert len(twice) > 100 and sum(a == b for a, b in zip(got, got[1:])) < len(twice) / 10
