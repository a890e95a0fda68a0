"""Quantiles, ranks, similarities and digests of groups of any size, against brute force."""

import hashlib
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugelake.operators import overlap, reports, similarity, splits
from gaugelake.operators.quantiles import grouped_quantiles, order_key, with_quantiles
from gaugelake.operators.ranks import places, running_sums
from gaugelake.operators.tasks import described

EDGES = [0.0, -0.0, 1.0, -1.0, 2.0, 1.9999999999999998, 2.0000000000000004, 0.5, 1e-300, -1e-300, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, 1e16, 3.0, 1 / 3, float("inf"), float("-inf")]


def test_order_keys_are_the_doubles_bits(spark):
    values = EDGES + [random.Random(1).uniform(-1, 1) * 10.0 ** random.Random(k).randrange(-300, 300) for k in range(500)] + [float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("k", order_key(F.col("v")))
    got = {struct.pack(">d", r.v): r.k for r in df.collect()}
    for v in values:
        size = struct.unpack(">q", struct.pack(">d", abs(v)))[0]
        assert v != v or got[struct.pack(">d", v)] == (-size if v < 0 else size)
    assert got[struct.pack(">d", float("nan"))] == max(got.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles_equal_numpy(spark, seed):
    r = random.Random(seed)
    kinds = {"ties": lambda: float(r.randrange(3)), "wide": lambda: r.uniform(-1, 1) * 10.0 ** r.randrange(-200, 200), "near": lambda: 1 + r.randrange(1000) * 2.0**-52, None: r.random, "one": lambda: 7.5, "hot": lambda: 0.0 if r.random() < 0.6 else r.gauss(0, 1)}
    rows = [(g, k % 2 or None, f()) for g, f in kinds.items() for k in range(1 if g == "one" else 301)] + [("ties", 1, None), ("empty", 1, None)]
    df = spark.createDataFrame(rows, "g string, h int, v double").repartition(3)
    fractions = {"low": 0.0, "q1": 0.1, "mid": 0.5, "q9": 0.95, "top": 1.0}
    got = {(x.g, x.h): x for x in grouped_quantiles(df, ["g", "h"], "v", fractions).collect()}
    groups = {}
    for g, h, v in rows:
        if v is not None:
            groups.setdefault((g, h), []).append(v)
    assert set(got) == set(groups)
    for key, values in groups.items():
        for name, q in fractions.items():
            assert got[key][name] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=0)
    every = grouped_quantiles(df, [], "v", {"m": 0.5}).collect()
    assert every[0].m == np.median([v for _, _, v in rows if v is not None])
    assert grouped_quantiles(df.where("false"), ["g"], "v", {"m": 0.5}).count() == 0
    summary = with_quantiles(df.groupBy("g").count(), df, ["g"], "v", {"m": 0.5})
    assert {x.g: x.m for x in summary.collect()}["empty"] is None and summary.count() == 7


def test_running_sums_and_places(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "a", "a", None, "b"]), r.choice([1, None]), k, r.random(), r.randrange(5)) for k in range(700)]
    df = spark.createDataFrame(rows, "g string, h int, id int, v double, n int").repartition(5)
    got = running_sums(df, ["g", "h"], ["v", "id"], ["n"]).collect()
    assert len(got) == 700
    for x in got:
        assert x.before_n == sum(n for g, h, i, v, n in rows if (g, h) == (x.g, x.h) and (v, i) < (x.v, x.id))
    down = {x.id: x.before_n for x in running_sums(df, [], ["v", "id"], ["n"], descending=True).collect()}
    assert all(down[i] == sum(m for _, _, j, w, m in rows if (w, j) > (v, i)) for _, _, i, v, _ in rows[:50])
    numbered = places(df, ["g"], ["v", "id"]).collect()
    for g in ("a", None):
        mine = sorted((x.v, x.place) for x in numbered if x.g == g)
        assert [p for _, p in mine] == list(range(1, len(mine) + 1))
    assert places(df.where("false"), ["g"], ["v"]).count() == 0


def _sets(n, seed, width=40):
    r = random.Random(seed)
    return [(k, sorted(r.sample(range(width), r.choice([0, 1, 2, 5, 12, 30])))) for k in range(n)]


def _score(a, b, measure):
    if measure == "euclidean":
        return -float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum()))
    both = len(set(a) & set(b))
    under = len(a) + len(b) - both if measure == "tanimoto" else (len(a) * len(b)) ** 0.5
    return (round(both / under, 12) if measure == "cosine" else both / under) if under else 0.0


@pytest.mark.parametrize("measure", ["tanimoto", "cosine", "euclidean"])
def test_pruned_search_equals_all_pairs(spark, monkeypatch, measure):
    monkeypatch.setattr(similarity, "BLOCK", 8)
    r = random.Random(7)
    rows = [(k, [r.gauss(0, 1) * 10 ** (k % 4), r.gauss(0, 1)]) for k in range(120)] if measure == "euclidean" else _sets(120, 7)
    kind = "double" if measure == "euclidean" else "int"
    df = spark.createDataFrame(rows, f"entity_id long, bits array<{kind}>")
    for others, k in ((True, 3), (False, 1)):
        got = {}
        for x in similarity.most_similar(df, df, k, others=others, measure=measure).collect():
            got.setdefault(x["query"], []).append((-x.similarity, x.candidate))
        for q, a in rows:
            want = sorted((-_score(a, b, measure), c) for c, b in rows if not (others and c == q))[:k]
            assert [(round(s, 9), c) for s, c in sorted(got[q])] == [(round(s, 9), c) for s, c in want]
    assert similarity.skipped["compared"] < similarity.skipped["pairs"] / 2


def test_keys_are_searched_apart(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 8)
    rows = [(g, k, b) for g in ("x", None) for k, b in _sets(40, 3)]
    df = spark.createDataFrame(rows, "g string, entity_id long, bits array<int>")
    got = {(x.g, x.entity_id): x.max_similarity for x in similarity.max_similarity(df.where("entity_id < 20"), df.where("entity_id >= 20 AND g = 'x'"), ("g",)).collect()}
    assert len(got) == 40 and all(got[None, k] == 0 for k in range(20))
    sets = dict(_sets(40, 3))
    assert all(abs(got["x", k] - max(_score(sets[k], sets[c], "tanimoto") for c in range(20, 40))) < 1e-12 for k in range(20))


def test_all_tasks_share_one_product(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 16)
    r, sets = random.Random(5), dict(_sets(90, 9))
    rows = [(s, t, k, r.choice(["train", "train", "validation", "test"])) for s in ("a", None) for t in (1, 2) for k in range(90) if r.random() < 0.9]
    rows += [("bare", 1, k, "test") for k in range(3)]
    got = similarity.max_similarity_by_task(spark.createDataFrame(rows, "strategy string, repeat int, entity_id long, partition string"), spark.createDataFrame(list(sets.items()), "entity_id long, bits array<int>"), ["strategy", "repeat"]).collect()
    assert len(got) == len(rows)
    for x in got:
        train = [k for s, t, k, p in rows if (s, t, p) == (x.strategy, x.repeat, "train")]
        want = None if x.partition == "train" else max((_score(sets[x.entity_id], sets[k], "tanimoto") for k in train), default=0.0)
        assert x.max_similarity == (None if want is None else pytest.approx(want))


@pytest.mark.parametrize("upto", [0, 3, 12])
def test_small_sets_meet_in_their_subsets(spark, monkeypatch, upto):
    monkeypatch.setattr(similarity, "_small", lambda counts: upto)
    r = random.Random(upto)
    sets = {f"e{k}": sorted(r.sample(range(100), r.choice([0, 1, 2, 3, 7]))) for k in range(50)}
    sets |= {f"e{k}": sets["e0"] for k in (50, 51)} | {"wide": list(range(20 if upto < 12 else 12))}
    # More tasks than a mask has; the last has no train rows, and so a tile without an answer.
    rows = [(t, k, "test" if t == 70 else r.choice(["train", "test"])) for t in range(71) for k in sets if t > 1 or k == "wide"]
    df = spark.createDataFrame(rows, "repeat int, entity_id string, partition string")
    got = similarity.max_similarity_by_task(df, spark.createDataFrame(list(sets.items()), "entity_id string, bits array<int>"), ["repeat"]).collect()
    train = {}
    for t, k, p in rows:
        train.setdefault(t, []).extend([k] if p == "train" else [])
    assert len(got) == len(rows)
    for x in got:
        want = None if x.partition == "train" else max((_score(sets[x.entity_id], sets[k], "tanimoto") for k in train[x.repeat]), default=0.0)
        assert x.max_similarity == want
    alone = similarity.max_similarity_by_task(df.where("repeat = 70"), spark.createDataFrame(list(sets.items()), "entity_id string, bits array<int>"), ["repeat"])
    assert {x.max_similarity for x in alone.collect()} == {0.0}  # no answer in any tile


def test_which_sets_are_small():
    assert similarity._small({1: 10_000, 3: 10_000, 30: 5}) == 3 and similarity._small({30: 10_000, 12: 100}) == 0 and similarity._small({}) == 0


def test_best_sets_holds_strips(monkeypatch):
    """Places and scores are those of all pairs sorted, in strips of any length; a strip, not all pairs, is held."""
    monkeypatch.setattr(similarity, "STRIP", 64)
    r = np.random.default_rng(3)
    a, b = (np.packbits(r.random((n, 128)) < 0.2, axis=1, bitorder="little").view(np.uint64) for n in (40, 30))
    for measure in ("tanimoto", "cosine"):
        near, score = similarity.best_sets(a, b, 4, measure, (np.arange(30), np.arange(30)))
        for i in range(40):
            bits = [set(np.flatnonzero(np.unpackbits(w.view(np.uint8), bitorder="little")).tolist()) for w in (a[i], *b)]
            want = sorted((-_score(bits[0], x, measure), k) for k, x in enumerate(bits[1:]) if k != i)[:4]
            assert [(-s, k) for s, k in zip(score[i], near[i])] == want
    assert (similarity.most_shared(a, b) == similarity.best_sets(a, b, 1, "tanimoto")[1][:, 0]).all()


def _packed(r, n, width, p):
    return np.packbits(r.random((n, width)) < p, axis=1, bitorder="little").view(np.uint64)


def _counted(monkeypatch):
    """How many pairs of words have been counted since, in a list of one."""
    seen, plain = [0], np.bitwise_count

    def spy(x, *args, **kwargs):
        seen[0] += x.size if x.ndim == 2 and 1 not in x.shape else 0
        return plain(x, *args, **kwargs)

    monkeypatch.setattr(np, "bitwise_count", spy)
    return seen


def test_copies_are_compared_once(monkeypatch):
    """A search's work follows the different sets; ties, copies of a query's own row and rows that share nothing come by their places."""
    r = np.random.default_rng(4)
    sets = np.vstack([_packed(r, 12, 64, 0.1), np.zeros((1, 1), np.uint64)])
    a = sets[r.integers(0, len(sets), 400)]
    seen = _counted(monkeypatch)
    near, score = similarity.best_sets(a, a, 6, "cosine", (np.arange(400), np.arange(400)))
    assert seen[0] < 400 * 400 / 4
    bits = [set(np.flatnonzero(np.unpackbits(w.view(np.uint8), bitorder="little")).tolist()) for w in a]
    for i in range(0, 400, 7):
        want = sorted((-_score(bits[i], x, "cosine"), k) for k, x in enumerate(bits) if k != i)[:6]
        assert [(-s, k) for s, k in zip(score[i], near[i])] == want


@pytest.mark.parametrize("width", [64, 320])
def test_tasks_share_their_counts(monkeypatch, width):
    """The best of every task from one count of each pair; tasks whose train rows are few, far off or none need all pairs of their queries."""
    r = np.random.default_rng(width)
    a, b = _packed(r, 150, width, 0.2), _packed(r, 3000, width, 0.2)
    asks, fits = r.random((150, 15)) < 0.3, r.random((3000, 15)) < 0.7
    seen = _counted(monkeypatch)
    similarity.best_of_tasks(a, asks, b, fits)
    assert seen[0] <= 2 * 150 * 3000 * width / 64
    fits[:, 3], fits[:, 5], fits[1:, 4] = False, r.random(3000) < 0.01, False
    fits[0, 4] = True
    task, query, score = similarity.best_of_tasks(a, asks, b, fits)
    got = dict(zip(zip(task.tolist(), query.tolist()), score.tolist()))
    want = {}
    for t in range(15):
        rows = np.flatnonzero(asks[:, t])
        if fits[:, t].any():
            want |= {(t, q): s for q, s in zip(rows.tolist(), similarity.most_shared(a[rows], b[fits[:, t]]).tolist())}
    assert got == want


def test_spans_of_blocks(spark, monkeypatch):
    """Blocks of queries meet several blocks at once, and answers are those of all pairs."""
    for name, value in (("BLOCK", 8), ("SPAN", 64), ("TILES", 4)):
        monkeypatch.setattr(similarity, name, value)
    rows = [(g, k, b) for g in ("x", None) for k, b in _sets(100, 3)]
    sets = dict(_sets(100, 3))
    df = spark.createDataFrame(rows, "g string, entity_id long, bits array<int>")
    got = {}
    for x in similarity.most_similar(df, df, 3, ("g",), others=True, measure="cosine").collect():
        got.setdefault((x.g, x["query"]), []).append((-x.similarity, x.candidate))
    for g in ("x", None):
        for q, a in sets.items():
            assert sorted(got[g, q]) == sorted((-_score(a, b, "cosine"), c) for c, b in sets.items() if c != q)[:3]


def test_assignments_of_all_seeds_are_those_of_each(spark):
    r = random.Random(2)
    rows = [(f"m{k:03d}", r.gauss(0, 1), f"g{r.randrange(30)}" if k % 9 else f"own{k}", sorted(r.sample(range(40), 6))) for k in range(200)]
    df = spark.createDataFrame(rows, "entity_id string, target double, grp string, bits array<int>")
    every = splits.split_assignments(df, df, seeds=(13, 37))
    assert every.columns == ["strategy", "repeat", "seed", "entity_id", "partition", "grp", "max_similarity"]
    held = {}
    for x in every.collect():
        held.setdefault((x.strategy, x.seed), {})[x.entity_id] = x.partition
    assert set(held) == {(s, k) for s in splits.STRATEGIES for k in (13, 37)}
    one = {"random": splits.random_partitions, "group": splits.group_partitions, "low_similarity": lambda t, s: splits.low_similarity_partitions(t, df, s)}
    for (strategy, seed), parts in held.items():
        assert {x.entity_id: x.partition for x in one[strategy](df, seed).collect()} == parts and len(parts) == 200
    assert held["random", 13] != held["random", 37]
    with pytest.raises(ValueError, match="unknown"):
        splits.split_assignments(df, df, ["other"])


def test_assignments_without_similarities_compare_no_rows(spark, monkeypatch):
    r = random.Random(6)
    df = spark.createDataFrame([(k, r.gauss(0, 1), "g", [k % 7]) for k in range(60)], "entity_id long, target double, grp string, bits array<int>")
    want = {(x.seed, x.entity_id): x.partition for x in splits.split_assignments(df, df, ["random"], (13,)).collect()}
    monkeypatch.setattr(splits, "max_similarity_by_task", None)
    got = splits.split_assignments(df, df, ["random"], (13,), similar=False)
    assert got.columns == ["strategy", "repeat", "seed", "entity_id", "partition", "grp"]
    assert {(x.seed, x.entity_id): x.partition for x in got.collect()} == want


def test_digests_stream(spark):
    r = random.Random(8)
    rows = [(r.choice(["a", "b", None]), f"id{r.randrange(10**6)}") for _ in range(5000)] + [("none", None), ("a", None), ("a", "id1"), ("a", "id1")]
    got = {x.g: (x.n, x.digest) for x in reports.id_digest(spark.createDataFrame(rows, "g string, i string").repartition(4), "i", ["g"]).collect()}
    for g in ("a", "b", None, "none"):
        ids = sorted(i for h, i in rows if h == g and i is not None)
        assert got[g] == (sum(h == g for h, _ in rows), hashlib.sha256("\n".join(ids).encode()).hexdigest())
    assert reports.id_digest(spark.createDataFrame([], "g string, i string"), "i", ["g"]).count() == 0


def test_feature_audit_and_coverage(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (2, None, None)], "x int, y string, z double")
    assert {r.feature: (r.non_null, round(r.missing_share, 6), r.distinct_values, r.kind) for r in reports.feature_audit(df, ["x", "y", "z"]).collect()} == {"x": (3, 0, 2, "numeric"), "y": (2, 0.333333, 1, "categorical"), "z": (0, 1, 0, "numeric")}
    assert {r.feature for r in reports.constant_columns(df, ["x", "y", "z"]).collect()} == {"y", "z"}
    ids = lambda *k: spark.createDataFrame([(i,) for i in k], "entity_id int")
    assert overlap.restricted_to(ids(1, 2, 3), ids(1, 1, 2), exact=True).count() == 2 and overlap.restricted_to(ids(1), ids(1, 2)).count() == 1
    for features in (ids(1), ids(1, 2, 2)):
        with pytest.raises(ValueError, match="no features"):
            overlap.restricted_to(features, ids(1, 2), exact=True)


def test_descriptions_follow_names():
    assert described("x_fit_target_q25") == "predictor: lower quartile of target, train and validation rows"
    assert described("x_test_similarity_below_0p3") == "predictor: share of test rows with similarity below 0.3"
    assert described("x_shift_mass_smd") == "predictor: difference of means in standard deviations of mass between fit and test rows"
    assert described("x_hp_alpha") == "predictor: parameter alpha of the fitted model" and described("run_id").startswith("identifier") and described("y_rmse") == "outcome: root mean square error"


def test_few_runs_are_held_and_parts_are_counted_apart(monkeypatch):
    """Whatever the number of train rows, a step holds the common words of some runs; tasks that share few pairs count their own ones alone."""
    r = np.random.default_rng(7)
    a, b = _packed(r, 200, 64, 0.2), _packed(r, 20000, 64, 0.2)
    monkeypatch.setattr(similarity, "WORDS", 1 << 13)
    monkeypatch.setattr(similarity, "ACROSS", 1 << 11)
    most, plain = [0], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x, *args, **kwargs: (most.append(x.size if x.ndim == 2 and 1 not in x.shape else 0), plain(x, *args, **kwargs))[1])
    one = similarity.best_of_tasks(a, np.ones((200, 1), bool), b, np.ones((20000, 1), bool))
    near, score = similarity.best_sets(a, b, 3, "tanimoto")
    assert max(most) <= 1 << 13 and (one[2] == score[:, 0]).all()
    parts = r.integers(0, 10, 20000)
    asks, fits = r.random((200, 10)) < 0.2, parts[:, None] == np.arange(10)
    most.clear()
    task, query, score = similarity.best_of_tasks(a, asks, b, fits)
    assert sum(most) < 200 * 20000 / 2
    for t in range(10):
        rows = np.flatnonzero(asks[:, t])
        assert dict(zip(query[task == t].tolist(), score[task == t].tolist())) == dict(zip(rows.tolist(), similarity.most_shared(a[rows], b[parts == t]).tolist()))


def test_all_strategies_share_a_product(spark, monkeypatch):
    """The rows of the low-similarity strategy meet its first train rows once, with the other strategies; then the new ones alone. Similarities are those to all train rows."""
    r = random.Random(5)
    sets = {k: sorted(r.sample(range(30), r.choice([0, 4, 13, 14, 15]))) for k in range(120)}
    df = spark.createDataFrame([(k, r.gauss(0, 1), f"g{k % 20}", b) for k, b in sets.items()], "entity_id long, target double, grp string, bits array<int>")
    met, plain = [], splits.max_similarity_by_task

    def spy(assignments, bits, keys):
        met.append({(x.strategy, x.partition): x.n for x in assignments.groupBy("strategy", "partition").agg(F.count("*").alias("n")).collect()})
        return plain(assignments, bits, keys)

    monkeypatch.setattr(splits, "max_similarity_by_task", spy)
    rows = splits.split_assignments(df, df, seeds=(13, 37)).collect()
    assert len(met) == 2 and met[0]["low_similarity", "train"] == 168 and met[1] == {("low_similarity", "train"): 24, ("low_similarity", "validation"): 24, ("low_similarity", "test"): 24}
    assert len(rows) == 720
    for x in rows:
        train = [y.entity_id for y in rows if (y.strategy, y.seed, y.partition) == (x.strategy, x.seed, "train")]
        assert x.max_similarity == (None if x.partition == "train" else max(_score(sets[x.entity_id], sets[k], "tanimoto") for k in train))


def test_tasks_are_searched_without_rows_in_pandas(spark):
    """Ids of any size come back as they went in, with and without tasks, whatever words and tasks a row has."""
    r, base = random.Random(1), (1 << 60) + 1
    sets = {base + k: sorted(r.sample(range(150), 20)) for k in range(60)}
    bits = spark.createDataFrame(list(sets.items()), "entity_id long, bits array<int>")
    rows = [(t, base + k, "train" if (k + t) % 3 else "test") for t in range(70) for k in range(t % 2, 60, 1 + t // 2)]
    df = spark.createDataFrame(rows, "t int, entity_id long, partition string")
    for keys, known in ((["t"], df), ([], df.where("t = 0"))):
        got = similarity.max_similarity_by_task(known, bits, keys).collect()
        assert len(got) == known.count()
        for x in got:
            train = [k for t, k, p in rows if (t, p) == (x.t, "train")]
            assert x.max_similarity == (None if x.partition == "train" else max((_score(sets[x.entity_id], sets[k], "tanimoto") for k in train), default=0.0))


def test_words_of_columns():
    import pyarrow as pa

    r = np.random.default_rng(3)
    words = r.integers(0, 1 << 63, (50, 3), dtype=np.uint64)
    values = [x.tobytes() for x in words]
    for kind in (pa.binary(), pa.large_binary()):
        column = pa.chunked_array([pa.array(values[:20], kind), pa.array([], kind), pa.array(values, kind).slice(20, 30)])
        assert (similarity._column_words(column, 3) == words).all()
        assert (similarity._column_words(column.slice(7, 21), 3) == words[7:28]).all()
        assert similarity._column_words(column.slice(0, 0), 3).shape == (0, 3)
    assert (similarity._mask(words, 150) == [[int(x[t // 64]) >> t % 64 & 1 for t in range(150)] for x in words]).all()


def test_seeds_need_no_python_workers(spark):
    """A list of rows is an RDD that Python workers unpickle, beside those of the functions: a daemon and a worker a core more on each executor."""
    seeds = splits.seed_tasks(spark, (37, 13))
    assert seeds.dtypes == [("repeat", "int"), ("seed", "int")] and [tuple(x) for x in seeds.collect()] == [(1, 37), (2, 13)]
    assert splits.seed_tasks(spark, ()).count() == 0
    assert "RDD" not in seeds._jdf.queryExecution().toString()
