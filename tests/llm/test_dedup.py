"""Near-duplicates, lines, spans, mixing and quality rules on small tables, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugelake.llm import minhash_dedup
from gaugelake.llm._shared import connected_components
from gaugelake.llm.embedding_dedup import near_vectors, tile_links
from gaugelake.llm.line_dedup import dedup_lines
from gaugelake.llm.minhash_dedup import linked, match_threshold, near_duplicates
from gaugelake.llm.mixing import mix_sources, splitting_tree
from gaugelake.llm.quality_rules import quality_rules
from gaugelake.llm.sentence_spans import dedup_spans
from gaugelake.llm.shingles import shingle_sets

SPACE = re.compile(r"[^ \t-\r]+")
ODD = [(None, "a row without an id here", "en", "s0"), (900, None, "en", "s0"), (901, "", None, None), (902, " \n\t ", "xx", "s1"), (903, "One", "en", None), (904, "one", "de", "s2"), (905, "two words", "en", "s1")]


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["Äpfel", "naïve", "日本"]
    make = lambda n: " ".join(r.choices(words, k=n))
    rows, i = [], 0

    def add(text):
        nonlocal i
        rows.append((i, text, "en", f"s{i % 4}"))
        i += 1

    for _ in range(25):
        add(make(r.randint(3, 120)))
    for base in (make(150), make(90), "same " * 40):  # families: exact, upper case, near and farther copies, more than a posting list may hold
        for k in range(50):
            ws = base.split(" ")
            for _ in range(k % 8):
                ws[r.randrange(len(ws))] = r.choice(words)
            add(" ".join(ws) if k % 3 else base.upper() if k % 2 else base)
    passage = make(60)
    for _ in range(40):  # a passage that many share
        add(f"{make(100)} {passage} {make(100)}")
    add(make(30_000))
    return rows + ODD + [rows[3], rows[40]]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({"u": F.lit(1), "d1": F.lit("x"), "size": F.lit(None).cast("int"), "k1": F.lit(2), "row": F.lit(3), "n_words": F.lit(4), "h1": F.lit(5)}).repartition(3)


@pytest.mark.parametrize(("width", "percent", "block", "hot"), [(3, 85, 256, 16), (5, 80, 6, 4)])
def test_near_duplicates_equal_brute_force(spark, corpus, monkeypatch, width, percent, block, hot):
    monkeypatch.setattr(minhash_dedup, "BLOCK_DOCS", block)
    sets = {}
    for doc_id, text, *_ in corpus:
        ws = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in SPACE.findall(text or "")]
        sets[doc_id] = {tuple(ws[k : k + width]) for k in range(len(ws) - width + 1)} if len(ws) >= width else {tuple(ws)} if ws else set()
    ids = [k for k in sets if k is not None]
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components(ids, links)
    got = near_duplicates(frame(spark, corpus), width=width, percent=percent, hot=hot).collect()
    assert len(got) == len(corpus)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert (r.component_id, r.kept) == ((want[r.doc_id], want[r.doc_id] == r.doc_id) if r.doc_id is not None else (None, True))
    assert len({r.component_id for r in got}) < len(corpus) - 50
    assert near_duplicates(frame(spark, []), width=width).count() == 0


def test_linked_agrees_for_small_and_large_tiles():
    r = random.Random(1)
    base = [r.getrandbits(60) for _ in range(200)]
    sets = [np.unique(np.array(r.sample(base, 150) + [r.getrandbits(60) for _ in range(r.randint(0, 60))], np.uint64)) for _ in range(40)]
    left, right = np.arange(20), np.arange(20, 40)
    i, j = linked(sets, left, right, 50)
    want = {(a, b) for a in left.tolist() for b in right.tolist() if 100 * len(np.intersect1d(sets[a], sets[b])) >= 50 * len(np.union1d(sets[a], sets[b]))}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and 0 < len(want) < 400
    assert 30 < match_threshold(64, 85, 5e-7) < 45


def test_shingles_ignore_case_and_all_ascii_spaces():
    a, b, c, d = shingle_sets([b"A b\tC\n d", b"a B c\x0bD", b"a b c", b"  "])
    assert a.tolist() == b.tolist() and len(a) == 2 and set(c.tolist()) < set(a.tolist()) and len(d) == 0


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_components_of_a_chain_and_a_star(spark, few):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(300, 340)] + [(5, 5), (None, 3), (9, 8)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long"), few=few).collect()}
    want = components(range(100, 161), edges[:60]) | {k: 7 for k in [7, *range(300, 340)]} | {8: 8, 9: 8}
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long"), few=few).count() == 0


def test_near_vectors_equal_brute_force(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 16))
    rows = [(k, (centres[k % 6] + r.normal(size=16) * r.uniform(0, 0.5)).astype(np.float32).tolist(), k % 2) for k in range(150)]
    rows += [(200 + k, rows[5][1], 1) for k in range(40)]  # equal vectors
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None] * 16, 1), (304, rows[5][1], None), (305, [], 1), (306, [float("inf")] * 16, 0), (307, rows[5][1][:8], 1), (None, rows[5][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"u": F.lit(1), "node": F.lit("x"), "dim": F.lit(0)}).repartition(3)
    ok = {i: (np.array(v, float), k) for i, v, k in rows if i is not None and i not in range(300, 307)}
    cosine = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    links = [(a, b) for a in ok for b in ok if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and cosine(ok[a][0], ok[b][0]) >= 0.93]
    want = components([k for k, *_ in rows if k is not None], links)
    got = near_vectors(df).collect()
    assert len(got) == len(rows)
    for x in got:
        n = sum(x.vec_id in p for p in links) if x.vec_id is not None else 0
        assert (x.n_links, x.component_id, x.kept) == (n, want.get(x.vec_id), x.vec_id is None or want[x.vec_id] == x.vec_id)
    assert near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1e-200, 1.0, 1e200])
def test_bounds_lose_no_pair(scale):
    r = np.random.default_rng(4)
    a = np.repeat(r.normal(size=(30, 1500)), 4, axis=0) + r.normal(size=(120, 1500)) * 0.275
    i, j = tile_links(a, a, 0.93, True)
    unit = a / np.sqrt((a**2).sum(axis=1))[:, None]
    want = {(x, y) for x, y in zip(*np.nonzero(unit @ unit.T >= 0.93), strict=True) if x < y}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and 10 < len(want) < 179
    if scale == 1.0:
        return
    b = a[:8] * scale ** 0.5
    assert len(tile_links(b, b, -1.0, True)[0]) == 28


def test_lines_on_many_sites_stay_once(spark):
    rows = [(k, f"own line number {k}\n  shared across all sites \nmore of {k} here", "en", f"s{k % 6}") for k in range(30)]
    rows += [(100 + k, f"only on two sites\nanother text {k} here\nonly on two sites", "en", f"s{k % 2}") for k in range(10)]
    rows += [(200 + k, "on five sites now\n\nx", "en", f"t{k}") for k in range(5)] + [(300 + k, "on null sites too", "en", None if k else "a") for k in range(9)] + ODD + [rows[0]]
    got = {(r.row.doc_id, r.text, r.n_lines, r.n_removed_lines) for r in dedup_lines(frame(spark, rows)).collect()}
    want = set()
    for doc_id, text, *_ in rows:
        lines = text.split("\n") if text is not None else []
        left = [x for k, x in enumerate(lines) if not (("shared across" in x and doc_id != 0) or ("five sites" in x and doc_id != 200))]
        want.add((doc_id, "\n".join(left) if text is not None else None, len(lines), len(lines) - len(left)))
    assert got == want
    assert dedup_lines(frame(spark, [])).count() == 0


def brute_spans(rows, run=2, min_words=20, long=10, stretch=6):
    """(text left, words removed, stretches) of each row."""
    value = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:15], 16)
    cut, first = {}, {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        pieces = re.findall(r"[^ \t-\r]+[ \t-\r]*", text or "")
        words = [p.rstrip(" \t\n\r\x0b\x0c") for p in pieces]
        ends = [k + 1 for k, p in enumerate(pieces) if "\n" in p or words[k][-1] in ".!?" or k == len(pieces) - 1]
        units = set(ends)
        for a, b in zip([0, *ends], ends):
            if b - a > long:
                for k in range(a, b - stretch + 1):
                    units.add(max(range(k, k + stretch), key=lambda j: (-value(words[j]), j)))
        units = sorted(units - {0})
        starts = [0, *units[:-1]]
        spans = []
        for k, a in enumerate(starts):
            stop = next((b for b in units[k + run - 1 :] if b - a >= min_words), None)
            if stop:
                spans.append((a, stop))
        spans = spans or ([(0, len(words))] if words else [])
        cut[doc_id, text] = pieces, words, ends, spans
        for a, b in spans:
            first.setdefault(tuple(words[a:b]), (doc_id, text, a))
    out = []
    for doc_id, text in rows:
        pieces, words, ends, spans = cut[doc_id, text]
        gone = {j for a, b in spans if first[tuple(words[a:b])] != (doc_id, text, a) for j in range(a, b)}
        lead = "" if 0 in gone else re.match(r"[ \t-\r]*", text or "")[0]
        kept = None if text is None else lead + "".join(p for j, p in enumerate(pieces) if j not in gone)
        out.append((doc_id, kept, len(gone), sum(j - 1 not in gone for j in gone)))
    return out


def test_spans_equal_brute_force(spark):
    r = random.Random(8)
    sentences = [" ".join(r.choices("alpha beta gamma delta eps zeta Ä ö".split(), k=r.randint(1, 7))) + r.choice([". ", "! ", ", ", ".\n", "\n", ".  "]) for _ in range(60)]
    rows = [(k, "".join(r.choices(sentences, k=r.randint(0, 25))) + "".join(sentences[10:16]) * (k % 3)) for k in range(40)]
    rows += [(o[0], o[1]) for o in ODD] + [rows[4], (1000, "a b c d. " * 300), (1001, "no stop " * 400), (1002, "  " + rows[3][1]), (1003, rows[3][1])]
    df = frame(spark, [(i, t, "en", "s") for i, t in rows])
    got = sorted(((x.row.doc_id, x.text, x.n_removed_words, x.n_spans) for x in dedup_spans(df).collect()), key=repr)
    assert got == sorted(brute_spans(rows), key=repr)
    assert sum(g[2] for g in got) > 100
    assert dedup_spans(frame(spark, [])).count() == 0


def test_mix_meets_its_targets(spark):
    r = random.Random(2)
    rows = [(k, " ".join(["w"] * r.randint(0, 60)), "en", r.choice(["a", "b", "b", "b", "ä", None])) for k in range(800)] + ODD + [(5000, "big " * 3000, "en", "b")]
    sized, draws, sources = mix_sources(frame(spark, rows), n_shards=7)
    sized = sized.collect()
    total = sum(len(SPACE.findall(t or "")) for _, t, *_ in rows)
    assert len(sized) == len(rows) and abs(sum(s.target for s in sources.collect()) - 1.5 * total) < 1e-6 * total
    for s in sources.collect():
        own = [x for x in sized if x.source == s.source]
        assert s.source_size == sum(x.size for x in own) and s.target <= 2 * s.source_size
        assert abs(sum(x.size * x.times for x in own) - s.target) <= max([x.size for x in own])
        assert all(x.times <= 2 for x in own) and all(x.size == len(SPACE.findall(x.row.text or "")) for x in own)
    drawn = draws.collect()
    assert len(drawn) == sum(x.times for x in sized) and {d.shard for d in drawn} <= set(range(7))
    again, _, _ = mix_sources(frame(spark, rows).repartition(5), n_shards=7)
    key = lambda x: (str(x.row.doc_id), x.size, x.times)
    assert sorted(map(key, again.collect())) == sorted(map(key, sized))
    empty = mix_sources(frame(spark, []))
    assert [e.count() for e in empty] == [0, 0, 0]


def test_tree_splits_exactly():
    quotas = np.array([100, 0, 7, 1003])
    tree = splitting_tree(quotas, 9, 3)
    assert tree.sum(axis=0).tolist() == quotas.tolist() and (tree >= 0).all() and np.ptp(tree.sum(axis=1)) <= 1
    assert (tree == splitting_tree(quotas, 9, 3)).all()


def test_quality_rules(spark):
    r = random.Random(6)
    good = lambda n: " ".join(r.choices(["the", "of", "and", "Some", "house", "garden", "walks", "in", "river", "green,", "old."], k=n))
    rows = [(k, good(150), "en", "s") for k in range(30)]
    rows += [(100, "bad### worse$$$ " * 40, "en", "s"), (101, " ".join(f"{good(1)}{k}***" for k in range(150)), "en", "s"), (102, "short", "en", "s"), (103, " ".join(f"x{k}" for k in range(200)), "en", "s"), (104, "a b\na b\n\n a b\nc", "qq", "s")] + ODD
    rows += [(105, "w " * 100_000, None, "s"), rows[0]]
    got = quality_rules(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {x.row.doc_id: x.quality for x in got}
    for doc_id, text, *_ in rows:
        ws = SPACE.findall(text or "")
        grams = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
        times = {g: grams.count(g) if len(grams) < 3000 else 9 for g in set(grams)}
        repeated = {k + d for k, g in enumerate(grams) if times[g] > 1 for d in range(3)}
        lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
        q = by[doc_id]
        assert (q.n_words, q.word_chars, q.n_symbols) == (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")))
        assert (q.n_dup_lines, q.n_repeat_words) == (len(lines) - len(set(lines)), len(repeated))
        assert q.base_failed == (len(ws) < 50 or 100 * len(repeated) > 50 * len(ws)) and not (q.base_failed and q.kept)
    assert all(by[k].kept for k in range(30)) and not by[101].kept and not by[103].kept and by[904].n_words == 1
    assert quality_rules(frame(spark, [])).count() == 0
