"""Phrase mining against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from gaugelake.llm import phrases
from gaugelake.llm.phrases import Buckets, Scan, mine_phrases, words_of

SCHEMA = "doc_id long, text string, lang string, a string"


def brute(rows, longest=3, least=10, covered=50, top=2000):
    counts, totals = Counter(), Counter()
    for _, text, lang, _ in rows:
        g = lang or "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^ \t]+", piece)
            totals[g] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    counts[g, tuple(w[i : i + n])] += 1
    cands = {k: f for k, f in counts.items() if len(k[1]) >= 2 and f >= least}
    out = {}
    for (g, w), a in cands.items():
        if any(h == g and len(v) > len(w) and 100 * f >= covered * a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) for (h, v), f in cands.items()):
            continue
        score, _, left, right = min((10**6 * a * a // (counts[g, w[:k]] * counts[g, w[k:]]), k, counts[g, w[:k]], counts[g, w[k:]]) for k in range(1, len(w)))
        out.setdefault(g, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((g, i, p.decode(), -a, left, right, totals[g], -s) for g, every in out.items() for i, (s, a, p, left, right) in enumerate(sorted(every)[:top], 1))


def corpus(seed, n=120):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(30)] + ["Über", "x\x00y", "né", "A", "　z", "é"]
    weights = [1 / (k + 1) for k in range(len(words))]
    text = lambda: "".join(w + r.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\x0b", ":"]) for w in r.choices(words, weights, k=r.randint(0, 60)))
    rows = [(k, text(), r.choice(["en", "en", "de", None]), "z") for k in range(n)]
    rows += [(None, None, "en", None), (1, "", "fr", None), (2, " ., ", None, "q"), (3, "new york city " * 400, "en", "q"), *[(4, "Hot Pair, hot pair", "de", None)] * 30, (5, "one two", "und", "")]
    return rows


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"bucket_bits": 6}), (3, {"max_words": 5, "min_count": 4, "bucket_bits": 17}), (4, {"min_count": 300, "top": 3}), (5, {"max_words": 2, "covered": 10, "top": 7})])
def test_equals_brute_force(spark, monkeypatch, seed, options):
    rows = corpus(seed)
    want = brute(rows, options.get("max_words", 3), options.get("min_count", 10), options.get("covered", 50), options.get("top", 2000))
    got = mine_phrases(spark.createDataFrame(rows, SCHEMA).repartition(3), **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == want and want


def test_empty_tables_and_other_names(spark):
    assert mine_phrases(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mine_phrases(spark.createDataFrame([(1, None, None, None), (2, "", "en", None)], SCHEMA)).count() == 0
    df = spark.createDataFrame([("a b " * 20, 7, "x")], "`rank` string, `score` int, phrase string")
    got = mine_phrases(df.withColumnRenamed("score", "group"), "rank", "group", max_words=2).collect()
    assert [(r.group, r.phrase, r.a, r.l, r.r, r.n) for r in got] == [("7", "a b", 20, 20, 20, 40), ("7", "b a", 19, 20, 20, 40)]


def test_long_texts_and_small_chunks(monkeypatch):
    """Windows, chunks and hand-overs of any size count alike."""
    text = ("aa bb cc dd, ee ff. " * 500 + "gg " * 900).encode()
    whole = [w for p in words_of(text) for w in p]
    monkeypatch.setattr(phrases, "WINDOW", 64)
    assert [w for p in words_of(text) for w in p] == whole and whole[:6] == [b"aa", b"bb", b"cc", b"dd", phrases.END, b"ee"]
    assert [w for p in words_of(b"x" * 500 + b" y") for w in p] == [b"x" * 500, b"y"]
    full = np.packbits(np.ones(1 << 10, np.uint8)).tobytes()
    count = lambda: dict(_counted(Scan(2, 2, 10, 10, full, full), text))
    want = count()
    monkeypatch.setattr(phrases, "CHUNK", 100)
    monkeypatch.setattr(phrases, "HELD", 3)
    assert count() == want and want["gg gg"] == 899 and want["aa bb"] == 500 and "dd ee" not in want


def _counted(scan, text):
    total = Counter()
    for batch in [*scan.read(text, "en"), *scan.finished()]:
        for kind, phrase, n in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
            if kind == 0:
                total[phrase.decode()] += n
    return total


def test_capped_counts_add_up():
    b = Buckets(8, 10)
    b.add(np.zeros(4, np.uint64))
    b.add(np.zeros(300, np.uint64))
    assert b.counts.max() == 10 and b.counts.sum() == 10
