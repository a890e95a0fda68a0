"""The pipeline's stages, one after another, against brute force on a small table."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from gaugelake.llm.pretokens import tokenizer_path  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "_row", "d1", "size"]
SPACE = re.compile(r"[^ \t-\r]+")


def shingles(text):
    ws = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in SPACE.findall(text)]
    return {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} - {()}


def test_stages_equal_brute_force(spark, tmp_path):
    r = random.Random(4)
    words = ["the", "of", "and", "in", "a", "to"] + [f"word{k}" for k in range(300)]
    make = lambda n: " ".join(r.choices(words[:6], k=1)[0] if r.random() < 0.4 else r.choice(words) for _ in range(n))
    rows = [(k, "\n".join(make(30) for _ in range(4)) + "\nthis line stands on every site", "en", f"s{k % 6}", 0) for k in range(60)]
    for k in range(60, 90):  # near copies
        ws = rows[k % 7][1].split(" ")
        ws[r.randrange(len(ws))] = "changed"
        rows.append((k, " ".join(ws), "en", f"s{k % 6}", 0))
    rows += [(200, None, "en", "s1", 0), (201, "", None, None, 0), (202, "short text", "en", "s1", 0), (203, "again and again " * 60, "en", "s2", 0), (204, "junk### more$$$ " * 90, "en", "s2", 0), (None, make(120), "en", "s3", 0)]
    rows += [rows[5], rows[5], (None, rows[11][1], "en", "s3", 0), (300, rows[-1][1], "en", "s3", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"_row": F.lit(1), "d1": F.lit("x"), "size": F.lit(None).cast("int")}).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen.append(docs)
    assert all(x.columns == COLUMNS for x in seen[:-1])
    good, lined, single, mixed, packed = (x.collect() for x in seen)
    passed = [(i, t) for i, t, *_ in rows if i is None or i < 90 or i == 300]
    assert Counter((x.doc_id, x.text) for x in good) == Counter(passed)

    sites, first = {}, {}
    for x in sorted(good, key=lambda x: (x.doc_id is None, x.doc_id)):
        for j, line in enumerate(x.text.split("\n")):
            if len(SPACE.findall(line)) >= 3:
                sites.setdefault(line.strip(), set()).add(x.source)
                first.setdefault(line.strip(), (x.doc_id, j))
    left = [(x.doc_id, "\n".join(line for j, line in enumerate(x.text.split("\n")) if len(sites.get(line.strip(), ())) < 5 or first[line.strip()] == (x.doc_id, j))) for x in good]
    assert Counter((x.doc_id, x.text) for x in lined) == Counter(x for x in left if x[1]) and any("every site" not in t for _, t in left)

    want = [(x.doc_id, x.text) for x in lined]  # rows without an id, and rows that share one, are rows like others
    sets, root = [shingles(t) for _, t in want], list(range(len(want)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(want)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(want):
        groups.setdefault(find(k), []).append((i is None, i or 0))
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in single) == sorted(min(g) for g in groups.values()) and len(single) < len(lined)
    want = {x.doc_id: x.text for x in single}
    assert len(want) == len(single)

    assert {x.doc_id for x in mixed} <= {x.doc_id for x in single}
    size = lambda xs: sum(len(SPACE.findall(x.text)) for x in xs)
    assert abs(size(mixed) - 1.5 * size(single)) <= 6 * max(len(SPACE.findall(x.text)) for x in single)
    times = {i: sum(x.doc_id == i for x in mixed) for i in want}
    assert max(times.values()) <= 2

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    counts = {}
    for p in packed:
        counts[p.doc_id] = counts.get(p.doc_id, 0) + p.length
        ids = tokenizer.encode(want[p.doc_id], add_special_tokens=False).ids + [2]
        assert np.frombuffer(p.ids, "<u4").tolist() == ids[p.start : p.start + p.length] and p.doc_tokens == len(ids)
    assert counts == {i: n * (len(tokenizer.encode(want[i], add_special_tokens=False).ids) + 1) for i, n in times.items() if n}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_stages_take_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, _row int")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
