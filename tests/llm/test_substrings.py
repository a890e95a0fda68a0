"""Repeated byte strings against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugelake.llm import substring_dedup
from gaugelake.llm.bwt import joined, repeated_windows
from gaugelake.llm.substring_dedup import anchors, remove_repeats


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=12), st.lists(st.text("ab", max_size=40), max_size=12), st.integers(2, 6), st.integers(2, 5))
def test_merged_transforms_find_every_repeat(some, more, width, shards):
    strings = [*some, *(m.encode() for m in more)]
    group, place = repeated_windows(strings, width, shards)
    begins = joined(strings)[1].tolist() if strings else []
    where = {}
    for s, at in zip(strings, begins, strict=True):
        for k in range(len(s) - width + 1):
            where.setdefault(s[k : k + width], []).append(at + k)
    got = {}
    for g, p in zip(group.tolist(), place.tolist(), strict=True):
        got.setdefault(g, []).append(p)
    assert sorted(map(sorted, got.values())) == sorted(v for v in where.values() if len(v) > 1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", max_size=60).map(str.encode), max_size=8))
def test_every_window_has_one_anchor_that_its_bytes_decide(texts):
    text, place, first, last, hashed = anchors(texts, 12, 4)
    seen, by = set(), {}
    for t, p, a, b, h in zip(text.tolist(), place.tolist(), first.tolist(), last.tolist(), hashed.tolist(), strict=True):
        for s in range(a, b + 1):
            assert (t, s) not in seen and s <= p <= s + 8
            seen.add((t, s))
            assert by.setdefault(texts[t][s : s + 12], (p - s, h)) == (p - s, h)
    assert seen == {(t, s) for t, x in enumerate(texts) for s in range(len(x) - 11)}


def brute(rows, width):
    first, out = {}, []
    known = sorted({(i, t) for i, t in rows if i is not None and t is not None})
    for i, t in known:
        data = t.encode()
        for s in range(len(data) - width + 1):
            first.setdefault(data[s : s + width], (i, s))
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        if i is not None:
            for s in range(len(data) - width + 1):
                if first[data[s : s + width]] != (i, s):
                    gone[s : s + width] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(data), int(gone.sum()), runs, bytes(np.frombuffer(data, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize(("chunk", "collection"), [(4096, 1_500_000), (3, 2000)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, chunk, collection):
    monkeypatch.setattr(substring_dedup, "CHUNK_DOCS", chunk)
    monkeypatch.setattr(substring_dedup, "COLLECTION_BYTES", collection)
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", collection // 3)
    r = random.Random(9)
    words = "die the naïve 日本 of and house tree über alpha beta gamma delta".split()
    make = lambda n: " ".join(r.choice(words) + str(r.randint(0, 99)) for _ in range(n))
    shared, line = make(40), make(12)
    rows = [(k, make(30)) for k in range(12)]
    rows += [(20 + k, f"{make(r.randint(0, 12))} {shared[: r.randint(60, 200)]} {make(10)}") for k in range(25)]
    rows += [(50 + k, rows[k % 3][1]) for k in range(9)] + [(70 + k, make(8) + line + make(8)) for k in range(15)]
    rows += [(90, "ab" * 400), (91, "x" * 150), (92, "x" * 99), (93, "x" * 100), (94, ""), (95, None), (None, shared), (96, "\0" * 300), (97, "é" * 120), (-5, shared), rows[3], (98, make(3000) + shared)]
    for base in range(3):
        for k in range(8):
            text = list(rows[base][1])
            text[r.randrange(len(text))] = "Z"
            rows.append((200 + base * 10 + k, "".join(text)))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, starts string, kept int").repartition(3)
    got = [(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in remove_repeats(df).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, 100), key=repr)
    assert remove_repeats(df.limit(0)).count() == 0
