"""License scans against brute force over all blocks and all templates."""

import random
import re

from gaugelake.llm import license_scan
from gaugelake.llm.license_scan import PHRASES, TEMPLATES, Index, scan_licenses, word_ids, words_of

SCHEMA = "doc_id long, text string, labels string, score string"


def split(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(text, templates, phrases, percent):
    w = split(text)
    places = [(label, i) for label, p in phrases for i in range(len(w)) if w[i : i + len(split(p))] == split(p)]
    found = []
    for t, (label, template) in enumerate(templates):
        tokens, k = set(split(template)), len(split(template))
        for a in range(0, len(w), k):
            shared = len(tokens & set(w[a : a + 2 * k]))
            if 100 * shared >= percent * len(tokens):
                found.append((label, t, a, min(a + 2 * k, len(w)), shared, len(tokens)))
    base = {label for label, _ in places}
    starts = [i for _, i in places]
    return (
        len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {f[0] for f in found})),
        max((f[4] / f[5] for f in found), default=0.0), sorted(found),
    )


def texts(seed):
    r = random.Random(seed)
    pool = [w for _, t in TEMPLATES for w in t.split()]
    noise = lambda n: " ".join(r.choice(pool if r.random() < 0.4 else ["the", "und", "Öl", "x9", "_", "A-b", "é"]) for _ in range(n))

    def copy():
        words = r.choice(TEMPLATES)[1].split()
        for _ in range(r.randint(0, len(words) // 4)):
            words[r.randrange(len(words))] = r.choice(["foo", "the", "license"])
        return " ".join(words)

    out = [f"{noise(r.randint(0, 90))}\n{copy()} {noise(r.randint(0, 90))} {copy() if k % 3 else ''}" for k in range(60)]
    return [*out, None, "", "...", "MIT\x00License mit license", "general public license general  PUBLIC-license", "apache", "mit", noise(4000)]


def test_equals_brute_force(spark):
    rows = [(k if k % 9 else None, t, "x", "y") for k, t in enumerate(texts(1))] + [(3, "Released under the MIT License", None, None)] * 3
    for percent in (60, 85, 100):
        got = scan_licenses(spark.createDataFrame(rows, SCHEMA).repartition(3), percent=percent).collect()
        assert len(got) == len(rows)
        shaped = sorted(repr((r.doc_id, *list(r)[1:-1], sorted(tuple(m) for m in r.matches))) for r in got)
        assert shaped == sorted(repr((i, *brute(t, TEMPLATES, PHRASES, percent))) for i, t, *_ in rows)
    assert any(r.score == 1 for r in got) and any(r.labels != r.base_labels for r in got)


def test_own_templates_empty_tables_and_no_phrases(spark):
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "alpha beta gamma delta " * 3, None, None), (2, "alpha", None, None)], SCHEMA)
    got = {r.doc_id: r for r in scan_licenses(df, (("own", "Alpha beta GAMMA"), ("none", "zeta eta theta")), ()).collect()}
    assert (got[1].labels, got[1].score, got[1].n_base, got[1].first_word) == ("own", 1.0, 0, None) and got[2].labels == "" and got[2].score == 0
    assert [m.first for m in got[1].matches] == [0, 3, 6]


def test_very_long_texts_are_cut_in_windows(monkeypatch):
    text = " ".join(t for _, t in TEMPLATES * 50).encode()
    names = {w: k for k, w in enumerate(sorted({w for _, t in TEMPLATES for w in words_of(t)}))}
    whole = word_ids(text, names)
    monkeypatch.setattr(license_scan, "WINDOW", 50)
    assert (word_ids(text, names) == whole).all() and len(whole) == sum(len(words_of(t)) for _, t in TEMPLATES) * 50


def test_filters_only_skip_what_cannot_match():
    """Any order of frequency gives the same matches."""
    names = sorted({w for _, t in TEMPLATES for w in words_of(t)} | {w for _, p in PHRASES for w in words_of(p)})
    r = random.Random(5)
    indexes = [Index(TEMPLATES, PHRASES, 70, {w: r.randrange(5) for w in names}) for _ in range(4)]
    for text in texts(6):
        found = [sorted(i.matches(word_ids((text or "").encode(), i.names))) for i in indexes]
        assert found[0] == found[1] == found[2] == found[3]
