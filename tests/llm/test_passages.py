"""Copies without three sentences, or with very short ones, and copies of any passage, against brute force."""

import random

import numpy as np

from gaugelake.llm.sentence_spans import dedup_spans, left_of, winnowed, words_of

SCHEMA = "doc_id long, text string"


def test_copies_without_sentences_go(spark):
    r = random.Random(3)
    make = lambda n, stop="": " ".join(f"w{r.randrange(500)}{stop}" for _ in range(n))
    flat, shout, short, wide = make(1856), make(60, "!!"), "one title only", "。".join(make(3) for _ in range(20))
    passage, line = make(51), make(60)
    rows = [(1, flat), (2, flat), (3, shout), (4, f"{make(40)} {shout} {make(30)}"), (5, short), (6, short), (7, wide), (8, f"{make(5)}。{wide}"), (9, f"{make(70)} {passage} {make(70)}"), (10, f"{make(33)} {passage}"), (11, "a. b. c. d. e. f. g. h. i. " * 4), (12, None), (13, ""), (None, line), (None, f"{line} x"), (14, "same " * 400), (15, flat), (15, flat), (16, "x" + make(20))]
    found = dedup_spans(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    got = {}
    for x in found:
        got.setdefault(x.row.doc_id, []).append(x)
    assert len(found) == len(rows)
    texts = {i: xs[0].text for i, xs in got.items()}
    for k in (1, 3, 5, 7, 9, 12, 13, 16):
        assert texts[k] == dict(rows)[k] and got[k][0].n_spans == 0
    assert texts[2] == texts[6] == "" and [x.text for x in got[15]] == ["", ""]
    assert shout.split()[30] + " " + shout.split()[31] not in texts[4] and got[4][0].n_spans == 1
    assert len(texts[8]) < len(wide) / 2
    assert len(texts[10].split()) <= 33 + 31 and texts[11] == "a. b. c. d. e. f. g. h. i. "
    assert 0 < len(texts[14].split()) < 400
    assert sum(len(x.text.split()) for x in got[None]) < 61 + 31
    assert dedup_spans(spark.createDataFrame([], SCHEMA)).count() == 0


def test_each_long_passage_holds_a_span_and_each_word_stays_somewhere(spark):
    r = random.Random(9)
    vocabulary = [f"v{k}" + r.choice(["", "", "", ".", ","]) for k in range(3000)]
    pool = [" ".join(r.choices(vocabulary, k=r.randint(51, 90))) for _ in range(15)]
    rows = [(k, " ".join([" ".join(r.choices(vocabulary, k=r.randint(0, 40))), r.choice(pool), " ".join(r.choices(vocabulary, k=r.randint(0, 40))), *r.choices(pool, k=k % 2)])) for k in range(80)]
    left = {x.row.doc_id: x.text.split() for x in dedup_spans(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    seen = set()
    for k, text in rows:
        ws, own = text.split(), set()
        for i in range(len(ws) - 50):
            w = tuple(ws[i : i + 51])
            own.add(w)
            if w in seen:  # no later copy of 51 words stays whole
                assert not any(tuple(left[k][j : j + 51]) == w for j in range(len(left[k]) - 50))
        seen |= own
    assert {w for ws in left.values() for w in ws} == {w for _, t in rows for w in t.split()}


def test_words_and_winnowing():
    text = "  Ab,\tc d\n\ne。f。 g\x0b "
    h, ends = words_of(text)
    assert len(h) == 6 and ends.tolist() == [3, 4, 5, 6]
    assert left_of(text, np.array([6])) == ("", 6, 1) and left_of(text, np.array([(1 << 32) + 2, 2 << 32 | 1])) == ("  Ab,\te。f。 g\x0b ", 2, 1)
    values = np.random.default_rng(1).integers(0, 9, 200).astype(np.uint64) << np.uint64(32)
    want = {max(j for j in range(i, i + 7) if values[j] == values[i : i + 7].min()) for i in range(194)}
    assert set(winnowed(values, 7).tolist()) == want and len(winnowed(values[:6], 7)) == 0 and len(winnowed(values, 7)) == 194
