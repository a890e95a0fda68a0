"""License scans: an exact join of text blocks with license templates by set containment.

A template's tokens are put in the order of their frequency in the whole corpus, rarest first. A block that holds enough of them holds one of the
first few (prefix filter), has enough template tokens of its own (length filter), and enough of both are left behind the first shared one
(positional filter). What passes is compared in full, so every block that meets the threshold is found and no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.llm._shared import ship

#: (label, text): notices and opening passages of public licenses, by which a text shows its license.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org. "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc", "Licensed under CC BY-NC 4.0."),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)
#: (label, words): phrases that name a license by themselves.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

#: Letters become small, all other ASCII but digits a space.
_FOLD = bytes(c if c >= 128 or 48 <= c < 58 or 97 <= c < 123 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
#: Bytes of a long text that are cut into words at once.
WINDOW = 1 << 22


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def word_ids(text: bytes, names: dict[bytes, int]) -> np.ndarray:
    """The number of each word, -1 for those without one."""
    text, parts, start = text.translate(_FOLD), [], 0
    while start < len(text):
        end = text.find(b" ", start + WINDOW)
        end = len(text) if end < 0 else end
        parts.append(np.array([names.get(w, -1) for w in text[start:end].split()], np.int32))
        start = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def token_counts(texts: DataFrame, names: dict[bytes, int]) -> dict[bytes, int]:
    """How often each of ``names`` occurs in all texts: a row for each of them, as many as the templates have tokens."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(len(names) + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                total += np.bincount(word_ids(text.as_py(), names) + 1, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(names)), pa.int32()), pa.array(total[1:], pa.int64())], ["token", "n"])

    ship(texts.sparkSession)
    found = {r.token: r.n for r in texts.mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}
    return {w: found.get(k, 0) for w, k in names.items()}


class Index:
    """Templates as sets of token ranks (0: rarest), with their prefixes."""

    def __init__(self, templates: tuple, phrases: tuple, percent: int, counts: dict[bytes, int]) -> None:
        order = sorted(counts, key=lambda w: (counts[w], w))
        self.names = {w: rank for rank, w in enumerate(order)}
        self.phrases = [(label, np.array([self.names[w] for w in words_of(p)], np.int32)) for label, p in phrases]
        self.labels = [label for label, _ in templates]
        self.sizes = [len(words_of(t)) for _, t in templates]  # a block is twice as long and starts at each multiple
        self.sets = [np.array(sorted({self.names[w] for w in words_of(t)}), np.int32) for _, t in templates]
        self.least = [-(-percent * len(s) // 100) for s in self.sets]
        #: For each template, whether a token is one of its own, and whether one of its prefix.
        self.own, self.first = (np.zeros((len(templates), len(order) + 1), bool) for _ in range(2))
        for t, s in enumerate(self.sets):
            self.own[t, s] = True
            self.first[t, s[: len(s) - self.least[t] + 1]] = True
        self.prefix = self.first.any(axis=0)

    def matches(self, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(template, start, end, shared tokens) of every block that meets the threshold. ids: -1 for other words, which is the last, false entry of the tables."""
        found = []
        hits = np.flatnonzero(self.prefix[ids])
        if not len(hits):
            return found
        for t, size in enumerate(self.sizes):
            at = hits[self.first[t, ids[hits]]] // size
            for block in np.unique(np.concatenate([at, at[at > 0] - 1])).tolist():
                start, end = block * size, min((block + 2) * size, len(ids))
                mine = np.unique(ids[start:end])
                mine = mine[mine >= 0]
                if len(mine) < self.least[t]:
                    continue
                held = self.own[t, mine]
                j = int(held.argmax())
                i = int(np.searchsorted(self.sets[t], mine[j]))
                if min(len(self.sets[t]) - i, len(mine) - j) < self.least[t]:
                    continue
                shared = int(held.sum())
                if shared >= self.least[t]:
                    found.append((t, start, end, shared))
        return found

    def places(self, ids: np.ndarray) -> list[tuple[str, np.ndarray]]:
        """(label, starts) of each phrase."""
        out = []
        for label, phrase in self.phrases:
            at = np.flatnonzero(ids[: max(len(ids) - len(phrase) + 1, 0)] == phrase[0])
            for k in range(1, len(phrase)):
                at = at[ids[at + k] == phrase[k]]
            out.append((label, at))
        return out


_OUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label: string, template: int, first: long, past: long, shared: int, size: int>>"


def scan_licenses(docs: DataFrame, templates: tuple = TEMPLATES, phrases: tuple = PHRASES, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, matches)`` for each row.

    Words are runs of digits, letters (A-Z as a-z) and characters beyond ASCII of the whole text. n_base counts the places of ``phrases``; first_word
    and last_word are the least and the greatest start (null: none). A template of k words is compared with every block of 2 k words that starts at a
    multiple of k (the last ones are shorter), so that each passage of its length lies in a block; a block that holds ``percent`` of its different words
    or more is a match. labels: those of phrases and matches, different ones in order, with commas; score: the highest share of a match, 0 without one.

    Null and empty texts have no words and empty labels. Rows are judged one by one: repeated rows and null ids come back as they are; texts of any length
    are taken whole; an empty table gives an empty result; other columns are not read. What is sent to the tasks is the templates, whose number the caller gives.
    """
    spark = docs.sparkSession
    tokens = sorted({w for _, t in (*templates, *phrases) for w in words_of(t)})
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    counts = token_counts(rows.select("text"), {w: k for k, w in enumerate(tokens)})

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index = Index(templates, phrases, percent, counts)
        for batch in batches:
            out = []
            for text in batch.column(1).cast(pa.binary()):
                ids = word_ids(text.as_py(), index.names)
                places = index.places(ids)
                starts = np.concatenate([at for _, at in places]) if places else np.zeros(0, np.int64)
                found = index.matches(ids)
                base = {label for label, at in places if len(at)}
                every = base | {index.labels[t] for t, *_ in found}
                matches = [{"label": index.labels[t], "template": t, "first": a, "past": b, "shared": k, "size": len(index.sets[t])} for t, a, b, k in found]
                ends = (int(starts.min()), int(starts.max())) if len(starts) else (None, None)
                score = max((k / len(index.sets[t]) for t, _, _, k in found), default=0.0)
                out.append((len(ids), len(starts), *ends, ",".join(sorted(base)), ",".join(sorted(every)), score, matches))
            if out:
                spans = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first", pa.int64()), ("past", pa.int64()), ("shared", pa.int32()), ("size", pa.int32())]))
                kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), spans]
                names = [c.split()[0] for c in _OUT.split(", ")[:7]] + ["matches"]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], ["id", *names])

    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {_OUT}").withColumnRenamed("id", id_col)
