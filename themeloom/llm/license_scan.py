"""Licence scans by a positional index of rare tokens.

Templates (licence notices and key phrases) are indexed by the places of their rare words: inverse
document frequencies come from a pass over all texts, and a word is posted if it is in one of
``RARE`` documents at most, or among the ``ANCHORS`` rarest of its template. So the words of a file
that are looked up are its licence words of highest frequency rank, all of them, and a notice is
found by those that stand in it whichever others were altered. A hit of a template's word at
template place t and file place f votes for a start at f - t, and postings that agree on the
relative position make a candidate. A candidate counts if the template's mandatory key phrases stand word for word in the
stretch, and enough of its words are at their places (``SLACK`` words of drift allowed).

Base phrases are templates that are their own key phrase, so their places come out of the same
index; all their places are counted.

Defined cases: null text is empty and has no words; without a place, first_word and last_word are
null and labels empty; an empty table gives an empty result; repeated rows are scanned each;
equal frequencies go by word, equal coverage by the earlier start; very long texts are read whole, one
at a time; columns besides id and text are not read, so their names may clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, arrow_schema, prepare, text_of

#: Phrases of the base and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Wording of public licence notices, with the phrases that must stand in a match.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("granted free of charge to any person obtaining a copy",)),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("except in compliance with the license",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("redistribute it and or modify it", "gnu general public license")),
    ("lgpl", "GNU Lesser General Public License", ("lesser general public license",)),
    ("agpl", "GNU Affero General Public License", ("affero general public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd", "BSD 3 Clause License", ("bsd 3 clause",)),
    ("bsd", "BSD 2 Clause License", ("bsd 2 clause",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("epl", "Eclipse Public License", ("eclipse public license",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("cc0", "CC0 1.0 Universal", ("cc0 1 0 universal",)),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("cc-by", "licensed under CC BY 4.0", ("under cc by 4 0",)),
    ("cc-by-sa", "licensed under CC BY-SA 4.0", ("under cc by sa 4 0",)),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", ("under cc by nc 4 0",)),
    ("cc-by-nd", "licensed under CC BY-ND 4.0", ("under cc by nd 4 0",)),
    ("proprietary", "All rights reserved", ("all rights reserved",)),
)
ANCHORS, RARE, SLACK, COVERAGE = 3, 100, 3, 0.6

#: Bytes that no word has become blanks; A-Z are lowered.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 127 else c for c in range(256))

RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


class Template:
    def __init__(self, label: str, text: str, phrases: tuple[str, ...], base: bool):
        self.label, self.base, self.words = label, base, words_of(text)
        self.phrases = [words_of(p) for p in phrases]


def templates() -> list[Template]:
    return [Template(label, p, (p,), True) for p, label in BASE.items()] + [Template(a, b, c, False) for a, b, c in NOTICES]


def _finds(words: list[bytes], phrase: list[bytes], lo: int, hi: int) -> bool:
    first, n = phrase[0], len(phrase)
    return any(words[i] == first and words[i : i + n] == phrase for i in range(max(lo, 0), min(hi, len(words)) - n + 1))


class Index:
    """Postings of the templates' rare words: word -> [(template, place)]."""

    def __init__(self, frequency: dict[bytes, int], documents: int, made: list[Template] | None = None):
        self.made = templates() if made is None else made
        idf = lambda w: math.log((documents + 1) / (frequency.get(w, 0) + 1))
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.made):
            ranked = sorted(set(t.words), key=lambda w: (-idf(w), w))
            for w in ranked[:1] if t.base else ranked[:ANCHORS] + [w for w in ranked[ANCHORS:] if frequency.get(w, 0) * RARE <= documents]:
                for place in (i for i, x in enumerate(t.words) if x == w):
                    self.postings.setdefault(w, []).append((k, place))
        self.absent = set(self.postings).isdisjoint

    def scan(self, words: list[bytes]) -> tuple[list[int], dict[int, float]]:
        """Starts of base phrases, and of every other template found its best coverage."""
        if self.absent(words):
            return [], {}
        votes: Counter = Counter()
        get = self.postings.get
        for f, w in enumerate(words):
            for k, place in get(w) or ():
                votes[k, f - place] += 1
        starts, best = {}, {}
        for k, start in votes:
            t = self.made[k]
            if t.base:
                if start >= 0 and words[start : start + len(t.words)] == t.words:
                    starts[start, k] = 1
                continue
            if best.get(k) == 1.0:
                continue
            end = start + len(t.words)
            if all(_finds(words, p, start - SLACK, end + SLACK) for p in t.phrases):
                share = self.coverage(words, t, start)
                if share >= COVERAGE:
                    best[k] = max(best.get(k, 0.0), share)
        return sorted(starts), best

    @staticmethod
    def coverage(words: list[bytes], t: Template, start: int) -> float:
        """The share of the template's words that stand at their places, with some drift."""
        n = 0
        for place, w in enumerate(t.words):
            at = start + place
            n += w in words[max(at - SLACK, 0) : max(at + SLACK + 1, 0)]
        return n / len(t.words)


class _Scan:
    def __init__(self, index):
        self.index = index

    def __call__(self, doc_id, texts):
        index, out = self.index.value, [[] for _ in range(7)]
        for text in texts:
            words = words_of(text)
            places, best = index.scan(words)
            starts = sorted(p for p, _ in places)
            base = sorted({index.made[k].label for _, k in places})
            labels = sorted({index.made[k].label for k in best} | set(base))
            score = 1.0 if places else max(best.values(), default=0.0)
            row = (len(words), len(places), starts[0] if starts else None, starts[-1] if starts else None, ",".join(base), ",".join(labels), score)
            for c, v in zip(out, row, strict=True):
                c.append(v)
        return [doc_id, *out]


class _Frequencies:
    def __init__(self, vocabulary: frozenset[bytes]):
        self.vocabulary = vocabulary

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n, common = Counter(), 0, self.vocabulary.intersection
        for b in batches:
            n += b.num_rows
            for text in b.column(0).to_pylist():
                seen.update(common(words_of(text)))
        seen[b""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], schema=arrow_schema("word binary, n long"))


def build_index(docs: DataFrame, text_col: str = "text", made: list[Template] | None = None) -> Index:
    """Counts in how many documents each word of the templates is (a row a word and task), and posts the rare ones."""
    prepare(docs.sparkSession)
    made = templates() if made is None else made
    vocabulary = frozenset(w for t in made for w in t.words)
    counts = docs.select(text_of(text_col).alias("text")).mapInArrow(_Frequencies(vocabulary), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    got = {bytes(r.word): r.n for r in counts.collect()}  # the templates' words at most
    return Index(got, got.get(b"", 0), made)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", made: list[Template] | None = None) -> DataFrame:
    """RESULT for each row of docs."""
    spark = docs.sparkSession
    prepare(spark)
    index = spark.sparkContext.broadcast(build_index(docs, text_col, made))
    return arrow_pass(docs, [F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")], _Scan(index), RESULT)
