"""License scans: exact containment join of text blocks with license notices.

A block is a run of consecutive words of the whole text, whatever its line feeds, for
every notice ``1 / THRESHOLD`` times as long as the notice. A notice is found in a
block when at least ``THRESHOLD`` of the notice's distinct words are in it. Every
notice found gives its label, except where more than half of the words between its
first and last match lie in those of another label's notice found with a higher
containment (so "version 3" of a license isn't "version 2" too).

The join orders each notice's words by their frequency in the whole corpus, rarest
first. Prefix filter: a block that reaches an overlap of o out of m words has one of
the first m - o + 1. Positional filter: if the rarest of its words is the q-th, only
words from the q-th on count, and o of them must stand within reach. Length filter:
a slice of texts with fewer than o such words has no block. What is left is verified.

Base phrases are looked for in the words of the whole text. Words are
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Defined cases: a
null or empty text has no words, empty labels and score 0; repeated rows are
scanned each; ties of containment give all labels; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgecast.llm import textkit as K
from forgecast.session import ensure_workers_can_import

# fixed values
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2",
                "cc by nc": "cc-by-nc"}
#: label -> notices; more can be given as a parameter
NOTICES = {
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge "
        "publish distribute sublicense and or sell copies of the software and to permit persons "
        "to whom the software is furnished to do so subject to the following conditions"),
    "apache-2": (
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy "
        "of the license at http www apache org licenses license 2 0"),
    "gpl-2": (
        "this work is licensed under the gnu general public license version 2",),
    "gpl-3": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms "
        "of the gnu general public license as published by the free software foundation either "
        "version 3 of the license or at your option any later version"),
    "lgpl-3": ("this work is licensed under the gnu lesser general public license version 3",),
    "mpl-2": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met",),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with "
        "or without fee is hereby granted",),
    "cc-by": (
        "this work is licensed under a creative commons attribution 4 0 international license",),
    "cc-by-nc": ("licensed under cc by nc 4 0",),
    "cc-by-sa": ("this work is licensed under cc by sa 4 0",),
}
THRESHOLD = 0.9
#: hits compared with their neighbours at a time
_PART = 4096


def templates(notices: dict[str, str | tuple[str, ...]]) -> list[tuple[str, str]]:
    """(label, text) of every notice with a word."""
    pairs = [(label, text) for label, texts in notices.items()
             for text in ([texts] if isinstance(texts, str) else texts)]
    return [(label, text) for label, text in pairs if len(_hash_words(text))]


def block_words(n_words: int, threshold: float) -> int:
    """Words of the blocks in which a notice of ``n_words`` words is looked for."""
    return math.ceil(n_words / threshold - 1e-9)


def needed(size: int, threshold: float) -> int:
    """Least overlap with a notice of ``size`` distinct words."""
    return math.ceil(threshold * size - 1e-9)


def _hash_words(text: str) -> np.ndarray:
    (_, t), = K.slices(pa.array([text], pa.large_string()))
    w = K.split_words(t, K.NON_ALNUM)
    return K.segment_hash(t.buf, w.starts, w.ends, K.FOLDED)


def _frequency_batches(universe: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(universe), dtype=np.int64)
        for batch in batches:
            for _, t in K.slices(batch.column(0)):
                w = K.split_words(t, K.NON_ALNUM)
                h = K.segment_hash(t.buf, w.starts, w.ends, K.FOLDED)
                at = np.searchsorted(universe, h)
                at[at == len(universe)] = 0
                total += np.bincount(at[universe[at] == h], minlength=len(universe))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(universe))), pa.array(total)], names=["word", "n"])
    return run


class NoticeIndex:
    """Notices as sets over one universe of words, each word with its rank, rarest first."""

    def __init__(self, pairs: list[tuple[str, str]], universe: np.ndarray, frequency: np.ndarray,
                 threshold: float) -> None:
        self.names = sorted({label for label, _ in pairs})
        self.label = np.array([self.names.index(label) for label, _ in pairs])
        self.universe = universe
        self.rank = np.full((len(pairs), len(universe)), -1)
        self.size, self.need, self.block = [], [], []
        for k, (_, text) in enumerate(pairs):
            h = _hash_words(text)
            words = np.unique(np.searchsorted(universe, h))
            rare = words[np.lexsort((universe[words], frequency[words]))]
            self.rank[k, rare] = np.arange(len(rare))
            self.size.append(len(words))
            self.need.append(needed(len(words), threshold))
            self.block.append(block_words(len(h), threshold))
        self.reach = max(self.block)


class Hits(NamedTuple):
    """Blocks that contain a notice: first and last matched word, label, containment, row."""

    first: np.ndarray
    last: np.ndarray
    label: np.ndarray
    share: np.ndarray
    row: np.ndarray


def _near(p: np.ndarray, rank: np.ndarray, size: int, need: int, block: int) -> np.ndarray:
    """Which places lie in a block around a prefix word that passes the positional filter."""
    step = np.zeros(len(p) + 1, dtype=np.int64)
    for q in range(size - need + 1):
        at, rest = p[rank == q], p[rank >= q]
        within = np.searchsorted(rest, at + block) - np.searchsorted(rest, at - block + 1)
        at = at[within >= need]
        np.add.at(step, np.searchsorted(p, at - block + 1), 1)
        np.add.at(step, np.searchsorted(p, at + block), -1)
    return np.cumsum(step[:-1]) > 0


def _distinct_from(p: np.ndarray, word: np.ndarray, block: int) -> np.ndarray:
    """Number of different words in the block that begins at each place."""
    n = len(p)
    order = np.lexsort((p, word))
    same = word[order[1:]] == word[order[:-1]]
    before = np.full(n, -1)
    before[order[1:][same]] = order[:-1][same]
    # a word counts in the blocks that begin after its last copy and reach it
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, np.maximum(before + 1, np.searchsorted(p, p - block + 1)), 1)
    step[1:] -= 1
    return np.cumsum(step[:-1])


def notice_hits(place: np.ndarray, word: np.ndarray, row: np.ndarray, index: NoticeIndex) -> Hits:
    """All blocks that contain a notice. ``place``: ascending; rows lie ``reach`` apart."""
    parts = [Hits(*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, float, np.int64)))]
    for k, (size, need, block) in enumerate(zip(index.size, index.need, index.block, strict=True)):
        rank = index.rank[k, word]
        at = np.flatnonzero(rank >= 0)
        if len(at) < need:
            continue
        at = at[_near(place[at], rank[at], size, need, block)]
        p = place[at]
        n = _distinct_from(p, word[at], block)
        ok = n >= need
        last = p[np.searchsorted(p, p[ok] + block) - 1]
        parts.append(Hits(p[ok], last, np.full(len(last), index.label[k]), n[ok] / size,
                          row[at[ok]]))
    return Hits(*map(np.concatenate, zip(*parts, strict=True)))


def without_variants(hits: Hits, reach: int) -> Hits:
    """The hits of which no better hit of another label takes more than half of the words."""
    order = np.argsort(hits.first, kind="stable")
    hits = Hits(*(x[order] for x in hits))
    lo = np.searchsorted(hits.first, hits.first - reach + 1)
    hi = np.searchsorted(hits.first, hits.last, side="right")
    keep = np.ones(len(order), dtype=bool)
    for part in range(0, len(order), _PART):
        a = np.arange(part, min(part + _PART, len(order)))
        n = hi[a] - lo[a]
        one = np.repeat(a, n)
        two = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[a], n)
        better = (hits.label[one] != hits.label[two]) & (hits.share[two] > hits.share[one])
        one, two = one[better], two[better]
        common = (np.minimum(hits.last[one], hits.last[two])
                  - np.maximum(hits.first[one], hits.first[two]) + 1)
        keep[one[2 * common > hits.last[one] - hits.first[one] + 1]] = False
    return Hits(*(x[keep] for x in hits))


def scan(t: K.Texts, index: NoticeIndex) -> tuple[K.Words, np.ndarray, list, np.ndarray]:
    """Words, base places (row, word, phrase), notice labels and best containment by row."""
    words = K.split_words(t, K.NON_ALNUM)
    h = K.segment_hash(t.buf, words.starts, words.ends, K.FOLDED)
    row = words.rows()
    places = [np.zeros((0, 3), dtype=np.int64)]
    for p, phrase in enumerate(BASE_PHRASES):
        w = _hash_words(phrase)
        at = np.arange(max(0, len(h) - len(w) + 1))
        for k, x in enumerate(w):
            at = at[h[at + k] == x]
        at = at[row[at] == row[at + len(w) - 1]]
        places.append(np.stack([row[at], at - words.first[row[at]], np.full(len(at), p)], axis=1))

    word = np.searchsorted(index.universe, h)
    word[word == len(index.universe)] = 0
    known = np.flatnonzero(index.universe[word] == h)
    hits = without_variants(notice_hits(known + index.reach * row[known], word[known], row[known],
                                        index), index.reach)
    labels: list[set[str]] = [set() for _ in range(t.rows)]
    score = np.zeros(t.rows)
    np.maximum.at(score, hits.row, hits.share)
    for r, k in np.unique(np.stack([hits.row, hits.label], axis=1), axis=0).tolist():
        labels[r].add(index.names[k])
    return words, np.concatenate(places), labels, score


def _scanner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        names = list(BASE_PHRASES.values())
        for batch in batches:
            for lo, t in K.slices(batch.column(1)):
                words, places, found, score = scan(t, index)
                base: list[set[str]] = [set() for _ in range(t.rows)]
                n = np.bincount(places[:, 0], minlength=t.rows)
                first = np.full(t.rows, np.iinfo(np.int64).max)
                last = np.full(t.rows, -1)
                np.minimum.at(first, places[:, 0], places[:, 1])
                np.maximum.at(last, places[:, 0], places[:, 1])
                for r, _, p in places.tolist():
                    base[r].add(names[p])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, t.rows), pa.array(words.counts, pa.int64()),
                     pa.array(n, pa.int64()), pa.array(first, mask=n == 0),
                     pa.array(last, mask=n == 0), pa.array([",".join(sorted(x)) for x in base]),
                     pa.array([",".join(sorted(x | y)) for x, y in zip(base, found, strict=True)]),
                     pa.array(np.where(n > 0, 1.0, score))],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word",
                           "base_labels", "labels", "score"])
    return run


def license_scan(docs: DataFrame, notices: dict[str, str | tuple[str, ...]] | None = None,
                 threshold: float = THRESHOLD, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Words, base phrases and license labels of every row."""
    spark = docs.sparkSession
    ensure_workers_can_import(spark)
    pairs = templates(notices or NOTICES)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    universe = np.unique(np.concatenate([_hash_words(x) for _, x in pairs]))
    counts = (rows.select("text").mapInArrow(_frequency_batches(universe), "word bigint, n bigint")
              .groupBy("word").agg(F.sum("n").alias("n")).collect())  # a row per notice word
    frequency = np.zeros(len(universe), dtype=np.int64)
    for word, n in counts:
        frequency[word] = n
    shared = spark.sparkContext.broadcast(NoticeIndex(pairs, universe, frequency, threshold))
    return rows.mapInArrow(_scanner(shared), "doc_id bigint, n_words bigint, n_base bigint, "
                           "first_word bigint, last_word bigint, base_labels string, "
                           "labels string, score double")
