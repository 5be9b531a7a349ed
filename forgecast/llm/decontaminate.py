"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

A document is contaminated by an item of m words if a run of its words has a
word edit distance of at most floor(m / 5) to the item.

An item is cut into blocks of at most ``BLOCK_WORDS`` words. Of the blocks of an item
within m / 5 edits, one at least is within a fifth of its own words (if all had
more, so had the item), so long items need no more walks than short ones. Per text,
every block-sized window at every word is a candidate:

1. Count filter, which loses nothing: within k edits a window shares all but
   2k of the block's m - 1 word pairs, so fewer pairs of the items' vocabulary
   rule it out.
2. CGK: a random walk over the words copies the current word and moves on or
   stays, as a random bit of (step, word) says. Edit distance becomes Hamming
   distance between walks, of which the first 3m / 2 steps count: later ones lie mostly past
   the window, where all walks agree.
3. Bit sampling: each of the repetitions takes its own walk and samples a few
   of its steps as a key; windows and blocks meet on equal keys. The number of
   repetitions follows from the target recall.
4. Each meeting pair is verified by the edit distance of the block to the best run
   from the window's start on, and then of the whole item to the runs around it.

Items are sent to the tasks in blocks of at most ``ITEM_BLOCK`` items, one pass
over the documents per block, so what is broadcast is bounded.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Defined cases: null and
empty texts and items never match; items of fewer than ``MIN_ITEM_WORDS`` words
match word by word only; a text may be shorter than an item by its edits; the first window of least distance is reported; repeated rows are
reported each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgecast.llm import textkit as K
from forgecast.session import ensure_workers_can_import

MIN_ITEM_WORDS = 5
EDITS_PER_WORDS = 5  # one edit per so many words of an item
SAMPLED_STEPS = 2
BLOCK_WORDS = 20
#: share of equal steps of a block's window at the largest distance. Its square is below the
#: share of equal keys that 300 pairs a length and kind of edit gave (5 to 20 words: 0.49 to
#: 0.77), as pairs differ; with it windows of 20 words that lost 4 meet with 0.995
AGREEMENT = 0.35
RECALL = 0.99
ITEM_BLOCK = 20_000
#: window starts whose walks are taken together; bytes of text searched together
STARTS = 1 << 12
#: cells of a row of edit distances taken together
CELLS = 1 << 21
SLICE_BYTES = 4 << 20

_U = np.uint64


def repetitions(agreement: float = AGREEMENT, steps: int = SAMPLED_STEPS,
                recall: float = RECALL) -> int:
    """Independent samples with which a pair meets at least once with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agreement ** steps))


def sampled_steps(lengths: np.ndarray, seed: int, steps: int = SAMPLED_STEPS) -> np.ndarray:
    """(lengths, steps): the steps of a walk that repetition ``seed`` samples per item length."""
    return np.stack([np.random.default_rng((seed, m)).choice(3 * m // 2, steps, replace=False)
                     for m in lengths.tolist()])


def walk_keys(words: np.ndarray, who: np.ndarray, length: np.ndarray, sampled: np.ndarray,
              seed: int) -> np.ndarray:
    """Keys of one repetition for the windows words[who, :length].

    One walk per row of ``words`` (word hashes from a start on, 0 past the text)
    serves windows of all lengths; what lies past a window counts as 0.
    ``sampled`` has the steps of each window.
    """
    rows, width = words.shape
    wide = np.concatenate([words, np.zeros((rows, 1), np.uint64)], axis=1)
    steps = int(sampled.max()) + 1
    at = np.zeros((steps, rows), dtype=np.int32)
    copied = np.empty((steps, rows), dtype=np.uint64)
    place = np.arange(rows)
    for step in range(steps):
        copied[step] = word = wide[place, at[step]]
        if step + 1 < steps:
            salt = _U((seed * 1_000_003 + step + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            move = (((word ^ salt) * _U(0xBF58476D1CE4E5B9)) >> _U(63)).astype(np.int32)
            at[step + 1] = np.minimum(at[step] + move, width)
    key = length.astype(np.uint64) * _U(1000) + _U(seed)
    for k in range(sampled.shape[1]):
        s = sampled[:, k]
        key = K.mix(key * _U(31) + np.where(at[s, who] < length, copied[s, who], _U(0)))
    return key


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Word edit distance of each row of a to the same row of b (equal shapes)."""
    count, m = a.shape
    place = np.arange(m + 1)
    row = np.repeat(place[None, :], count, axis=0)
    for i in range(1, m + 1):
        best = np.empty_like(row)
        best[:, 0] = i
        best[:, 1:] = np.minimum(row[:, :-1] + (a[:, i - 1:i] != b), row[:, 1:] + 1)
        row = np.minimum.accumulate(best - place, axis=1) + place
    return row[:, -1]


def distances_from(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least word edit distance of each row of a to a run of b from each place on."""
    count, width = b.shape
    a, b, place = a[:, ::-1], b[:, ::-1], np.arange(width + 1)
    row = np.zeros((count, width + 1), dtype=np.int64)  # the run may end anywhere
    for i in range(1, a.shape[1] + 1):
        best = np.empty_like(row)
        best[:, 0] = i
        best[:, 1:] = np.minimum(row[:, :-1] + (a[:, i - 1:i] != b), row[:, 1:] + 1)
        row = np.minimum.accumulate(best - place, axis=1) + place
    return row[:, ::-1]


class ItemIndex:
    """One part of the items: words, blocks, word pairs and the keys of every repetition."""

    def __init__(self, ids: list[int], texts: list[str | None]) -> None:
        found: list[tuple[int, np.ndarray]] = []
        short: dict[int, list[tuple[int, int]]] = {}  # by length: hash and id
        for lo, t in K.slices(pa.array(texts, pa.large_string())):
            words = K.split_words(t, K.SPACES)
            h = K.segment_hash(t.buf, words.starts, words.ends, K.FOLDED)
            found += [(ids[lo + i], h[a:b]) for i, (a, b) in enumerate(
                zip(words.first[:-1], words.first[1:], strict=True)) if b - a >= MIN_ITEM_WORDS]
            for i in np.flatnonzero((words.counts > 0) & (words.counts < MIN_ITEM_WORDS)).tolist():
                w = h[words.first[i]:words.first[i + 1]]
                short.setdefault(len(w), []).append((int(K.window_hash(w, len(w))[0]),
                                                     ids[lo + i]))
        self.short = {m: (np.array([x for x, _ in sorted(of)], dtype=np.uint64),
                          np.array([i for _, i in sorted(of)], dtype=np.int64))
                      for m, of in short.items()}
        self.ids = np.array([i for i, _ in found], dtype=np.int64)
        self.item_length = np.array([len(w) for _, w in found], dtype=np.int64)
        self.flat = np.concatenate([np.zeros(0, np.uint64), *(w for _, w in found)])
        self.item_first = np.cumsum(self.item_length) - self.item_length
        blocks = [(i, a, b - a) for i, (_, w) in enumerate(found) for a, b in block_bounds(len(w))]
        # per block: its item, its place in it, its number of words
        self.item, self.offset, self.length = np.array(blocks, dtype=np.int64).reshape(-1, 3).T
        self.lengths = np.unique(self.length)
        self.words = np.zeros((len(blocks), int(self.length.max(initial=0))), dtype=np.uint64)
        for k, (i, a, n) in enumerate(blocks):
            self.words[k, :n] = found[i][1][a:a + n]
        self.pairs = np.unique(np.concatenate(
            [np.zeros(0, np.uint64), *(_pair_hash(w[:-1], w[1:]) for _, w in found)]))
        self.rounds = []  # per repetition: sampled steps by length, sorted keys, their blocks
        for r in range(repetitions() if found else 0):
            steps = sampled_steps(self.lengths, r)
            mine = steps[np.searchsorted(self.lengths, self.length)]
            keys = walk_keys(self.words, np.arange(len(blocks)), self.length, mine, r)
            order = np.argsort(keys, kind="stable")
            self.rounds.append((steps, keys[order], order))


def block_bounds(m: int) -> list[tuple[int, int]]:
    """(first, end) of the blocks of an item of m words, of nearly equal sizes."""
    n = -(-m // BLOCK_WORDS)
    return [(i * m // n, (i + 1) * m // n) for i in range(n)]


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return K.mix(a * _U(3) + b)


def _meetings(index: ItemIndex, words: np.ndarray, who: np.ndarray,
              length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, block) pairs with an equal key in some repetition."""
    out = []
    row = np.searchsorted(index.lengths, length)
    for r, (steps, keys, order) in enumerate(index.rounds):
        mine = walk_keys(words, who, length, steps[row], r)
        lo = np.searchsorted(keys, mine, side="left")
        n = np.searchsorted(keys, mine, side="right") - lo
        window = np.repeat(np.arange(len(mine)), n)
        at = np.arange(len(window)) + np.repeat(lo - (np.cumsum(n) - n), n)
        out.append(window * len(keys) + order[at])
    both = np.unique(np.concatenate(out))
    window, block = both // len(index.item), both % len(index.item)
    ok = length[window] == index.length[block]
    return window[ok], block[ok]


def _candidates(index: ItemIndex, h: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, length) of the windows that pass the count filter; last: end of a word's text."""
    pair = _pair_hash(h[:-1], h[1:])
    near = np.searchsorted(index.pairs, pair)
    near[near == len(index.pairs)] = 0
    known = np.concatenate([[0], np.cumsum(index.pairs[near] == pair)])
    need = index.lengths - 1 - 2 * (index.lengths // EDITS_PER_WORDS)
    start = np.arange(len(h))
    reach = np.minimum(start + int(index.lengths[-1]) - 1, last - 1)  # no pair crosses texts
    start = start[known[reach] - known[start] >= need.min()]
    found = []
    for m, least in zip(index.lengths.tolist(), need.tolist(), strict=True):
        # a text may end up to a fifth of the words early; what lies past it counts as 0
        at = start[start + m - m // EDITS_PER_WORDS <= last[start]]
        found.append(at[known[np.minimum(at + m, last[at]) - 1] - known[at] >= least])
    return np.concatenate(found), np.repeat(index.lengths, [len(x) for x in found])


def _run(h: np.ndarray, start: np.ndarray, width: int, end: np.ndarray) -> np.ndarray:
    """Word hashes from each start on, 0 past the text's end."""
    place = start[:, None] + np.arange(width)
    inside = place < end[:, None]
    return np.where(inside, h[np.where(inside, place, 0)], np.uint64(0))


def _whole_items(index: ItemIndex, h: np.ndarray, row: np.ndarray, first: np.ndarray,
                 begin: np.ndarray, item: np.ndarray) -> Iterator[np.ndarray]:
    """Hits (row, item id, first word, distance) of the items that may begin near ``begin``.

    Places of one item that lie within its length are one stretch of text, in which the
    edit distance from every word on is taken at once.
    """
    if not len(row):
        return
    order = np.lexsort((begin, item, row))
    row, begin, item = row[order], begin[order], item[order]
    m = index.item_length[item]
    more = m // EDITS_PER_WORDS
    head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])
                                          | (begin[1:] - begin[:-1] > m[1:])])[:len(row)])
    tail = np.append(head[1:], len(row)) - 1
    row, item, m, more = row[head], item[head], m[head], more[head]
    lo = np.maximum(begin[head] - more, first[row])
    hi = np.minimum(begin[tail] + m + more, first[row + 1])
    order = np.lexsort((hi - lo, m))
    at = 0
    while at < len(order):
        size = int(m[order[at]])
        stop = int(np.searchsorted(m[order], size, side="right"))
        wide = hi[order[at:stop]] - lo[order[at:stop]]
        fit = int(np.searchsorted(wide * np.arange(1, len(wide) + 1), CELLS, side="right"))
        mine = order[at:at + max(1, fit)]
        at += len(mine)
        text = _run(h, lo[mine], int((hi - lo)[mine].max()), hi[mine])
        words = index.flat[index.item_first[item[mine]][:, None] + np.arange(size)]
        d = distances_from(words, text)
        d[np.arange(d.shape[1]) > (hi - lo)[mine, None]] = np.iinfo(np.int64).max
        place, least = np.argmin(d, axis=1), d.min(axis=1)
        ok = least <= size // EDITS_PER_WORDS
        yield np.stack([row[mine], index.ids[item[mine]],
                        lo[mine] + place - first[row[mine]], least], axis=1)[ok]


def _short_items(index: ItemIndex, h: np.ndarray, row: np.ndarray,
                 first: np.ndarray) -> Iterator[np.ndarray]:
    """Hits of the items of fewer than ``MIN_ITEM_WORDS`` words, which allow no edit."""
    for m, (keys, ids) in index.short.items():
        x = K.window_hash(h, m)
        lo = np.searchsorted(keys, x, side="left")
        n = np.searchsorted(keys, x, side="right") - lo
        n[row[:len(x)] != row[m - 1:]] = 0
        at = np.repeat(np.arange(len(x)), n)
        item = ids[np.arange(len(at)) + np.repeat(lo - (np.cumsum(n) - n), n)]
        yield np.stack([row[at], item, at - first[row[at]], np.zeros(len(at), np.int64)], axis=1)


def find_windows(t: K.Texts, index: ItemIndex) -> np.ndarray:
    """(row, item id, first word, distance) of the best window per row and item."""
    words = K.split_words(t, K.SPACES)
    hits = [np.zeros((0, 4), dtype=np.int64)]
    if not len(words.starts):
        return hits[0]
    h = K.segment_hash(t.buf, words.starts, words.ends, K.FOLDED)
    row = words.rows()
    last = words.first[1:][row]
    hits += _short_items(index, h, row, words.first)
    at = np.zeros(0, np.int64)
    if len(index.ids):
        at, length = _candidates(index, h, last)
    if not len(at):
        return _best(np.concatenate(hits))
    order = np.argsort(at, kind="stable")
    at, length = at[order], length[order]
    met = [np.zeros((0, 2), dtype=np.int64)]
    bounds = np.searchsorted(at, np.unique(at)[::STARTS]).tolist()
    for lo, hi in zip(bounds, [*bounds[1:], len(at)], strict=True):
        part, size = at[lo:hi], length[lo:hi]
        starts, who = np.unique(part, return_inverse=True)
        seen = _run(h, starts, index.words.shape[1], last[starts])
        w, k = _meetings(index, seen, who, size)
        for m in np.unique(size[w]).tolist():
            mine = np.flatnonzero(size[w] == m)
            start, block = part[w[mine]], k[mine]
            more = m // EDITS_PER_WORDS
            d = distances_from(index.words[block, :m], _run(h, start, m + more, last[start]))[:, 0]
            met.append(np.stack([start, block], axis=1)[d <= more])
    start, block = np.concatenate(met).T
    item, offset = index.item[block], index.offset[block]
    hits += _whole_items(index, h, row[start], words.first, start - offset, item)
    return _best(np.concatenate(hits))


def _best(found: np.ndarray) -> np.ndarray:
    """The first hit of least distance per row and item."""
    order = np.lexsort((found[:, 2], found[:, 3], found[:, 1], found[:, 0]))
    found = found[order]
    best = np.ones(len(found), dtype=bool)
    best[1:] = (found[1:, 0] != found[:-1, 0]) | (found[1:, 1] != found[:-1, 1])
    return found[best]


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(*shared.value)
        for batch in batches:
            for lo, t in K.slices(batch.column(1), SLICE_BYTES):
                found = find_windows(t, index)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(lo + found[:, 0])),
                     *(pa.array(found[:, k]) for k in (1, 2, 3))],
                    names=["doc_id", "item_id", "first_word", "distance"])
    return run


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text") -> DataFrame:
    """One row per document and item it contains: doc_id, item_id, first_word, distance."""
    spark = docs.sparkSession
    ensure_workers_can_import(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).cast("bigint").alias("item_id"),
                         F.col(item_text_col).cast("string").alias("text")).where(
        "item_id is not null and text is not null").distinct()
    blocks = max(1, math.ceil(items.count() / ITEM_BLOCK))
    parts = []
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast(([r[0] for r in block], [r[1] for r in block]))
        parts.append(rows.mapInArrow(
            _search(shared), "doc_id bigint, item_id bigint, first_word bigint, distance bigint"))
    return reduce(DataFrame.union, parts)
