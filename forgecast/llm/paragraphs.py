"""Substring deduplication: repeated paragraphs and repeated passages of word sequences.

Paragraphs are compared by similarity, windows by equality:

* A paragraph is a line feed-separated line of at least ``MIN_WORDS`` words, or a
  block of as many words of the whole text, whatever its line feeds. A block begins
  at a pair of words that has the least hash within ``REACH`` words to both sides, so
  a passage has the same blocks wherever it stands and however it is wrapped, and an
  edit changes the blocks near it only. Lines are compared with lines and blocks with
  blocks. Equal shingle sets are one class; the bands of each class's MinHash signature
  are joined, colliding classes are verified by the exact Jaccard similarity of their
  5-word shingle sets (0.8 or more), and components of links are clusters.
* A window is a run of ``WINDOW_WORDS`` words of the whole text, whatever its line
  feeds. Winnowing keeps the windows that have the least hash among ``WINNOW``
  consecutive ones, so two texts with a common passage of ``PASSAGE_WORDS`` words
  keep a common window of it. Equal windows are clusters, and each one is extended
  word by word as far as it equals the text around its first occurrence.

Of each cluster the first occurrence (least document id, then position) stays
and all others are removed. So no passage of ``PASSAGE_WORDS`` words of an earlier
text is left word by word, however the lines are broken; an edited passage is
found line by line and block by block.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Defined cases: null and
empty texts have no units; texts of rows without an id are left as they are;
repeated rows with one id keep the same words; ties go to the least id; a window
that overlaps its first occurrence loses the words after it only; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgecast.llm import textkit as K
from forgecast.llm.graph import Scratch, Similarity, join_ids, link, longs

#: words of the shortest line or block that is compared
MIN_WORDS = 20
#: words to both sides among which the first pair of words of a block has the least hash
REACH = 48
SHINGLE_WORDS = 5
#: words of a common passage that is found at any place of two texts
PASSAGE_WORDS = 50
WINDOW_WORDS = 26
WINNOW = PASSAGE_WORDS - WINDOW_WORDS + 1
#: bits of a window's place that hold its line; those above hold its first word
PLACE_BITS = 32
RECALL = 0.99
MAX_BANDS = 9
SKETCH_LONGS = 4
#: members of a band, chosen by hash, that are compared with all others first
PIVOTS = 4

_U = np.uint64
#: tells the keys of blocks from those of lines
_BLOCKS = _U(0x94D049BB133111EB)
_SKETCH = [f"s_{i}" for i in range(SKETCH_LONGS)]


def tune_bands(threshold: float, recall: float = RECALL,
               max_bands: int = MAX_BANDS) -> tuple[int, int]:
    """(bands, rows per band): most rows with which a pair at the threshold collides in some
    band with probability ``recall``, using ``max_bands`` bands at most."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))
        if bands <= max_bands:
            return bands, rows
    return max_bands, 1


def block_starts(h: np.ndarray, row: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Whether a block begins at each word; ``row``: the text of each word (ascending).

    A text's first word begins one, and so does a pair of words whose hash is less than
    that of the ``reach`` pairs before it and not more than that of those after it.
    """
    most = np.uint64(2**64 - 1)
    x = np.full(len(h), most, dtype=np.uint64)
    same = row[1:] == row[:-1]
    x[:-1][same] = K.window_hash(h, 2)[same]
    # texts lie ``reach`` places apart, so none sees the words of another
    number = np.concatenate([[0], np.cumsum(~same)]) if len(h) else row
    at = np.arange(len(h)) + reach * (number + 1)
    apart = np.full(len(h) + reach * (number[-1] + 2 if len(h) else 1), most, dtype=np.uint64)
    apart[at] = x
    least = _sliding(apart, reach, np.minimum)
    out = (x < least[at - reach]) & (x <= least[at + 1])
    out[:1] = True
    out[1:] |= ~same
    return out


class Units(NamedTuple):
    """Lines and blocks of a slice: shingle sets, place and whether they are blocks."""

    sets: K.Shingles
    row: np.ndarray
    line: np.ndarray
    first: np.ndarray
    words: np.ndarray
    block: np.ndarray

    @property
    def nodes(self) -> np.ndarray:
        """Key of each unit's class; lines and blocks are never in one class."""
        return K.signed(K.set_keys(self.sets) ^ np.where(self.block, _BLOCKS, _U(0)))


def paragraphs_of(t: K.Texts, min_words: int) -> Units:
    """The lines, then the blocks, of ``min_words`` words or more."""
    words = K.split_words(t, K.SPACES)
    feeds = np.flatnonzero(t.buf == 10)
    line_of = np.searchsorted(feeds, words.starts)  # line feeds before the word
    rows = words.rows()
    number = line_of - np.searchsorted(feeds, t.offs[:-1])[rows]
    h = K.segment_hash(t.buf, words.starts, words.ends, K.FOLDED)
    new_line = np.ones(len(rows), dtype=bool)
    new_line[1:] = (rows[1:] != rows[:-1]) | (number[1:] != number[:-1])
    heads, counts = [], []
    for starts in (new_line, block_starts(h, rows)):
        head = np.flatnonzero(starts)
        count = np.diff(np.append(head, len(rows)))
        heads.append(head[count >= min_words])
        counts.append(count[count >= min_words])
    head, count = np.concatenate(heads), np.concatenate(counts)
    first = np.concatenate([[0], np.cumsum(count)])
    inside = np.arange(first[-1]) + np.repeat(head - first[:-1], count)
    row = rows[head]
    return Units(K.shingle_sets(h[inside], first, SHINGLE_WORDS), row, number[head],
                 head - words.first[row], count, np.arange(len(head)) >= len(heads[0]))


def _bands(s: K.Shingles, bands: int, rows: int) -> np.ndarray:
    """(paragraphs, bands) keys of MinHash bands."""
    rng = np.random.default_rng(613)
    out = np.zeros((len(s.counts), bands), dtype=np.uint64)
    if not len(s.hash):
        return out
    at = np.concatenate([[0], np.cumsum(s.counts)[:-1]])
    moved = np.empty_like(s.hash)
    for b in range(bands):
        key = np.full(len(s.counts), b + 1, dtype=np.uint64)
        for _ in range(rows):
            add, odd = rng.integers(1, 2**63, 2, dtype=np.uint64)
            np.bitwise_xor(s.hash, add, out=moved)
            np.multiply(moved, odd | _U(1), out=moved)
            least = np.minimum.reduceat(moved, at)
            key = K.mix(key * _U(0x9E3779B97F4A7C15) + least)
        out[:, b] = key
    return out


def _paragraph_batches(min_words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, t in K.slices(batch.column(1)):
                u = paragraphs_of(t, min_words)
                keys = _bands(u.sets, bands, rows)
                keys[u.block] ^= _BLOCKS
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo + u.row]), pa.array(u.line, pa.int64()),
                     pa.array(u.first, pa.int64()), pa.array(u.words, pa.int64()),
                     pa.array(u.nodes), pa.array(u.sets.counts, pa.int64()),
                     *longs(K.signed(keys)), *longs(K.parity_sketch(u.sets, SKETCH_LONGS))],
                    names=["doc_id", "line", "first_word", "n_words", "node", "n",
                           *(f"b_{i}" for i in range(bands)), *_SKETCH])
    return run


def _in_row(node: np.ndarray, row: np.ndarray) -> np.ndarray:
    """One key for a class and the text it is looked for in."""
    return K.mix(node.view(np.uint64) ^ K.mix(row.astype(np.uint64)))


def _wanted_sets(min_words: int):
    """Shingle sets of the wanted classes of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(1)
            for lo, t in K.slices(batch.column(0)):
                u = paragraphs_of(t, min_words)
                ask = wanted.slice(lo, t.rows)
                keep = np.isin(_in_row(u.nodes, u.row), _in_row(
                    ask.flatten().to_numpy(), np.repeat(np.arange(t.rows),
                                                        ask.value_lengths().to_numpy())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u.nodes[keep]), pa.array(u.sets.counts[keep], pa.int64()),
                     K.list_column(K.signed(u.sets.hash[np.repeat(keep, u.sets.counts)]),
                                   u.sets.counts[keep])],
                    names=["node", "n", "elements"])
    return run


def _sliding(x: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """Least or greatest value (``pick``) of every n consecutive values."""
    out, width = x, 1
    while 2 * width <= n:
        out, width = pick(out[:-width], out[width:]), 2 * width
    return pick(out[:len(x) - n + 1], out[n - width:n - width + len(x) - n + 1])


def winnowed(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of the windows that are kept; ``row``: the text of each word.

    A window is kept if it has the least hash of some ``WINNOW`` consecutive windows
    of one text. This depends on the words of that run only.
    """
    if len(h) < PASSAGE_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    x = K.window_hash(h, WINDOW_WORDS)
    least = _sliding(x, WINNOW, np.minimum)
    least[row[:len(least)] != row[PASSAGE_WORDS - 1:]] = 0  # runs that cross texts
    pad = np.zeros(WINNOW - 1, np.uint64)
    at = np.flatnonzero((_sliding(np.concatenate([pad, least, pad]), WINNOW, np.maximum) == x)
                        & (x != 0))
    return at, x[at]


def _text_keys(h: np.ndarray, words: K.Words) -> np.ndarray:
    """Hash of each text's word sequence: tells texts with one id apart."""
    at = np.arange(len(h)) - np.repeat(words.first[:-1], words.counts)
    return K.row_sums(K.signed(K.mix(h ^ K.mix(at.astype(np.uint64) + _U(1)))), words.first)


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for lo, t in K.slices(batch.column(1)):
            words = K.split_words(t, K.SPACES)
            row = words.rows()
            h = K.segment_hash(t.buf, words.starts, words.ends, K.FOLDED)
            at, x = winnowed(h, row)
            row = row[at]
            feeds = np.flatnonzero(t.buf == 10)
            line = np.searchsorted(feeds, words.starts[at]) - np.searchsorted(feeds, t.offs[row])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[lo + row]), pa.array(_text_keys(h, words)[row]),
                 pa.array((at - words.first[row] << PLACE_BITS) + line, pa.int64()),
                 pa.array(K.signed(x))], names=["doc_id", "text_key", "place", "node"])


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a text's repeated windows that overlap or adjoin each other and, as far apart,
    their first occurrences: all words from a run's first window to its last one are equal."""
    for batch in batches:
        lists = batch.column(2)
        row = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())
        place, node, kept_doc, kept = (x.to_numpy() for x in lists.flatten().flatten())
        first, shift = place >> PLACE_BITS, (place >> PLACE_BITS) - (kept >> PLACE_BITS)
        order = np.lexsort((first, shift, kept_doc, row))
        row, place, node, kept_doc, kept, first, shift = (
            x[order] for x in (row, place, node, kept_doc, kept, first, shift))
        new = np.ones(len(row), dtype=bool)
        new[1:] = ((row[1:] != row[:-1]) | (kept_doc[1:] != kept_doc[:-1])
                   | (shift[1:] != shift[:-1]) | (first[1:] - first[:-1] > WINDOW_WORDS))
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(row)) - 1
        ids, keys = (batch.column(k).to_numpy()[row[head]] for k in range(2))
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(x) for x in (ids, keys, kept_doc[head], shift[head], first[head],
                                     first[tail], node[head], node[tail])),
             *(K.list_column(x, tail - head + 1) for x in (place, kept))], names=_CHAIN)


def _near(h: np.ndarray, words: K.Words, row: np.ndarray, first: np.ndarray,
          side: np.ndarray) -> pa.Array:
    """WINNOW word hashes at most before (side 0, nearest first) or after (1) each window."""
    step, at = np.arange(WINNOW), words.first[row] + first
    place = np.where(side[:, None] == 1, at[:, None] + WINDOW_WORDS + step,
                     at[:, None] - 1 - step)
    inside = (place >= words.first[row][:, None]) & (place < words.first[row + 1][:, None])
    return K.binary_column(h[place[inside]], 8 * inside.sum(axis=1))


def _entries(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row of each entry of a column of lists, and the entries; a null list has none."""
    counts = pc.fill_null(lists.value_lengths(), 0).to_numpy()
    return np.repeat(np.arange(len(lists)), counts), lists.flatten()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words around the ends of each text's own chains and around the first occurrences."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for lo, t in K.slices(batch.column(1)):
            words = K.split_words(t, K.SPACES)
            h = K.segment_hash(t.buf, words.starts, words.ends, K.FOLDED)
            keys = _text_keys(h, words)
            row, own = _entries(batch.column(2).slice(lo, t.rows))
            text_key, start, end, kept_doc, shift, *nodes = (x.to_numpy() for x in own.flatten())
            here = keys[row] == text_key  # not of another text with this id
            row, start, end, kept_doc, shift, *nodes = (
                x[here] for x in (row, start, end, kept_doc, shift, *nodes))
            for side, (first, node) in enumerate(zip((start, end), nodes, strict=True)):
                sides = np.full(len(row), side, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x) for x in (ids[lo + row], keys[row], first, sides, node)),
                     _near(h, words, row, first, sides),
                     *(pa.array(x) for x in (start, kept_doc, first - shift))], names=_AROUND)
            row, asked = _entries(batch.column(3).slice(lo, t.rows))
            first, side = np.divmod(asked.to_numpy(), 2)
            fits = first + WINDOW_WORDS <= words.counts[row]  # another text with this id
            row, first, side = row[fits], first[fits], side[fits]
            node = K.window_hash(h, WINDOW_WORDS)[words.first[row] + first]
            none = pa.nulls(len(row), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x) for x in (ids[lo + row], keys[row], first, side, K.signed(node))),
                 _near(h, words, row, first, side), none, none, none], names=_AROUND)


def _table(near: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """At most WINNOW numbers each as rows of a matrix, and which places they fill."""
    near = near.cast(pa.large_binary())
    filled = np.arange(WINNOW) < pc.binary_length(near).to_numpy()[:, None] // 8
    out = np.zeros(filled.shape, dtype=np.int64)
    if filled.any():
        lo, hi = np.frombuffer(near.buffers()[1], np.int64)[[near.offset, near.offset + len(near)]]
        out[filled] = np.frombuffer(near.buffers()[2], np.uint8)[lo:hi].view(np.int64)
    return out, filled


def _equal_words(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Number of equal values at the beginning of each two lists."""
    (x, in_x), (y, in_y) = _table(a), _table(b)
    return np.logical_and.accumulate((x == y) & in_x & in_y, axis=1).sum(axis=1)


def _extensions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal words beyond each end of a chain."""
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [*(b.column(k) for k in range(4)), pa.array(_equal_words(b.column(4), b.column(5)))],
            names=["doc_id", "text_key", "start", "side", "more"])


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word ranges to remove: a chain's windows with up to WINNOW equal words before and after."""
    mask = (1 << PLACE_BITS) - 1
    for b in batches:
        n = b.column(6).value_lengths().to_numpy()
        doc, kept_doc, start, end, before, after = (
            np.repeat(b.column(k).to_numpy(), n) for k in range(6))
        place, kept_place = (b.column(k).flatten().to_numpy() for k in (6, 7))
        first, kept = place >> PLACE_BITS, kept_place >> PLACE_BITS
        lo = first - np.minimum(WINNOW, first - start + before)
        hi = first + WINDOW_WORDS + np.minimum(WINNOW, end - first + after)
        lo = np.where(doc == kept_doc, np.maximum(lo, kept + WINDOW_WORDS), lo)
        ok = hi > lo
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[ok]) for x in (doc, place & mask, lo, hi - lo, kept_doc,
                                       kept_place & mask, lo - (first - kept))], names=_RESULT)


_CHAIN = ["doc_id", "text_key", "kept_doc_id", "shift", "start", "end", "start_node", "end_node",
          "places", "kept_places"]
_AROUND = ["doc_id", "text_key", "first_word", "side", "node", "near", "start", "kept_doc_id",
           "kept_first_word"]
_RESULT = ["doc_id", "line", "first_word", "n_words", "kept_doc_id", "kept_line",
           "kept_first_word"]


def repeated_windows(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Removed word ranges of (doc_id, text): repeats of a window, extended where equal.

    Words around windows are read and compared at the ends of chains of windows only. A
    place is a window's first word and line in one number.
    """
    wins = scratch.store(rows.mapInArrow(
        _window_batches, "doc_id bigint, text_key bigint, place bigint, node bigint"), "windows")
    # windows that occur once go before their places are compared
    often = scratch.store(wins.groupBy("node").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("kept_doc_id")).where("n > 1")
        .select("node", "kept_doc_id"), "often")
    wins = scratch.store(wins.join(often.hint("shuffle_hash"), "node"), "common")
    scratch.drop("windows", "often")
    kept = scratch.store(wins.where("doc_id = kept_doc_id").groupBy("node").agg(
        F.min("place").alias("kept_place")), "kept")
    again = join_ids(wins, kept, "node", limit=0).where(
        f"doc_id <> kept_doc_id or shiftright(place, {PLACE_BITS}) <> "
        f"shiftright(kept_place, {PLACE_BITS})")
    chains = again.groupBy("doc_id", "text_key").agg(F.collect_set(
        F.struct("place", "node", "kept_doc_id", "kept_place")).alias("places")).mapInArrow(
        _chains, ", ".join(f"{c} bigint" for c in _CHAIN[:-2])
        + ", places array<bigint>, kept_places array<bigint>")
    chains = scratch.store(chains, "chains")
    scratch.drop("common", "kept")

    # texts go by a shuffle at every size: the lists beside them grow as they do
    own = chains.groupBy("doc_id").agg(F.collect_list(F.struct(
        "text_key", "start", "end", "kept_doc_id", "shift", "start_node", "end_node")).alias("own"))
    asked = chains.select(F.col("kept_doc_id").alias("doc_id"), F.explode(F.array(
        (F.col("start") - F.col("shift")) * 2, (F.col("end") - F.col("shift")) * 2 + 1)).alias("at"))
    asked = asked.groupBy("doc_id").agg(F.collect_set("at").alias("asked"))
    texts = (rows.join(own.hint("merge"), "doc_id", "left").join(asked.hint("merge"), "doc_id", "left")
             .where("own is not null or asked is not null").select("doc_id", "text", "own", "asked"))
    around = scratch.store(texts.mapInArrow(_contexts, ", ".join(
        f"{c} {'binary' if c == 'near' else 'bigint'}" for c in _AROUND)), "around")
    scratch.drop()
    first = ["kept_doc_id", "kept_first_word", "side", "node"]
    there = scratch.store(
        around.where("start is null").groupBy("doc_id", "first_word", "side", "node")
        .agg(F.min_by("near", "text_key").alias("kept_near")).toDF(*first, "kept_near"), "there")
    sides = around.where("start is not null").join(there.hint("merge"), first)
    more = scratch.store(sides.select(
        "doc_id", "text_key", "start", "side", "near", "kept_near").mapInArrow(
        _extensions, "doc_id bigint, text_key bigint, start bigint, side bigint, more bigint"),
        "more")
    scratch.drop("around", "there")
    more = more.groupBy("doc_id", "text_key", "start").agg(
        F.max(F.expr("if(side = 0, more, 0)")).alias("before"),
        F.max(F.expr("if(side = 1, more, 0)")).alias("after"))
    return chains.join(more, ["doc_id", "text_key", "start"]).select(
        "doc_id", "kept_doc_id", "start", "end", "before", "after", "places",
        "kept_places").mapInArrow(_extend, ", ".join(f"{c} bigint" for c in _RESULT))


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        min_words: int = MIN_WORDS, sim: Similarity | None = None) -> DataFrame:
    """One row per removed word range: doc_id, line (in which the unit begins), first_word,
    n_words, kept_doc_id, kept_line, kept_first_word."""
    scratch = Scratch(docs.sparkSession, "paragraphs")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    return (similar_paragraphs(rows, min_words, sim or Similarity(), scratch)
            .union(repeated_windows(rows, scratch)).distinct())


def similar_paragraphs(rows: DataFrame, min_words: int, sim: Similarity,
                       scratch: Scratch) -> DataFrame:
    """Removed lines and blocks of (doc_id, text), as word ranges."""
    bands, per_band = tune_bands(sim.num / sim.den)
    keys = [f"b_{i}" for i in range(bands)]
    paragraphs = scratch.store(rows.mapInArrow(
        _paragraph_batches(min_words, bands, per_band),
        "doc_id bigint, line bigint, first_word bigint, n_words bigint, node bigint, n bigint, "
        + ", ".join(f"{c} bigint" for c in (*keys, *_SKETCH))), "paragraphs")
    # plain numbers only, so that a class is one fixed-width row of a hash table
    classes = scratch.store(paragraphs.groupBy("node").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("first_doc_id"),
        *(F.min(c).alias(c) for c in ("n", *keys, *_SKETCH))), "classes")

    scratch.drop()
    # from here on a unit's place and class are enough, and after the bands a class's sketch
    units = scratch.store(paragraphs.select("doc_id", "line", "first_word", "n_words", "node"),
                          "units")
    scratch.drop("paragraphs")
    # bands in which two classes meet
    keyed = classes.select(F.explode(F.array(*keys)).alias("key"), "node", "n")
    # a class has one row per band here, so that keys alone are shuffled
    met = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = scratch.store(met, "met")
    scratch.drop()
    # the few keys go into a hash table, so that the rows of all bands aren't sorted
    keyed = keyed.join(met.hint("shuffle_hash"), "key", "left_semi")
    postings = scratch.store(keyed.withColumn("u", F.lit(0).cast("bigint")), "postings")
    classes = scratch.store(classes.drop("n", *keys), "sketches")
    scratch.drop("classes", "met")

    def sets_of(nodes: DataFrame) -> DataFrame:
        ask = (classes.join(nodes, "node").groupBy(F.col("first_doc_id").alias("doc_id"))
               .agg(F.collect_list("node").alias("wanted")))
        scratch.drop("ask")
        found = join_ids(rows, scratch.store(ask, "ask"), "doc_id").select("text", "wanted")
        return (found.mapInArrow(_wanted_sets(min_words),
                                 "node bigint, n bigint, elements array<bigint>")
                .dropDuplicates(["node"]))

    _, root = link(postings, classes.select("node", *_SKETCH), sets_of, sim, scratch,
                   pivots=PIVOTS)
    member = scratch.store(
        classes.select("node", "copies", "first_doc_id").join(root, "node", "left")
        .withColumn("root", F.coalesce("root", "node")), "member")
    kept = scratch.store(member.groupBy("root").agg(
        F.sum("copies").alias("members"), F.min("first_doc_id").alias("kept_doc_id"))
        .where("members > 1").select("root", "kept_doc_id"), "clusters")
    label = join_ids(member, kept, "root").select("node", "root", "kept_doc_id")
    hits = scratch.store(units.join(label, "node").drop("node"), "hits")
    scratch.drop("postings", "ask", "member", "sketches", "clusters", "units")
    place = scratch.store(hits.where("doc_id = kept_doc_id").groupBy("root").agg(
        F.min("first_word").alias("kept_first_word"), F.min("line").alias("kept_line")), "place")
    return (join_ids(hits, place, "root")
            .where("doc_id <> kept_doc_id or first_word <> kept_first_word").select(*_RESULT))


def _cut(text: str, ranges: list[tuple[int, int]]) -> str:
    """``text`` without the word ranges (first, number). A line that loses all its words goes
    with its line feed; words removed from other lines go with the separators after them."""
    raw = text.encode()
    (_, t), = K.slices(pa.array([text], pa.large_string()), max(1, len(raw)))
    words = K.split_words(t, K.SPACES)
    step = np.zeros(len(words.starts) + 1, dtype=np.int64)
    for first, n in ranges:
        step[first] += 1
        step[first + n] -= 1
    gone = np.cumsum(step[:-1]) > 0
    feeds = np.flatnonzero(t.buf == 10)
    heads = np.concatenate([[0], feeds + 1])
    tails = np.append(feeds, len(raw))
    first = np.searchsorted(words.starts, heads)
    last = np.searchsorted(words.starts, tails)
    out = []
    for a, b, i, j in zip(heads.tolist(), tails.tolist(), first.tolist(), last.tolist(),
                          strict=True):
        part = gone[i:j]
        if not part.any():
            out.append(raw[a:b])
        elif not part.all():
            ends = np.append(words.starts[i + 1:j], b)
            out.append(raw[a:words.starts[i]] + b"".join(
                raw[words.starts[i + k]:ends[k]] for k in np.flatnonzero(~part)))
    return b"\n".join(out).decode()


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, gone = batch.column("text"), batch.column("gone")
        new = [x.as_py() if not g.is_valid or not x.is_valid else
               _cut(x.as_py(), [(r["first_word"], r["n_words"]) for r in g.as_py()])
               for x, g in zip(texts, gone, strict=True)]
        yield batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"),
                               pa.array(new, batch.schema.field("text").type))


def cut_paragraphs(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs`` without the removed word ranges; texts left without a word go."""
    scratch = Scratch(docs.sparkSession, "paragraph-cuts")
    gone = scratch.store(removed.groupBy("doc_id").agg(
        F.collect_set(F.struct("first_word", "n_words")).alias("gone")), "gone")
    scratch.drop()
    whole = join_ids(docs.alias("d"), gone, "doc_id", "left", limit=0)
    whole = whole.mapInArrow(_cut_batches, whole.schema)
    whole = whole.where(F.col("gone").isNull() | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    if "n_chars" in docs.columns:
        whole = whole.withColumn("n_chars", F.when(F.col("gone").isNull(), F.col("n_chars"))
                                 .otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return whole.select(*docs.columns)
