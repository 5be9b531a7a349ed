"""Token counts by dynamic programming over a trie of distinct pre-tokens.

The distinct pre-tokens (chunks, see ``pieces``) of a group of texts form a
trie. Level by level, each trie node extends the piece matches that are open at
its parent by one byte and takes the best forward score and its token count, so
a prefix shared by many pre-tokens is solved once. The count at a pre-token's
terminal node is then added to every text, once per occurrence.

Counts equal the number of ids of ``piece_codec.encode`` (same vocabulary, same
tie rule). Defined cases: null and empty texts have 0 tokens; rows are
independent, so repeated rows and empty tables need no rule; a pre-token of
more than ``TRIE_BYTES`` bytes shares no prefix worth keeping and is solved
alone; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgecast.llm import pieces as P
from forgecast.llm import textkit as K
from forgecast.session import ensure_workers_can_import

SLICE_BYTES = 2 << 20
TRIE_BYTES = 64
_PAST = 3 * TRIE_BYTES


def trie_levels(c: P.Chunks, who: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The trie of chunks ``who``, level by level: (parent node, byte, node of each chunk)."""
    node = np.zeros(len(who), dtype=np.int64)  # all at the root
    live, levels = np.arange(len(who)), []
    lengths = np.diff(c.offs)[who]
    depth = 0
    while True:
        live = live[lengths[live] > depth]
        if not len(live):
            return levels
        byte = c.buf[c.offs[who[live]] + depth].astype(np.int64)
        nodes, at = np.unique(node[live] * 256 + byte, return_inverse=True)
        node[live] = at
        depth += 1
        levels.append((nodes >> 8, nodes & 255, np.stack([live, at])))


def trie_counts(v: P.Vocabulary, c: P.Chunks) -> np.ndarray:
    """Tokens of the best path of every distinct chunk."""
    lengths = np.diff(c.offs)
    out = np.zeros(len(lengths), dtype=np.int64)
    for k in np.flatnonzero(lengths > TRIE_BYTES):
        out[k] = len(P.best_path(v, c.buf[c.offs[k]:c.offs[k + 1]].tobytes())[0])
    who = np.flatnonzero(lengths <= TRIE_BYTES)
    # open matches of a level, by node then by start: trie state (-1: dead), forward score and
    # count at the start, bytes left of the start's first character (-1: unset, _PAST: past it)
    at, state = np.zeros(1, np.int64), np.zeros(1, np.int32)
    score, count, left = np.zeros(1), np.zeros(1, np.int64), np.full(1, -1)
    size = np.zeros(1, np.int64)  # bytes of the start's first character
    for depth, (parent, byte, ends) in enumerate(trie_levels(c, who), 1):
        first = np.searchsorted(at, parent, side="left")
        n = np.searchsorted(at, parent, side="right") - first
        pick = P.spans(first, n)
        at = np.repeat(np.arange(len(parent)), n)
        b = np.repeat(byte, n)
        state, score, count, left, size = (x[pick] for x in (state, score, count, left, size))
        size = np.where(left < 0, P._CHAR_BYTES[b], size)
        left = np.where(left < 0, size, left) - 1
        child = v.base[np.maximum(state, 0)] + b.astype(np.int32)
        state = np.where((state >= 0) & (v.check[child] == state) & (child > 0), child, -1)
        piece = np.where(state >= 0, v.piece[np.maximum(state, 0)], -1)
        hit = piece >= 0
        unknown = (left == 0) & ~hit
        total = np.where(hit, score + v.score[np.maximum(piece, 0)], score + v.unknown)
        tokens = count + np.where(hit, 1, size)
        end = np.flatnonzero(hit | unknown)
        order = end[np.lexsort((end, -total[end], at[end]))]  # best first, then earlier start
        top = order[np.flatnonzero(np.diff(at[order], prepend=-1))]
        best_count = np.zeros(len(parent), np.int64)
        best_count[at[top]] = tokens[top]
        chunk, node = ends
        stop = lengths[who[chunk]] == depth
        out[who[chunk[stop]]] = best_count[node[stop]]
        # what stays open, and a new start at every node that was reached
        left = np.where(left == 0, _PAST, left)
        keep = (state >= 0) | ((left > 0) & (left < TRIE_BYTES))
        cat = [np.concatenate([x[keep], y]) for x, y in (
            (at, at[top]), (state, np.zeros(len(top), np.int32)), (score, total[top]),
            (count, tokens[top]), (left, np.full(len(top), -1)), (size, np.zeros(len(top), int)))]
        order = np.argsort(cat[0], kind="stable")
        at, state, score, count, left, size = (x[order] for x in cat)
    return out


def _counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for lo, t in K.slices(batch.column(1), SLICE_BYTES):
                c = P.chunked(t)
                each = trie_counts(v, c)[c.inverse]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, t.rows), pa.array(np.diff(c.first), pa.int64()),
                     pa.array(K.row_sums(each, c.first), pa.int64())],
                    names=["doc_id", "n_pretokens", "n_tokens"])
    return run


def token_counts(docs: DataFrame, model_path: str = P.DEFAULT_MODEL, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of every row: one narrow pass."""
    spark = docs.sparkSession
    ensure_workers_can_import(spark)
    shared = spark.sparkContext.broadcast(P.load_vocabulary(model_path))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_counter(shared), "doc_id bigint, n_pretokens bigint, n_tokens bigint")
