"""Quality rules by repetition coverage.

Every whole text is split into words (``[^\\x20\\x09-\\x0D]+``). Rolling hashes of
several n-gram lengths find the n-grams that occur twice or more in the text;
the characters of all words inside such n-grams, and of all lines equal to an
earlier line, are set against the characters of all words.

Defined cases: a null or empty text has no words and is rejected; ties and
repeated rows are judged one by one; an empty table gives an empty result;
other columns are not read. A text of any length is judged whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgecast.llm import textkit as K
from forgecast.session import ensure_workers_can_import

#: n-gram length -> largest accepted percentage of word characters inside repeated n-grams
GRAM_LIMITS = {5: 20, 6: 19, 8: 17, 10: 15}
#: largest accepted percentage of word characters in lines equal to an earlier line
LINE_LIMIT = 20
MIN_WORDS = 10
REPEAT_WORDS_LIMIT = 20

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars",
           *(f"rep{n}_chars" for n in GRAM_LIMITS)]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def measure(t: K.Texts) -> dict[str, np.ndarray]:
    """The counts of each text of a slice."""
    words = K.split_words(t, K.SPACES)
    rows = words.rows()
    out = {"n_words": words.counts}
    heads = np.zeros(len(t.buf) + 1, dtype=np.int64)
    np.cumsum((t.buf & 0xC0) != 0x80, out=heads[1:])
    chars = heads[words.ends] - heads[words.starts]
    out["word_chars"] = K.row_sums(chars, words.first)
    out["n_symbols"] = K.row_sums(_SYMBOLS[t.buf], t.offs)
    salt = K.mix(np.arange(1, t.rows + 1, dtype=np.uint64))

    # lines with a word: runs between line feeds, none crossing a row
    feed = np.flatnonzero(t.buf == 10)
    starts = np.union1d(t.offs[:-1], feed + 1)
    line_row = np.searchsorted(t.offs, starts, side="right") - 1
    ends = _line_ends(starts, feed, t)
    w0, w1 = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    live = w1 > w0
    starts, ends, w0, w1 = starts[live], ends[live], w0[live], w1[live]
    line_row = line_row[live]
    key = K.mix(K.segment_hash(t.buf, starts, ends) + salt[line_row])
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), dtype=bool)
    later[order[1:][key[order][1:] == key[order][:-1]]] = True
    out["n_dup_lines"] = np.bincount(line_row[later], minlength=t.rows)
    upto = np.concatenate([[0], np.cumsum(chars)])
    out["dup_line_chars"] = np.bincount(
        line_row[later], weights=(upto[w1] - upto[w0])[later], minlength=t.rows).astype(np.int64)

    # repeated n-grams; a text without a repeated 5-gram has no longer one
    h = K.segment_hash(t.buf, words.starts, words.ends)
    index = np.arange(len(h))
    for n in GRAM_LIMITS:
        covered = np.zeros(len(index), dtype=bool)
        if len(index) >= n:
            r = rows[index]
            ok = np.flatnonzero(r[:len(r) - n + 1] == r[n - 1:])
            grams = K.window_hash(h[index], n)[ok]
            twice = ok[_repeated(K.mix(grams + salt[r[ok]]))]
            depth = np.zeros(len(index) + 1, dtype=np.int64)
            depth[twice] += 1
            depth[twice + n] -= 1
            covered = np.cumsum(depth[:-1]) > 0
        inside = index[covered]
        out[f"rep{n}_chars"] = np.bincount(rows[inside], weights=chars[inside],
                                           minlength=t.rows).astype(np.int64)
        if n == 5:
            out["n_repeat_words"] = np.bincount(rows[inside], minlength=t.rows)
            index = np.flatnonzero((out["n_repeat_words"] > 0)[rows])
    return out


def _line_ends(starts: np.ndarray, feed: np.ndarray, t: K.Texts) -> np.ndarray:
    """End of the line that begins at each start: the next line feed or the row's end."""
    row = np.searchsorted(t.offs, starts, side="right") - 1
    row_end = t.offs[np.minimum(row + 1, t.rows)]
    at = np.searchsorted(feed, starts)
    nxt = np.where(at < len(feed), feed[np.minimum(at, max(len(feed) - 1, 0))] if len(feed) else 0,
                   np.iinfo(np.int64).max)
    return np.minimum(nxt, row_end)


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for lo, t in K.slices(batch.column(1)):
            counts = measure(t)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, t.rows), *(pa.array(counts[c], pa.int64()) for c in _COUNTS)],
                names=["doc_id", *_COUNTS])


def verdict() -> Column:
    """True where no repetition share is over its limit."""
    share = [(f"rep{n}_chars", limit) for n, limit in GRAM_LIMITS.items()]
    ok = F.lit(True)
    for name, limit in [*share, ("dup_line_chars", LINE_LIMIT)]:
        ok = ok & (100 * F.col(name) <= limit * F.col("word_chars"))
    return ok


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` for every row of ``docs``: one narrow pass."""
    ensure_workers_can_import(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    counts = rows.mapInArrow(_measure_batches,
                             "doc_id bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS))
    failed = ((F.col("n_words") < MIN_WORDS)
              | (100 * F.col("n_repeat_words") > REPEAT_WORDS_LIMIT * F.col("n_words")))
    return (counts.withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & verdict()))
