"""SentencePiece-style encoding and decoding: unigram Viterbi, byte fallback, markers.

``encode`` adds piece ids to each row, ``decode`` gives the text back. Decoding
what ``encode`` made returns every text exactly: characters without a piece,
and the marker character itself, travel as bytes.

Defined cases: a null text has null ids and decodes to null; an empty one has
no ids; byte pieces that aren't valid UTF-8 (only in ids from elsewhere) decode
to replacement characters, ids outside the vocabulary to nothing; rows are
independent, so repeated rows and empty tables need no rule; the id and all
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgecast.llm import pieces as P
from forgecast.llm import textkit as K
from forgecast.session import ensure_workers_can_import

#: bytes of text whose distinct chunks are solved together
SLICE_BYTES = 2 << 20


def _encoder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for lo, t in K.slices(batch.column(1), SLICE_BYTES):
                c = P.chunked(t)
                flat, offs, scores = P.solve(v, c)
                each = np.diff(offs)[c.inverse]
                ids = flat[P.spans(offs[c.inverse], each)]
                texts = batch.column(1).slice(lo, t.rows)
                empty = pc.is_null(texts)
                counts = K.row_sums(each, c.first)
                bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                total = np.concatenate([[0.0], np.cumsum(scores[c.inverse])])[c.first]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, t.rows), texts,
                     pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids), mask=empty),
                     pc.if_else(empty, pa.scalar(None, pa.float64()), pa.array(np.diff(total)))],
                    names=["doc_id", "text", "ids", "score"])
    return run


def _decoder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        size = np.diff(v.text_offs)
        for batch in batches:
            lists = batch.column(2)
            flat = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            known = (flat >= 0) & (flat < len(size))
            ids = np.where(known, flat, 0)
            width = np.where(known, size[ids], 0)
            raw = v.text_bytes[P.spans(v.text_offs[ids], width)]
            ends = np.concatenate([[0], np.cumsum(width)])[
                np.concatenate([[0], np.cumsum(n)]).astype(np.int64)]
            # the marker that encoding put in front
            lead = ends[:-1][(np.diff(ends) > 0)]
            drop = np.zeros(len(raw), dtype=bool)
            drop[lead[raw[lead] == 32]] = True
            ends = ends - np.concatenate([[0], np.cumsum(drop)])[ends]
            raw = np.ascontiguousarray(raw[~drop])
            text = pa.Array.from_buffers(
                pa.large_binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
            try:
                text = text.cast(pa.large_string())
            except pa.ArrowInvalid:
                text = pa.array([x.decode(errors="replace") for x in text.to_pylist()],
                                pa.large_string())
            text = pc.if_else(pc.is_null(lists), pa.scalar(None, pa.large_string()), text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lists, batch.column(3), text.cast(pa.string())],
                names=["doc_id", "text", "ids", "score", "decoded"])
    return run


_ENCODED = "doc_id bigint, text string, ids array<int>, score double"


def encode(docs: DataFrame, model_path: str = P.DEFAULT_MODEL, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, text, ids, score) of every row."""
    spark = docs.sparkSession
    ensure_workers_can_import(spark)
    shared = spark.sparkContext.broadcast(P.load_vocabulary(model_path))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encoder(shared), _ENCODED)


def decode(encoded: DataFrame, model_path: str = P.DEFAULT_MODEL) -> DataFrame:
    """Rows of ``encode`` with a column ``decoded``."""
    spark = encoded.sparkSession
    ensure_workers_can_import(spark)
    shared = spark.sparkContext.broadcast(P.load_vocabulary(model_path))
    return (encoded.select("doc_id", "text", "ids", "score")
            .mapInArrow(_decoder(shared), _ENCODED + ", decoded string"))


def _round_trip(shared):
    """Encoding and decoding in one Python stage; the texts stay inside it."""
    encoder, decoder = _encoder(shared), _decoder(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in decoder(encoder(batches)):
            text, decoded = b.column(1), b.column(4)
            same = pc.if_else(pc.is_null(text), pc.is_null(decoded),
                              pc.fill_null(pc.equal(text, decoded.cast(text.type)), False))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), same],
                                             names=["doc_id", "ids", "score", "round_trip"])
    return run


def codec_digest(docs: DataFrame, model_path: str = P.DEFAULT_MODEL, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Per row: number and hash of the ids, score, and whether decoding gives the text back."""
    spark = docs.sparkSession
    ensure_workers_can_import(spark)
    shared = spark.sparkContext.broadcast(P.load_vocabulary(model_path))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    done = rows.mapInArrow(_round_trip(shared),
                           "doc_id bigint, ids array<int>, score double, round_trip boolean")
    return done.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                       F.xxhash64("ids").alias("ids_hash"), F.round("score", 6).alias("score"),
                       "round_trip")
