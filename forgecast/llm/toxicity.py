"""Toxicity: gradient-boosted trees over dense text features, isotonic calibration.

Features per text: densities of a learned lexicon of words and word stems,
lexicon words near a second-person word, capitals, punctuation and obfuscation
(words that mix letters with digits or symbols), and length. Labels are used
only of rows whose crc32(doc_id as text) mod 5 is not 0, and of ``TRAIN_ROWS`` of
these at most, the first by a hash of the id. The training rows are split by
hash: the lexicon, the trees and the calibration each learn from rows of their own.

Defined cases: a null or empty text has zero features and a score like others;
repeated rows are scored each; where a part lacks a class, all three steps learn from
all training rows; without training texts of both classes every score is the share of
toxic ones (0 without any); an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgecast.llm import textkit as K
from forgecast.llm.graph import Scratch, join_ids

#: documented bound of the labelled rows that are learned from
TRAIN_ROWS = 20_000
LEXICON_WORDS = 2_000
MIN_TOXIC_TEXTS = 4
STEM_BYTES = 5
NEAR_WORDS = 5
TREES, DEPTH = 20, 3
SECOND_PERSON = ("you", "your", "yours", "du", "dich", "dein", "tu", "te", "toi", "vous", "usted")

FEATURES = ["n_words", "lexicon", "lexicon_words", "stems", "near_you", "capitals", "marks",
            "punctuation", "obfuscated"]


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def _terms(t: K.Texts) -> tuple[K.Words, np.ndarray, np.ndarray]:
    """Words with the hash of each and of its stem."""
    w = K.split_words(t, K.NON_ALNUM)
    stem = np.minimum(w.ends, w.starts + STEM_BYTES)
    whole = K.segment_hash(t.buf, w.starts, w.ends, K.FOLDED)
    return w, whole, K.mix(K.segment_hash(t.buf, w.starts, stem, K.FOLDED) + np.uint64(1))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice: toxic and other texts that have each term."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, t in K.slices(batch.column(0)):
            w, whole, stem = _terms(t)
            row = w.rows()
            for kind, h in enumerate((whole, stem)):
                both = np.unique(np.stack([h, row.astype(np.uint64)], axis=1), axis=0)
                terms, at = np.unique(both[:, 0], return_inverse=True)
                bad = np.bincount(at, weights=toxic[lo + both[:, 1].astype(np.int64)],
                                  minlength=len(terms)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(K.signed(terms)), pa.array(np.full(len(terms), kind, np.int32)),
                     pa.array(bad), pa.array(np.bincount(at, minlength=len(terms)) - bad)],
                    names=["term", "kind", "bad", "good"])


def _featurer(shared):
    def isin(h: np.ndarray, known: np.ndarray) -> np.ndarray:
        return np.isin(h, known) if len(known) else np.zeros(len(h), dtype=bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, stems = shared.value
        you = np.concatenate([_terms(next(iter(K.slices(pa.array([x]))))[1])[1]
                              for x in SECOND_PERSON])
        for batch in batches:
            for lo, t in K.slices(batch.column(1)):
                w, whole, stem = _terms(t)
                hit = isin(whole, lexicon)
                reach = np.concatenate([[0], np.cumsum(isin(whole, you))])
                at = np.arange(len(hit))
                near = hit & (reach[np.minimum(at + NEAR_WORDS + 1, len(hit))]
                              > reach[np.maximum(at - NEAR_WORDS, 0)])
                upper = (t.buf >= 65) & (t.buf <= 90)
                marks = (t.buf == 33) | (t.buf == 63)
                ascii_ = t.buf < 128
                point = ascii_ & K.NON_ALNUM[t.buf] & ~K.SPACES[t.buf]
                s = K.split_words(t, K.SPACES)
                odd = np.concatenate([[0], np.cumsum(point | ((t.buf >= 48) & (t.buf <= 57)))])
                mixed = (odd[s.ends - 1] - odd[np.minimum(s.starts + 1, s.ends - 1)]) > 0
                n = np.maximum(w.counts, 1)
                size = np.maximum(np.diff(t.offs), 1)
                hits = K.row_sums(hit, w.first)
                values = [np.log1p(w.counts), hits / n, np.log1p(hits),
                          K.row_sums(isin(stem, stems), w.first) / n,
                          K.row_sums(near, w.first) / n, K.row_sums(upper, t.offs) / size,
                          K.row_sums(marks, t.offs) / size, K.row_sums(point, t.offs) / size,
                          K.row_sums(mixed, s.first) / np.maximum(s.counts, 1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, t.rows),
                     *(pa.array(x.astype(np.float64)) for x in values)],
                    names=["doc_id", *FEATURES])
    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                    text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    train = (labels.select(F.col("doc_id").cast("bigint"), F.col("toxic").cast("int"))
             .where("doc_id is not null and toxic in (0, 1)").where(~held_out())
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .withColumn("h", F.xxhash64("doc_id")).orderBy("h").limit(train_rows)
             .select("doc_id", "toxic", F.pmod("h", F.lit(10)).alias("part")))
    train = scratch.store(train, "train")
    shown = held_out().alias("held_out")
    learn = scratch.store(join_ids(rows, train, "doc_id"), "learn")
    # three parts of two classes
    step = F.when(F.col("part") < 4, 0).when(F.col("part") < 8, 1).otherwise(2)
    found = learn.groupBy(step.alias("step"), "toxic").count().collect()
    classes = {k: sum(r["count"] for r in found if r["toxic"] == k) for k in (0, 1)}
    if not classes[0] or not classes[1]:
        share = float(classes[1]) / max(1, sum(classes.values()))
        return rows.select("doc_id", shown, F.lit(share).alias("score"),
                           F.lit(int(share >= 0.5)).alias("predicted"))
    first, second, third = (("part < 4", "part >= 4 and part < 8", "part >= 8") if len(found) == 6
                            else ("true", "true", "true"))

    terms = (learn.where(first).select("text", "toxic")
             .mapInArrow(_count_terms, "term bigint, kind int, bad bigint, good bigint")
             .groupBy("term", "kind").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
             .where(f"bad >= {MIN_TOXIC_TEXTS}")
             .withColumn("odds", (F.col("bad") + 0.1) / (F.col("good") + 0.5))
             .where(f"odds > {4 * classes[1] / classes[0]}"))
    known = []
    for kind in (0, 1):
        top = (terms.where(F.col("kind") == kind).orderBy(F.desc("odds"), F.desc("bad"), "term")
               .limit(LEXICON_WORDS).select("term").collect())
        known.append(np.array([r[0] for r in top], dtype=np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast(tuple(known))
    schema = "doc_id bigint, " + ", ".join(f"{c} double" for c in FEATURES)
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")

    def featured(part: DataFrame) -> DataFrame:
        return vector.transform(part.select("doc_id", "text").mapInArrow(_featurer(shared), schema))

    rest = learn.where(f"({second}) or ({third})")
    fit = scratch.store(featured(rest).join(train, "doc_id")
                        .select("doc_id", *FEATURES, "toxic", "part"), "fit")
    fit = vector.transform(fit)
    trees = GBTClassifier(featuresCol="features", labelCol="toxic", maxIter=TREES, maxDepth=DEPTH,
                          seed=5).fit(fit.where(second))

    def margins(part: DataFrame) -> DataFrame:
        return trees.transform(part).withColumn("margin", vector_to_array("probability")[1])

    # rows of one margin are one weighted point
    points = margins(fit.where(third)).groupBy("margin").agg(
        F.avg(F.col("toxic").cast("double")).alias("toxic"),
        F.count("*").cast("double").alias("weight"))
    curve = IsotonicRegression(featuresCol="margin", labelCol="toxic", weightCol="weight",
                               predictionCol="score").fit(points)
    out = curve.transform(margins(featured(rows)).select("doc_id", "margin"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    # the margin keeps documents of one calibrated step in order
    score = 0.999 * score + 0.001 * F.col("margin")
    return out.select("doc_id", shown, score.alias("score"),
                      (score >= 0.5).cast("int").alias("predicted"))
