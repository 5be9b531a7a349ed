"""Corpus preparation: the stages applied one after another to ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgecast.llm.decontaminate import contaminated
from forgecast.llm.graph import Scratch, join_ids
from forgecast.llm.ngram_join import ngram_jaccard_join
from forgecast.llm.paragraphs import cut_paragraphs, repeated_paragraphs
from forgecast.llm.piece_codec import codec_digest
from forgecast.llm.quality import quality_rules

#: the result has no SQL form (see the brute-force test)
ORACLE_SQL = None


def by_text(docs: DataFrame) -> DataFrame:
    """``docs`` with a hash of the text in ``_key``: decisions about texts hold for rows
    without an id and for repeated ids too."""
    return docs.withColumn("_key", F.xxhash64(F.coalesce("text", F.lit(""))))


def _as_id(keyed: DataFrame) -> DataFrame:
    return keyed.select(F.col("_key").alias("doc_id"), "text")


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    return join_ids(by_text(docs), keys, "_key", "left_anti").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is rejected go."""
    scratch = Scratch(spark, "pipeline-quality")
    rejected = scratch.store(quality_rules(_as_id(by_text(docs))).where("not kept")
                             .select(F.col("doc_id").alias("_key")).distinct(), "rejected")
    return _without(docs, rejected)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: the one with the least id (null
    last, then by text hash), and one row of it if it is repeated. Texts without a word
    are in no group and stay."""
    scratch = Scratch(spark, "pipeline-join")
    keyed = by_text(docs)
    groups = scratch.store(ngram_jaccard_join(_as_id(keyed)).where("n_shingles > 0").select(
        F.col("doc_id").alias("_key"), "component_id").distinct(), "groups")
    rows = scratch.store(keyed.groupBy("_key", F.col("doc_id").alias("_id")).agg(
        F.count("*").alias("rows")), "rows")
    order = F.struct(F.col("_id").isNull().alias("none"), "_id", "_key", "rows")
    kept = scratch.store(groups.join(rows, "_key").groupBy("component_id").agg(
        F.min(order).alias("k")).select("k._key", "k._id", "k.rows"), "kept")
    gone = scratch.store(groups.select("_key").join(kept.select("_key"), "_key", "left_anti"), "gone")
    left = join_ids(keyed, gone, "_key", "left_anti")
    # rows of kept texts: those with another id go, one of equal rows stays
    again = scratch.store(rows.groupBy("_key").agg(F.sum("rows").alias("n")).where("n > 1")
                          .join(kept, "_key").select("_key", "_id"), "again")
    once = join_ids(left, again.select("_key"), "_key", "left_anti")
    several = left.join(again, "_key").where(F.col("doc_id").eqNullSafe(F.col("_id")))
    return once.select(*docs.columns).union(
        several.dropDuplicates(["_key"]).select(*docs.columns))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat an earlier one are cut; texts left without a word go. A row
    without an id takes a hash of its text as id here, greater than any given id."""
    last = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    own = docs.withColumn("_id", F.col("doc_id")).withColumn("doc_id", F.coalesce("doc_id", last))
    cut = cut_paragraphs(own, repeated_paragraphs(own))
    return cut.withColumn("doc_id", F.col("_id")).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    scratch = Scratch(spark, "pipeline-decontamination")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = scratch.store(contaminated(_as_id(by_text(docs)), items)
                          .select(F.col("doc_id").alias("_key")).distinct(), "leaks")
    return _without(docs, leaks)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, as number and hash, with the round trip's result."""
    return codec_digest(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", ngram_join_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding and decoding", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
