"""Corpus pipeline stages: null and repeated ids, empty tables, the whole chain."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

import corpus_pipeline as P

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])


def prose(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
             for _ in range(300)]
    return " ".join(rng.choice(words) for _ in range(n))


def rows(*pairs):
    return [(i, t, None, "s", None) for i, t in pairs]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(1, prose(900, 30))], "item_id bigint, text string").write.parquet(
        str(folder / "benchmark.parquet"))
    return str(folder)


def test_one_row_of_each_group_stays_whatever_its_id(spark, sf_dir):
    same, near = prose(1, 80), prose(1, 80) + " end"
    docs = spark.createDataFrame(rows((None, same), (None, same), (7, same), (7, same), (8, same),
                                      (9, near), (3, prose(2, 80)), (None, prose(3, 60)),
                                      (None, ""), (5, None)), DOCS)
    got = P.ngram_join_stage(spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert sorted(map(repr, (tuple(r)[:2] for r in got.collect()))) == sorted(map(repr, [
        (7, same), (3, prose(2, 80)), (None, prose(3, 60)), (None, ""), (5, None)]))
    only = spark.createDataFrame(rows(*[(None, same)] * 4), DOCS)
    assert P.ngram_join_stage(spark, only, sf_dir).count() == 1


def test_rejected_and_contaminated_rows_go_without_an_id(spark, sf_dir):
    fine, junk = prose(4, 60), "word " * 60
    leak = prose(5, 20) + " " + prose(900, 30) + " " + prose(6, 20)
    docs = spark.createDataFrame(rows((None, junk), (1, junk), (1, fine), (None, fine)), DOCS)
    got = [tuple(r)[:2] for r in P.quality_stage(spark, docs, sf_dir).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(1, fine), (None, fine)]))
    docs = spark.createDataFrame(rows((None, leak), (2, leak), (2, fine), (None, fine)), DOCS)
    got = [tuple(r)[:2] for r in P.decontamination_stage(spark, docs, sf_dir).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(2, fine), (None, fine)]))


def test_repeated_passages_of_rows_without_an_id_are_cut(spark, sf_dir):
    passage = prose(7, 80)
    docs = spark.createDataFrame(rows((1, prose(8, 50) + " " + passage),
                                      (None, prose(9, 50) + " " + passage + " " + prose(10, 40))), DOCS)
    got = [(r.doc_id, len(r.text.split())) for r in P.substring_stage(spark, docs, sf_dir).collect()]
    assert sorted(n for _, n in got) == [90, 130] and {i for i, _ in got} == {1, None}


def test_stages_of_an_empty_table(spark, sf_dir):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in P.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
