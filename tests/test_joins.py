"""Hot-key lookup joins equal the plain join for every join type and key mix."""

import pytest
from pyspark.sql import functions as F

from forgecast.operators.joins import hot_keys, lookup_join


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame(
        [(i, "a") for i in range(9)] + [(20, "b"), (21, "b"), (30, None), (31, "z")],
        "id int, k string")
    right = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "k string, v double")
    return left, right


def test_hot_keys_are_the_busiest_and_bounded(sides):
    left, _ = sides
    assert hot_keys(left, "k", 2, 10) == ["a", "b"]
    assert hot_keys(left, "k", 2, 1) == ["a"]
    assert hot_keys(left, "k", 100, 10) == []


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("hot", [[], ["a"], ["a", "b"], ["z"], ["q"]])
def test_lookup_join_equals_plain_join(sides, how, hot):
    left, right = sides
    rows = lambda df: sorted(map(str, df.select("id", "k", "v").collect()))
    assert rows(lookup_join(left, right, "k", how, hot)) == rows(left.join(right, "k", how))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_spreads_hot_and_null_keys(spark, how):
    from forgecast.operators.joins import SALTS, salted_join
    rows = [("hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i % 50}", i) for i in range(3000)]
    left = spark.createDataFrame(rows, "key string, i int")
    right = spark.createDataFrame([("hot", 1), ("k2", 2), ("absent", 3)], "key string, v int")
    want = left.join(right, "key", how)
    got = salted_join(left, right, "key", how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                             "spark.sql.adaptive.autoBroadcastJoinThreshold",
                                             "spark.sql.adaptive.coalescePartitions.enabled",
                                             "spark.sql.shuffle.partitions") if spark.conf.get(k, None)}
    for k, v in {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "64",
                 "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                 "spark.sql.adaptive.coalescePartitions.enabled": "false"}.items():
        spark.conf.set(k, v)
    try:
        sizes = [r["count"] for r in salted_join(left, right, "key", "left").groupBy(
            F.spark_partition_id()).count().collect()]
    finally:
        for k in ("spark.sql.autoBroadcastJoinThreshold",
                  "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(k)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(sizes) < 3 * 1000 // SALTS * 2  # 1,000 rows of one key are not one task's
