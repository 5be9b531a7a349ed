"""Large items split across tasks give the same series columns as one window."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from forgecast.operators.series import split_series


@pytest.mark.parametrize("parts", [1, 3, 7, 16])
def test_split_series_equals_window(spark, parts):
    # one big item, small ones, and a one-row item; x is unique inside an item
    data = ([("big", i, float(i * 3 % 17), f"s{i % 4}") for i in range(57)]
            + [("mid", i, float(i), "t") for i in range(9)]
            + [("one", 0, 5.0, "u")])
    df = spark.createDataFrame(data, "k string, x int, v double, s string")
    got = split_series(df, "k", ["x"], {"v": 6, "x": 1}, firsts=("s",), n_partitions=parts)
    w = Window.partitionBy("k").orderBy("x")
    want = df.select(
        "k", "x", F.row_number().over(w).alias("rn"),
        F.count(F.lit(1)).over(Window.partitionBy("k")).alias("n_obs"),
        *[F.lag("v", j).over(w).alias(f"v_lag{j}") for j in range(1, 7)],
        F.lag("x", 1).over(w).alias("x_lag1"),
        F.first("s").over(w).alias("s_first"))
    cols = ["k", "x", "rn", "n_obs", *[f"v_lag{j}" for j in range(1, 7)], "x_lag1", "s_first"]
    a = sorted(tuple(r) for r in got.select(*cols).collect())
    b = sorted(tuple(r) for r in want.select(*cols).collect())
    assert a == b


def test_large_item_paths_match_the_window_paths(spark, price, ship):
    from forgecast.operators import features as FE
    from forgecast import config as C
    large = [C.DENSE_DEMO_NSN, "1680-01-444-5555"]
    for a, b in [(FE.dense_lag_features(price), FE.dense_lag_features(price, large_items=large)),
                 (FE.sparse_training_frame(price, ship),
                  FE.sparse_training_frame(price, ship, large_items=large))]:
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
