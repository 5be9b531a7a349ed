"""Stored tables: rows kept, about one file per bucket."""

from __future__ import annotations

from pyspark.sql import functions as F

from forgecast.sources.storage import store_table


def test_rebalanced_buckets_are_single_files(spark):
    rows = (spark.range(0, 4000, 1, 8)
            .select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None)
                    .otherwise((F.col("id") % 97).cast("string")).alias("supplier_id"), "id"))
    stored = store_table(rows, "rebalance_test", "supplier_id", buckets=4, rebalance=True)
    assert len(stored.inputFiles()) <= 4
    assert sorted(map(str, stored.collect())) == sorted(map(str, rows.collect()))
    grouped = stored.groupBy("supplier_id").count()
    assert "Exchange hashpartitioning" not in grouped._jdf.queryExecution().executedPlan().toString()
    spread = store_table(rows, "spread_test", "supplier_id", buckets=4)
    assert len(spread.inputFiles()) > 4
