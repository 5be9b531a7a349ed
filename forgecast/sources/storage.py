"""Write a derived table once and read it back, optionally bucketed by a key.

Pipelines that use the procurement tables in several branches (training
runs, request batches, streams) store them once instead of re-deriving them
from the raw tables in every branch. Bucketing by the item (or supplier) key
lets every later window, grouped fit and join on that key read the table
without another shuffle. Files go under the shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import scratch_path


def store_table(df: DataFrame, name: str, bucket_by: str | None = None,
                buckets: int | None = None, rebalance: bool = False) -> DataFrame:
    """Write ``df`` and read it back, bucketed by ``bucket_by`` if that is given.

    ``rebalance``: for rows that aren't partitioned by the bucket key yet. They are shuffled
    by it first, so that a bucket is about one file and not one per task; adaptive execution
    splits the partition of a hot key, which then has several files.
    """
    spark = df.sparkSession
    tag = uuid.uuid4().hex[:12]
    path = scratch_path(spark, f"{name}-{tag}")
    if bucket_by is None:
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if rebalance:
        df = df.hint("rebalance", n, bucket_by)
    table = f"forgecast_{name}_{tag}"
    (df.write.mode("overwrite").option("path", path)
     .bucketBy(n, bucket_by).sortBy(bucket_by).saveAsTable(table))
    return spark.table(table)
