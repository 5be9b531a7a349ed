"""Train / hold-out splits.

* per item (chronological): see ``features.dense_split``;
* pooled (positional): rows in a global order, the first ``max(1, n*3//4)``
  train. The global position is computed without pulling all rows into one
  task: range-partition on the order, sort within partitions, count rows per
  partition (one small row per partition), and add each partition's offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..session import cut_lineage

_LOCAL_BITS = 33  # monotonically_increasing_id = partition << 33 | row in partition


def global_positions(df: DataFrame, order: list[Column], n_partitions: int | None = None,
                     name: str = "gpos") -> DataFrame:
    """Add a 0-based global row position in ``order`` (a total order), plus ``n_total``."""
    spark = df.sparkSession
    n = n_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    tagged = ordered.withColumn("_mid", F.monotonically_increasing_id())
    # Reliable checkpoint pins the ids (the range exchange samples its bounds).
    tagged = cut_lineage(tagged)
    tagged = tagged.withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
    # One row per partition: bounded by the partition count, safe to broadcast.
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"),
        F.sum("_cnt").over(Window.partitionBy()).alias("n_total"))
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + local)
            .drop("_mid", "_pid", "_off"))


def pooled_split(df: DataFrame, order: list[Column], num: int = C.SPARSE_TRAIN_NUM,
                 den: int = C.SPARSE_TRAIN_DEN) -> DataFrame:
    """Positional split: ``is_train`` for the first ``max(1, floor(n*num/den))`` rows."""
    pos = global_positions(df, order)
    k = F.greatest(F.lit(1), F.floor(F.col("n_total") * num / den))
    return pos.withColumn("n_train", k.cast("long")).withColumn("is_train", F.col("gpos") < F.col("n_train"))


def sparse_order() -> list[Column]:
    """Order of the pooled frame: item, then date (nulls last), then a total tie-break."""
    return [F.col("nsn").asc_nulls_last(), F.col("date").asc_nulls_last(),
            F.col("target_price").asc_nulls_last(), F.col("prev_price").asc_nulls_last(),
            F.col("market_index").asc_nulls_last(), F.col("demand_quantity").asc_nulls_last()]
