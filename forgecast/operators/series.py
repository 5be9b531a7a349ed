"""Series features for items too large for one task.

The usual series operators run one window per item (``partitionBy("nsn")``).
For an item holding a large share of all rows, this module computes the same
columns -- 1-based position, item size, first values and lags -- with the
item split across tasks:

1. range-partition on (item, order) so a large item spans many partitions,
   and pin the partition ids with a reliable checkpoint;
2. number rows inside each (partition, item) *slice*;
3. bring each slice the ``K`` rows that precede it from earlier slices of the
   same item: every slice's last ``K`` rows are ranked per item, and a slice
   asks for the ``K`` tail positions just before its start (an equi-join with
   fan-out ``K``, never a range or cross join);
4. lags are then a window over (slice, item) with the carried rows in front;
   positions add the sizes of the earlier slices; first values come from a
   partial ``min_by`` per item.

The per-item tables in steps 3-4 hold at most ``K`` rows per slice, so their
size is bounded by ``K x (items + partitions)``, not by the item's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def split_series(df: DataFrame, key: str, order: list[str], lags: dict[str, int],
                 firsts: tuple[str, ...] = (), n_partitions: int | None = None) -> DataFrame:
    """Add ``rn`` (1-based), ``n_obs``, ``<col>_lag<k>`` for k in 1..lags[col],
    and ``<col>_first`` for ``firsts``, computing each item across tasks.

    ``order`` must be a total order within an item (ascending, nulls last).
    """
    spark = df.sparkSession
    n = n_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    K = max(lags.values()) if lags else 0
    asc = [F.col(c).asc_nulls_last() for c in order]
    desc = [F.col(c).desc_nulls_first() for c in order]

    ranked = cut_lineage(df.repartitionByRange(n, F.col(key).asc_nulls_last(), *asc)
                         .withColumn("_pid", F.spark_partition_id()))
    in_slice = Window.partitionBy("_pid", key)
    rows = ranked.withColumn("_lrn", F.row_number().over(in_slice.orderBy(*asc)))

    # slice sizes -> rows of the item before each slice, and the item size
    slices = rows.groupBy("_pid", key).agg(F.count(F.lit(1)).alias("_cnt"))
    per_item = Window.partitionBy(key).orderBy("_pid")
    slices = slices.select(
        "_pid", key,
        F.coalesce(F.sum("_cnt").over(per_item.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
        F.sum("_cnt").over(Window.partitionBy(key)).alias("n_obs"))

    out = rows
    if K:
        carry_cols = [c for c in lags if c not in order]
        # the last K rows of every slice, numbered per item in (slice, order)
        tails = (rows.withColumn("_rk", F.row_number().over(in_slice.orderBy(*desc)))
                 .where(F.col("_rk") <= K)
                 .select(key, "_pid", *order, *carry_cols))
        tails = tails.withColumn(
            "_tpos", F.row_number().over(Window.partitionBy(key).orderBy("_pid", *asc)))
        # tail rows before each slice start, and the K tail positions a slice needs
        ends = (tails.groupBy(key, "_pid").agg(F.count(F.lit(1)).alias("_tc"))
                .select(key, "_pid", F.coalesce(F.sum("_tc").over(
                    per_item.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_end")))
        wanted = ends.select(key, F.col("_pid").alias("_to"),
                             F.explode(F.sequence(F.col("_end") - K + 1, F.col("_end"))).alias("_tpos")
                             ).where(F.col("_tpos") >= 1)
        carried = (wanted.join(tails.drop("_pid"), [key, "_tpos"], "inner")
                   .select(F.col("_to").alias("_pid"), key, *order, *carry_cols,
                           F.lit(True).alias("_carry")))
        mine = rows.withColumn("_carry", F.lit(False))
        both = mine.unionByName(carried, allowMissingColumns=True)
        w = in_slice.orderBy(*asc)
        lag_cols = [F.lag(c, k).over(w).alias(f"{c}_lag{k}")
                    for c, kk in lags.items() for k in range(1, kk + 1)]
        out = both.select("*", *lag_cols).where(~F.col("_carry")).drop("_carry")

    out = (out.join(slices, ["_pid", key], "inner")
           .withColumn("rn", (F.col("_off") + F.col("_lrn")).cast("int")))
    if firsts:
        order_key = F.struct(*[x for c in order
                               for x in (F.col(c).isNull().alias(f"{c}_n"), F.col(c).alias(c))])
        first = (ranked.groupBy(key)
                 .agg(F.min_by(F.struct(*[F.col(c) for c in firsts]), order_key).alias("_f"))
                 .select(key, *[F.col(f"_f.{c}").alias(f"{c}_first") for c in firsts]))
        out = out.join(first, key, "left")
    return out.drop("_pid", "_lrn", "_off")


def lag_column(c: str, k: int) -> Column:
    return F.col(f"{c}_lag{k}")
