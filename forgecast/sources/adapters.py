"""Derive the procurement tables from TPC-H style tables (``lineitem``, ``orders``).

* price history: one observation per (part, ship day): ``nsn`` = part key,
  ``unit_price`` = Σ extended price / Σ quantity, ``demand_quantity`` = Σ quantity,
  ``supplier_id`` = smallest supplier key of the day (it varies inside a part),
  ``market_index`` = the month's price level over all parts relative to the
  overall level, ``data_density_class`` from the part's observation count.
* supplier shipping: one report per (supplier, ship month) from lineitem ⋈ orders:
  mean absolute order-to-ship days, share of urgent orders, shipment count.

Prices are rounded per line to DECIMAL(18,2) and summed as whole cents in a
BIGINT (exact, so the values do not depend on the order in which rows are
summed, and the hot per-line aggregate keeps fixed-width long buffers instead
of wide-decimal objects). Cents become DOUBLE once, through an exact decimal.
Group keys stay numeric through the shuffles and become strings afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C



def _null(t: str):
    return F.lit(None).cast(t)


def read_driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ratio(amount, qty):
    return F.try_divide(amount.cast("double"), qty.cast("double"))


def _cents(price):
    """Whole cents of a price rounded to 2 decimals (the DECIMAL(18,2) rounding)."""
    return (price.cast("decimal(18,2)") * 100).cast("bigint")


def _amount(cents):
    """Σ cents as the exact DECIMAL amount (converted to DOUBLE by ``_ratio``)."""
    return cents.cast("decimal(38,0)") / F.lit(100).cast("decimal(38,0)")


def price_history_from_lineitem(lineitem: DataFrame) -> DataFrame:
    li = lineitem.select(
        "l_partkey", F.to_date("l_shipdate").alias("date"), "l_suppkey",
        F.col("l_quantity").cast("bigint").alias("qty"), _cents(F.col("l_extendedprice")).alias("cents"),
    ).where(F.col("l_partkey").isNotNull())
    # Map-side partial aggregation collapses a hot part to one row per day
    # before the shuffle, so skew in lineitem does not reach the windows.
    daily = li.groupBy("l_partkey", "date").agg(
        F.sum("cents").alias("cents"),
        F.sum("qty").alias("demand_quantity"),
        F.min("l_suppkey").alias("l_suppkey"),
    ).select(F.col("l_partkey").cast("string").alias("nsn"), "date", "cents", "demand_quantity",
             F.col("l_suppkey").cast("string").alias("supplier_id")
    # Same rows; it states the filter that joins on ``nsn`` infer, so every
    # consumer of this table pushes the same scan filter and the exchanges
    # stay reusable across them.
    ).where(F.col("nsn").isNotNull())
    # One row per calendar month (bounded by the time span, not the data
    # volume), aggregated straight from lineitem: its partial aggregation
    # leaves a few hundred rows per task, so this costs a pruned scan and no
    # large shuffle, and the daily aggregate is shuffled only once. Only these
    # month rows go through decimals (exact totals past 2^53 cents).
    everything = Window.partitionBy()
    months = (
        li.groupBy(F.trunc("date", "month").alias("month"))
        .agg(F.sum("cents").alias("m_cents"), F.sum("qty").alias("m_qty"))
        .select("month", _amount(F.col("m_cents")).alias("m_amount"), "m_qty")
        .select(
            "month",
            F.try_divide(_ratio(F.col("m_amount"), F.col("m_qty")),
                         _ratio(F.sum("m_amount").over(everything),
                                F.sum("m_qty").over(everything))).alias("market_index"),
        )
    )
    # per-item window on the string key: every later series window reuses it
    per_item = Window.partitionBy("nsn")
    n_obs = F.count(F.lit(1)).over(per_item)
    density = (F.when(n_obs >= C.ADAPTER_DENSE_MIN_OBS, F.lit(C.DENSE_CLASS))
               .when(n_obs >= C.ADAPTER_MODERATE_MIN_OBS, F.lit(C.MODERATE_CLASS))
               .otherwise(F.lit(C.SPARSE_CLASS)))
    return (
        daily.join(F.broadcast(months), F.trunc(daily["date"], "month") == months["month"], "left")
        .select(
            "nsn",
            _null("string").alias("item_description"),
            "date",
            # one part-day's cents are far below 2^53: exact as a double, so
            # this single division is the correctly rounded Σ price / Σ qty
            F.try_divide(F.col("cents").cast("double") / F.lit(100.0),
                         F.col("demand_quantity").cast("double")).alias("unit_price"),
            "demand_quantity",
            "market_index",
            "supplier_id",
            _null("string").alias("contract_id"),
            density.alias("data_density_class"),
            _null("string").alias("recommended_modeling_approach"),
        )
    )


def supplier_shipping_from_orders(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    li = lineitem.select("l_orderkey", "l_suppkey", F.to_date("l_shipdate").alias("ship_day"))
    o = orders.select("o_orderkey", F.to_date("o_orderdate").alias("order_day"), "o_orderpriority")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"], "inner")
    urgent = F.when(F.col("o_orderpriority") == C.URGENT_PRIORITY, 1).otherwise(0)
    n = F.count(F.lit(1))
    return (
        j.groupBy("l_suppkey", F.trunc("ship_day", "month").alias("report_month"))
        .agg(
            F.avg(F.abs(F.datediff("ship_day", "order_day"))).cast("double").alias("avg_lead_time_days"),
            (F.sum(urgent).cast("double") / n.cast("double")).alias("expedite_rate"),
            n.cast("int").alias("shipments_completed"),
        )
        .select(
            F.col("l_suppkey").cast("string").alias("supplier_id"),
            _null("string").alias("supplier_name"), "report_month",
            "avg_lead_time_days", _null("double").alias("on_time_delivery_rate"),
            _null("double").alias("defect_rate"), _null("string").alias("primary_shipping_code"),
            _null("string").alias("region"), "shipments_completed", "expedite_rate",
            _null("double").alias("avg_freight_cost"), _null("double").alias("risk_score"),
        )
    )


def transactions_from_orders(orders: DataFrame) -> DataFrame:
    """Procurement transactions: one row per order, ``order_date`` typed as DATE."""
    return orders.select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("buyer_id"),
        F.to_date("o_orderdate").alias("order_date"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("amount"),
    )


def load_driver_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(price_history, supplier_shipping) derived from the driver's parquet tables."""
    li = read_driver_table(spark, sf_dir, "lineitem")
    orders = read_driver_table(spark, sf_dir, "orders")
    return price_history_from_lineitem(li), supplier_shipping_from_orders(li, orders)


def store_driver_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The derived tables written once (price history bucketed by item,
    shipping bucketed by supplier) for pipelines with many consumers."""
    from .storage import store_table
    price, ship = load_driver_tables(spark, sf_dir)
    return (store_table(price, "price_history", "nsn"),
            store_table(ship, "supplier_shipping", "supplier_id", rebalance=True))
