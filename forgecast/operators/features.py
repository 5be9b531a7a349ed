"""Feature operators over *all* items at once (DataFrame -> DataFrame).

Every series operation uses one window spec, partitioned by item and ordered
by date (nulls last, like a pandas sort) with a total tie-break, so all the
windows of a query share a single shuffle by ``nsn``. Items are bounded by
their number of distinct observation dates, so one item never holds an
unbounded share of the rows once the price table has its (item, date) grain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import log_gap, month_number
from .joins import hot_keys, lookup_join

_TIE_BREAK = ("unit_price", "demand_quantity", "market_index", "supplier_id")
SERIES_COLUMNS = ("date", *_TIE_BREAK)  # the total order of a series, ascending, nulls last


def series_order(descending: bool = False) -> list[Column]:
    cols = ["date", *_TIE_BREAK]
    if descending:
        return [F.col(c).desc_nulls_first() for c in cols]
    return [F.col(c).asc_nulls_last() for c in cols]


def series_order_key() -> Column:
    """A struct that sorts like ``series_order()`` (nulls last) for max_by/min_by."""
    parts = []
    for c in ("date", *_TIE_BREAK):
        parts += [F.col(c).isNull().alias(f"{c}_null"), F.col(c).alias(c)]
    return F.struct(*parts)


def series_window(descending: bool = False) -> Window:
    return Window.partitionBy("nsn").orderBy(*series_order(descending))


# ---------------------------------------------------------------- dense path
def dense_lag_features(price: DataFrame, n_lags: int = C.N_LAGS,
                       large_items: list[str] | None = None) -> DataFrame:
    """One row per item observation after the first ``n_lags`` (positional lags).

    ``lag_1`` is the *oldest* price of the window (t - n_lags) and ``lag_n`` the
    newest (t - 1). ``demand_quantity``, ``market_index`` and ``month`` belong
    to the target row. ``pos`` is the 1-based position of the row in its item
    and ``n_usable`` the number of rows the item contributes. Items listed in
    ``large_items`` are computed split across tasks (``operators/series.py``).
    """
    if large_items:
        big = F.col("nsn").isin(list(large_items))
        return (dense_lag_features(price.where(~big), n_lags)
                .unionByName(_dense_lags_split(price.where(big), n_lags)))
    w = series_window()
    lags = [F.lag("unit_price", n_lags - k + 1).over(w).cast("double").alias(f"lag_{k}")
            for k in range(1, n_lags + 1)]
    rows = price.select(
        "nsn", "date",
        F.row_number().over(w).alias("rn"),
        F.count(F.lit(1)).over(Window.partitionBy("nsn")).alias("n_obs"),
        *lags,
        F.col("demand_quantity").cast("double").alias("demand_quantity"),
        F.col("market_index").cast("double").alias("market_index"),
        month_number(F.col("date")).alias("month"),
        F.col("unit_price").cast("double").alias("target"),
    )
    return (rows.where(F.col("rn") > n_lags)
            .select("nsn", "date", (F.col("rn") - n_lags).alias("pos"),
                    (F.col("n_obs") - n_lags).alias("n_usable"),
                    *[f"lag_{k}" for k in range(1, n_lags + 1)],
                    "demand_quantity", "market_index", "month", "target"))


def _dense_lags_split(price: DataFrame, n_lags: int) -> DataFrame:
    from .series import split_series
    s = split_series(price, "nsn", list(SERIES_COLUMNS), {"unit_price": n_lags})
    return (s.where(F.col("rn") > n_lags)
            .select("nsn", "date", (F.col("rn") - n_lags).alias("pos"),
                    (F.col("n_obs") - n_lags).alias("n_usable"),
                    *[F.col(f"unit_price_lag{n_lags - k + 1}").cast("double").alias(f"lag_{k}")
                      for k in range(1, n_lags + 1)],
                    F.col("demand_quantity").cast("double").alias("demand_quantity"),
                    F.col("market_index").cast("double").alias("market_index"),
                    month_number(F.col("date")).alias("month"),
                    F.col("unit_price").cast("double").alias("target")))


def dense_split(features: DataFrame) -> DataFrame:
    """Per-item chronological split: first ``floor(n * 4 / 5)`` usable rows train."""
    n_train = F.floor(F.col("n_usable") * C.DENSE_TRAIN_NUM / C.DENSE_TRAIN_DEN)
    return features.withColumn("n_train", n_train.cast("long")).withColumn(
        "is_train", F.col("pos") <= F.col("n_train"))


def history_points(price: DataFrame) -> DataFrame:
    """Observation count per item (counted before the warm-up cut)."""
    return price.groupBy("nsn").agg(F.count(F.lit(1)).alias("dense_points"))


def last_observation(price: DataFrame) -> DataFrame:
    """Latest row per item: date, price, demand, market, supplier, and the
    item's ``max(date)`` as ``last_history_month``."""
    latest = F.max_by(F.struct(*[F.col(c) for c in (
        "date", "unit_price", "demand_quantity", "market_index", "supplier_id")]),
        series_order_key())
    # max_by over a struct key: a partial aggregate, so a hot item collapses map-side.
    return (price.groupBy("nsn")
            .agg(latest.alias("l"), F.max("date").alias("last_history_month"),
                 F.count(F.lit(1)).alias("n_obs"))
            .select("nsn", "l.*", "last_history_month", "n_obs"))


def last_lag_vector(price: DataFrame, n_lags: int = C.N_LAGS) -> DataFrame:
    """The last ``n_lags`` prices of every item, oldest first, plus the state
    needed for a recursive forecast. ``complete`` is false for short items."""
    top = (price.select("nsn", "date", "unit_price", "demand_quantity", "market_index",
                        "supplier_id",
                        F.row_number().over(series_window(descending=True)).alias("rk"))
           .where(F.col("rk") <= n_lags))  # planned as a per-partition top-k
    return (top.groupBy("nsn")
            .agg(F.sort_array(F.collect_list(F.struct(
                    (-F.col("rk")).alias("k"), F.col("unit_price").cast("double").alias("p")))
                 ).alias("tail"),
                 F.max_by(F.struct("date", "demand_quantity", "market_index"),
                          -F.col("rk")).alias("last"))
            .select("nsn",
                    F.transform("tail", lambda x: x["p"]).alias("lags"),
                    (F.size("tail") == n_lags).alias("complete"),
                    F.col("last.date").alias("last_date"),
                    F.col("last.demand_quantity").cast("double").alias("last_demand"),
                    F.col("last.market_index").cast("double").alias("last_market")))


# --------------------------------------------------------------- sparse path
def supplier_rollup(shipping: DataFrame, k: int = C.ROLLUP_REPORTS) -> DataFrame:
    """Mean of the latest ``k`` reports per supplier (by ``report_month``).

    Rows are ranked first and nulls skipped by the mean afterwards, so a
    supplier whose latest ``k`` values are null gets NULL. ``n_reports`` counts
    every report of the supplier (0 never appears: absent suppliers have no row).
    """
    w = Window.partitionBy("supplier_id").orderBy(
        F.col("report_month").desc_nulls_last(), F.col("avg_lead_time_days").desc_nulls_last(),
        F.col("expedite_rate").desc_nulls_last())
    return (shipping.select("supplier_id", "report_month", "avg_lead_time_days", "expedite_rate",
                            F.row_number().over(w).alias("rk"))
            .where(F.col("rk") <= k)
            .groupBy("supplier_id")
            .agg(F.avg("avg_lead_time_days").alias("supplier_avg_lead_3m"),
                 F.avg("expedite_rate").alias("supplier_expedite_3m"),
                 F.count(F.lit(1)).alias("n_reports")))


def price_pairs(price: DataFrame, large_items: list[str] | None = None) -> DataFrame:
    """Consecutive observations (prev, cur) within an item, one row per cur.

    Also carries the item's *first* density class and supplier (training
    semantics) and its *last* supplier (serving semantics). Items listed in
    ``large_items`` are computed split across tasks.
    """
    if large_items:
        big = F.col("nsn").isin(list(large_items))
        return price_pairs(price.where(~big)).unionByName(_pairs_split(price.where(big)))
    w = series_window()
    whole = Window.partitionBy("nsn")
    prev_date = F.lag("date").over(w)
    gap = F.datediff("date", prev_date)
    return (price.select(
                "nsn", "date",
                F.row_number().over(w).alias("rn"),
                F.count(F.lit(1)).over(whole).alias("n_obs"),
                F.first("data_density_class").over(w).alias("density"),
                F.first("supplier_id").over(w).alias("first_supplier_id"),
                F.col("supplier_id").alias("cur_supplier_id"),
                gap.alias("gap_days"),
                F.lag("unit_price").over(w).cast("double").alias("prev_price"),
                F.col("market_index").cast("double").alias("market_index"),
                F.col("demand_quantity").alias("demand_quantity"),
                (F.col("market_index") - F.lag("market_index").over(w)).alias("delta_market"),
                F.col("unit_price").cast("double").alias("target_price"))
            .where(F.col("rn") > 1)
            .withColumn("log_gap", log_gap(F.col("gap_days"))))


def _pairs_split(price: DataFrame) -> DataFrame:
    from .series import split_series
    s = split_series(price, "nsn", list(SERIES_COLUMNS),
                     {"date": 1, "unit_price": 1, "market_index": 1},
                     firsts=("data_density_class", "supplier_id"))
    return (s.where(F.col("rn") > 1)
            .select("nsn", "date", "rn", "n_obs",
                    F.col("data_density_class_first").alias("density"),
                    F.col("supplier_id_first").alias("first_supplier_id"),
                    F.col("supplier_id").alias("cur_supplier_id"),
                    F.datediff("date", "date_lag1").alias("gap_days"),
                    F.col("unit_price_lag1").cast("double").alias("prev_price"),
                    F.col("market_index").cast("double").alias("market_index"),
                    F.col("demand_quantity").alias("demand_quantity"),
                    (F.col("market_index") - F.col("market_index_lag1")).alias("delta_market"),
                    F.col("unit_price").cast("double").alias("target_price"))
            .withColumn("log_gap", log_gap(F.col("gap_days"))))


def hot_suppliers(price: DataFrame, min_rows: int = C.HOT_KEY_ROWS,
                  max_keys: int = C.MAX_HOT_KEYS) -> list[str]:
    """Suppliers on at least ``min_rows`` price rows: the likely hot keys of
    the rollup joins (counted on the price table, not the pair frame; the list
    only picks the join strategy, never the answer). Meant for a stored price
    table, where it is a one-column partial aggregate; on a lazily derived one
    it would re-derive the table."""
    return hot_keys(price, "supplier_id", min_rows, max_keys)


def _hot(price: DataFrame, hot) -> list:
    return hot_suppliers(price) if hot == "auto" else list(hot or [])


def sparse_training_frame(price: DataFrame, shipping: DataFrame,
                          large_items: list[str] | None = None, hot=None) -> DataFrame:
    """Pair rows of every item with >= 2 observations, joined to the rollup of
    the item's first supplier (no match -> NULL features).

    The rollup has one row per supplier; Spark broadcasts it when its measured
    size is under the broadcast threshold (AQE), else it shuffles. Hot
    suppliers (``hot``: a list, or "auto" to count them on ``price`` -- for
    stored tables) are joined against a broadcast of their own rollup rows,
    so one supplier's pairs are not gathered into one task.
    """
    pairs = price_pairs(price, large_items)
    rollup = supplier_rollup(shipping).withColumnRenamed("supplier_id", "first_supplier_id")
    j = lookup_join(pairs, rollup, "first_supplier_id", "left", _hot(price, hot))
    return j.select(*C.SPARSE_FRAME_COLUMNS, "date")


def sparse_filter(frame: DataFrame, density: str = C.SPARSE_CLASS) -> DataFrame:
    """Keep one density class and drop rows with a null in any frame column."""
    return frame.where(F.col("density") == density).dropna("any", subset=C.SPARSE_FRAME_COLUMNS)


def latest_pair(price: DataFrame) -> DataFrame:
    """The last two observations of every item with at least two, as one row.

    Ranked with ``row_number() <= 2`` so Spark keeps a per-item top-2 on the
    map side (WindowGroupLimit) and shuffles two rows per item, not its history.
    """
    cols = ("date", "unit_price", "demand_quantity", "market_index", "supplier_id")
    top = (price.select("nsn", *cols, F.row_number().over(series_window(descending=True)).alias("rk"))
           .where(F.col("rk") <= 2))
    pick = (lambda k: F.max(F.when(F.col("rk") == k, F.struct(*[F.col(c) for c in cols]))))
    return (top.groupBy("nsn")
            .agg(pick(1).alias("cur"), pick(2).alias("prev"), F.count(F.lit(1)).alias("n_top"))
            .where(F.col("n_top") == 2)
            .select("nsn",
                    F.datediff("cur.date", "prev.date").alias("gap_days"),
                    F.col("prev.unit_price").cast("double").alias("prev_price"),
                    F.col("cur.market_index").cast("double").alias("market_index"),
                    F.col("cur.demand_quantity").cast("double").alias("demand_quantity"),
                    (F.col("cur.market_index") - F.col("prev.market_index")).alias("delta_market"),
                    F.col("cur.unit_price").cast("double").alias("last_observed_price"),
                    F.col("cur.supplier_id").alias("supplier_id"))
            .withColumn("log_gap", log_gap(F.col("gap_days"))))


def sparse_serving_features(price: DataFrame, shipping: DataFrame, hot=None) -> DataFrame:
    """Latest pair of each item, scored against the rollup of its *last* supplier.

    Items with fewer than two rows have no row (the request layer reports
    ``need sparse history``). A supplier with no reports at all gets the
    fallback lead/expedite values; a supplier whose latest reports are null
    keeps NULL. Hot suppliers are joined as in ``sparse_training_frame``.
    """
    latest = latest_pair(price)
    rollup = supplier_rollup(shipping)
    j = lookup_join(latest, rollup, "supplier_id", "left", _hot(price, hot))
    has_reports = F.col("n_reports").isNotNull()
    return j.select(
        "nsn", "supplier_id", "gap_days", "log_gap", "prev_price", "market_index",
        "demand_quantity", "delta_market",
        F.when(has_reports, F.col("supplier_avg_lead_3m"))
         .otherwise(F.lit(C.SERVE_DEFAULT_LEAD)).alias("supplier_avg_lead_3m"),
        F.when(has_reports, F.col("supplier_expedite_3m"))
         .otherwise(F.lit(C.SERVE_DEFAULT_EXPEDITE)).alias("supplier_expedite_3m"),
        "last_observed_price")


def min_history_status(price: DataFrame, n_lags: int = C.N_LAGS) -> DataFrame:
    """Per item: observation count and whether the dense / sparse paths can run."""
    return (price.groupBy("nsn").agg(F.count(F.lit(1)).alias("n_obs"))
            .select("nsn", "n_obs",
                    F.when(F.col("n_obs") - n_lags >= C.DENSE_MIN_ROWS, F.lit("ok"))
                     .otherwise(F.lit("insufficient_history")).alias("dense_status"),
                    F.when(F.col("n_obs") >= 2, F.lit("ok"))
                     .otherwise(F.lit(C.ERR_NEED_SPARSE)).alias("sparse_status")))
