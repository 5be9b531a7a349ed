"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

All of them read the driver's whole tables (through the adapters) so their
work grows with the data. Float columns that come out of sums in a
data-dependent order (means, logs) are rounded to 6 decimals so an
independent SQL engine can be compared value by value.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import responses as RS
from ..operators import features as FE
from ..operators import splits as SP
from ..operators import training as TR
from ..operators.forecast import recursive_forecast, score_pooled
from ..session import ensure_checkpoint_dir, ensure_workers_can_import, scratch_path
from ..sources import adapters as A
from ..sources.health import row_counts
from . import serving as SV
from . import train as TP

R = 6


def _tables(spark: SparkSession, sf_dir: str):
    ensure_workers_can_import(spark)
    ensure_checkpoint_dir(spark)
    return A.load_driver_tables(spark, sf_dir)


def _stored(spark: SparkSession, sf_dir: str):
    """Derived tables written once, bucketed by their keys (many-consumer plans)."""
    ensure_workers_can_import(spark)
    ensure_checkpoint_dir(spark)
    return A.store_driver_tables(spark, sf_dir)


def _trained(spark: SparkSession, sf_dir: str, pooled: bool = True):
    """Stored tables plus models fitted once: the per-item model table is
    written (bucketed by item) before any serving branch reads it."""
    from ..sources.storage import store_table
    price, ship = _stored(spark, sf_dir)
    models = store_table(TR.model_table(_fits(price)), "dense_models", "model_key")
    model = (TP.sparse_pooled_fit(FE.sparse_training_frame(price, ship, hot="auto"),
                                  holdout=False).model if pooled else None)
    return price, ship, models, model


def _orders(spark, sf_dir):
    return A.read_driver_table(spark, sf_dir, "orders")


def _r(c: str, alias: str | None = None):
    return F.round(F.col(c), R).alias(alias or c)


# -------------------------------------------------------------- sources
def price_history_scan(spark, sf_dir):
    return _tables(spark, sf_dir)[0]


def supplier_shipping_scan(spark, sf_dir):
    return _tables(spark, sf_dir)[1]


def transactions_scan(spark, sf_dir):
    return A.transactions_from_orders(_orders(spark, sf_dir))


def table_row_counts(spark, sf_dir):
    price, ship = _tables(spark, sf_dir)
    tx = A.transactions_from_orders(_orders(spark, sf_dir))
    return row_counts({C.TABLE_SHIP: ship, C.TABLE_PRICE: price, C.TABLE_TX: tx})


# -------------------------------------------------------------- dense path
def dense_lag_features(spark, sf_dir):
    return FE.dense_lag_features(_tables(spark, sf_dir)[0])


def dense_split(spark, sf_dir):
    f = FE.dense_split(FE.dense_lag_features(_tables(spark, sf_dir)[0]))
    return f.select("nsn", "date", "pos", "n_usable", "n_train", "is_train")


def dense_points(spark, sf_dir):
    return FE.history_points(_tables(spark, sf_dir)[0])


def _fits(price):
    # adapter output is grouped by (item, day): every item is bounded by its dates
    return TP.dense_fits(price, max_group_rows=None)


def dense_holdout_mae(spark, sf_dir):
    fits = _fits(_tables(spark, sf_dir)[0])
    return fits.where(F.col("status") == "ok").select(
        "nsn", "n_usable", "n_train", "n_holdout", _r("baseline", "train_mean"), _r("holdout_mae"))


def dense_models(spark, sf_dir):
    """Model table (rows only: one per item with enough history)."""
    return TR.model_table(_fits(_tables(spark, sf_dir)[0]))


def _stump_fits(price):
    """Per-item fits of one tree with one split: grown trees that plain SQL can state."""
    return TP.dense_fits(price, C.STUMP_PARAMS, max_group_rows=None)


def dense_stump_models(spark, sf_dir):
    """One-split models of every item, with split and hold-out error.

    Prices are short decimals, so means often lie half-way between two rounded values;
    these are taken up (``+ 1e-7``), whatever the last bit of the sum.
    """
    fits = _stump_fits(_tables(spark, sf_dir)[0]).where(F.col("status") == "ok")
    split = F.size("tree") > 0
    return fits.select("nsn", "n_train", "n_holdout", F.round(F.col("baseline") + 1e-7, 4).alias("baseline"),
                       F.when(split, F.get("feature", F.lit(0))).alias("feature"),
                       F.when(split, F.round(F.get("threshold", F.lit(0)) + 1e-7, 4)).alias("threshold"),
                       F.when(split, F.round(F.get("value", F.lit(1)) + 1e-7, 4)).alias("left_value"),
                       F.when(split, F.round(F.get("value", F.lit(2)) + 1e-7, 4)).alias("right_value"),
                       F.round(F.col("holdout_mae") + 1e-7, 4).alias("holdout_mae"))


def dense_stump_forecast(spark, sf_dir):
    """Six recursive steps of every item's one-split model: prices vary by step."""
    price, _ = _tables(spark, sf_dir)
    fc = recursive_forecast(FE.last_lag_vector(price), TR.model_table(_stump_fits(price)))
    return fc.select("nsn", "step", _r("forecast_price"), "reference_month")


def _dense_forecast_long(price):
    models = TR.model_table(_fits(price))
    return recursive_forecast(FE.last_lag_vector(price), models)


def dense_forecast(spark, sf_dir):
    fc = _dense_forecast_long(_tables(spark, sf_dir)[0])
    return fc.select("nsn", "step", _r("forecast_price"), "reference_month")


def dense_forecast_single_model(spark, sf_dir):
    """Single-model mode: the busiest item's dense model forecasts every item."""
    price, _ = _tables(spark, sf_dir)
    fc = TP.single_model_forecast(price, TP.busiest_item(price))
    return fc.select("nsn", "step", _r("forecast_price"), "reference_month")


def forecast_chart_rows(spark, sf_dir):
    fc = _dense_forecast_long(_tables(spark, sf_dir)[0])
    nested = fc.groupBy("nsn").agg(F.sort_array(F.collect_list(
        F.struct("step", "forecast_price", "reference_month"))).alias("forecast"))
    rows = RS.forecast_chart_rows(nested, key="nsn")
    return rows.select("nsn", "step", "month", _r("forecast_price"))


# -------------------------------------------------------------- sparse path
def price_pairs(spark, sf_dir):
    p = FE.price_pairs(_tables(spark, sf_dir)[0])
    return p.select("nsn", "date", "gap_days", _r("log_gap"), "prev_price", "market_index",
                    "demand_quantity", "delta_market", "target_price", "density",
                    "first_supplier_id", "cur_supplier_id")


def supplier_rollup_3(spark, sf_dir):
    r = FE.supplier_rollup(_tables(spark, sf_dir)[1])
    return r.select("supplier_id", _r("supplier_avg_lead_3m"), _r("supplier_expedite_3m"),
                    "n_reports")


def _frame_out(df):
    return df.select("nsn", "density", "gap_days", _r("log_gap"), "prev_price", "market_index",
                     "demand_quantity", "delta_market", "target_price",
                     _r("supplier_avg_lead_3m"), _r("supplier_expedite_3m"), "date")


def sparse_training_frame(spark, sf_dir):
    price, ship = _tables(spark, sf_dir)
    return _frame_out(FE.sparse_training_frame(price, ship))


def sparse_filter_dropna(spark, sf_dir):
    price, ship = _tables(spark, sf_dir)
    return _frame_out(FE.sparse_filter(FE.sparse_training_frame(price, ship)))


def sparse_split(spark, sf_dir):
    price, ship = _tables(spark, sf_dir)
    sub = FE.sparse_filter(FE.sparse_training_frame(price, ship))
    return SP.pooled_split(sub, SP.sparse_order()).select("nsn", "date", "gpos", "n_train", "is_train")


def sparse_serving_features(spark, sf_dir):
    price, ship = _tables(spark, sf_dir)
    s = FE.sparse_serving_features(price, ship)
    return s.select("nsn", "supplier_id", "gap_days", _r("log_gap"), "prev_price", "market_index",
                    "demand_quantity", "delta_market", _r("supplier_avg_lead_3m"),
                    _r("supplier_expedite_3m"), "last_observed_price")


def sparse_fit_score(spark, sf_dir):
    """Pooled model fitted on the sparse class, scoring every item's latest pair (rows only)."""
    price, ship = _stored(spark, sf_dir)
    hot = FE.hot_suppliers(price)  # stored table: a one-column partial aggregate
    res = TP.sparse_pooled_fit(FE.sparse_training_frame(price, ship, hot=hot), holdout=False)
    feats = FE.sparse_serving_features(price, ship, hot=hot)
    return score_pooled(feats, res.model, list(C.SPARSE_FEATURES), "forecast_next_purchase_price"
                        ).select("nsn", "last_observed_price", "forecast_next_purchase_price")


def sparse_stump_fit(spark, sf_dir):
    """Pooled one-split model of the sparse class: its split and hold-out error."""
    price, ship = _stored(spark, sf_dir)
    res = TP.sparse_pooled_fit(FE.sparse_training_frame(price, ship, hot="auto"),
                               params=C.STUMP_PARAMS)
    m = res.model
    one = (lambda xs, i: float(xs[i]) if len(xs) else None)
    row = (res.n_rows, res.n_train, m.baseline, int(m.feature[0]) if len(m.feature) else None,
           one(m.threshold, 0), one(m.value, 1), one(m.value, 2), res.holdout_mae)
    out = spark.createDataFrame([row], "n_rows bigint, n_train bigint, baseline double, feature int, "
                                "threshold double, left_value double, right_value double, "
                                "holdout_mae double")
    return out.select("n_rows", "n_train", "feature", *(_r(c) for c in (
        "baseline", "threshold", "left_value", "right_value", "holdout_mae")))


def sparse_stump_score(spark, sf_dir):
    """The pooled one-split model scoring every item's latest pair."""
    price, ship = _stored(spark, sf_dir)
    hot = FE.hot_suppliers(price)
    res = TP.sparse_pooled_fit(FE.sparse_training_frame(price, ship, hot=hot),
                               params=C.STUMP_PARAMS, holdout=False)
    feats = FE.sparse_serving_features(price, ship, hot=hot)
    return score_pooled(feats, res.model, list(C.SPARSE_FEATURES), "forecast_next_purchase_price"
                        ).select("nsn", "last_observed_price", _r("forecast_next_purchase_price"))


def last_observation(spark, sf_dir):
    return FE.last_observation(_tables(spark, sf_dir)[0])


def last_lag_vector(spark, sf_dir):
    v = FE.last_lag_vector(_tables(spark, sf_dir)[0])
    return v.select("nsn", *[F.try_element_at("lags", F.lit(k)).alias(f"lag_{k}")
                             for k in range(1, C.N_LAGS + 1)],
                    F.size("lags").alias("n_lags"), "complete", "last_date", "last_demand",
                    "last_market")


def min_history_status(spark, sf_dir):
    return FE.min_history_status(_tables(spark, sf_dir)[0])


# -------------------------------------------------------------- requests
def _requests(spark, sf_dir):
    return SV.requests_from_orders(_orders(spark, sf_dir))


def request_defaults(spark, sf_dir):
    ensure_workers_can_import(spark)
    return SV.request_defaults(_requests(spark, sf_dir))


def request_routing(spark, sf_dir):
    price, _ = _tables(spark, sf_dir)
    return SV.route_requests(_requests(spark, sf_dir), price)


def requests_per_action(spark, sf_dir):
    ensure_workers_can_import(spark)
    return SV.requests_per_action(_requests(spark, sf_dir))


def dense_request_forecast(spark, sf_dir):
    price, _, models, _ = _trained(spark, sf_dir, pooled=False)
    routed = SV.route_requests(_requests(spark, sf_dir), price, models)
    d = SV.dense_responses(routed, price, models)
    return (d.select("request_id", "nsn", F.explode("forecast").alias("s"))
            .select("request_id", "nsn", F.col("s.step").alias("step"),
                    F.round("s.forecast_price", R).alias("forecast_price"),
                    F.col("s.reference_month").alias("reference_month")))


def shared_model_request_forecast(spark, sf_dir):
    """Dense requests answered by one shared model (a stump of the busiest item), as the
    modelled service does: any item with six rows gets a forecast."""
    price, _ = _tables(spark, sf_dir)
    model = TP.single_model(price, TP.busiest_item(price), C.STUMP_PARAMS)
    routed = SV.route_requests(_requests(spark, sf_dir), price, model)
    d = SV.dense_responses(routed, price, model)
    return (d.select("request_id", "nsn", F.explode("forecast").alias("s"))
            .select("request_id", "nsn", F.col("s.step").alias("step"),
                    F.round("s.forecast_price", R).alias("forecast_price"),
                    F.col("s.reference_month").alias("reference_month")))


def response_unwrap(spark, sf_dir):
    price, _ = _tables(spark, sf_dir)
    routed = SV.route_requests(_requests(spark, sf_dir), price)
    return RS.unwrap_table(RS.envelope_responses(routed))


def health(spark, sf_dir):
    price, _ = _tables(spark, sf_dir)
    models = TR.model_table(_fits(price))
    return SV.health(spark, models)


def responses(spark, sf_dir):
    """Full response table (dense, sparse, health, errors) for the request batch (rows only)."""
    price, ship, models, pooled = _trained(spark, sf_dir)
    return SV.respond(_requests(spark, sf_dir), price, ship, models, pooled, hot_suppliers="auto")


# -------------------------------------------------------------- runs
def run_summary(spark, sf_dir):
    price, ship = _stored(spark, sf_dir)
    out = scratch_path(spark, f"models-{uuid.uuid4().hex}")
    s = TP.run_training(spark, price, ship, out, log_runs=False)
    return TP.summary_df(spark, s)


def run_compare(spark, sf_dir):
    price, ship = _stored(spark, sf_dir)
    out = scratch_path(spark, f"runs-{uuid.uuid4().hex}")
    for label in C.EXPERIMENT_LABELS:
        TP.run_training(spark, price, ship, os.path.join(out, label), experiment_name=label,
                        run_name=label, log_runs=False)
        s = spark.read.json(os.path.join(out, label, "forecasting_metadata")).first().asDict()
        TP.log_run(spark, s, out, run_name=label)
    return TP.compare_runs(spark.read.parquet(os.path.join(out, "run_history")))


def stream_scoring(spark, sf_dir):
    from ..streaming.scoring import append_stream, request_stream_from_orders
    price, ship, models, pooled = _trained(spark, sf_dir)
    base = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    q = append_stream(request_stream_from_orders(spark, sf_dir), price, ship, models, pooled,
                     os.path.join(base, "sink"), os.path.join(base, "checkpoint"))
    q.awaitTermination()
    return spark.read.parquet(os.path.join(base, "sink"))


def stream_stump_answers(spark, sf_dir):
    """The request stream answered with one-split models: every answer plain SQL can state."""
    from ..streaming.scoring import append_stream, request_stream_from_orders
    from ..sources.storage import store_table
    price, ship = _stored(spark, sf_dir)
    models = store_table(TR.model_table(_stump_fits(price)), "dense_models", "model_key")
    pooled = TP.sparse_pooled_fit(FE.sparse_training_frame(price, ship, hot="auto"),
                                  params=C.STUMP_PARAMS, holdout=False).model
    base = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    append_stream(request_stream_from_orders(spark, sf_dir), price, ship, models, pooled,
                  os.path.join(base, "sink"), os.path.join(base, "checkpoint")).awaitTermination()
    out = spark.read.parquet(os.path.join(base, "sink"))
    total = F.aggregate("forecast", F.lit(0.0), lambda acc, s: acc + s["forecast_price"])
    return out.select("request_id", "action", "nsn", F.size("forecast").alias("n_steps"),
                      F.round(total, 4).alias("forecast_total"), "last_history_month",
                      "last_observed_price", _r("forecast_next_purchase_price"),
                      "gap_days_between_last_observations", "status", "models_loaded", "error")


QUERIES = {
    "price_history_scan": price_history_scan,
    "supplier_shipping_scan": supplier_shipping_scan,
    "transactions_scan": transactions_scan,
    "table_row_counts": table_row_counts,
    "dense_lag_features": dense_lag_features,
    "dense_split": dense_split,
    "dense_points": dense_points,
    "dense_holdout_mae": dense_holdout_mae,
    "dense_forecast": dense_forecast,
    "dense_forecast_single_model": dense_forecast_single_model,
    "forecast_chart_rows": forecast_chart_rows,
    "price_pairs": price_pairs,
    "supplier_rollup_3": supplier_rollup_3,
    "sparse_training_frame": sparse_training_frame,
    "sparse_filter_dropna": sparse_filter_dropna,
    "sparse_split": sparse_split,
    "sparse_serving_features": sparse_serving_features,
    "last_observation": last_observation,
    "last_lag_vector": last_lag_vector,
    "min_history_status": min_history_status,
    "request_defaults": request_defaults,
    "request_routing": request_routing,
    "requests_per_action": requests_per_action,
    "dense_request_forecast": dense_request_forecast,
    "shared_model_request_forecast": shared_model_request_forecast,
    "dense_stump_models": dense_stump_models,
    "dense_stump_forecast": dense_stump_forecast,
    "sparse_stump_fit": sparse_stump_fit,
    "sparse_stump_score": sparse_stump_score,
    "response_unwrap": response_unwrap,
    "stream_stump_answers": stream_stump_answers,
    "health": health,
    # rows-only (no SQL equivalent: boosted trees, streaming, run logs)
    "dense_models": dense_models,
    "sparse_fit_score": sparse_fit_score,
    "responses": responses,
    "run_summary": run_summary,
    "run_compare": run_compare,
    "stream_scoring": stream_scoring,
}
