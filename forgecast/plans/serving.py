"""Request scoring as table -> table jobs.

A request table (request_id, action, nsn, horizon_months) is resolved in one
batch: defaults are filled in, each request is routed by action, joined to
the latest per-item state and models, scored, and all answers come back as
one response table with a nullable ``error`` column (row-level errors never
fail the job).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import clean_key, iso_date, months_after, price_display
from ..operators import features as FE
from ..operators.boosting import Model
from ..operators.forecast import (
    forecast_arrays,
    recursive_forecast,
    score_pooled,
    shared_model_forecast,
)
from ..operators.joins import hot_keys, lookup_join, salted_join


def requests_from_orders(orders: DataFrame) -> DataFrame:
    """A request stream derived from the order table (one request per order).

    * action by order priority: urgent -> sparse forecast, high -> dense
      forecast, medium -> left out (defaults to dense), not specified ->
      health, low -> an action the service does not know;
    * item = the ordering customer's key read as an item key (some exist as
      items, some do not); left out for pending orders (defaults apply);
    * horizon = month of the order date for open orders, left out for
      finished ones (defaults to 6), 0 for pending ones (empty forecast).
    """
    pr = F.col("o_orderpriority")
    action = (F.when(pr == "1-URGENT", F.lit("forecast_sparse"))
              .when(pr == "2-HIGH", F.lit("forecast_dense"))
              .when(pr == "3-MEDIUM", F.lit(None).cast("string"))
              .when(pr == "4-NOT SPECIFIED", F.lit("health"))
              .otherwise(F.lit("reorder")))
    st = F.col("o_orderstatus")
    nsn = F.when(st == "P", F.lit(None).cast("string")).otherwise(F.col("o_custkey").cast("string"))
    horizon = (F.when(st == "O", F.month("o_orderdate"))
               .when(st == "P", F.lit(0)).otherwise(F.lit(None)).cast("int"))
    return orders.select(F.col("o_orderkey").cast("string").alias("request_id"),
                         action.alias("action"), nsn.alias("nsn"), horizon.alias("horizon_months"))


def request_defaults(requests: DataFrame) -> DataFrame:
    """Missing action -> dense forecast; missing item -> the action's demo item;
    missing horizon -> 6 (cast to int)."""
    action = F.coalesce(F.col("action"), F.lit(C.DEFAULT_ACTION))
    default_nsn = F.when(action == "forecast_sparse", F.lit(C.SPARSE_DEMO_NSN)).otherwise(
        F.lit(C.DENSE_DEMO_NSN))
    return requests.select(
        "request_id", action.alias("action"),
        F.coalesce(clean_key(F.col("nsn")), default_nsn).alias("nsn"),
        F.coalesce(F.col("horizon_months").cast("int"), F.lit(C.DEFAULT_HORIZON)).alias("horizon_months"))


@dataclass
class ServingState:
    """Everything a response needs from the history, one row per item and
    independent of the requests:

    * ``stats``: nsn, n_obs, last_history_month;
    * ``lags``: the recursion state (``features.last_lag_vector``);
    * ``sparse``: nsn, last_observed_price, forecast_next_purchase_price,
      gap_days -- the pooled model's score of each item's latest pair
      (None when no pooled model is given).

    A batch job builds it lazily inside its own plan. A stream (or any caller
    answering many request batches) stores it once, bucketed by item, so a
    micro-batch is a lookup join plus the recursion of the requested items,
    never a window over the whole history.
    """
    stats: DataFrame
    lags: DataFrame
    sparse: DataFrame | None = None

    def restricted(self, keys: list[str]) -> "ServingState":
        """The rows of the listed items only (filters, pushed into the scans)."""
        keep = (lambda df: None if df is None else df.where(F.col("nsn").isin(keys)))
        return ServingState(keep(self.stats), keep(self.lags), keep(self.sparse))


def serving_state(price: DataFrame, shipping: DataFrame | None = None,
                  sparse_model: Model | None = None, hot_suppliers=None) -> ServingState:
    """``hot_suppliers``: see ``features.sparse_serving_features``."""
    stats = price.groupBy("nsn").agg(F.count(F.lit(1)).alias("n_obs"),
                                     F.max("date").alias("last_history_month"))
    sparse = None
    if shipping is not None and sparse_model is not None:
        feats = FE.sparse_serving_features(price, shipping, hot_suppliers)
        sparse = score_pooled(feats, sparse_model, list(C.SPARSE_FEATURES),
                              "forecast_next_purchase_price").select(
            "nsn", "last_observed_price", "forecast_next_purchase_price", "gap_days")
    return ServingState(stats, FE.last_lag_vector(price), sparse)


def store_serving_state(state: ServingState) -> ServingState:
    """Write the state once (bucketed by item) and read it back."""
    from ..sources.storage import store_table
    return ServingState(store_table(state.stats, "serving_stats", "nsn"),
                        store_table(state.lags, "serving_lags", "nsn"),
                        None if state.sparse is None else
                        store_table(state.sparse, "serving_sparse", "nsn"))


def _state(price_or_state) -> ServingState:
    if isinstance(price_or_state, ServingState):
        return price_or_state
    return serving_state(price_or_state)


def hot_items(requests: DataFrame, min_rows: int, max_items: int) -> list[str]:
    """Items asked for by at least ``min_rows`` requests (the ``max_items``
    busiest of them). A partial-aggregate count, so a hot item collapses
    map-side; the list is bounded by ``max_items``."""
    return hot_keys(request_defaults(requests), "nsn", min_rows, max_items)


def _bcast(df: DataFrame, on: bool) -> DataFrame:
    return F.broadcast(df) if on else df


def route_requests(requests: DataFrame, price: DataFrame | ServingState,
                   models: DataFrame | Model | None = None, broadcast_items: bool = False
                   ) -> DataFrame:
    """Resolve defaults and decide each request's route and error message.

    ``price`` is the price history or a ``ServingState``. ``models`` is optional: a
    dense model table (a dense request for an item without a model is an error) or one
    shared model (any item with a full lag vector is answered); without it the history
    must be long enough to train on.
    ``broadcast_items`` (only for a state restricted to a bounded list of
    items) answers the requests in place, without a shuffle on the item key.
    """
    req = request_defaults(requests)
    items = _state(price).stats.select("nsn", "n_obs")
    if isinstance(models, Model):
        dense_ok = F.col("n_obs") >= C.N_LAGS
    elif models is not None:
        # item-side lookups are joined first (unique keys on both sides), so
        # the request table takes a single join
        has_model = models.select(F.col("model_key").alias("nsn"), F.lit(True).alias("has_model"))
        items = items.join(has_model, "nsn", "left")
        dense_ok = F.col("has_model").isNotNull()
    else:
        dense_ok = (F.col("n_obs") - C.N_LAGS) >= C.DENSE_MIN_ROWS
    j = (req.join(F.broadcast(items), "nsn", "left") if broadcast_items
         else salted_join(req, items, "nsn", "left"))
    a = F.col("action")
    err = (F.when(a == "forecast_dense",
                  F.when(F.col("n_obs").isNull(),
                         F.format_string(C.ERR_NO_SERIES.replace("{nsn}", "%s"), F.col("nsn")))
                  .when(~dense_ok, F.format_string("insufficient history for NSN %s", F.col("nsn"))))
           .when(a == "forecast_sparse",
                 F.when(F.coalesce(F.col("n_obs"), F.lit(0)) < 2, F.lit(C.ERR_NEED_SPARSE)))
           .when(a == "health", F.lit(None).cast("string"))
           .otherwise(F.format_string(C.ERR_UNKNOWN_ACTION.replace("{action}", "%s"), a)))
    route = F.when(err.isNotNull(), F.lit("error")).otherwise(a)
    return j.select("request_id", "action", "nsn", "horizon_months",
                    route.alias("route"), err.alias("error"))


def item_table(state: ServingState, models: DataFrame | Model) -> DataFrame:
    """All that an answer needs of an item, as one row per item (for streams)."""
    items = state.stats.join(state.lags.drop("n_obs", "last_history_month"), "nsn", "left")
    if state.sparse is not None:
        items = items.join(state.sparse, "nsn", "left")
    if isinstance(models, DataFrame):
        items = items.join(models.withColumnRenamed("model_key", "nsn"), "nsn", "left")
    return items


def answer_rows(requests: DataFrame, items: DataFrame, shared: Model | None = None,
                models_loaded: bool = True) -> DataFrame:
    """The answers of ``respond``, row by row: one join with ``item_table`` and one narrow
    pass, no grouping, so a stream of requests can be answered in append mode.

    All requests without an item ask for a default one, so these two keys are joined to a
    broadcast of their rows, where the requests are, and not gathered in one task."""
    defaults = [C.DENSE_DEMO_NSN, C.SPARSE_DEMO_NSN]
    j = lookup_join(request_defaults(requests), items, "nsn", "left", defaults)
    a, n = F.col("action"), F.col("n_obs")
    has_model = (n >= C.N_LAGS) if shared is not None else F.col("baseline").isNotNull()
    error = (F.when(a == "forecast_dense",
                    F.when(n.isNull(), F.format_string(C.ERR_NO_SERIES.replace("{nsn}", "%s"),
                                                       F.col("nsn")))
                    .when(~has_model, F.format_string("insufficient history for NSN %s",
                                                      F.col("nsn"))))
             .when(a == "forecast_sparse",
                   F.when(F.coalesce(n, F.lit(0)) < 2, F.lit(C.ERR_NEED_SPARSE)))
             .when(a != "health", F.format_string(C.ERR_UNKNOWN_ACTION.replace("{action}", "%s"), a)))
    fine = error.isNull()
    j = (j.withColumn("error", error).withColumn("dense", fine & (a == "forecast_dense"))
         .withColumn("rare", fine & (a == "forecast_sparse"))
         .withColumn("horizon", F.when(F.col("dense"), F.col("horizon_months"))))
    out = forecast_arrays(j, shared)
    dense, rare = F.col("dense"), F.col("rare")
    health_ = F.col("error").isNull() & (a == "health")
    month = (lambda s: iso_date(months_after(F.col("last_date"), s["step"])))
    steps = F.transform("steps", lambda s: F.struct(
        s["step"].alias("step"), s["forecast_price"].alias("forecast_price"),
        month(s).alias("reference_month")))
    fnp = F.when(rare, F.col("forecast_next_purchase_price"))
    return out.select(
        "request_id", "action", "nsn", F.when(dense | rare, F.lit(C.MODEL_NAME)).alias("model"),
        F.when(dense, steps).alias("forecast"),
        F.when(dense, iso_date(F.col("last_history_month"))).alias("last_history_month"),
        F.when(rare, F.col("last_observed_price")).alias("last_observed_price"),
        fnp.alias("forecast_next_purchase_price"),
        F.when(fnp.isNotNull(), price_display(fnp)).alias("forecast_display"),
        F.when(rare, F.col("gap_days").cast("int")).alias("gap_days_between_last_observations"),
        F.when(health_, F.lit("ok")).alias("status"),
        F.when(health_, F.lit(models_loaded)).alias("models_loaded"), "error",
        F.current_timestamp().alias("prediction_timestamp"))


def requests_per_action(requests: DataFrame) -> DataFrame:
    return (request_defaults(requests).groupBy("action")
            .agg(F.count(F.lit(1)).alias("n_requests")))


def dense_responses(routed: DataFrame, price: DataFrame | ServingState,
                    models: DataFrame | Model, broadcast_items: bool = False) -> DataFrame:
    """nsn, model, forecast (steps in order), last_history_month per dense request.

    ``models``: the dense model table, or one shared model that answers every item.

    The recursion runs once per requested *item*, up to the largest horizon
    asked for it (a pre-aggregation that collapses hot items map-side). An item's
    steps are one row (at most its horizon long), joined to its requests, and each
    request takes the first ``horizon`` of them, which are identical to a forecast
    run with that horizon. Requests aren't grouped: a repeated request id is
    answered row by row.
    """
    dense = routed.where(F.col("route") == "forecast_dense").select(
        "request_id", "nsn", F.col("horizon_months").alias("horizon"))
    need = dense.groupBy("nsn").agg(F.max("horizon").alias("horizon"))
    st = _state(price)
    wanted = st.lags.join(need, "nsn", "inner")
    fc = (shared_model_forecast(wanted, models) if isinstance(models, Model)
          else recursive_forecast(wanted, models))
    steps = fc.groupBy("nsn").agg(F.sort_array(F.collect_list(
        F.struct("step", "forecast_price", "reference_month"))).alias("steps"))
    items = (need.select("nsn").join(st.stats.select("nsn", "last_history_month"), "nsn", "left")
             .join(steps, "nsn", "left"))
    answers = (dense.join(F.broadcast(items), "nsn", "left") if broadcast_items
               else salted_join(dense, items, "nsn", "left"))
    # an item without a forecast has no steps
    own = F.expr("filter(coalesce(steps, array()), s -> s.step <= horizon)")
    return answers.select("request_id", "nsn", F.lit(C.MODEL_NAME).alias("model"),
                          own.alias("forecast"),
                          iso_date(F.col("last_history_month")).alias("last_history_month"))


def sparse_responses(routed: DataFrame, price: DataFrame | ServingState,
                     shipping: DataFrame | None = None, model: Model | None = None,
                     broadcast_items: bool = False) -> DataFrame:
    """nsn, model, last observed price, next purchase price, last gap per sparse request."""
    sparse = routed.where(F.col("route") == "forecast_sparse").select("request_id", "nsn")
    scored = (price.sparse if isinstance(price, ServingState) and price.sparse is not None
              else serving_state(price, shipping, model).sparse)
    return sparse.join(_bcast(scored, broadcast_items), "nsn", "inner").select(
        "request_id", "nsn", F.lit(C.MODEL_NAME).alias("model"),
        F.col("last_observed_price"), "forecast_next_purchase_price",
        F.col("gap_days").cast("int").alias("gap_days_between_last_observations"))


def models_present(models: DataFrame | Model | None) -> DataFrame | None:
    """One row: whether the model table has a row. A plan; nothing runs until it is read."""
    if not isinstance(models, DataFrame):
        return None
    return models.limit(1).agg((F.count(F.lit(1)) > 0).alias("models_loaded"))


def health(spark, models: DataFrame | None) -> DataFrame:
    """One row: status and whether a non-empty model table is present, as a lazy plan."""
    present = models_present(models)
    if present is None:
        present = spark.range(1).select(F.lit(models is not None).alias("models_loaded"))
    return present.select(F.lit("ok").alias("status"), "models_loaded")


def respond(requests: DataFrame, price: DataFrame, shipping: DataFrame, models: DataFrame | Model,
            sparse_model: Model, models_loaded: bool | None = None,
            state: ServingState | None = None,
            hot_rows: int | None = C.HOT_KEY_ROWS, max_hot_items: int = C.MAX_HOT_KEYS,
            hot_suppliers=None) -> DataFrame:
    """One response row per request (dense, sparse, health or error).

    ``state`` (e.g. a stored ``ServingState``) replaces the per-item work on
    the history; without it the state is built inside this plan
    (``hot_suppliers`` as in ``features.sparse_serving_features``). Health answers look
    into the model table unless ``models_loaded`` says it.

    Hot items: the item-side tables may be bucketed scans, which AQE cannot
    split, so a hot item is isolated explicitly. Items with at least
    ``hot_rows`` requests (at most ``max_hot_items`` of them) are answered
    against a broadcast of just their state -- bounded by that list -- where
    their requests already are, with no shuffle on the item key. All other
    requests take the shuffle joins.
    """
    st = (state if state is not None
          else serving_state(price, shipping, sparse_model, hot_suppliers))
    if st.sparse is None and shipping is not None and sparse_model is not None:
        st = replace(st, sparse=serving_state(price, shipping, sparse_model, hot_suppliers).sparse)
    req = request_defaults(requests)
    hot = hot_items(req, hot_rows, max_hot_items) if hot_rows else []
    if not hot:
        return _respond(req, st, models, models_loaded)
    is_hot = F.col("nsn").isin(hot)
    cold = _respond(req.where(~is_hot), st, models, models_loaded)
    own = models if isinstance(models, Model) else models.where(F.col("model_key").isin(hot))
    warm = _respond(req.where(is_hot), st.restricted(hot), own, models_loaded, broadcast_items=True)
    return cold.unionByName(warm)


def _respond(requests: DataFrame, st: ServingState, models: DataFrame | Model,
             models_loaded: bool | None,
             broadcast_items: bool = False) -> DataFrame:
    """Routes are disjoint and every routed request appears in its part, so the
    parts are stacked with ``unionByName`` -- no join on the request id."""
    routed = route_requests(requests, st, models, broadcast_items)
    d = dense_responses(routed, st, models, broadcast_items).withColumn(
        "action", F.lit("forecast_dense"))
    s = sparse_responses(routed, st, broadcast_items=broadcast_items).withColumn(
        "action", F.lit("forecast_sparse"))
    is_health = F.col("route") == "health"
    present = models_present(models) if models_loaded is None else None
    loaded = (F.lit(models_loaded is None or bool(models_loaded)) if present is None
              else present.scalar())
    other = routed.where(~F.col("route").isin("forecast_dense", "forecast_sparse")).select(
        "request_id", "action", "nsn", "error",
        F.when(is_health, F.lit("ok")).alias("status"),
        F.when(is_health, loaded).alias("models_loaded"))
    out = d.unionByName(s, allowMissingColumns=True).unionByName(other, allowMissingColumns=True)
    fnp = F.col("forecast_next_purchase_price")
    return out.select(
        "request_id", "action", "nsn", "model", "forecast", "last_history_month",
        "last_observed_price", fnp.alias("forecast_next_purchase_price"),
        F.when(fnp.isNotNull(), price_display(fnp)).alias("forecast_display"),
        "gap_days_between_last_observations", "status", "models_loaded", "error",
        F.current_timestamp().alias("prediction_timestamp"))
