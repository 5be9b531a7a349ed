"""Response-table helpers: forecast chart rows and gateway envelope unwrapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C


def forecast_chart_rows(responses: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, month, forecast_price) per forecast step; no rows for an empty forecast.

    ``month`` is the first 10 characters of the step's reference month and a
    missing price shows as 0.
    """
    return (responses.select(key, F.explode("forecast").alias("s"))
            .select(key, F.col("s.step").alias("step"),
                    F.substring(F.coalesce(F.col("s.reference_month"), F.lit("")), 1, 10).alias("month"),
                    F.coalesce(F.col("s.forecast_price").cast("double"), F.lit(0.0)).alias("forecast_price")))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT<"), F.lit(False))


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def unwrap_response(raw: Column) -> tuple[Column, Column, Column]:
    """Unwrap a gateway JSON body (string column).

    Returns (payload variant, branch taken, error). Order of lookup: a
    ``response`` object (its ``prediction`` object if any, else itself); then
    the first object among the keys in ``UNWRAP_KEYS``; else the body. A body
    that is not a JSON object is an error that keeps the raw text.
    """
    body = F.try_parse_json(raw)
    resp = _field(body, "response")
    pred_in_resp = _field(resp, "prediction")
    payload = F.when(_is_object(resp) & _is_object(pred_in_resp), pred_in_resp).when(
        _is_object(resp), resp)
    branch = F.when(_is_object(resp) & _is_object(pred_in_resp), F.lit("response.prediction")).when(
        _is_object(resp), F.lit("response"))
    for key in C.UNWRAP_KEYS:
        v = _field(body, key)
        payload = payload.when(_is_object(v), v)
        branch = branch.when(_is_object(v), F.lit(key))
    ok = _is_object(body)
    payload = F.when(~ok, F.lit(None)).otherwise(payload.otherwise(body))
    branch = F.when(~ok, F.lit("error")).otherwise(branch.otherwise(F.lit("body")))
    error = F.when(~ok, F.lit("unexpected response shape"))
    return payload, branch, error


def envelope_responses(routed: DataFrame) -> DataFrame:
    """Gateway bodies built from routed requests, one envelope style per route:
    dense -> response.prediction, sparse -> result, health -> bare body,
    error -> response, unknown action -> a bare JSON string (not an object)."""
    inner = F.to_json(F.struct("request_id", "nsn", "route", "error"))
    r = F.col("route")
    raw = (F.when(r == "forecast_dense", F.format_string('{"response": {"prediction": %s}}', inner))
           .when(r == "forecast_sparse", F.format_string('{"result": %s}', inner))
           .when(r == "health", inner)
           .when(F.col("action").isin(*C.ACTIONS), F.format_string('{"response": %s}', inner))
           .otherwise(F.concat(F.lit('"'), F.col("error"), F.lit('"'))))
    return routed.select("request_id", raw.alias("raw"))


def unwrap_table(raw_table: DataFrame) -> DataFrame:
    payload, branch, error = unwrap_response(F.col("raw"))
    return raw_table.select(
        "request_id", branch.alias("branch"),
        F.try_variant_get(payload, "$.request_id", "string").alias("payload_request_id"),
        F.try_variant_get(payload, "$.route", "string").alias("payload_route"),
        F.try_variant_get(payload, "$.error", "string").alias("payload_error"),
        error.alias("error"))
