"""Explicit schemas of the procurement tables and of derived tables."""

from pyspark.sql import types as T

PRICE_HISTORY = T.StructType([
    T.StructField("nsn", T.StringType()),
    T.StructField("item_description", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("unit_price", T.DoubleType()),
    T.StructField("demand_quantity", T.LongType()),
    T.StructField("market_index", T.DoubleType()),
    T.StructField("supplier_id", T.StringType()),
    T.StructField("contract_id", T.StringType()),
    T.StructField("data_density_class", T.StringType()),
    T.StructField("recommended_modeling_approach", T.StringType()),
])

SUPPLIER_SHIPPING = T.StructType([
    T.StructField("supplier_id", T.StringType()),
    T.StructField("supplier_name", T.StringType()),
    T.StructField("report_month", T.DateType()),
    T.StructField("avg_lead_time_days", T.DoubleType()),
    T.StructField("on_time_delivery_rate", T.DoubleType()),
    T.StructField("defect_rate", T.DoubleType()),
    T.StructField("primary_shipping_code", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("shipments_completed", T.IntegerType()),
    T.StructField("expedite_rate", T.DoubleType()),
    T.StructField("avg_freight_cost", T.DoubleType()),
    T.StructField("risk_score", T.DoubleType()),
])

REQUESTS = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("nsn", T.StringType()),
    T.StructField("horizon_months", T.IntegerType()),
])

FORECAST_STEP = T.StructType([
    T.StructField("step", T.IntegerType()),
    T.StructField("forecast_price", T.DoubleType()),
    T.StructField("reference_month", T.StringType()),
])

# One row per model: trees flattened into parallel node arrays.
MODEL_TABLE = T.StructType([
    T.StructField("model_key", T.StringType()),
    T.StructField("baseline", T.DoubleType()),
    T.StructField("n_trees", T.IntegerType()),
    T.StructField("tree", T.ArrayType(T.IntegerType())),
    T.StructField("feature", T.ArrayType(T.IntegerType())),
    T.StructField("threshold", T.ArrayType(T.DoubleType())),
    T.StructField("missing_left", T.ArrayType(T.BooleanType())),
    T.StructField("left", T.ArrayType(T.IntegerType())),
    T.StructField("right", T.ArrayType(T.IntegerType())),
    T.StructField("value", T.ArrayType(T.DoubleType())),
])
