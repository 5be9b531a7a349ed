"""Fixed values that must equal the modelled application's for identical results.

Fixed values (kept together, in natural order, as plain text):
"""

# Default item keys used when a request omits ``nsn``.
DENSE_DEMO_NSN = "9150-01-123-4567"
SPARSE_DEMO_NSN = "4820-00-111-2222"

# Table names.
TABLE_PRICE = "item_price_history_forecasting"
TABLE_SHIP = "supplier_shipping_performance"
TABLE_TX = "procurement_transactions"
DEFAULT_DATABASE = "logistics"

# Density classes.
DENSE_CLASS = "dense_monthly"
MODERATE_CLASS = "moderate_quarterly"
SPARSE_CLASS = "sparse_multi_year"

# Dense model.
N_LAGS = 6
DENSE_MIN_ROWS = 12
DENSE_TRAIN_NUM, DENSE_TRAIN_DEN = 4, 5  # first 80 % of usable rows
DENSE_PARAMS = dict(max_depth=5, learning_rate=0.08, max_iter=200,
                    min_samples_leaf=20, l2_regularization=0.0,
                    max_leaf_nodes=31, max_bins=255)
DENSE_FEATURES = [f"lag_{k}" for k in range(1, N_LAGS + 1)] + [
    "demand_quantity", "market_index", "month"]

# Pooled sparse model.
SPARSE_MIN_ROWS = 8
SPARSE_TRAIN_NUM, SPARSE_TRAIN_DEN = 3, 4  # max(1, first 75 %) of rows
SPARSE_PARAMS = dict(max_depth=3, learning_rate=0.06, max_iter=200,
                     min_samples_leaf=2, l2_regularization=0.5,
                     max_leaf_nodes=31, max_bins=255)
SPARSE_FEATURES = ["log_gap", "prev_price", "market_index", "demand_quantity",
                   "delta_market", "supplier_avg_lead_3m", "supplier_expedite_3m"]
SPARSE_FRAME_COLUMNS = ["nsn", "density", "gap_days", "log_gap", "prev_price",
                        "market_index", "demand_quantity", "delta_market",
                        "target_price", "supplier_avg_lead_3m", "supplier_expedite_3m"]

# Supplier rollup = mean of the latest 3 reports; serving
# fallbacks when a supplier has no reports at all.
ROLLUP_REPORTS = 3
SERVE_DEFAULT_LEAD = 15.0
SERVE_DEFAULT_EXPEDITE = 0.05

# Request handling.
DEFAULT_ACTION = "forecast_dense"
DEFAULT_HORIZON = 6
ACTIONS = ("forecast_dense", "forecast_sparse", "health")
MODEL_NAME = "hist_gradient_boosting_regressor"
ERR_NO_SERIES = "No series for NSN {nsn}"
ERR_NEED_SPARSE = "need sparse history"
ERR_UNKNOWN_ACTION = "unknown action {action}"
ERR_FEW_SPARSE = "Not enough sparse rows for GBM demo."
ERR_NO_DENSE_ROWS = "No rows for dense NSN {nsn}"
ERR_SHORT_SERIES = "Not enough history for gradient boosting."

# Run log.
DEFAULT_EXPERIMENT = "price-forecasting"
EXPERIMENT_LABELS = ("baseline", "scenario_b")
DISABLE_FLAG_VALUES = ("1", "true", "yes")
MODEL_FILES = ("dense_gbm", "sparse_gbm")

# Source-mode words.
CSV_MODES = ("csv", "file", "local")
TABLE_MODES = ("warehouse", "impala", "dw", "hive")

# Words that stand for an empty cell in the CSV files.
NULL_WORDS = ("#N/A", "N/A", "NA", "NULL", "NaN", "None", "nan", "null")

# Response unwrapping keys, in lookup order.
UNWRAP_KEYS = ("prediction", "result", "data", "output")

# Skew guard (ours): a join key (requested item, supplier) with at least this
# many rows is joined against a broadcast of its own lookup row (at most this
# many keys; the rest take the shuffle join).
HOT_KEY_ROWS = 1_000_000
MAX_HOT_KEYS = 1_000

# One tree with one split (ours): a grown model whose every number plain SQL can state.
STUMP_PARAMS = dict(max_depth=1, learning_rate=0.5, max_iter=1, min_samples_leaf=4,
                    l2_regularization=0.5, max_leaf_nodes=31, max_bins=255)

# Adapter rule (ours, not the application's): density class by observation count.
ADAPTER_DENSE_MIN_OBS = 30
ADAPTER_MODERATE_MIN_OBS = 18
URGENT_PRIORITY = "1-URGENT"
