"""Training run: load -> features -> fit both model kinds -> persist -> log.

Every step is a DataFrame job over all items. Sinks (all under ``models_dir``,
a shared folder on a cluster):

* ``dense_gbm``   - model table, one row per item (trees as node arrays),
                    with split sizes and hold-out MAE;
* ``sparse_gbm``  - the pooled model (one row);
* ``sparse_training_frame`` - the pair frame of all density classes;
* ``forecasting_metadata``  - one-row JSON run summary;
* ``run_history`` - appended (run, key, value) rows (the experiment log).

The pair frame is written first and read back, so the pooled split and fit
start from a materialised table instead of re-running the windows.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from .. import schemas as S
from ..functions.columns import abs_error
from ..operators import features as FE
from ..operators import splits as SP
from ..operators import training as TR
from ..operators.boosting import Model
from ..operators.forecast import score_pooled, shared_model_forecast
from ..sources.storage import store_table


@dataclass
class PooledResult:
    model: Model
    n_rows: int
    n_train: int
    holdout_mae: float
    scored: DataFrame  # hold-out rows with predictions


def sparse_pooled_fit(frame: DataFrame, density: str = C.SPARSE_CLASS,
                      min_rows: int = C.SPARSE_MIN_ROWS, params: dict | None = None,
                      holdout: bool = True) -> PooledResult:
    """Filter one density class, drop incomplete rows, split 75/25 by position
    in (item, date) order, fit on the first part and (``holdout``) score the rest."""
    # stored: the order's range bounds are sampled from these rows, not by the windows again
    sub = store_table(FE.sparse_filter(frame, density), "sparse_rows")
    split = SP.pooled_split(sub, SP.sparse_order())
    n_rows = split.count()  # reads the checkpointed split
    if n_rows < min_rows:
        raise ValueError(C.ERR_FEW_SPARSE)
    n_train = max(1, n_rows * C.SPARSE_TRAIN_NUM // C.SPARSE_TRAIN_DEN)
    model = TR.fit_pooled(split.where("is_train"), list(C.SPARSE_FEATURES), "target_price",
                          params=params)
    scored = score_pooled(split.where(~F.col("is_train")), model, list(C.SPARSE_FEATURES))
    if not holdout:
        return PooledResult(model, n_rows, n_train, float("nan"), scored)
    mae = scored.agg(F.avg(abs_error(F.col("target_price"), F.col("prediction")))).first()[0]
    return PooledResult(model, n_rows, n_train, 0.0 if mae is None else float(mae), scored)


def dense_fits(price: DataFrame, params: dict | None = None,
               max_group_rows: int | None = 200_000) -> DataFrame:
    """Per-item fits; items above ``max_group_rows`` rows (checked with a
    partial-aggregate count) are fitted by the distributed trainer.
    ``None`` skips the check, for inputs whose (item, date) grain already bounds
    every item by its number of dates (e.g. the adapters' output)."""
    large = [] if max_group_rows is None else TR.oversized_items(price, max_group_rows)
    return TR.fit_dense_per_item(FE.dense_split(FE.dense_lag_features(price, large_items=large)),
                                 params, large_items=large)


def run_training(spark: SparkSession, price: DataFrame, shipping: DataFrame, models_dir: str,
                 dense_nsn: str | None = None, experiment_name: str | None = None,
                 run_name: str | None = None, log_runs: bool = True, experiment: str | None = None,
                 max_group_rows: int = 200_000) -> dict:
    """Train and persist both model kinds; return the run summary.

    ``dense_nsn`` restricts the dense model to one item (the single-item
    demo); by default every item gets its own model.
    """
    dense_price = price if dense_nsn is None else price.where(F.col("nsn") == dense_nsn)
    points = dense_price.count()
    if points == 0:
        raise ValueError(C.ERR_NO_DENSE_ROWS.format(nsn=dense_nsn))
    fits = dense_fits(dense_price, max_group_rows=max_group_rows)
    fits.write.mode("overwrite").parquet(os.path.join(models_dir, "dense_gbm"))
    fits = spark.read.parquet(os.path.join(models_dir, "dense_gbm"))
    ok = fits.where(F.col("status") == "ok")
    if dense_nsn is not None and ok.isEmpty():
        raise ValueError(C.ERR_SHORT_SERIES)
    dense_stats = ok.agg(
        F.count(F.lit(1)).alias("items"),
        (F.sum(F.col("holdout_mae") * F.col("n_holdout")) / F.sum("n_holdout")).alias("mae"),
    ).first()

    frame_path = os.path.join(models_dir, "sparse_training_frame")
    large = TR.oversized_items(price, max_group_rows)
    hot = FE.hot_suppliers(price)
    FE.sparse_training_frame(price, shipping, large, hot).write.mode("overwrite").parquet(frame_path)
    frame = spark.read.parquet(frame_path)
    pooled = sparse_pooled_fit(frame)
    spark.createDataFrame([pooled.model.to_row("pooled")], "model_key string, baseline double, "
                          "n_trees int, tree array<int>, feature array<int>, "
                          "threshold array<double>, missing_left array<boolean>, left array<int>, "
                          "right array<int>, value array<double>"
                          ).write.mode("overwrite").parquet(os.path.join(models_dir, "sparse_gbm"))

    summary = {
        "dense_nsn": dense_nsn if dense_nsn is not None else "*",
        "dense_points": int(points),
        "dense_items_trained": int(dense_stats["items"]),
        "dense_gbm_mae_holdout": None if dense_stats["mae"] is None else float(dense_stats["mae"]),
        "sparse_gbm_mae_holdout": pooled.holdout_mae,
        "sparse_rows": pooled.n_rows,
        "models_written": list(C.MODEL_FILES),
    }
    if experiment_name:
        summary["experiment_name"] = experiment_name
    summary_df(spark, summary).coalesce(1).write.mode("overwrite").json(
        os.path.join(models_dir, "forecasting_metadata"))
    if log_runs:
        try:
            log_run(spark, summary, models_dir, run_name=run_name, experiment=experiment)
        except Exception as e:  # logging never fails a training run
            summary["run_log_error"] = str(e)
    return summary


#: summary fields that aren't strings; any may be null
SUMMARY_TYPES = {"dense_points": "bigint", "dense_items_trained": "bigint",
                 "dense_gbm_mae_holdout": "double", "sparse_gbm_mae_holdout": "double",
                 "sparse_rows": "bigint", "models_written": "array<string>"}


def summary_df(spark: SparkSession, summary: dict) -> DataFrame:
    row = dict(summary)
    row["models_written"] = list(row.get("models_written", []))
    fields = sorted(row)
    schema = ", ".join(f"{c} {SUMMARY_TYPES.get(c, 'string')}" for c in fields)
    return spark.createDataFrame([tuple(row[c] for c in fields)], schema)


def run_log_rows(spark: SparkSession, summary: dict, experiment: str | None = None,
                 run_name: str | None = None, run_id: str | None = None) -> DataFrame:
    """Params and metrics of one run as (run_id, experiment, run_name, kind, key, value)."""
    exp = (experiment or "").strip() or C.DEFAULT_EXPERIMENT
    name = (run_name or "").strip() or (summary.get("experiment_name") or "").strip() or None
    rid = run_id or uuid.uuid4().hex
    rows = [("param", "dense_nsn", str(summary.get("dense_nsn", "")))]
    if summary.get("experiment_name"):
        rows.append(("param", "experiment_name_label", str(summary["experiment_name"])))
    rows.append(("param", "dense_points", str(int(summary.get("dense_points") or 0))))
    for key in ("dense_gbm_mae_holdout", "sparse_gbm_mae_holdout"):
        if summary.get(key) is not None:
            rows.append(("metric", key, repr(float(summary[key]))))
    return spark.createDataFrame(
        [(rid, exp, name, k, key, v) for k, key, v in rows],
        "run_id string, experiment string, run_name string, kind string, key string, value string")


def log_run(spark: SparkSession, summary: dict, models_dir: str, run_name: str | None = None,
            experiment: str | None = None, disabled: str | None = None) -> bool:
    """Append the run's params / metrics to ``run_history``. A disable flag of
    1/true/yes skips logging."""
    if (disabled or "").strip().lower() in C.DISABLE_FLAG_VALUES:
        return False
    run_log_rows(spark, summary, experiment, run_name).write.mode("append").parquet(
        os.path.join(models_dir, "run_history"))
    return True


def compare_runs(history: DataFrame) -> DataFrame:
    """One row per run, one column per metric (runs side by side)."""
    metrics = history.where(F.col("kind") == "metric")
    return (metrics.groupBy("run_id", "run_name")
            .pivot("key", ["dense_gbm_mae_holdout", "sparse_gbm_mae_holdout"])
            .agg(F.first(F.col("value").cast("double"))))


def load_models(spark: SparkSession, models_dir: str) -> tuple[DataFrame, Model]:
    """Read both persisted models: the per-item model table (fitted items only)
    and the pooled model (one bounded row)."""
    dense = (spark.read.parquet(os.path.join(models_dir, "dense_gbm"))
             .where(F.col("status") == "ok").select(*TR.MODEL_COLUMNS))
    row = spark.read.parquet(os.path.join(models_dir, "sparse_gbm")).first()
    if row is None:
        raise ValueError(f"no pooled model under {models_dir}")
    return dense, Model.from_row(row.asDict())


def health_from_dir(spark: SparkSession, models_dir: str) -> DataFrame:
    """Whether both stored models are there, as a plan: building it runs no job.

    A folder without a model table is a row with the error; so is an empty table, with
    ``models_loaded`` false.
    """
    schema = "status string, models_loaded boolean, error string"
    try:
        dense = (spark.read.schema(TR.DENSE_FIT_SCHEMA)
                 .parquet(os.path.join(models_dir, "dense_gbm")).where(F.col("status") == "ok"))
        sparse = spark.read.schema(S.MODEL_TABLE).parquet(os.path.join(models_dir, "sparse_gbm"))
    except Exception as e:  # a health check reports, it does not raise
        return spark.createDataFrame([(None, False, str(e))], schema)
    here = F.count(F.lit(1)) > 0
    found = (dense.limit(1).agg(here.alias("dense")).select("dense", sparse.limit(1).agg(
        here).scalar().alias("sparse")))
    return found.select(F.when(F.col("sparse"), F.lit("ok")).alias("status"),
                        (F.col("dense") & F.col("sparse")).alias("models_loaded"),
                        F.when(~F.col("sparse"), F.lit(f"no pooled model under {models_dir}"))
                        .alias("error"))


def busiest_item(price: DataFrame) -> str:
    """The item with the most observations (ties: smallest key) -- a one-row answer."""
    row = (price.groupBy("nsn").agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.col("n").desc(), F.col("nsn").asc()).first())
    if row is None:
        raise ValueError("empty price history")
    return row["nsn"]


def single_model(price: DataFrame, dense_nsn: str, params: dict | None = None) -> Model | None:
    """The dense model of one item (at most max_iter x leaves nodes); None if it has none."""
    row = TR.model_table(dense_fits(price.where(F.col("nsn") == dense_nsn), params)).first()
    return row and Model.from_row(row.asDict())


def single_model_forecast(price: DataFrame, dense_nsn: str, horizon: int = C.DEFAULT_HORIZON
                          ) -> DataFrame:
    """Single-model mode: one dense model, fitted on ``dense_nsn`` only, forecasts
    every item that has a full lag vector (items with fewer rows get none)."""
    return shared_model_forecast(FE.last_lag_vector(price), single_model(price, dense_nsn),
                                 horizon=horizon)
