"""Scoring: recursive multi-step dense forecasts and one-step sparse scores.

Both run as Arrow-batched Python over whole batches of items: the trees of
every item in a batch are packed into one set of node arrays and traversed
together, so a step of the recursion is a handful of numpy operations per
batch, never a loop of Spark jobs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions.columns import iso_date, months_after
from .boosting import Model, predict

_MODEL_COLS = ("baseline", "n_trees", "tree", "feature", "threshold", "missing_left", "left",
               "right", "value")


class PackedForest:
    """Models concatenated into one set of node arrays; rows point to their model."""

    def __init__(self, models: list[Model]):
        self.n = len(models)
        self.baseline = np.array([m.baseline for m in models], dtype=np.float64)
        off = np.cumsum([0, *(len(m.tree) for m in models)])[:-1]
        cat = (lambda xs, dt: np.concatenate(xs).astype(dt) if len(xs) else np.zeros(0, dt))
        self.feature = cat([m.feature for m in models], np.int64)
        self.threshold = cat([m.threshold for m in models], np.float64)
        self.missing_left = cat([m.missing_left for m in models], bool)
        self.left = cat([np.where(m.left >= 0, m.left + o, -1)
                         for m, o in zip(models, off, strict=True)], np.int64)
        self.right = cat([np.where(m.right >= 0, m.right + o, -1)
                          for m, o in zip(models, off, strict=True)], np.int64)
        self.value = cat([m.value for m in models], np.float64)
        roots = [m.roots() + o for m, o in zip(models, off, strict=True)]
        self.root = cat(roots, np.int64)
        self.trees = np.array([len(r) for r in roots], dtype=np.int64)
        self.first = np.cumsum([0, *self.trees])[:-1].astype(np.int64)

    def predict(self, X: np.ndarray, active: np.ndarray | None = None,
                which: np.ndarray | None = None) -> np.ndarray:
        """Row i of ``X`` is scored by model ``which[i]`` (model i without ``which``).

        Tree t of all rows is added at once, t = 0, 1, ...: the order (and rounding) of
        scoring one model tree by tree, with memory for the rows and the forest only.
        """
        which = np.arange(len(X)) if which is None else which
        out = self.baseline[which]
        trees = self.trees[which]
        if active is not None:
            trees = np.where(active, trees, 0)
        for t in range(int(trees.max()) if len(trees) else 0):
            rows = np.flatnonzero(trees > t)
            node = self.root[self.first[which[rows]] + t]
            while True:
                inner = np.flatnonzero(self.feature[node] >= 0)
                if not len(inner):
                    break
                at = node[inner]
                x = X[rows[inner], self.feature[at]]
                go_left = np.where(np.isnan(x), self.missing_left[at], x <= self.threshold[at])
                node[inner] = np.where(go_left, self.left[at], self.right[at])
            out[rows] += self.value[node]
        return out


def model_from_pandas_row(r) -> Model:
    return Model.from_row({c: r[c] for c in _MODEL_COLS})


# ------------------------------------------------------------------- dense
FORECAST_SCHEMA = ("nsn string, step int, forecast_price double, last_date date")


def _month_after(last_month: np.ndarray, h: int) -> np.ndarray:
    return ((last_month.astype(np.int64) - 1 + h) % 12 + 1).astype(np.float64)


def _forecast_batches(it: Iterator[pd.DataFrame], n_lags: int, shared: PackedForest | None = None
                      ) -> Iterator[pd.DataFrame]:
    """Steps of every row, with the row's own model or the one of ``shared``."""
    for pdf in it:
        if pdf.empty:
            continue
        n = len(pdf)
        if shared is not None:
            forest, with_trees = shared, np.arange(n)
            which, baseline = np.zeros(n, dtype=np.int64), np.full(n, shared.baseline[0])
        else:
            # Models without tree nodes (constant means: most short series) predict
            # their baseline at every step; only models with trees are unpacked.
            n_nodes = np.fromiter((0 if t is None else len(t) for t in pdf["tree"]), np.int64, n)
            with_trees = np.flatnonzero(n_nodes > 0)
            baseline, which = pdf["baseline"].to_numpy(np.float64), None
            forest = (PackedForest([model_from_pandas_row(r) for r in
                                    pdf.iloc[with_trees].to_dict("records")])
                      if len(with_trees) else None)
        window = np.array([np.asarray(v, dtype=np.float64) for v in pdf["lags"]], dtype=np.float64
                          ).reshape(n, n_lags)
        demand = pdf["last_demand"].to_numpy(np.float64)
        market = pdf["last_market"].to_numpy(np.float64)
        last_date = pd.to_datetime(pdf["last_date"])
        last_month = last_date.dt.month.to_numpy()
        horizon = pdf["horizon"].fillna(0).to_numpy(np.int64)
        h_max = int(horizon.max()) if n else 0
        last_dates, items = pdf["last_date"].to_numpy(), pdf["nsn"].to_numpy()
        for h in range(1, h_max + 1):
            active = horizon >= h
            X = np.column_stack([window, demand, market, _month_after(last_month, h)])
            pred = baseline.copy()
            if forest is not None:
                pred[with_trees] = forest.predict(X[with_trees], active[with_trees], which)
            idx = np.flatnonzero(active)
            yield pd.DataFrame({"nsn": items[idx], "step": np.full(len(idx), h, dtype=np.int32),
                                "forecast_price": pred[idx], "last_date": last_dates[idx]})
            window = np.column_stack([window[:, 1:], pred])


def recursive_forecast(state: DataFrame, models: DataFrame, horizon=C.DEFAULT_HORIZON,
                       n_lags: int = C.N_LAGS, model_on: str = "nsn") -> DataFrame:
    """Multi-step forecast for every state row that has a model and a full lag vector.

    ``state``: (nsn, lags, complete, last_date, last_demand, last_market[, horizon])
    where ``nsn`` keys the output rows and ``model_on`` names the column that
    selects the model (``model_key`` of ``models``). Step h predicts from the
    last ``n_lags`` values (observed, then predicted), the carried-forward
    demand and market index, and the calendar month of ``last_date + h months``.
    """
    if "horizon" not in state.columns:
        state = state.withColumn("horizon", F.lit(int(horizon)))
    m = models.withColumnRenamed("model_key", "_mk")
    j = (state.where(F.col("complete"))
         .join(m, F.col(model_on) == F.col("_mk"), "inner")
         .select("nsn", "lags", "last_date", "last_demand", "last_market", "horizon",
                 *_MODEL_COLS))
    fc = j.mapInPandas(lambda it: _forecast_batches(it, n_lags), FORECAST_SCHEMA)
    # step h is dated h months after the fixed last date (day clamped to month end)
    return fc.select("nsn", "step", "forecast_price",
                     iso_date(months_after(F.col("last_date"), F.col("step"))).alias("reference_month"))


def shared_model_forecast(state: DataFrame, model: Model | dict | None,
                          horizon: int = C.DEFAULT_HORIZON, n_lags: int = C.N_LAGS) -> DataFrame:
    """``recursive_forecast`` with one model (or its row of the model table) for every item.

    The model is bounded (trees x nodes); its forest is built once per task and all rows
    of all batches point to it. Without a model there are no rows.
    """
    if "horizon" not in state.columns:
        state = state.withColumn("horizon", F.lit(int(horizon)))
    j = (state.where(F.col("complete") & F.lit(model is not None))
         .select("nsn", "lags", "last_date", "last_demand", "last_market", "horizon"))
    model = Model.from_row(model) if isinstance(model, dict) else model

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _forecast_batches(it, n_lags, PackedForest([model]))

    fc = j.mapInPandas(run, FORECAST_SCHEMA)
    return fc.select("nsn", "step", "forecast_price",
                     iso_date(months_after(F.col("last_date"), F.col("step"))).alias("reference_month"))


STEP_TYPE = "array<struct<step:int,forecast_price:double>>"


def forecast_arrays(rows: DataFrame, shared: Model | None = None, n_lags: int = C.N_LAGS
                    ) -> DataFrame:
    """``rows`` with ``steps``: the recursive forecast of every row as one array.

    A row-by-row form (no join, no grouping) for streams: ``rows`` has the recursion state
    (lags, complete, last_date, last_demand, last_market, horizon) and, without a ``shared``
    model, its own model's columns. Rows without state, model or horizon get an empty array.
    """
    import pyarrow as pa
    kind = pa.list_(pa.struct([("step", pa.int32()), ("forecast_price", pa.float64())]))
    need = ["lags", "complete", "last_date", "last_demand", "last_market", "horizon",
            *(() if shared is not None else _MODEL_COLS)]
    schema = T.StructType.fromDDL(", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", steps {STEP_TYPE}")

    def run(batches):
        forest = None if shared is None else PackedForest([shared])
        for b in batches:
            out: list[list[dict]] = [[] for _ in range(b.num_rows)]
            pdf = b.select(need).to_pandas()
            live = pdf["complete"].eq(True) & pdf["horizon"].gt(0)
            if forest is None:
                live &= pdf["baseline"].notna()
            pdf = pdf[live].assign(nsn=np.flatnonzero(live))
            for steps in _forecast_batches(iter([pdf]), n_lags, forest):
                for i, h, x in zip(steps["nsn"], steps["step"], steps["forecast_price"], strict=True):
                    out[i].append({"step": int(h), "forecast_price": float(x)})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)],
                                             names=[*b.schema.names, "steps"])

    return rows.mapInArrow(run, schema)


# ------------------------------------------------------------------ sparse
def score_pooled(df: DataFrame, model: Model, features: list[str], out: str = "prediction"
                 ) -> DataFrame:
    """Score every row with one pooled model (bounded size: trees x nodes), shipped
    with the task closure; rows stream through Arrow batches."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(it):
        for pdf in it:
            X = pdf[features].to_numpy(dtype=np.float64, na_value=np.nan)
            pdf[out] = predict(model, X)
            yield pdf

    return df.mapInPandas(run, schema)
