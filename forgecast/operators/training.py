"""Model training as Spark jobs.

* ``fit_dense_per_item``: one boosted model per item, fitted inside
  ``mapInArrow`` over items whose rows lie together; the same task scores the items'
  hold-out rows, so fit and hold-out MAE cost one pass. An item is one series,
  bounded by its number of distinct dates.
* ``fit_pooled``: one model over many items, by ``forests.fit_models``: exact cut
  points and exact gradient sums, so the trees are the same for any number of rows per
  partition. All rows are fitted; no rows are sampled or withheld at any size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from .. import schemas as S
from . import boosting as B
from .forests import fit_models
from .splits import global_positions

DENSE_FIT_SCHEMA = T.StructType(
    [T.StructField("nsn", T.StringType())] + list(S.MODEL_TABLE.fields) + [
        T.StructField("n_usable", T.LongType()),
        T.StructField("n_train", T.LongType()),
        T.StructField("n_holdout", T.LongType()),
        T.StructField("holdout_mae", T.DoubleType()),
        T.StructField("status", T.StringType()),
    ])

MODEL_COLUMNS = ["model_key", "baseline", "n_trees", "tree", "feature", "threshold",
                 "missing_left", "left", "right", "value"]


def _arrow_schema(schema: T.StructType):
    import pyarrow as pa
    conv = {T.StringType: pa.string(), T.DoubleType: pa.float64(), T.LongType: pa.int64(),
            T.IntegerType: pa.int32(), T.BooleanType: pa.bool_()}

    def one(dt):
        if isinstance(dt, T.ArrayType):
            return pa.list_(one(dt.elementType))
        return conv[type(dt)]
    return pa.schema([(f.name, one(f.dataType)) for f in schema.fields])


def fit_dense_per_item(split_features: DataFrame, params: dict | None = None,
                       min_rows: int = C.DENSE_MIN_ROWS, large_items: list[str] | None = None
                       ) -> DataFrame:
    """One row per item: its model (flattened trees), split sizes and hold-out MAE.

    Input: ``features.dense_split`` output (already hash-partitioned by item,
    so neither path below shuffles again).

    * items with fewer than ``min_rows`` usable rows: ``insufficient_history``;
    * items whose training part is below ``2 * min_samples_leaf`` rows: no
      split is legal, every tree is a zero leaf, so the model *is* the training
      mean -- computed JVM-side with a window mean and a grouped MAE;
    * all other items: the boosting kernel in ``mapInArrow``, many items at a time,
      except ``large_items`` (too big for one task; see ``oversized_items``),
      which the distributed trainer grows together.
    """
    params = dict(C.DENSE_PARAMS if params is None else params)
    feats = list(C.DENSE_FEATURES)
    can_split = F.col("n_train") >= 2 * params["min_samples_leaf"]
    enough = F.col("n_usable") >= min_rows
    no_trees = F.array().cast("array<int>")

    # --- status-only and constant-mean items (built-in expressions)
    per_item = Window.partitionBy("nsn")
    simple = (split_features.where(~(enough & can_split))
              .withColumn("_mean", F.avg(F.when(F.col("is_train"), F.col("target"))).over(per_item))
              .groupBy("nsn")
              .agg(F.first("n_usable").alias("n_usable"), F.first("n_train").alias("n_train"),
                   F.first("_mean").alias("_mean"),
                   F.avg(F.when(~F.col("is_train"), F.abs(F.col("target") - F.col("_mean"))))
                   .alias("_mae")))
    ok = (F.col("n_usable") >= min_rows) & (F.col("n_train") >= 1)
    simple = simple.select(
        "nsn", F.col("nsn").alias("model_key"),
        F.when(ok, F.col("_mean")).alias("baseline"),
        F.when(ok, F.lit(params["max_iter"])).otherwise(F.lit(0)).cast("int").alias("n_trees"),
        no_trees.alias("tree"), no_trees.alias("feature"),
        F.array().cast("array<double>").alias("threshold"),
        F.array().cast("array<boolean>").alias("missing_left"),
        no_trees.alias("left"), no_trees.alias("right"),
        F.array().cast("array<double>").alias("value"),
        "n_usable", "n_train", (F.col("n_usable") - F.col("n_train")).alias("n_holdout"),
        F.when(ok, F.col("_mae")).alias("holdout_mae"),
        F.when(ok, F.lit("ok")).otherwise(F.lit("insufficient_history")).alias("status"))

    # --- items with room for splits: the kernel, over many whole items at a time
    arrow_schema = _arrow_schema(DENSE_FIT_SCHEMA)

    def fit_items(batches):
        import pyarrow as pa
        for tbl, starts in _whole_items(batches, FIT_ROWS):
            size = np.diff(np.r_[starts, tbl.num_rows])
            order = np.lexsort((tbl.column("pos").to_numpy(), np.repeat(np.arange(len(starts)), size)))
            col = (lambda c: tbl.column(c).to_numpy(zero_copy_only=False)[order])
            X = np.column_stack([col(c).astype(np.float64) for c in feats])
            models, errors = B.fit_many(X, col("target").astype(np.float64),
                                        col("is_train").astype(bool), starts, **params)
            n_usable, n_train = (col(c)[starts].tolist() for c in ("n_usable", "n_train"))
            keys = tbl.column("nsn").take(starts).to_pylist()
            rows = [dict(nsn=k, n_usable=n, n_train=t, n_holdout=n - t, holdout_mae=e, status="ok",
                         **m.to_row(k))
                    for k, n, t, e, m in zip(keys, n_usable, n_train, errors, models, strict=True)]
            yield from pa.Table.from_pylist(rows, schema=arrow_schema).to_batches()

    cols = ["nsn", "pos", "n_usable", "n_train", "is_train", *feats, "target"]
    large = list(large_items or [])
    small = ~F.col("nsn").isin(large) if large else F.lit(True)
    # the window gathers an item's rows one after another (where they aren't yet) and counts them
    boosted = (split_features.where(enough & can_split & small)
               .select(*cols, F.count(F.lit(1)).over(per_item).alias("_rows"))
               .mapInArrow(fit_items, DENSE_FIT_SCHEMA))
    out = simple.select(*DENSE_FIT_SCHEMA.fieldNames()).unionByName(boosted)
    if large:
        big = split_features.where(enough & can_split & F.col("nsn").isin(large))
        out = out.unionByName(_fit_large_items(big, params, feats))
    return out


#: rows of whole items that are fitted at once
FIT_ROWS = 50_000


def _whole_items(batches, at_once: int):
    """(table, starts) of consecutive whole items, as many rows each as ``_rows`` says:
    about ``at_once`` rows or one larger item."""
    import pyarrow as pa
    parts, have, need = [], 0, at_once
    for b in batches:
        parts.append(b)
        have += b.num_rows
        if have < need:
            continue
        tbl = pa.Table.from_batches(parts)
        sizes, starts, at = tbl.column("_rows").to_numpy(), [], 0
        while at < have and at + sizes[at] <= have:
            starts.append(at)
            at += int(sizes[at])
        need = at_once if at == have else max(at_once, int(sizes[at]))
        if starts:
            yield tbl.slice(0, at), np.array(starts)
        parts, have = tbl.slice(at).to_batches(), have - at
    if have:
        tbl = pa.Table.from_batches(parts)
        sizes, starts, at = tbl.column("_rows").to_numpy(), [], 0
        while at < have:
            starts.append(at)
            at += int(sizes[at])
        yield tbl, np.array(starts)


def oversized_items(price: DataFrame, max_rows: int) -> list[str]:
    """Items with more than ``max_rows`` observations (a partial-aggregate count;
    the list is bounded by total rows / ``max_rows``)."""
    return [r["nsn"] for r in price.groupBy("nsn").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > max_rows).select("nsn").collect()]


def _fit_large_items(rows: DataFrame, params: dict, feats: list[str]) -> DataFrame:
    """Items too large for a single task: fitted together, a tree level of all items at a
    time (``forests.fit_models``); their hold-out rows are scored in one job."""
    counts = {r["nsn"]: r for r in rows.groupBy("nsn").agg(
        F.first("n_usable").alias("n_usable"), F.first("n_train").alias("n_train")).collect()}
    if not counts:
        return rows.sparkSession.createDataFrame([], DENSE_FIT_SCHEMA)
    models = fit_models(rows.where("is_train"), feats, "target", params, key="nsn")

    def errors(batches):
        for pdf in batches:
            for nsn, part in pdf.groupby("nsn"):
                x = part[feats].to_numpy(dtype=np.float64, na_value=np.nan)
                e = np.abs(part["target"].to_numpy(np.float64) - B.predict(models[nsn], x))
                yield pd.DataFrame({"nsn": [nsn], "e": [float(e.sum())]})

    mae = {r["nsn"]: r["e"] for r in rows.where(~F.col("is_train")).select("nsn", "target", *feats)
           .mapInPandas(errors, "nsn string, e double").groupBy("nsn").agg(F.sum("e").alias("e"))
           .collect()}
    out = []
    for nsn, model in models.items():
        n, n_train = int(counts[nsn]["n_usable"]), int(counts[nsn]["n_train"])
        out.append(dict(nsn=nsn, n_usable=n, n_train=n_train, n_holdout=n - n_train, status="ok",
                        holdout_mae=mae[nsn] / (n - n_train) if n > n_train else None,
                        **model.to_row(nsn)))
    return rows.sparkSession.createDataFrame(out, DENSE_FIT_SCHEMA)


def model_table(fits: DataFrame) -> DataFrame:
    """Model rows (``model_key`` = item) of the fitted items only."""
    return fits.where(F.col("status") == "ok").select(*MODEL_COLUMNS)


# ------------------------------------------------------------------ pooled
def fit_pooled(train: DataFrame, features: list[str], target: str,
               params: dict | None = None) -> B.Model:
    """One model over all rows of ``train``, by the same rule at every size."""
    params = dict(C.SPARSE_PARAMS if params is None else params)
    return fit_models(train, features, target, params)["pooled"]


def fit_distributed(train: DataFrame, features: list[str], target: str, params: dict,
                    seed: int = 42, order_col: str | None = None, early_stopping: bool = False,
                    validation_fraction: float = 0.1, n_iter_no_change: int = 10,
                    tol: float = 1e-7) -> B.Model:
    """One model over all rows, with a Spark job per tree level at every size.

    ``early_stopping`` (off unless asked for) holds out the first
    ``ceil(validation_fraction * n)`` rows in a seeded hash order of ``order_col``.
    """
    if not early_stopping:
        return fit_models(train, features, target, params, part_rows=1)["pooled"]
    key = F.col(order_col) if order_col else F.monotonically_increasing_id()
    rows = train.select(*features, target, key.alias("_key"))
    ranked = global_positions(rows.withColumn("_h", F.xxhash64(F.col("_key"), F.lit(seed))),
                              [F.col("_h"), F.col("_key")], name="_vpos")
    held = F.col("_vpos") < F.ceil(F.lit(validation_fraction) * F.col("n_total"))
    return fit_models(ranked.withColumn("_held", held), features, target, params,
                      validation="_held", n_iter_no_change=n_iter_no_change, tol=tol)["pooled"]
