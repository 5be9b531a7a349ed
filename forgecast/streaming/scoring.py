"""Score a stream of requests (Structured Streaming).

``append_stream``: the stream is read with ``readStream`` (file source) and joined to one
static table with a row per item (history counts, lag vectors, models, pooled scores),
which is computed and stored once, bucketed by item, before the stream starts. Answers
are made row by row (``serving.answer_rows``), so the query is a plain append query: each
request is read and answered once, and the file sink's log keeps the answers of a batch
exactly once when a query is restarted in the middle.

``score_stream`` answers each micro-batch with the batch job of a request table
(``foreachBatch``) and marks the answers with the batch id, for callers who need it; a
replayed batch overwrites its own output.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.boosting import Model
from ..plans import serving as SV
from ..sources.storage import store_table


def request_stream_from_orders(spark: SparkSession, folder: str, file_name: str = "orders.parquet",
                               max_files: int = 1) -> DataFrame:
    """Streaming request table derived from order files in ``folder`` whose
    names match ``file_name`` (a glob); ``max_files`` files per micro-batch."""
    schema = spark.read.parquet(os.path.join(folder, file_name)).schema
    orders = (spark.readStream.schema(schema).option("pathGlobFilter", file_name)
              .option("maxFilesPerTrigger", max_files).parquet(folder))
    return SV.requests_from_orders(orders)


def append_stream(requests: DataFrame, price: DataFrame, shipping: DataFrame,
                 models: DataFrame | Model, sparse_model: Model, sink: str, checkpoint: str, available_now: bool = True,
                 state: SV.ServingState | None = None):
    """Answer the stream as an append query; returns the ``StreamingQuery``."""
    if state is None:
        state = SV.serving_state(price, shipping, sparse_model, hot_suppliers="auto")
    items = store_table(SV.item_table(state, models), "serving_items", "nsn")
    shared = models if isinstance(models, Model) else None
    present = SV.models_present(models)
    loaded = True if present is None else present.first()[0]  # one row, before the start
    w = (SV.answer_rows(requests, items, shared, loaded).writeStream.format("parquet")
         .outputMode("append").option("path", sink).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def score_stream(requests: DataFrame, price: DataFrame, shipping: DataFrame, models: DataFrame,
                 sparse_model: Model, sink: str, checkpoint: str, available_now: bool = True,
                 state: SV.ServingState | None = None):
    """Answer each micro-batch with the batch job, its answers marked with the batch id."""
    if state is None:
        state = SV.store_serving_state(SV.serving_state(price, shipping, sparse_model,
                                                        hot_suppliers="auto"))

    def answer(batch: DataFrame, batch_id: int) -> None:
        out = SV.respond(batch, price, shipping, models, sparse_model, state=state)
        (out.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .parquet(os.path.join(sink, f"batch_id={batch_id}")))

    w = requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
