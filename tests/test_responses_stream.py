"""Response unwrapping, chart rows, streaming scoring and the driver contract."""

import os

from pyspark.sql import functions as F

from forgecast import config as C
from forgecast.functions import responses as RS
from forgecast.operators import features as FE
from forgecast.operators import training as TR
from forgecast.plans import train as TP

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def test_unwrap_branches(spark):
    raw = spark.createDataFrame([
        ("1", '{"response": {"prediction": {"route": "a"}}}'),
        ("2", '{"response": {"route": "b", "prediction": 3}}'),
        ("3", '{"prediction": "x", "result": {"route": "c"}}'),
        ("4", '{"output": {"route": "d"}}'),
        ("5", '{"route": "e"}'),
        ("6", '"just text"'),
        ("7", 'not json'),
    ], "request_id string, raw string")
    got = {r.request_id: (r.branch, r.payload_route, r.error) for r in RS.unwrap_table(raw).collect()}
    assert got["1"] == ("response.prediction", "a", None)
    assert got["2"] == ("response", "b", None)
    assert got["3"] == ("result", "c", None)
    assert got["4"] == ("output", "d", None)
    assert got["5"] == ("body", "e", None)
    assert got["6"][0] == "error" and got["6"][2] == "unexpected response shape"
    assert got["7"][0] == "error"


def test_chart_rows(spark):
    df = spark.createDataFrame(
        [("r1", [(1, 2.5, "2024-01-31"), (2, None, None)]), ("r2", [])],
        "request_id string, forecast array<struct<step:int,forecast_price:double,reference_month:string>>")
    rows = sorted(tuple(r) for r in RS.forecast_chart_rows(df).collect())
    assert rows == [("r1", 1, "2024-01-31", 2.5), ("r1", 2, "", 0.0)]


def test_stream_scoring_answers_every_request(spark, tmp_path):
    from forgecast.plans import catalog as Q
    from forgecast.streaming.scoring import request_stream_from_orders, score_stream
    price, ship = Q._tables(spark, SF)
    models = TR.model_table(TP.dense_fits(price))
    pooled = TP.sparse_pooled_fit(FE.sparse_training_frame(price, ship))
    q = score_stream(request_stream_from_orders(spark, SF), price, ship, models, pooled.model,
                     str(tmp_path / "sink"), str(tmp_path / "ckpt"))
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "sink"))
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    assert out.count() == orders.count()
    assert out.select("request_id").distinct().count() == orders.count()
    assert out.where(F.col("error").isNull() & (F.col("action") == "forecast_dense")).count() > 0


def test_entry_contract(spark):
    import sys
    sys.path.insert(0, ROOT)
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["nsn", "step", "forecast_price", "reference_month"]
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
    for name in ("request_routing", "price_pairs", "requests_per_action"):
        assert E.queries()[name](spark, SF).count() > 0


def test_stream_answers_each_request_once_over_several_batches(spark, tmp_path):
    from forgecast.plans import catalog as Q
    from forgecast.streaming.scoring import request_stream_from_orders, score_stream
    src = str(tmp_path / "in")
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    for i, part in enumerate(orders.randomSplit([1.0, 1.0, 1.0], seed=3)):
        part.coalesce(1).write.parquet(os.path.join(src, f"batch{i}"))
    os.makedirs(os.path.join(src, "flat"))
    for i in range(3):
        f = [x for x in os.listdir(os.path.join(src, f"batch{i}")) if x.endswith(".parquet")][0]
        os.link(os.path.join(src, f"batch{i}", f), os.path.join(src, "flat", f"orders-{i}.parquet"))
    price, ship = Q._tables(spark, SF)
    models = TR.model_table(TP.dense_fits(price))
    pooled = TP.sparse_pooled_fit(FE.sparse_training_frame(price, ship), holdout=False)
    stream = request_stream_from_orders(spark, os.path.join(src, "flat"), "orders-*.parquet")
    q = score_stream(stream, price, ship, models, pooled.model, str(tmp_path / "sink"),
                     str(tmp_path / "ckpt"))
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "sink"))
    assert out.select("batch_id").distinct().count() == 3
    assert out.count() == orders.count() == out.select("request_id").distinct().count()


def test_a_restarted_stream_answers_every_request_once(spark, tmp_path):
    """Files that arrive between two runs, and the batch form: the same answers, once."""
    from forgecast.plans import catalog as Q
    from forgecast.plans import serving as SV
    from forgecast.streaming.scoring import append_stream
    price, ship = Q._tables(spark, SF)
    models = TR.model_table(TP.dense_fits(price))
    pooled = TP.sparse_pooled_fit(FE.sparse_training_frame(price, ship)).model
    requests = SV.requests_from_orders(spark.read.parquet(f"{SF}/orders.parquet"))
    first, rest = (requests.where(F.pmod(F.crc32(F.col("request_id").cast("binary")), F.lit(2)) == k)
                   for k in (0, 1))
    folder, sink, ckpt = (str(tmp_path / x) for x in ("in", "sink", "ckpt"))

    def run():
        stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(
            folder)
        append_stream(stream, price, ship, models, pooled, sink, ckpt).awaitTermination()

    first.repartition(2).write.mode("append").parquet(folder)
    run()
    assert spark.read.parquet(sink).count() == first.count()
    rest.repartition(2).write.mode("append").parquet(folder)
    run()
    run()  # nothing new
    got = spark.read.parquet(sink).drop("prediction_timestamp")
    want = SV.respond(requests, price, ship, models, pooled).drop("prediction_timestamp")
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_requests_without_an_item_are_not_gathered_in_one_task(spark, price, ship):
    from pyspark.sql import functions as F

    from forgecast.operators.boosting import Model
    from forgecast.plans import serving as SV
    model = Model(7.0, 1)
    items = SV.item_table(SV.serving_state(price, ship, model), model)
    requests = spark.range(400, numPartitions=8).select(
        F.col("id").cast("string").alias("request_id"), F.lit(None).cast("string").alias("action"),
        F.when(F.col("id") % 10 == 0, F.lit("no such item")).alias("nsn"), F.lit(2).alias("horizon_months"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = SV.answer_rows(requests, items, model).select(
            "request_id", "error", F.size("forecast").alias("n"), F.spark_partition_id().alias("part")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted(int(r.request_id) for r in rows) == list(range(400))
    assert all((r.error is not None) if int(r.request_id) % 10 == 0 else r.n == 2 for r in rows)
    fine = [r.part for r in rows if r.error is None]
    assert max(fine.count(x) for x in set(fine)) <= 50
