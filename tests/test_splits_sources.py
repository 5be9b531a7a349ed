"""Global positional split, readers / fallback, health counts, ingest."""

import os

from conftest import make_price
from fixtures import PRICE_CSV, SHIP_CSV
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from forgecast import config as C
from forgecast.operators import splits as SPL
from forgecast.sources import health, ingest, readers


@settings(max_examples=5, deadline=None)
@given(n=st.integers(1, 60), parts=st.integers(1, 7), seed=st.integers(0, 1000))
def test_global_positions_match_a_global_row_number(spark, n, parts, seed):
    df = spark.range(n).select(F.col("id"), (F.col("id") * 7919 % 13).alias("k"))
    shuffled = df.orderBy(F.rand(seed)).repartition(parts)
    order = [F.col("k").asc(), F.col("id").asc()]
    got = {r.id: r.gpos for r in SPL.global_positions(shuffled, order, n_partitions=parts).collect()}
    want = {r.id: r.rn - 1 for r in
            df.select("id", F.row_number().over(Window.orderBy("k", "id")).alias("rn")).collect()}
    assert got == want


def test_pooled_split_keeps_at_least_one_training_row(spark):
    df = spark.range(3).withColumnRenamed("id", "x")
    s = SPL.pooled_split(df, [F.col("x")]).collect()
    assert sum(r.is_train for r in s) == 2 and all(r.n_train == 2 for r in s)
    one = SPL.pooled_split(spark.range(1), [F.col("id")]).first()
    assert one.is_train and one.n_train == 1


def _write_csvs(folder):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"{C.TABLE_PRICE}.csv"), "w") as f:
        f.write(PRICE_CSV)
    with open(os.path.join(folder, f"{C.TABLE_SHIP}.csv"), "w") as f:
        f.write(SHIP_CSV)


def test_csv_readers_and_table_fallback(spark, tmp_path):
    folder = str(tmp_path / "raw")
    _write_csvs(folder)
    assert readers.source_mode(" CSV ") == "csv" and readers.source_mode("hive") == "auto"
    p = readers.load_price_history(spark, folder, source="auto", database="no_such_db")
    assert p.count() == 51 and dict(p.dtypes)["date"] == "date"
    s = readers.load_supplier_shipping(spark, folder, source="csv")
    assert dict(s.dtypes)["report_month"] == "date" and s.count() == 12
    first = readers.sorted_price_history(p).first()
    assert first.nsn == "1680-01-444-5555"


def test_table_row_counts_and_ingest(spark, tmp_path, price, ship):
    counts = {r.table_name: r.row_count for r in
              health.row_counts({C.TABLE_PRICE: price, C.TABLE_SHIP: ship}).collect()}
    assert counts == {C.TABLE_PRICE: 51, C.TABLE_SHIP: 12}
    folder = str(tmp_path / "raw")
    _write_csvs(folder)
    out = str(tmp_path / "tables")
    st1 = ingest.stage_raw_tables(spark, folder, out)
    assert st1 == {C.TABLE_SHIP: "written", C.TABLE_PRICE: "written", C.TABLE_TX: "missing source"}
    st2 = ingest.stage_raw_tables(spark, folder, out)
    assert st2[C.TABLE_PRICE] == "exists"
    assert spark.read.parquet(os.path.join(out, C.TABLE_PRICE)).count() == 51


def test_price_rows_with_null_item_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "raw2")
    os.makedirs(folder)
    with open(os.path.join(folder, f"{C.TABLE_PRICE}.csv"), "w") as f:
        f.write(PRICE_CSV.splitlines()[0] + "\n,x,2020-01-01,1.0,1,1.0,S,C,sparse_multi_year,z\n")
    assert readers.load_price_history(spark, folder, source="csv").count() == 0
    assert make_price(spark, [("A", None, 1.0, 1, 1.0, "S", "d")]).count() == 1
