"""Readers bind columns by name and accept the usual date forms."""

import datetime as dt

import pytest

from forgecast import schemas as S
from forgecast.plans import train as TP
from forgecast.sources import readers

NAMES = [f.name for f in S.SUPPLIER_SHIPPING]


def _csv(path, names, rows):
    lines = [",".join(names)] + [",".join(str(r.get(c, "")) for c in names) for r in rows]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def _read(spark, path):
    return readers.read_csv(spark, path, S.SUPPLIER_SHIPPING, ("report_month",))


def test_columns_by_name_and_dates(spark, tmp_path):
    forms = ["2025-09-01", "2025-09-01 00:00:00", "2025-09-01T10:30:00", "9/1/2025",
             "09/01/2025 7:05", "2025/9/1", "20250901", ""]
    rows = [{"supplier_id": i, "avg_lead_time_days": 15.0, "expedite_rate": 0.1, "report_month": f,
             "shipments_completed": 7, "extra": "x"} for i, f in enumerate(forms)]
    got = _read(spark, _csv(tmp_path / "a.csv", ["extra", *reversed(NAMES)], rows)).collect()
    assert [r.report_month for r in sorted(got, key=lambda r: int(r.supplier_id))] == [
        dt.date(2025, 9, 1)] * 7 + [None]
    assert {(r.avg_lead_time_days, r.expedite_rate, r.shipments_completed) for r in got} == {
        (15.0, 0.1, 7)}


def test_missing_column_and_bad_date_fail(spark, tmp_path):
    with pytest.raises(ValueError, match="expedite_rate"):
        _read(spark, _csv(tmp_path / "a.csv", [c for c in NAMES if c != "expedite_rate"], []))
    bad = _read(spark, _csv(tmp_path / "b.csv", NAMES, [{"report_month": "soon"}]))
    with pytest.raises(Exception, match="not a date"):
        bad.collect()


def test_any_table_failure_falls_back(spark, monkeypatch):
    def fail(*_):
        raise RuntimeError("metastore away")
    monkeypatch.setattr(type(spark), "table", fail)
    monkeypatch.setattr(type(spark.catalog), "tableExists", lambda *_: True)
    assert readers.read_table(spark, "t") is None


def test_summary_without_models_and_runs_of_one_label(spark):
    summary = {"dense_nsn": "*", "dense_points": 3, "dense_items_trained": 0,
               "dense_gbm_mae_holdout": None, "sparse_gbm_mae_holdout": 1.5, "sparse_rows": 9,
               "models_written": []}
    assert TP.summary_df(spark, summary).first().dense_gbm_mae_holdout is None
    runs = [TP.run_log_rows(spark, summary | {"sparse_gbm_mae_holdout": m}, run_name="same")
            for m in (1.0, 2.0)]
    got = TP.compare_runs(runs[0].union(runs[1])).collect()
    assert sorted(r.sparse_gbm_mae_holdout for r in got) == [1.0, 2.0]


def test_numbers_are_read_or_reported_never_lost(spark, tmp_path):
    from pyspark.sql import types as T

    from forgecast.sources.readers import read_csv, read_csv_rejects
    schema = T.StructType([T.StructField("name", T.StringType()),
                           T.StructField("price", T.DoubleType()),
                           T.StructField("n", T.LongType()), T.StructField("day", T.DateType())])
    head = "n,price,day,name\n"
    good = ['12.0,"1,234.50",2024-01-02,a', "7,1e3,1/2/2024,b", ",,,", 'NaN,NA,null,c',
            '"1,000",-2.5,20240102,d', "1.2e3,0,2024-01-02 10:00:00,e"]
    bad = ["1.5,1,2024-01-02,f", "3,abc,not a day,g", '"1,00",1,2024-01-02,h']
    (tmp_path / "t.csv").write_text(head + "\n".join(good + bad) + "\n")
    rows, rejected = read_csv_rejects(spark, str(tmp_path / "t.csv"), schema)
    got = {r.name: (r.price, r.n, str(r.day)) for r in rows.collect()}
    day = "2024-01-02"
    assert got == {"a": (1234.5, 12, day), "b": (1000.0, 7, day), None: (None, None, "None"),
                   "c": (None, None, "None"), "d": (-2.5, 1000, day), "e": (0.0, 1200, day)}
    reasons = {r.name: list(r.reasons) for r in rejected.collect()}
    assert reasons == {"f": ["n: not a number: 1.5"], "h": ["n: not a number: 1,00"],
                       "g": ["price: not a number: abc", "day: not a date: not a day"]}
    with pytest.raises(Exception, match="not a number"):
        read_csv(spark, str(tmp_path / "t.csv"), schema).collect()
    (tmp_path / "fine.csv").write_text(head + "\n".join(good) + "\n")
    assert read_csv(spark, str(tmp_path / "fine.csv"), schema).count() == len(good)


def test_staging_on_a_uri_keeps_rows_as_they_are(spark, tmp_path):
    from fixtures import PRICE_CSV, SHIP_CSV

    from forgecast import config as C
    from forgecast.sources.ingest import stage_raw_tables
    lines = PRICE_CSV.strip().splitlines()
    nothing = "," + lines[1].split(",", 1)[1]
    (tmp_path / f"{C.TABLE_PRICE}.csv").write_text("\n".join([*lines, nothing]) + "\n")
    (tmp_path / f"{C.TABLE_SHIP}.csv").write_text(SHIP_CSV)
    src, out = tmp_path.as_uri(), (tmp_path / "out").as_uri()
    first = stage_raw_tables(spark, src, out)
    assert first == {C.TABLE_SHIP: "written", C.TABLE_PRICE: "written",
                     C.TABLE_TX: "missing source"}
    staged = spark.read.parquet(f"{out}/{C.TABLE_PRICE}")
    assert staged.count() == len(lines) and staged.where("nsn is null").count() == 1
    assert stage_raw_tables(spark, src, out)[C.TABLE_PRICE] == "exists"
