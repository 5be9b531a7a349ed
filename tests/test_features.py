"""Feature operators, one test per semantic trap, plus null / edge handling."""

import datetime as dt

import pytest
from conftest import make_price, make_ship
from pyspark.sql import functions as F

from forgecast import config as C
from forgecast.operators import features as FE

D = C.DENSE_CLASS
SP = C.SPARSE_CLASS


def test_t1_lag_1_is_the_oldest_value(spark):
    rows = [("A", f"2024-{m:02d}-01", float(m), 1, 1.0, "S1", D) for m in range(1, 10)]
    f = FE.dense_lag_features(make_price(spark, rows)).orderBy("pos").collect()
    assert len(f) == 3
    first = f[0]
    assert (first.lag_1, first.lag_6, first.target) == (1.0, 6.0, 7.0)
    assert first.month == 7.0 and first.pos == 1 and first.n_usable == 3


def test_t2_rollup_uses_latest_three_reports_globally(spark):
    ship = make_ship(spark, [("S1", "2025-01-01", 10.0, 0.1), ("S1", "2025-02-01", 20.0, 0.2),
                             ("S1", "2025-03-01", 30.0, 0.3), ("S1", "2025-04-01", 40.0, 0.4),
                             ("S2", "2025-01-01", 5.0, 0.5)])
    r = {x.supplier_id: x for x in FE.supplier_rollup(ship).collect()}
    assert r["S1"].supplier_avg_lead_3m == pytest.approx(30.0)
    assert r["S1"].supplier_expedite_3m == pytest.approx(0.3)
    assert r["S2"].supplier_avg_lead_3m == 5.0 and r["S2"].n_reports == 1
    # the purchase dates play no role: an old purchase still sees the 2025 reports
    price = make_price(spark, [("A", "2010-01-01", 1.0, 1, 1.0, "S1", SP),
                               ("A", "2011-01-01", 2.0, 1, 1.0, "S1", SP)])
    fr = FE.sparse_training_frame(price, ship).first()
    assert fr.supplier_avg_lead_3m == pytest.approx(30.0)


def test_rollup_ranks_before_skipping_nulls(spark):
    ship = make_ship(spark, [("S1", "2025-01-01", 10.0, 0.1), ("S1", "2025-02-01", None, None),
                             ("S1", "2025-03-01", None, None), ("S1", "2025-04-01", None, None)])
    r = FE.supplier_rollup(ship).first()
    assert r.supplier_avg_lead_3m is None and r.supplier_expedite_3m is None


def test_t3_missing_supplier_null_in_training_default_in_serving(spark):
    price = make_price(spark, [("A", "2020-01-01", 1.0, 1, 1.0, "NOPE", SP),
                               ("A", "2021-01-01", 2.0, 1, 1.1, "NOPE", SP)])
    ship = make_ship(spark, [("S1", "2025-01-01", 10.0, 0.1)])
    fr = FE.sparse_training_frame(price, ship).first()
    assert fr.supplier_avg_lead_3m is None
    assert FE.sparse_filter(FE.sparse_training_frame(price, ship)).count() == 0
    sv = FE.sparse_serving_features(price, ship).first()
    assert (sv.supplier_avg_lead_3m, sv.supplier_expedite_3m) == (15.0, 0.05)


def test_t3_reported_but_null_values_stay_null_in_serving(spark):
    price = make_price(spark, [("A", "2020-01-01", 1.0, 1, 1.0, "S1", SP),
                               ("A", "2021-01-01", 2.0, 1, 1.1, "S1", SP)])
    ship = make_ship(spark, [("S1", "2025-01-01", None, None)])
    sv = FE.sparse_serving_features(price, ship).first()
    assert sv.supplier_avg_lead_3m is None and sv.supplier_expedite_3m is None


def test_t4_first_supplier_in_training_last_in_serving(spark):
    price = make_price(spark, [("A", "2020-01-01", 1.0, 1, 1.0, "S1", SP),
                               ("A", "2021-01-01", 2.0, 1, 1.0, "S2", SP),
                               ("A", "2022-01-01", 3.0, 1, 1.0, "S2", SP)])
    ship = make_ship(spark, [("S1", "2025-01-01", 10.0, 0.1), ("S2", "2025-01-01", 20.0, 0.2)])
    leads = {r.supplier_avg_lead_3m for r in FE.sparse_training_frame(price, ship).collect()}
    assert leads == {10.0}
    assert FE.sparse_serving_features(price, ship).first().supplier_avg_lead_3m == 20.0


def test_t5_serving_row_is_the_last_pair(spark):
    price = make_price(spark, [("A", "2020-01-01", 1.0, 1, 1.0, "S1", SP),
                               ("A", "2020-01-11", 2.0, 3, 1.5, "S1", SP),
                               ("A", "2020-02-10", 4.0, 7, 1.25, "S1", SP)])
    ship = make_ship(spark, [("S1", "2025-01-01", 10.0, 0.1)])
    sv = FE.sparse_serving_features(price, ship).first()
    assert (sv.gap_days, sv.prev_price, sv.last_observed_price) == (30, 2.0, 4.0)
    assert (sv.market_index, sv.demand_quantity, sv.delta_market) == (1.25, 7.0, -0.25)


def test_gap_days_and_log_gap(spark):
    price = make_price(spark, [("A", "2024-02-28", 1.0, 1, 1.0, "S1", SP),
                               ("A", "2024-03-01", 2.0, 1, 1.0, "S1", SP)])
    p = FE.price_pairs(price).first()
    assert p.gap_days == 2
    assert p.log_gap == pytest.approx(1.0986122886681098)


def test_null_dates_sort_last_and_null_items_form_no_series(spark):
    price = make_price(spark, [("A", None, 9.0, 1, 1.0, "S1", SP),
                               ("A", "2020-01-01", 1.0, 1, 1.0, "S1", SP),
                               ("A", "2021-01-01", 2.0, 1, 1.0, "S1", SP)])
    last = FE.last_observation(price).first()
    assert last.date is None and last.unit_price == 9.0
    assert last.last_history_month == dt.date(2021, 1, 1)


def test_one_row_item_gets_no_pair_and_status(spark):
    price = make_price(spark, [("A", "2020-01-01", 1.0, 1, 1.0, "S1", SP)])
    assert FE.price_pairs(price).count() == 0
    st = FE.min_history_status(price).first()
    assert (st.dense_status, st.sparse_status) == ("insufficient_history", C.ERR_NEED_SPARSE)


def test_short_lag_vector_is_incomplete(spark):
    price = make_price(spark, [("A", f"2024-0{m}-01", float(m), 1, 1.0, "S1", D) for m in range(1, 4)])
    v = FE.last_lag_vector(price).first()
    assert v.lags == [1.0, 2.0, 3.0] and not v.complete


def test_dense_split_is_floor_of_four_fifths(spark):
    rows = [("A", str(dt.date(2020, 1, 1) + dt.timedelta(days=i)), float(i), 1, 1.0, "S1", D)
            for i in range(6 + 13)]
    s = FE.dense_split(FE.dense_lag_features(make_price(spark, rows)))
    assert s.where("is_train").count() == 10 and s.first().n_train == 10


def test_results_do_not_depend_on_input_order(spark, price, ship):
    a = FE.sparse_training_frame(price, ship)
    b = FE.sparse_training_frame(price.orderBy(F.rand(7)).repartition(5), ship.repartition(3))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_hot_supplier_joins_equal_the_plain_joins(spark, price, ship):
    """A hot-supplier list only changes the join strategy, never the rows."""
    rows = lambda df: sorted(map(str, df.collect()))
    sups = [r.supplier_id for r in price.select("supplier_id").distinct().collect()]
    assert FE.hot_suppliers(price, min_rows=36, max_keys=5) == ["SUP-005"]
    assert FE.hot_suppliers(price, min_rows=5, max_keys=2) == ["SUP-005", "SUP-008"]
    with_null = price.unionByName(make_price(spark, [
        ("N1", "2024-01-01", 5.0, 1, 1.0, None, C.SPARSE_CLASS),
        ("N1", "2024-03-01", 6.0, 2, 1.1, None, C.SPARSE_CLASS)]))
    for p in (price, with_null):
        plain = rows(FE.sparse_training_frame(p, ship, hot=[]))
        serve = rows(FE.sparse_serving_features(p, ship, hot=[]))
        for hot in (sups[:1], sups, "auto"):
            assert rows(FE.sparse_training_frame(p, ship, hot=hot)) == plain
            assert rows(FE.sparse_serving_features(p, ship, hot=hot)) == serve
