"""Driver-table adapters against a brute-force pandas / exact-Decimal computation."""

import os
from decimal import Decimal

import pandas as pd
import pytest

from forgecast import config as C
from forgecast.sources import adapters as A

SMOKE = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SMOKE), reason="driver tables not present")


def _cents(x) -> int:
    # DECIMAL(18,2) rounding of the line price (half away from zero), in whole cents
    return int(Decimal(repr(float(x))).quantize(Decimal("0.01"), rounding="ROUND_HALF_UP") * 100)


@pytest.fixture(scope="module")
def lineitem():
    li = pd.read_parquet(f"{SMOKE}/lineitem.parquet",
                         columns=["l_orderkey", "l_partkey", "l_suppkey", "l_quantity",
                                  "l_extendedprice", "l_shipdate"])
    li = li[li["l_partkey"].notna()].copy()
    li["date"] = pd.to_datetime(li["l_shipdate"]).dt.date
    li["cents"] = [_cents(x) for x in li["l_extendedprice"]]
    li["qty"] = li["l_quantity"].astype("int64")
    return li


def test_price_history_equals_brute_force(spark, lineitem):
    li = lineitem
    li = li.assign(month=[d.replace(day=1) for d in li["date"]])
    m = li.groupby("month").agg(c=("cents", "sum"), q=("qty", "sum"))
    level = (m["c"].sum() / 100) / m["q"].sum()
    index = {k: ((r.c / 100) / r.q) / level for k, r in m.iterrows()}
    g = li.groupby(["l_partkey", "date"]).agg(c=("cents", "sum"), q=("qty", "sum"),
                                              s=("l_suppkey", "min")).reset_index()
    n_obs = g.groupby("l_partkey")["date"].transform("count")
    want = {}
    for r, n in zip(g.itertuples(), n_obs):
        dens = (C.DENSE_CLASS if n >= C.ADAPTER_DENSE_MIN_OBS else
                C.MODERATE_CLASS if n >= C.ADAPTER_MODERATE_MIN_OBS else C.SPARSE_CLASS)
        want[(str(r.l_partkey), r.date)] = (
            (r.c / 100) / r.q, int(r.q), index[r.date.replace(day=1)], str(r.s), dens)

    got_df = A.price_history_from_lineitem(spark.read.parquet(f"{SMOKE}/lineitem.parquet"))
    got = {(r.nsn, r.date): (r.unit_price, r.demand_quantity, r.market_index, r.supplier_id,
                             r.data_density_class) for r in got_df.collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        g_ = got[k]
        assert g_[0] == w[0], k          # Σ cents / 100 / Σ qty: one exact rounding each
        assert g_[1:2] == w[1:2] and g_[3:] == w[3:], k
        assert g_[2] == pytest.approx(w[2], rel=1e-12), k


def test_supplier_reports_equal_brute_force(spark, lineitem):
    orders = pd.read_parquet(f"{SMOKE}/orders.parquet",
                             columns=["o_orderkey", "o_orderdate", "o_orderpriority"])
    j = lineitem.merge(orders, left_on="l_orderkey", right_on="o_orderkey")
    j["lead"] = (pd.to_datetime(j["date"]) - pd.to_datetime(j["o_orderdate"]).dt.normalize()).dt.days.abs()
    j["urgent"] = (j["o_orderpriority"] == C.URGENT_PRIORITY).astype(int)
    j["month"] = [d.replace(day=1) for d in j["date"]]
    want = {(str(s), mo): (g["lead"].mean(), g["urgent"].mean(), len(g))
            for (s, mo), g in j.groupby(["l_suppkey", "month"])}
    got_df = A.supplier_shipping_from_orders(spark.read.parquet(f"{SMOKE}/lineitem.parquet"),
                                             spark.read.parquet(f"{SMOKE}/orders.parquet"))
    got = {(r.supplier_id, r.report_month): (r.avg_lead_time_days, r.expedite_rate,
                                             r.shipments_completed) for r in got_df.collect()}
    assert got.keys() == want.keys()
    for k, (lead, exp, n) in want.items():
        assert got[k][0] == pytest.approx(lead, rel=1e-12)
        assert got[k][1] == pytest.approx(exp, rel=1e-12)
        assert got[k][2] == n
