import io
import os
import sys

import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fixtures import PRICE_CSV, SHIP_CSV  # noqa: E402

from forgecast import schemas as S  # noqa: E402
from forgecast.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=4, app="forgecast-tests")
    yield s
    s.stop()


def _frame(spark, text, schema, date_cols):
    pdf = pd.read_csv(io.StringIO(text), parse_dates=list(date_cols))
    for c in date_cols:
        pdf[c] = pdf[c].dt.date
    return spark.createDataFrame(pdf, schema)


@pytest.fixture(scope="session")
def price(spark):
    return _frame(spark, PRICE_CSV, S.PRICE_HISTORY, ("date",))


@pytest.fixture(scope="session")
def ship(spark):
    return _frame(spark, SHIP_CSV, S.SUPPLIER_SHIPPING, ("report_month",))


def make_price(spark, rows):
    """rows: (nsn, date 'YYYY-MM-DD' or None, price, demand, market, supplier, density)."""
    import datetime as dt
    out = []
    for nsn, d, p, q, m, sup, dens in rows:
        out.append((nsn, None, None if d is None else dt.date.fromisoformat(d), p, q, m, sup, None,
                    dens, None))
    return spark.createDataFrame(out, S.PRICE_HISTORY)


def make_ship(spark, rows):
    """rows: (supplier, month 'YYYY-MM-DD', lead, expedite)."""
    import datetime as dt
    out = [(s, None, dt.date.fromisoformat(m), lead, None, None, None, None, None, exp, None, None)
           for s, m, lead, exp in rows]
    return spark.createDataFrame(out, S.SUPPLIER_SHIPPING)
