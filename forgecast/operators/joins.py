"""Many-to-one lookup joins that survive a hot key.

A lookup side with one row per key (supplier rollup, per-item state) is
joined to a large side on which one key may hold a third of the rows. AQE
splits a skewed sort-merge join only when both inputs are plain shuffle
stages, which a bucketed scan or an aggregate over a window is not. So the
hot keys are isolated explicitly:

* ``hot_keys`` counts rows per key with a partial aggregate (a hot key
  collapses map-side) and returns at most ``max_keys`` of the busiest keys
  with at least ``min_rows`` rows;
* ``lookup_join`` joins the rows of those keys against a broadcast of their
  lookup rows only (bounded by the list), where the rows already are, and
  all other rows through the ordinary shuffle join.

The list only chooses the join strategy: both branches give the exact
answer, so an approximate list (e.g. counted on a cheaper table) is safe.

Without a list, ``lookup_join`` salts: a row goes to one of ``SALTS`` shares of its key
by a hash of the row, and every lookup row is repeated for each share. No task gets more
than about a share of a hot key, rows without a key are spread over the shares too, and
nothing has to be counted first. A small lookup table is still broadcast at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: shares of a key in a salted join, and copies of each lookup row
SALTS = 16


def hot_keys(df: DataFrame, key: str, min_rows: int, max_keys: int) -> list:
    n = F.count(F.lit(1))
    rows = (df.where(F.col(key).isNotNull()).groupBy(key).agg(n.alias("_n"))
            .where(F.col("_n") >= min_rows).orderBy(F.col("_n").desc(), F.col(key))
            .limit(max_keys).collect())
    return [r[key] for r in rows]


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "left",
                hot: list | None = None) -> DataFrame:
    """``left.join(right, key, how)`` with the ``hot`` keys answered by a
    broadcast of their ``right`` rows (``right`` holds one row per key). Without ``hot``
    keys the join is salted; columns come in the order of the plain join."""
    if not hot:
        return salted_join(left, right, key, how)
    is_hot = F.col(key).isin(list(hot))
    cold = left.where(F.col(key).isNull() | ~is_hot).join(right, key, how)
    warm = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how)
    return cold.unionByName(warm)


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "left",
                salts: int = SALTS) -> DataFrame:
    """``left.join(right, key, how)`` (left or inner) with every key dealt over ``salts`` shares."""
    rest = [c for c in left.columns if c != key]
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = left.withColumn("_salt", salt).join(copies, [key, "_salt"], how)
    return out.select(key, *rest, *(c for c in right.columns if c != key))
