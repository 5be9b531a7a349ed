"""Idempotent raw ingest: CSV folder -> Parquet tables, never overwriting.

Folders may lie on any file system that Spark reads; rows are staged as they are (a row
without an item key stays, the readers of the staged tables decide about it).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import config as C
from .. import schemas as S
from ..session import path_exists
from .readers import read_csv


def stage_raw_tables(spark: SparkSession, csv_dir: str, out_dir: str) -> dict[str, str]:
    """Write each of the three tables to ``out_dir/<table>`` only if absent.

    Returns ``{table: "written" | "exists" | "missing source"}``.
    """
    schemas = {C.TABLE_SHIP: S.SUPPLIER_SHIPPING, C.TABLE_PRICE: S.PRICE_HISTORY, C.TABLE_TX: None}
    status = {}
    for table, schema in schemas.items():
        src, dst = f"{csv_dir}/{table}.csv", f"{out_dir}/{table}"
        if path_exists(spark, f"{dst}/_SUCCESS"):
            status[table] = "exists"
            continue
        if not path_exists(spark, src):
            status[table] = "missing source"
            continue
        df = read_csv(spark, src, schema)
        if "order_date" in df.columns:
            df = df.withColumn("order_date", F.to_date("order_date"))
        # a write that broke off left no _SUCCESS and is done again
        df.write.mode("overwrite").parquet(dst)
        status[table] = "written"
    return status
