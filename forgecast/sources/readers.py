"""Readers for the three procurement tables (CSV files or metastore tables).

``source`` selects where a table comes from:

* ``"csv"`` (also ``"file"``, ``"local"``): read ``<path>/<table>.csv`` only.
* ``"table"`` (also ``"warehouse"``, ``"impala"``, ``"dw"``, ``"hive"``) or
  ``"auto"``: read ``<database>.<table>`` first and fall back to the CSV when
  the table is missing, unreadable or empty.

CSV columns are bound by header name, and a missing column is an error. Dates
may carry a time or be written with slashes; numbers may carry thousands separators,
whole numbers a decimal point with zeros. A cell that is neither empty nor readable is
never lost: it fails the read, or (``read_csv_rejects``) its row is kept aside with the
reason. The readers never sort (ordering belongs to the windows and the sinks).
"""

from __future__ import annotations

import logging
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from .. import schemas as S


log = logging.getLogger(__name__)

#: accepted besides the ISO forms (a date, optionally with a time)
DATE_FORMATS = ("M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "yyyy/M/d", "yyyy/M/d H:mm:ss",
                "yyyyMMdd")


def source_mode(value: str | None) -> str:
    """Normalise a source-mode word (trim + lower) to ``csv`` or ``auto``."""
    mode = (value or "").strip().lower()
    if mode in C.CSV_MODES:
        return "csv"
    return "auto"  # table modes and unset both try the table first


def _named_cells(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {', '.join(missing)}")
    return df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             date_cols: tuple[str, ...] = ()) -> DataFrame:
    """CSV scan with a header row. With ``schema`` no inference pass runs, and the first
    cell that can't be read fails the job, named in the error."""
    if schema is not None:
        out = []
        for f in schema:
            value, bad = parsed_cell(f)
            fail = F.raise_error(F.concat(F.lit(f"{path}: "), bad)).cast(f.dataType)
            out.append(F.when(bad.isNull(), value).otherwise(fail).alias(f.name))
        return _named_cells(spark, path, schema).select(*out)
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    for c in date_cols:
        if c in df.columns and not isinstance(df.schema[c].dataType, T.DateType):
            df = df.withColumn(c, F.to_date(F.col(c)))
    return df


def read_csv_rejects(spark: SparkSession, path: str, schema: T.StructType
                     ) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): typed rows, and the rows with cells that can't be read.

    Rejected rows have their cells as text and ``reasons``, one text per bad cell; every
    row of the file is in exactly one of the two.
    """
    cells = _named_cells(spark, path, schema)
    parsed = {f.name: parsed_cell(f) for f in schema}
    reasons = F.array_compact(F.array(*(bad for _, bad in parsed.values())))
    good = cells.where(F.size(reasons) == 0).select(
        *(value.alias(name) for name, (value, _) in parsed.items()))
    return good, cells.withColumn("reasons", reasons).where(F.size("reasons") > 0)


def parsed_cell(f: T.StructField) -> tuple[Column, Column]:
    """Value of a text cell, and what is wrong with it (null if nothing)."""
    if isinstance(f.dataType, T.StringType):
        return F.col(f.name), F.lit(None).cast("string")
    cell = F.trim(F.col(f.name))
    cell = F.when((cell != "") & ~cell.isin(*C.NULL_WORDS), cell)
    if isinstance(f.dataType, T.DateType):
        value, kind = parsed_date(cell), "date"
    else:
        value, kind = parsed_number(cell, f.dataType), "number"
    bad = F.when(cell.isNotNull() & value.isNull(),
                 F.format_string(f"{f.name}: not a {kind}: %s", cell))
    return value, bad


def parsed_date(cell: Column) -> Column:
    """Date of a text; null if it is none."""
    formats = [F.try_to_timestamp(cell, F.lit(f)).cast("date") for f in DATE_FORMATS]
    return F.coalesce(cell.try_cast("date"), *formats)


def parsed_number(cell: Column, kind: T.DataType) -> Column:
    """Number of a text; null if it is none, or no whole number where one is wanted."""
    plain = F.when(cell.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.\d*)?$"),
                   F.regexp_replace(cell, ",", "")).otherwise(cell)
    if not isinstance(kind, T.IntegralType):
        return plain.try_cast(kind)
    whole = F.regexp_replace(plain, r"\.0*$", "")
    # 1.2e3 is a whole number too
    wide = plain.try_cast("decimal(38,6)")
    return F.coalesce(whole.try_cast(kind), F.when(wide == F.floor(wide), wide).try_cast(kind))


def read_table(spark: SparkSession, table: str, database: str = C.DEFAULT_DATABASE
               ) -> DataFrame | None:
    """``SELECT * FROM db.table``; ``None`` when missing, unreadable or empty."""
    name = f"{database}.{table}" if database else table
    try:
        if not spark.catalog.tableExists(name):
            return None
        df = spark.table(name)
        if df.isEmpty():
            return None
        return df
    except Exception as e:  # any failure means the other source, as for a missing table
        log.warning("table %s not readable, using the CSV: %s", name, e)
        return None


def _load(spark: SparkSession, table: str, schema: T.StructType, date_cols,
          path: str | None, source: str | None, database: str) -> DataFrame:
    df = None
    if source_mode(source) != "csv":
        df = read_table(spark, table, database)
        if df is not None:
            for c in date_cols:
                if c in df.columns:
                    df = df.withColumn(c, F.to_date(F.col(c)))
    if df is None:
        if path is None:
            raise ValueError(f"no table {database}.{table} and no CSV folder given")
        df = read_csv(spark, os.path.join(path, f"{table}.csv"), schema, date_cols)
    return df


def load_price_history(spark: SparkSession, path: str | None = None, source: str | None = "auto",
                       database: str = C.DEFAULT_DATABASE) -> DataFrame:
    """Item price history; rows with a null item key are dropped (they form no series)."""
    df = _load(spark, C.TABLE_PRICE, S.PRICE_HISTORY, ("date",), path, source, database)
    return df.where(F.col("nsn").isNotNull())


def load_supplier_shipping(spark: SparkSession, path: str | None = None, source: str | None = "auto",
                           database: str = C.DEFAULT_DATABASE) -> DataFrame:
    return _load(spark, C.TABLE_SHIP, S.SUPPLIER_SHIPPING, ("report_month",), path, source, database)


def load_transactions(spark: SparkSession, path: str | None = None, source: str | None = "auto",
                      database: str = C.DEFAULT_DATABASE) -> DataFrame:
    """Transactions table: schema on read; ``order_date`` typed when present."""
    df = None
    if source_mode(source) != "csv":
        df = read_table(spark, C.TABLE_TX, database)
    if df is None:
        if path is None:
            raise ValueError(f"no table {database}.{C.TABLE_TX} and no CSV folder given")
        df = read_csv(spark, os.path.join(path, f"{C.TABLE_TX}.csv"))
    if "order_date" in df.columns:
        df = df.withColumn("order_date", F.to_date(F.col("order_date")))
    return df


load_procurement_transactions = load_transactions


def sorted_price_history(df: DataFrame) -> DataFrame:
    """Sink-side ordering (item, date), nulls last; windows do their own ordering."""
    return df.orderBy(F.col("nsn").asc_nulls_last(), F.col("date").asc_nulls_last())
