"""Table health check: row counts of the three tables, and listing on all-zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C

TABLES = (C.TABLE_SHIP, C.TABLE_PRICE, C.TABLE_TX)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: (table_name, row_count). One distributed count each,
    combined with ``unionByName`` so Spark runs them as one job."""
    parts = [df.agg(F.count(F.lit(1)).cast("long").alias("row_count"))
             .select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def table_row_counts(spark: SparkSession, database: str = C.DEFAULT_DATABASE) -> DataFrame:
    """Counts of the metastore tables; a missing table counts 0."""
    tables = {}
    for t in TABLES:
        name = f"{database}.{t}"
        if spark.catalog.tableExists(name):
            tables[t] = spark.table(name)
        else:
            tables[t] = spark.range(0).select(F.lit(1).alias("x"))
    return row_counts(tables)


def zero_diagnostics(spark: SparkSession, database: str = C.DEFAULT_DATABASE) -> DataFrame:
    """``SHOW TABLES IN db`` (used when every count is zero)."""
    return spark.sql(f"SHOW TABLES IN {database}")


def check_tables(spark: SparkSession, database: str = C.DEFAULT_DATABASE
                 ) -> tuple[DataFrame, DataFrame | None]:
    """Row counts, plus the database listing when every count is zero."""
    counts = table_row_counts(spark, database)
    total = counts.agg(F.sum("row_count")).first()[0] or 0
    return counts, (zero_diagnostics(spark, database) if total == 0 else None)
