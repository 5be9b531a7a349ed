"""Column helpers (all built-in Spark expressions, whole-stage codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_gap(days: Column) -> Column:
    """log(1 + gap days) as double."""
    return F.log1p(days.cast("double"))


def month_number(d: Column) -> Column:
    """Calendar month of a date as double."""
    return F.month(d).cast("double")


def months_after(d: Column, h: Column | int) -> Column:
    """``d`` plus ``h`` months from the fixed date (day clamped to month end)."""
    return F.add_months(d, h if isinstance(h, Column) else F.lit(h))


def iso_date(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def clean_key(c: Column) -> Column:
    """Item id input as typed by a user: surrounding blanks removed."""
    return F.trim(c)


def price_display(c: Column) -> Column:
    """Four-decimal display of a price (missing -> 0)."""
    return F.format_string("%.4f", F.coalesce(c.cast("double"), F.lit(0.0)))


def abs_error(y: Column, pred: Column) -> Column:
    return F.abs(y - pred)
