"""Calendar buckets as built-in expressions (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_week_sql(t: str) -> str:
    """`%Y-%W`: year, then the Monday-first week of year 00-53 (not ISO).

    Days before the first Monday of January fall in week 00.
    """
    week = f"floor((dayofyear({t}) + 6 - weekday({t})) / 7)"
    # year as zero-padded digits: the same text as date_format(t, 'yyyy') for
    # years 0-9999, without a formatter call per row
    return f"concat(lpad(CAST(year({t}) AS STRING), 4, '0'), '-', lpad(CAST({week} AS STRING), 2, '0'))"


def year_week(t: str) -> Column:
    return F.expr(year_week_sql(t))


def year_month_sql(t: str) -> str:
    """`%Y-%m` (zero-padded digits, no per-row formatter)."""
    return f"concat(lpad(CAST(year({t}) AS STRING), 4, '0'), '-', lpad(CAST(month({t}) AS STRING), 2, '0'))"


def hour_of_day(t: str) -> Column:
    """`CAST(strftime('%H', t) AS INTEGER)` in the session zone (UTC)."""
    return F.expr(f"CAST(hour({t}) AS INT)")
