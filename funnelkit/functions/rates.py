"""Ratio and rounding helpers as SQL expression snippets.

Rules the reports share:
* percentages are DOUBLE (`100.0D` is a double literal; a bare `100.0` would be
  a DECIMAL and turn the whole ratio into a decimal);
* a zero denominator yields NULL (SQL reports) or 0.0 (dashboard reports);
* rounding is SQL ROUND, half away from zero.

The `*_sql` functions return text for `selectExpr` / `F.expr`; the Column
forms wrap them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct_sql(num: str, den: str, digits: int = 2) -> str:
    """ROUND(100.0 * num / NULLIF(den, 0), digits) — NULL when den is 0."""
    return f"round(100.0D * ({num}) / nullif({den}, 0), {digits})"


def pct0_sql(num: str, den: str, digits: int = 2) -> str:
    """Dashboard form: round(100 * num / den, digits) if den else 0."""
    return f"coalesce({pct_sql(num, den, digits)}, 0.0D)"


def div_first_pct_sql(num: str, den: str, digits: int = 2) -> str:
    """round(num / den * 100, digits): divide first, then scale (notebook form)."""
    return f"round(({num}) / nullif({den}, 0) * 100.0D, {digits})"


def ratio_sql(num: str, den: str) -> str:
    """Unrounded num / den as DOUBLE, NULL when den is 0."""
    return f"CAST({num} AS DOUBLE) / nullif({den}, 0)"


def ratio0_sql(num: str, den: str) -> str:
    return f"coalesce({ratio_sql(num, den)}, 0.0D)"


def pct(num: str, den: str, digits: int = 2) -> Column:
    return F.expr(pct_sql(num, den, digits))


def ratio(num: str, den: str) -> Column:
    return F.expr(ratio_sql(num, den))


def avg_of_rates_sql(rate_pct: str, over: str = "") -> str:
    """ROUND(AVG(rate), 2) computed exactly.

    Averaging already-rounded doubles and rounding again lands on ties whose
    outcome depends on float noise and summation order (so it differs between
    engines and partitionings). Summing integer basis points and rounding the
    quotient half-up with integer arithmetic is order-independent. `over` turns
    the aggregates into window aggregates (e.g. "OVER (PARTITION BY channel)").
    """
    bp = f"CAST(round({rate_pct} * 100) AS BIGINT)"
    n = f"count({bp}) {over}"
    return f"floor((2 * sum({bp}) {over} + {n}) / nullif(2.0D * {n}, 0)) / 100.0D"
