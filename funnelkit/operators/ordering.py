"""Ordering of report outputs.

A global `orderBy` range-partitions its input, which costs a sampling job and
an extra stage. For outputs whose size is bounded by construction (one row per
dimension value, hour, week, month, or an explicit limit) the rows
are brought into one partition with a narrow `coalesce(1)` and sorted there.
Outputs that grow with the data (user-grain reports) keep the distributed
range sort (`order`).

Sort keys are given as SQL-like specs: "col", "col DESC", "col ASC NULLS LAST".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SORTS = {
    ("ASC", None): F.asc, ("DESC", None): F.desc,
    ("ASC", "FIRST"): F.asc_nulls_first, ("ASC", "LAST"): F.asc_nulls_last,
    ("DESC", "FIRST"): F.desc_nulls_first, ("DESC", "LAST"): F.desc_nulls_last,
}


def sort_key(spec: str | Column) -> Column:
    """'col [ASC|DESC] [NULLS FIRST|LAST]' -> a sort Column (default ASC)."""
    if not isinstance(spec, str):
        return spec
    words = spec.split()
    name, rest = words[0], [w.upper() for w in words[1:]]
    direction = "DESC" if "DESC" in rest else "ASC"
    nulls = rest[rest.index("NULLS") + 1] if "NULLS" in rest else None
    return _SORTS[(direction, nulls)](name)


def small(df: DataFrame) -> DataFrame:
    """One partition for a bounded intermediate (dimension cells, buckets).

    Windows, rollups and sorts over it then need no exchange: a single
    partition already satisfies any clustering requirement.
    """
    return df.coalesce(1)


def order(df: DataFrame, *specs) -> DataFrame:
    """Distributed global sort (range partitioning) for unbounded outputs."""
    return df.orderBy(*[sort_key(s) for s in specs])


def order_small(df: DataFrame, *specs) -> DataFrame:
    """Sort a result whose row count is bounded by dimensions, buckets or a limit."""
    return df.coalesce(1).orderBy(*[sort_key(s) for s in specs])
