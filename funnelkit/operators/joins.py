"""Join helpers with an explicit broadcast policy.

A side is broadcast only when its size is known to be small: its few rows were
fetched once (`small_lookup`) or it is the output of a small LIMIT. Any other
side is left to the planner: adaptive query execution measures the shuffled side
at run time and broadcasts it only below its threshold; beyond it the join stays
a sort-merge join whose skewed partitions are split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_MAX_ROWS = 100_000


def small_lookup(lookup: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> tuple[DataFrame, bool]:
    """(`lookup`, whether it is small): computed here and once, and broadcast as fetched, if it has at most `max_rows` rows.

    A larger one is returned as it came, for the planner to join.
    """
    rows = lookup.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return lookup, False
    return F.broadcast(lookup.sparkSession.createDataFrame(rows, lookup.schema)), True


def bounded_by_limit(df: DataFrame, n: int) -> DataFrame:
    """`df.limit(n)`, broadcast if n itself is small."""
    return F.broadcast(df.limit(n)) if n <= BROADCAST_MAX_ROWS else df.limit(n)
