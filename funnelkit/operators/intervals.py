"""Joins over time: general interval join and forward as-of join.

Both cut time into slots, so that the rows of one busy key spread over as many
tasks as there are slots: `interval_join` joins by (key, slot) and checks the
bounds exactly; `next_after` sorts each (key, slot) once and carries the first
row of the later slots into it. Positions are BIGINTs, e.g. `micros_sql(t)`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOUR = 3_600_000_000
DAY = 24 * HOUR


def micros_sql(t: str) -> str:
    """A timestamp as microseconds since 1970 (session zone UTC)."""
    return f"unix_micros(CAST({t} AS TIMESTAMP))"


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, lo: int, hi: int,
                  splits: int = 1) -> DataFrame:
    """All pairs with equal keys and right_at - left_at in [lo, hi]; columns of `left`, then those of `right` but the keys.

    Slots are as wide as the window divided by `splits`: a left row goes to the
    `splits` + 1 slots its window can touch, a right row to its own, so a pair
    meets exactly once and more splits spread a busy key further. NULL keys or
    positions pair with nothing. Column names other than the keys must differ.
    """
    if hi < lo:
        raise ValueError(f"an empty window: {lo} > {hi}")
    slot = max(1, -(-(hi - lo) // splits))
    usable = " AND ".join(f"{c} IS NOT NULL" for c in keys) + f" AND ({left_at}) IS NOT NULL"
    first, last = (_slot_sql(f"({left_at}) + {edge}L", slot) for edge in (lo, hi))
    wide = left.where(usable).withColumn("__slot", F.explode(F.expr(f"sequence({first}, {last})")))
    own = right.selectExpr(*[f"{c} AS __k{i}" for i, c in enumerate(keys)], f"{_slot_sql(right_at, slot)} AS __in",
                           *[c for c in right.columns if c not in keys])
    met = [F.col(c) == F.col(f"__k{i}") for i, c in enumerate(keys)]
    on = (F.col("__slot") == F.col("__in")) & F.expr(f"{right_at} - {left_at} BETWEEN {lo}L AND {hi}L")
    for m in met:
        on = on & m
    return wide.join(own, on).select(*left.columns, *[c for c in right.columns if c not in keys])


def _slot_sql(at: str, width: int) -> str:
    """floor(at / width) in integers, for negative positions too."""
    return f"(({at}) - pmod({at}, {width}L)) DIV {width}L"


def next_after(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, slot: int = DAY,
               name: str = "next_at") -> DataFrame:
    """`left` with the smallest right_at >= left_at of its key as column `name`, NULL if there is none.

    One sorted pass over the union of both sides, (key, slot) by (key, slot).
    Into each of them one more row is carried: the first position of the key's
    later slots, from a window over (key, slot) minima, of which a key has one a
    slot at most. Repeated right positions are merged first; rows of `left` with
    a NULL key or position get NULL.
    """
    payload = F.struct(*[F.col(c) for c in left.columns])
    have = " AND ".join(f"{c} IS NOT NULL" for c in keys)
    asks = left.where(f"{have} AND ({left_at}) IS NOT NULL").select(
        *keys, F.expr(f"CAST({left_at} AS BIGINT)").alias("__at"), payload.alias("__row"))
    hits = right.where(have).selectExpr(*keys, f"CAST({right_at} AS BIGINT) AS __at").where("__at IS NOT NULL").distinct()
    asks, hits = (d.withColumn("__slot", F.expr(_slot_sql("__at", slot))) for d in (asks, hits))

    none = F.lit(None).cast("bigint")
    minima = hits.groupBy(*keys, "__slot").agg(F.min("__at").alias("__first")).unionByName(
        asks.select(*keys, "__slot", none.alias("__first"))).groupBy(*keys, "__slot").agg(F.min("__first").alias("__first"))
    by_key = ", ".join(keys)
    carried = minima.selectExpr(*keys, "__slot", f"min(__first) OVER (PARTITION BY {by_key} ORDER BY __slot DESC"
                                " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS __hit").where("__hit IS NOT NULL")

    no_row = F.lit(None).cast(asks.schema["__row"].dataType)
    union = asks.select(*keys, "__slot", "__at", none.alias("__hit"), "__row")
    union = union.unionByName(hits.select(*keys, "__slot", "__at", F.col("__at").alias("__hit"), no_row.alias("__row")))
    union = union.unionByName(carried.select(*keys, "__slot", F.col("__hit").alias("__at"), "__hit", no_row.alias("__row")))
    # from the latest position on: rows at the same position see each other
    found = union.withColumn(name, F.expr(f"min(__hit) OVER (PARTITION BY {by_key}, __slot ORDER BY __at DESC"
                                          " RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
    matched = found.where("__row IS NOT NULL").select("__row.*", name)
    rest = left.where(f"NOT ({have}) OR ({left_at}) IS NULL").withColumn(name, none)
    return matched.unionByName(rest)
