"""Canonical event tables derived from the driver's parquet tables.

`clickstream`  - from `events.parquet` (one month, microsecond times).
`order_events` - from orders joined to customer, nation and region (long date
                 range, real dimension joins).

Both return the canonical schema (`schema.CANONICAL_COLUMNS`). The derivation
is pure column expressions over the scan, so filters and column pruning of
downstream reports reach the parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit import schema
from funnelkit.functions.dims import with_dimensions

# How the driver's event vocabulary maps onto the funnel stages
# (rows of any other type are not funnel events).
CLICK_EVENT_MAP = {"view": "view", "click": "view", "signup": "cart", "purchase": "purchase"}
# order status -> funnel stage
ORDER_STATUS_MAP = {"O": "view", "P": "cart", "F": "purchase"}
# number of sub-users each driver user id is split into (by event_id % USER_SPLIT)
USER_SPLIT = 16


def _map_values(col: str, mapping: dict[str, str]):
    expr = None
    for raw, mapped in mapping.items():
        cond = F.col(col) == F.lit(raw)
        expr = F.when(cond, F.lit(mapped)) if expr is None else expr.when(cond, F.lit(mapped))
    return expr


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clickstream_from(ev: DataFrame) -> DataFrame:
    """Canonical events from rows shaped like `events.parquet` (batch or stream)."""
    base = ev.where(F.col("event_type").isin(*CLICK_EVENT_MAP)).select(
        F.col("event_id"),
        F.col("ts").alias("event_time"),
        _map_values("event_type", CLICK_EVENT_MAP).alias("event_type"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"),
                 (F.col("event_id") % USER_SPLIT).cast("string")).alias("user_id"),
        F.col("value").cast("decimal(18,2)").alias("price"),
    )
    return with_dimensions(base, "event_id").select(*schema.CANONICAL_COLUMNS)


def clickstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clickstream_from(table(spark, sf_dir, "events"))


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders x customer x nation x region as funnel events.

    nation (25 rows) and region (5 rows) are fixed-size reference tables and
    are broadcast; customer grows with the scale factor and is joined by key
    (AQE picks broadcast or sort-merge from its measured size and splits a
    skewed customer's partition).
    """
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    # both lookups broadcast side by side (independent, so their jobs run in parallel)
    customer = (
        table(spark, sf_dir, "customer")
        .select("c_custkey", "c_nationkey", "c_mktsegment")
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "c_mktsegment", "r_name")
    )
    orders = (
        table(spark, sf_dir, "orders")
        .where(F.col("o_orderstatus").isin(*ORDER_STATUS_MAP))
        .select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    )
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return joined.select(
        F.col("o_orderkey").alias("event_id"),
        F.col("o_orderdate").alias("event_time"),
        _map_values("o_orderstatus", ORDER_STATUS_MAP).alias("event_type"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("r_name").alias("country"),
        F.col("c_mktsegment").alias("device"),
        F.col("o_orderpriority").alias("channel"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
    )

