"""Order value and purchase frequency per country (two-level aggregation).

Per-(user, country) purchase count and spend first, then per country, so a
country with heavy buyers does not dominate a naive per-order average. Money
stays DECIMAL(18,2) through the sums (exact and order-independent) and is
converted to DOUBLE only for the final division.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.functions.rates import pct_sql
from funnelkit.operators.ordering import order_small


def user_purchases(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'purchase'").groupBy("user_id", "country").agg(
        F.expr("count(1) AS purchase_count"), F.expr("sum(price) AS total_spend"))


def order_value(events: DataFrame, min_buyers: int = 20) -> DataFrame:
    """country, buyers, avg_orders_per_buyer, avg_spend_per_buyer, aov, repeat_buyer_rate_pct."""
    spend = "CAST(sum(total_spend) AS DOUBLE)"
    agg = user_purchases(events).groupBy("country").agg(
        F.expr("count(user_id) AS buyers"),
        F.expr("round(avg(purchase_count), 2) AS avg_orders_per_buyer"),
        F.expr(f"round({spend} / nullif(count(total_spend), 0), 2) AS avg_spend_per_buyer"),
        F.expr(f"round({spend} / nullif(sum(purchase_count), 0), 2) AS aov"),
        F.expr("count(CASE WHEN purchase_count > 1 THEN user_id END) AS repeaters"),
    )
    out = agg.where(f"buyers >= {int(min_buyers)}").selectExpr(
        "country", "buyers", "avg_orders_per_buyer", "avg_spend_per_buyer", "aov",
        f"{pct_sql('repeaters', 'buyers')} AS repeat_buyer_rate_pct")
    return order_small(out, "avg_spend_per_buyer DESC NULLS LAST", "country")
