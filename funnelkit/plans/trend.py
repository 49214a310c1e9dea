"""Time-bucketed reports: weekly conversion trend and hourly abandonment.

Both aggregate to at most a few hundred buckets first; the global windows
(LAG over weeks, running sum over hours) then run on that tiny result only,
never on raw events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.functions.rates import pct_sql
from funnelkit.functions.timefmt import year_week_sql
from funnelkit.operators.flags import segment_users
from funnelkit.operators.ordering import order_small, small


def weekly_trend(events: DataFrame) -> DataFrame:
    """week (%Y-%W), sessions, purchasers, cvr_pct, prev_week_cvr, wow_cvr_change_pp."""
    weekly = events.where("event_time IS NOT NULL").selectExpr(
        f"{year_week_sql('event_time')} AS week", "user_id", "event_type")
    cells = small(segment_users(weekly, ["week"])).selectExpr("*", f"{pct_sql('purchasers', 'sessions')} AS cvr_pct")
    out = cells.selectExpr(
        "week", "sessions", "purchasers", "cvr_pct",
        "lag(cvr_pct) OVER (ORDER BY week) AS prev_week_cvr",
        "round(cvr_pct - lag(cvr_pct) OVER (ORDER BY week), 2) AS wow_cvr_change_pp",
    )
    return order_small(out, "week")


def hourly_abandonment(events: DataFrame) -> DataFrame:
    """Per UTC hour: distinct carting / purchasing users, abandonment, running carts.

    Only cart and purchase events need their user; every other event keeps
    its hour alive with a NULL user, so view traffic collapses to one row per
    hour in the map-side partial aggregate instead of one row per viewer.
    """
    relevant = "event_type IN ('cart', 'purchase') AND user_id IS NOT NULL"
    ev = events.where("event_time IS NOT NULL").selectExpr(
        "CAST(hour(event_time) AS INT) AS hour_of_day",
        f"CASE WHEN {relevant} THEN user_id END AS u",
        f"CASE WHEN {relevant} AND event_type = 'cart' THEN 1 ELSE 0 END AS c",
        f"CASE WHEN {relevant} AND event_type = 'purchase' THEN 1 ELSE 0 END AS p",
    )
    per_user = ev.groupBy("hour_of_day", "u").agg(F.expr("max(c) AS c"), F.expr("max(p) AS p"))
    hours = per_user.groupBy("hour_of_day").agg(F.expr("sum(c) AS cart_users"), F.expr("sum(p) AS purchase_users"))
    out = small(hours).selectExpr(
        "hour_of_day", "cart_users", "purchase_users",
        "cart_users - purchase_users AS abandoned",
        f"{pct_sql('cart_users - purchase_users', 'cart_users')} AS abandonment_rate_pct",
        "sum(cart_users) OVER (ORDER BY hour_of_day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_carts",
    )
    return order_small(out, "hour_of_day")
