"""Running totals and previous values over series too long for one task (see `operators.prefix`)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.operators.prefix import sorted_scan


def running_events_by_minute(events: DataFrame) -> DataFrame:
    """minute, events, purchases, running_events, running_purchases, prev_events, prev_minute; in order."""
    minutes = events.where("event_time IS NOT NULL").groupBy(F.expr("date_trunc('MINUTE', event_time) AS minute")).agg(
        F.expr("count(1) AS events"), F.expr("count_if(event_type = 'purchase') AS purchases"))
    return sorted_scan(minutes.withColumn("minute", F.col("minute").cast("timestamp_ntz")), [], ["minute"],
                       sums={"running_events": "events", "running_purchases": "purchases"},
                       lags={"prev_events": "events", "prev_minute": "minute"})


def purchase_sequence(events: DataFrame) -> DataFrame:
    """user_id, event_id, event_time, cents, purchase_no, running_cents, prev_purchase_time: each user's purchases in order.

    Purchases at the same instant go by event_id; a NULL price adds nothing.
    """
    purchases = events.where("event_type = 'purchase' AND user_id IS NOT NULL AND event_time IS NOT NULL").selectExpr(
        "user_id", "event_id", "event_time", "CAST(price * 100 AS BIGINT) AS cents")
    return sorted_scan(purchases, ["user_id"], ["event_time", "event_id"], rank="purchase_no", rank_by=("event_time", "event_id"),
                       sums={"running_cents": "cents"}, lags={"prev_purchase_time": "event_time"})
