"""First-purchase cohorts and 60-day repeat purchase.

A buyer repeats when some purchase falls in (t0, t0 + window], t0 being the
first purchase. Only the earliest later purchase matters, so the question is
"is the second-smallest *distinct* purchase time within the window".

`cohort_retention` answers it without a self-join:

1. distinct (user, time) purchases (hash aggregate, map-side pre-aggregated);
2. `row_number() <= 2` per user ordered by time. Spark plans this as a
   WindowGroupLimit that also runs *before* the shuffle, so each map task
   sends at most two rows per user: a user holding a third of all purchases
   costs two rows per task, not a third of the data in one task;
3. one aggregate per user, one per month (tiny).

`cohort_selfjoin` does the same through the general `interval_join` (equi key,
strict lower bound, inclusive upper bound); it must return the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.functions.rates import pct_sql
from funnelkit.functions.timefmt import year_month_sql
from funnelkit.operators.intervals import DAY, interval_join, micros_sql
from funnelkit.operators.ordering import order_small

SLOTS = 16
PURCHASES = "event_type = 'purchase' AND user_id IS NOT NULL AND event_time IS NOT NULL"


def first_two_purchases(events: DataFrame) -> DataFrame:
    """(user_id, first_purchase_time, next_purchase_time or NULL)."""
    times = events.where(PURCHASES).select("user_id", "event_time").distinct()
    top2 = times.selectExpr(
        "user_id", "event_time", "row_number() OVER (PARTITION BY user_id ORDER BY event_time) AS rn"
    ).where("rn <= 2")
    return top2.groupBy("user_id").agg(
        F.expr("min(event_time) AS first_purchase_time"),
        F.expr("max(CASE WHEN rn = 2 THEN event_time END) AS next_purchase_time"),
    )


def _cohort_table(per_user: DataFrame, repeat_sql: str, min_cohort: int) -> DataFrame:
    agg = per_user.groupBy(F.expr(f"{year_month_sql('first_purchase_time')} AS cohort_month")).agg(
        F.expr("count(1) AS cohort_size"),
        F.expr(f"sum(CASE WHEN {repeat_sql} THEN 1 ELSE 0 END) AS repeat_buyers"),
    )
    out = agg.where(f"cohort_size >= {int(min_cohort)}").selectExpr(
        "cohort_month", "cohort_size", "repeat_buyers",
        f"{pct_sql('repeat_buyers', 'cohort_size')} AS retention_60d_pct")
    return order_small(out, "cohort_month")


def cohort_retention(events: DataFrame, window_days: int = 60, min_cohort: int = 10) -> DataFrame:
    """cohort_month, cohort_size, repeat_buyers, retention_60d_pct."""
    repeat = (f"next_purchase_time IS NOT NULL AND "
              f"next_purchase_time <= first_purchase_time + INTERVAL {int(window_days)} DAYS")
    return _cohort_table(first_two_purchases(events), repeat, min_cohort)


def cohort_selfjoin(events: DataFrame, window_days: int = 60, min_cohort: int = 10) -> DataFrame:
    """Interval self-join form: first purchase x later purchases of the same user.

    Purchase times are distinct before the join, which goes by (user, time slot):
    the purchases of one busy user spread over the `SLOTS` slots of the window,
    and only the earliest of each slot is left for the final reduction.
    """
    p = events.where(PURCHASES).select("user_id", F.expr(f"{micros_sql('event_time')} AS at")).distinct()
    first = p.groupBy("user_id").agg(F.expr("min(at) AS first_at"))
    pairs = interval_join(first, p, ["user_id"], "first_at", "at", 1, int(window_days) * DAY, splits=SLOTS)
    repeats = pairs.groupBy("user_id", F.expr(f"at DIV {DAY}L AS day")).agg(F.expr("min(at) AS at")).groupBy("user_id").agg(
        F.expr("min(at) AS repeat_at"))
    per_user = first.join(repeats, "user_id", "left").withColumn("first_purchase_time", F.timestamp_micros("first_at"))
    return _cohort_table(per_user, "repeat_at IS NOT NULL", min_cohort)
