"""What happens after a cart or a view: abandoned carts and time to purchase."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.functions.rates import pct_sql
from funnelkit.operators.intervals import DAY, HOUR, micros_sql, next_after
from funnelkit.operators.ordering import order_small
from funnelkit.operators.quantiles import quantile_disc
from funnelkit.session import saved

USABLE = "user_id IS NOT NULL AND event_time IS NOT NULL"
PERCENTS = (25, 50, 75, 90)


def cart_abandoners(events: DataFrame, hours: int = 2) -> DataFrame:
    """event_id, user_id, cart_time, country, device, channel, next_purchase_time: carts to follow up.

    A cart is abandoned if its user makes no purchase from its instant on until
    `hours` later, that instant included. The user's next purchase after that,
    if any, is reported.
    """
    at = F.expr(f"{micros_sql('event_time')} AS at")
    carts = events.where(f"event_type = 'cart' AND {USABLE}").select(
        "event_id", "user_id", F.col("event_time").alias("cart_time"), "country", "device", "channel", at)
    purchases = events.where(f"event_type = 'purchase' AND {USABLE}").select("user_id", at)
    found = next_after(carts, purchases, ["user_id"], "at", "at", slot=hours * HOUR)
    return found.where(f"next_at IS NULL OR next_at - at > {hours * HOUR}L").select(
        "event_id", "user_id", "cart_time", "country", "device", "channel",
        F.expr("CAST(timestamp_micros(next_at) AS TIMESTAMP_NTZ) AS next_purchase_time"))


def time_to_purchase(events: DataFrame) -> DataFrame:
    """channel, n, p25_s, p50_s, p75_s, p90_s, same_day_pct: from a user's first view in a channel to their next purchase there.

    n counts the (user, channel) pairs with such a purchase. The quantiles are
    exact (discrete) and in seconds; same day means the same UTC date.
    """
    at = F.expr(f"{micros_sql('event_time')} AS at")
    usable = events.where(USABLE).select("user_id", "channel", "event_type", at)
    views = usable.where("event_type = 'view' AND channel IS NOT NULL").groupBy("user_id", "channel").agg(F.min("at").alias("at"))
    purchases = usable.where("event_type = 'purchase'").select("user_id", "channel", "at")
    pairs = saved(next_after(views, purchases, ["user_id", "channel"], "at", "at", slot=DAY).where("next_at IS NOT NULL").selectExpr(
        "channel", "next_at - at AS micros", f"floor(at / {DAY}D) = floor(next_at / {DAY}D) AS same_day"), "time-to-purchase")
    quantiles = quantile_disc(pairs, ["channel"], "micros", PERCENTS)
    same = pairs.groupBy(F.col("channel").alias("s_channel")).agg(
        F.expr(f"{pct_sql('count_if(same_day)', 'count(1)')} AS same_day_pct"))
    out = quantiles.join(same, F.expr("channel = s_channel")).selectExpr(
        "channel", "n", *[f"p{p} / 1000000.0D AS p{p}_s" for p in PERCENTS], "same_day_pct")
    return order_small(out, "channel")
