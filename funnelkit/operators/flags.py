"""User-grain stage flags: the shared intermediate of almost every report.

Every funnel report first collapses events to one row per user (or per user and
segment) holding 0/1 flags, then sums the flags per segment. Expressed as two
hash aggregations, Spark runs a partial (map-side) aggregate before each
shuffle, so a user with a huge number of events still sends at most one row per
map task and grouping key across the network: hot users cannot skew the stage.

Expressions are written as SQL snippets (`F.expr`): the same Catalyst
expressions, built with one driver->JVM call each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelkit import schema

FLAG_NAMES = {"view": "did_view", "cart": "did_cart", "purchase": "did_purchase"}


def is_type(event_type: str) -> Column:
    return F.expr(f"event_type = '{event_type}'")


def flag_sql(event_type: str) -> str:
    return f"max(CASE WHEN event_type = '{event_type}' THEN 1 ELSE 0 END)"


def user_flags(events: DataFrame, dims: Sequence[str] = (), with_count: bool = False) -> DataFrame:
    """(user_id, *dims, did_view, did_cart, did_purchase[, n_events]).

    GROUP BY semantics: a NULL user_id forms one group, as in the SQL reports
    that count rows of this grain.
    """
    aggs = [F.expr(f"{flag_sql(t)} AS {FLAG_NAMES[t]}") for t in schema.EVENT_TYPES]
    if with_count:
        aggs.append(F.expr("count(1) AS n_events"))
    return events.groupBy("user_id", *dims).agg(*aggs)


def segment_users(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """COUNT(DISTINCT user_id) and COUNT(DISTINCT purchasing user_id) per key.

    Flags form: one (key, user) aggregate then a sum. No Expand node, unlike
    two DISTINCT aggregates in one SELECT. NULL user ids are skipped, as
    COUNT(DISTINCT) does.
    """
    per_user = (
        events.where("user_id IS NOT NULL")
        .groupBy(*keys, "user_id")
        .agg(F.expr(f"{flag_sql('purchase')} AS did_purchase"))
    )
    return per_user.groupBy(*keys).agg(F.expr("count(1) AS sessions"), F.expr("sum(did_purchase) AS purchasers"))


def user_profile(events: DataFrame) -> DataFrame:
    """One row per user: lenient flags, event count and modal dimensions.

    The modal value breaks ties towards the smallest value; NULLs do not count.
    One aggregate with one exchange, on user_id: `mode` keeps value -> count per
    user, counted in each task before the exchange and merged after it, so a
    user's size is bounded by the dimension's values, not by their events.
    """
    return events.groupBy("user_id").agg(
        F.expr(f"{flag_sql('view')} AS viewed"),
        F.expr(f"{flag_sql('cart')} AS carted"),
        F.expr(f"{flag_sql('purchase')} AS purchased"),
        F.expr("count(1) AS n_events"), *_modes())


def _modes():
    return [F.expr(f"mode({d}, true) AS home_{d}") for d in schema.DIMENSIONS]


def user_mode_dims(events: DataFrame) -> DataFrame:
    """(user_id, home_country, home_device, home_channel)."""
    return events.groupBy("user_id").agg(*_modes())


def event_sets(events: DataFrame) -> DataFrame:
    """The set of event types per user as sorted text plus membership flags.

    Built from flags rather than `collect_set`: the set has at most three
    members, so concatenating the present names in sorted order is the same
    value without materialising an array per group.
    """
    present = ", ".join(f"CASE WHEN {FLAG_NAMES[t]} = 1 THEN '{t}' END" for t in sorted(schema.EVENT_TYPES))
    return user_flags(events).selectExpr(
        "user_id",
        f"concat_ws(',', {present}) AS event_set",
        "did_view = 1 AS has_view",
        "did_cart = 1 AS has_cart",
        "did_purchase = 1 AS has_purchase",
        "did_cart = 1 AND did_purchase = 1 AS sequential_purchase",
    )
