"""Stage-conversion funnels.

Three definitions coexist and are kept apart on purpose:

* lenient (SQL reports): grain (user, segment); viewers are users with a view;
  zero denominators give NULL.
* sequential (dashboard): grain (user, segment); viewers are *all* users of the
  segment and a purchaser must also have carted; zero denominators give 0.
* home segment (notebook): see `plans.home`.

None of them checks event order, only presence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit import schema
from funnelkit.functions.rates import pct0_sql, pct_sql, ratio_sql
from funnelkit.operators.flags import user_flags
from funnelkit.operators.ordering import order_small

LENIENT_RATES = (
    f"{pct_sql('carted', 'viewers')} AS view_to_cart_pct",
    f"{pct_sql('purchasers', 'carted')} AS cart_to_purchase_pct",
    f"{pct_sql('purchasers', 'viewers')} AS overall_cvr_pct",
)
SEQUENTIAL_RATES = (
    f"{pct0_sql('carted', 'viewers')} AS view_to_cart_pct",
    f"{pct0_sql('purchasers', 'carted')} AS cart_to_purchase_pct",
    f"{pct0_sql('purchasers', 'viewers')} AS overall_cvr_pct",
)


def lenient_segment(events: DataFrame, dim: str) -> DataFrame:
    """(dim, total_users, viewers, carted, purchasers) at the (user, dim) grain."""
    return user_flags(events, [dim]).groupBy(dim).agg(
        F.expr("count(1) AS total_users"),
        F.expr("sum(did_view) AS viewers"),
        F.expr("sum(did_cart) AS carted"),
        F.expr("sum(did_purchase) AS purchasers"),
    )


def country_funnel(events: DataFrame) -> DataFrame:
    """Lenient funnel per country, worst overall conversion first."""
    out = lenient_segment(events, "country").selectExpr("country", "viewers", "carted", "purchasers", *LENIENT_RATES)
    return order_small(out, "overall_cvr_pct ASC NULLS FIRST", "country")


def device_funnel(events: DataFrame, low_sample: int = 1000) -> DataFrame:
    """Lenient funnel per device with a small-sample flag, best first."""
    out = lenient_segment(events, "device").selectExpr(
        "device", "viewers", "carted", "purchasers", *LENIENT_RATES,
        f"CASE WHEN total_users < {int(low_sample)} THEN 'low_sample' ELSE 'ok' END AS sample_flag")
    return order_small(out, "overall_cvr_pct DESC NULLS LAST", "device")


# --------------------------------------------------------------------------
# sequential (dashboard) definitions
# --------------------------------------------------------------------------

def _sequential_counts(flags: DataFrame, keys: list[str]) -> DataFrame:
    aggs = [F.expr("count(1) AS viewers"), F.expr("sum(did_cart) AS carted"),
            F.expr("sum(did_cart * did_purchase) AS purchasers")]
    if "n_events" in flags.columns:
        aggs.append(F.expr("sum(n_events) AS total_events"))
    return flags.groupBy(*keys).agg(*aggs)


def sequential_segment(events: DataFrame, dim: str) -> DataFrame:
    """(dim, viewers, carted, purchasers) under the sequential definition."""
    return _sequential_counts(user_flags(events, [dim]), [dim])


def country_funnel_seq(events: DataFrame) -> DataFrame:
    out = sequential_segment(events, "country").selectExpr(
        "country", "viewers", "carted", "purchasers", *SEQUENTIAL_RATES)
    return order_small(out, "overall_cvr_pct DESC", "country")


def channel_cvr_seq(events: DataFrame) -> DataFrame:
    out = sequential_segment(events, "channel").selectExpr(
        "channel", "viewers AS sessions", "purchasers AS purchases",
        f"{pct0_sql('purchasers', 'viewers')} AS cvr_pct")
    return order_small(out, "cvr_pct DESC", "channel")


def device_cvr_seq(events: DataFrame) -> DataFrame:
    out = sequential_segment(events, "device").selectExpr(
        "device", f"{pct0_sql('purchasers', 'viewers')} AS cvr_pct")
    return order_small(out, "cvr_pct DESC", "device")


def worst_market(events: DataFrame) -> DataFrame:
    """The country with the lowest sequential overall CVR (ties: first name)."""
    out = sequential_segment(events, "country").selectExpr(
        "country", "viewers", "carted", "purchasers", *SEQUENTIAL_RATES)
    return order_small(out, "overall_cvr_pct", "country").limit(1)


def funnel_counts(events: DataFrame) -> DataFrame:
    """One row: sequential viewers, carted, purchasers and total events."""
    return _sequential_counts(user_flags(events, with_count=True), [])


def funnel_kpis(events: DataFrame) -> DataFrame:
    """Headline KPIs of the overview page (sequential funnel)."""
    return funnel_counts(events).selectExpr(
        "viewers", "carted", "purchasers", "total_events",
        "coalesce(round(100.0D * (1.0D - purchasers / nullif(carted, 0)), 1), 0.0D) AS cart_abandon_rate",
        f"{pct0_sql('purchasers', 'viewers')} AS overall_cvr",
    )


def funnel_stages(events: DataFrame) -> DataFrame:
    """The funnel chart's data: one row per stage with % of the first stage."""
    stages = funnel_counts(events).selectExpr(
        "viewers",
        "stack(3, 1, '{}', viewers, 2, '{}', carted, 3, '{}', purchasers)".format(*schema.STAGE_LABELS)
        + " AS (stage_order, stage, users)",
    )
    out = stages.selectExpr("stage_order", "stage", "users", f"{pct0_sql('users', 'viewers', 1)} AS pct_of_initial")
    return order_small(out, "stage_order")


def overall_funnel(events: DataFrame) -> DataFrame:
    """Lenient overall funnel with unrounded ratios (NULL on zero)."""
    c = user_flags(events).agg(
        F.expr("sum(did_view) AS viewers"), F.expr("sum(did_cart) AS carted"),
        F.expr("sum(did_purchase) AS purchasers"))
    return c.selectExpr(
        "viewers", "carted", "purchasers",
        f"{ratio_sql('carted', 'viewers')} AS v2c_rate",
        f"{ratio_sql('purchasers', 'carted')} AS c2p_rate",
        f"{ratio_sql('purchasers', 'viewers')} AS overall",
    )
