"""Home-segment funnels: each user counted once, in their modal segment.

Dimensions are drawn per event, so one user spans several countries, devices
and channels. These reports give each user the segment they appear in most
(ties to the smallest value) and count lenient stage flags over *all* the
user's events. Rates divide first and scale second (`x / y * 100`), rounded to
2 decimals; zero denominators give NULL.

One user-grain aggregate (`user_profile`) feeds every report here: flags and
all three modes are computed in a single shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit import schema
from funnelkit.functions.rates import div_first_pct_sql
from funnelkit.operators.flags import user_profile
from funnelkit.operators.ordering import order_small


def _home_counts(profile: DataFrame, dim: str) -> DataFrame:
    return profile.groupBy(F.col(f"home_{dim}").alias(dim)).agg(
        F.expr("sum(viewed) AS viewers"), F.expr("sum(carted) AS carted"), F.expr("sum(purchased) AS purchasers"))


def home_funnel(events: DataFrame, dim: str = "country", profile: DataFrame | None = None) -> DataFrame:
    """dim, viewers, carted, purchasers, v2c_pct, c2p_pct, overall_cvr; best first."""
    if dim not in schema.DIMENSIONS:
        raise ValueError(f"home segment must be one of {schema.DIMENSIONS}, got {dim!r}")
    counts = _home_counts(profile if profile is not None else user_profile(events), dim)
    out = counts.selectExpr(
        dim, "viewers", "carted", "purchasers",
        f"{div_first_pct_sql('carted', 'viewers')} AS v2c_pct",
        f"{div_first_pct_sql('purchasers', 'carted')} AS c2p_pct",
        f"{div_first_pct_sql('purchasers', 'viewers')} AS overall_cvr",
    )
    return order_small(out, "overall_cvr DESC NULLS LAST", dim)


def home_channel_funnel(events: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """channel, viewers, carted, purchasers, overall_cvr; best first."""
    counts = _home_counts(profile if profile is not None else user_profile(events), "channel")
    out = counts.selectExpr("channel", "viewers", "carted", "purchasers",
                            f"{div_first_pct_sql('purchasers', 'viewers')} AS overall_cvr")
    return order_small(out, "overall_cvr DESC NULLS LAST", "channel")


def channel_country_matrix(events: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """CVR per (home channel, home country) pivoted to one column per country present.

    The pivot runs on the already aggregated (channel, country) cells; Spark
    finds their countries with one job over the cells.
    """
    p = profile if profile is not None else user_profile(events)
    cells = p.groupBy(F.col("home_channel").alias("channel"), F.col("home_country").alias("country")).agg(
        F.expr(f"{div_first_pct_sql('sum(purchased)', 'sum(viewed)')} AS cvr"))
    matrix = cells.groupBy("channel").pivot("country").agg(F.expr("first(cvr)"))
    return order_small(matrix, "channel")


def channel_conversion_summary(events: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """channel, users (all users whose home channel it is), converters, cvr."""
    p = profile if profile is not None else user_profile(events)
    agg = p.groupBy(F.col("home_channel").alias("channel")).agg(
        F.expr("count(1) AS users"), F.expr("sum(purchased) AS converters"))
    out = agg.selectExpr("channel", "users", "converters", f"{div_first_pct_sql('converters', 'users')} AS cvr")
    return order_small(out, "cvr DESC NULLS LAST", "channel")
