"""Session quality: funnel depth per (user, country, channel, device).

The rank is DENSE_RANK within country by (depth desc, total_events desc).
Windowing the user rows by country would put every user of a country into one
task.

* The top-n report takes the first n rows in that order - each task keeps its
  own n and one task merges those. Whatever ranks before a row in its country is
  then among them too, so the rank of the n rows is found within them alone.
* All rows are ranked by a sorted scan (`operators.prefix`): range-partitioned by
  (country, depth, events, user), ranked inside each partition, plus what the
  partitions before held. One shuffle gives both rank and order.

The country average is sum(depth) / count(rows) of a country: integer sums are
exact. A NULL country gets a NULL average, as the correlated
`WHERE ud2.country = ud.country` gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.operators.joins import bounded_by_limit, small_lookup
from funnelkit.operators.ordering import order, order_small
from funnelkit.operators.prefix import sorted_scan

DEPTH_SQL = ("max(CASE event_type WHEN 'purchase' THEN 3 WHEN 'cart' THEN 2 WHEN 'view' THEN 1 ELSE 0 END)"
             " AS depth_score")
# The labels of the depth scores.
LABEL_SQL = ("CASE depth_score WHEN 3 THEN 'converted' WHEN 2 THEN 'carted_no_purchase'"
             " WHEN 1 THEN 'view_only' ELSE 'unknown' END AS quality_label")
OUTPUT = ("user_id", "country", "channel", "device", "depth_score", LABEL_SQL, "total_events",
          "country_avg_depth", "round(depth_score - country_avg_depth, 2) AS vs_country_avg", "rank_in_country")
ORDER = ("country ASC NULLS FIRST", "rank_in_country", "user_id", "channel", "device")
RANK_KEY = ("depth_score", "total_events")


def user_depth(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", "country", "channel", "device").agg(
        F.expr(DEPTH_SQL), F.expr("count(1) AS total_events"))


def country_averages(ud: DataFrame) -> DataFrame:
    """(a_country, country_avg_depth), one row a country, NULL included."""
    return ud.groupBy(F.col("country").alias("a_country")).agg(F.expr(
        "CASE WHEN a_country IS NOT NULL THEN round(CAST(sum(depth_score) AS DOUBLE) / count(1), 2) END AS country_avg_depth"))


def ranked(ud: DataFrame) -> DataFrame:
    """Every row with rank_in_country, in the order of the report."""
    return sorted_scan(ud, ["country"], ["depth_score DESC", "total_events DESC", "user_id", "channel", "device"],
                       rank="rank_in_country", rank_by=RANK_KEY)


def rank_ladder(ud: DataFrame) -> DataFrame:
    """(country, depth_score, total_events, users, rank_in_country): the distinct triples with their ranks, in order."""
    triples = ud.groupBy("country", *RANK_KEY).agg(F.expr("count(1) AS users"))
    return sorted_scan(triples, ["country"], ["depth_score DESC", "total_events DESC"], rank="rank_in_country", rank_by=RANK_KEY)


def session_quality(events: DataFrame, limit: int = 500) -> DataFrame:
    """Top `limit` rows by (country, rank) with deterministic tie-breaks."""
    ud = user_depth(events)
    top = order(ud, "country ASC NULLS FIRST", "depth_score DESC", "total_events DESC", "user_id", "channel", "device")
    rows = bounded_by_limit(top, limit).join(country_averages(ud), F.expr("country <=> a_country"))
    rank = "dense_rank() OVER (PARTITION BY country ORDER BY depth_score DESC, total_events DESC) AS rank_in_country"
    return order_small(rows.coalesce(1).selectExpr("*", rank).selectExpr(*OUTPUT), *ORDER)


def session_quality_full(events: DataFrame) -> DataFrame:
    """Every (user, country, channel, device) row with its rank, in order."""
    rows = ranked(user_depth(events))
    averages, few = small_lookup(country_averages(rows))
    out = rows.join(averages, F.expr("country <=> a_country")).selectExpr(*OUTPUT)
    return out if few else order(out, *ORDER)


def depth_window(events: DataFrame) -> DataFrame:
    """The rank ladder itself: how many rows share each (country, rank)."""
    return rank_ladder(user_depth(events))


def depth_correlated(events: DataFrame) -> DataFrame:
    """The country average as the left join that the correlated scalar subquery means.

    The join is left to adaptive execution, which measures the averages.
    """
    rows = ranked(user_depth(events))
    averages = country_averages(rows).where("a_country IS NOT NULL")
    return order(rows.join(averages, F.expr("country = a_country"), "left").selectExpr(*OUTPUT), *ORDER)
