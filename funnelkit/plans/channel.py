"""Channel x country reports built on one shared (country, channel) aggregate.

`channel_cells` is COUNT(DISTINCT user) / COUNT(DISTINCT purchasing user) per
(country, channel) in flags form. It has at most |countries| x |channels|
rows and is kept in one partition, so everything downstream (ranking window,
rollup, per-channel averages as window aggregates) runs on a handful of rows
without another exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.functions.rates import avg_of_rates_sql, pct_sql
from funnelkit.operators.flags import flag_sql, segment_users
from funnelkit.operators.ordering import order_small, small

CELL_CVR = f"{pct_sql('purchasers', 'sessions')} AS cvr_pct"
ROW_TYPE = "CASE gid WHEN 0 THEN 'detail' WHEN 1 THEN 'channel_total' ELSE 'grand_total' END AS row_type"
# country / channel labelled 'ALL' where the grouping set rolled them up
LABELS = ("CASE WHEN gid & 1 = 1 THEN 'ALL' ELSE country END AS country",
          "CASE WHEN gid & 2 = 2 THEN 'ALL' ELSE channel END AS channel")
ROLLUP_ORDER = ("row_type", "cvr_pct DESC", "country", "channel")


def channel_cells(events: DataFrame) -> DataFrame:
    """(country, channel, sessions, purchasers, cvr_pct), in one partition.

    At most |countries| x |channels| rows, so the ranking window, rollup and
    channel averages below run in that partition without another exchange.
    """
    return small(segment_users(events, ["country", "channel"]).selectExpr("*", CELL_CVR))


def channel_rank(events: DataFrame, min_sessions: int = 50) -> DataFrame:
    """Channels ranked by CVR within each country (dense rank, ties share)."""
    ranked = channel_cells(events).where(f"sessions >= {int(min_sessions)}").selectExpr(
        "country", "channel", "sessions", "purchasers", "cvr_pct",
        "dense_rank() OVER (PARTITION BY country ORDER BY cvr_pct DESC) AS rank_in_country")
    return order_small(ranked, "country", "rank_in_country", "channel")


def channel_country_rollup(events: DataFrame, min_sessions: int = 30) -> DataFrame:
    """Detail cells, per-channel subtotals and a grand total in one ROLLUP.

    Subtotals *sum the per-cell distinct counts of the kept cells* (a user
    active in two countries counts twice), which is the report's definition;
    `segment_cube` is the true distinct rollup.
    """
    cells = channel_cells(events).where(f"sessions >= {int(min_sessions)}")
    rolled = cells.rollup("channel", "country").agg(
        F.expr("sum(sessions) AS sessions"), F.expr("sum(purchasers) AS purchasers"),
        F.expr("grouping_id() AS gid"))
    out = rolled.selectExpr(*LABELS, "sessions", "purchasers", CELL_CVR, ROW_TYPE)
    return order_small(out, *ROLLUP_ORDER)


def rollup_union(events: DataFrame, min_sessions: int = 30) -> DataFrame:
    """The same report as three UNION ALL branches over the filtered cells."""
    cells = channel_cells(events).where(f"sessions >= {int(min_sessions)}")
    detail = cells.selectExpr("country", "channel", "sessions", "purchasers", "cvr_pct", "'detail' AS row_type")
    sums = [F.expr("sum(sessions) AS sessions"), F.expr("sum(purchasers) AS purchasers")]
    by_channel = cells.groupBy("channel").agg(*sums).selectExpr(
        "'ALL' AS country", "channel", "sessions", "purchasers", CELL_CVR, "'channel_total' AS row_type")
    grand = cells.agg(*sums).selectExpr(
        "'ALL' AS country", "'ALL' AS channel", "sessions", "purchasers", CELL_CVR, "'grand_total' AS row_type")
    return order_small(detail.unionByName(by_channel).unionByName(grand), *ROLLUP_ORDER)


def segment_cube(events: DataFrame) -> DataFrame:
    """True distinct rollup over (channel, country): users are not double counted.

    Events collapse to (channel, country, user) flags first; GROUPING SETS then
    expand those, not the events, and the flags are summed per set.
    """
    flags = events.where("user_id IS NOT NULL").groupBy("channel", "country", "user_id").agg(
        F.expr(f"{flag_sql('purchase')} AS p"))
    per_user = flags.groupingSets(
        [["channel", "country", "user_id"], ["channel", "user_id"], ["user_id"]],
        "channel", "country", "user_id",
    ).agg(F.expr("max(p) AS did_purchase"), F.expr("grouping(channel) * 2 + grouping(country) AS gid"))
    agg = per_user.groupBy("gid", "channel", "country").agg(
        F.expr("count(1) AS sessions"), F.expr("sum(did_purchase) AS purchasers"))
    out = agg.selectExpr(*LABELS, "sessions", "purchasers", CELL_CVR, ROW_TYPE)
    return order_small(out, *ROLLUP_ORDER)


def channel_vs_average(events: DataFrame, min_sessions: int = 50, band: float = 0.10) -> DataFrame:
    """Each kept (channel, country) cell against the channel's unweighted mean CVR.

    The detail-to-own-aggregate join is a window aggregate over the channel:
    same rows as joining the per-channel averages back, without a join.
    """
    cells = channel_cells(events).where(f"sessions >= {int(min_sessions)}")
    with_avg = cells.selectExpr(
        "*", f"{avg_of_rates_sql('cvr_pct', 'OVER (PARTITION BY channel)')} AS channel_avg_cvr_pct")
    hi, lo = repr(1.0 + band), repr(1.0 - band)
    out = with_avg.selectExpr(
        "channel", "country", "sessions",
        "cvr_pct AS country_cvr_pct",
        "channel_avg_cvr_pct",
        "round(cvr_pct - channel_avg_cvr_pct, 2) AS vs_channel_avg_pp",
        f"CASE WHEN cvr_pct > channel_avg_cvr_pct * {hi}D THEN 'outperforming'"
        f" WHEN cvr_pct < channel_avg_cvr_pct * {lo}D THEN 'underperforming'"
        " ELSE 'in_line' END AS performance_flag",
    )
    return order_small(out, "channel", "vs_channel_avg_pp DESC", "country")


def distinct_vs_flags(events: DataFrame) -> DataFrame:
    """COUNT(DISTINCT ...) and the flags rewrite side by side per cell.

    Both pairs must be equal; the flags form avoids the Expand that two
    distinct aggregates with different arguments need.
    """
    distinct = events.groupBy("country", "channel").agg(
        F.expr("count(DISTINCT user_id) AS sessions_distinct"),
        F.expr("count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS purchasers_distinct"))
    flags = segment_users(events, ["country", "channel"]).withColumnsRenamed(
        {"sessions": "sessions_flags", "purchasers": "purchasers_flags"})
    joined = distinct.join(flags, ["country", "channel"])
    return order_small(joined, "country", "channel")


def sessions_approx_check(events: DataFrame, rsd: float = 0.05, allowed: float = 0.2) -> DataFrame:
    """Exact distinct users per cell, and whether the estimate lies within `allowed` (four times `rsd`) of them."""
    exact = segment_users(events, ["country", "channel"])
    est = sessions_approx(events, rsd).select("country", "channel", "sessions_approx", "purchasers_approx")
    near = f"abs({{0}}_approx - {{0}}) <= {allowed}D * {{0}} + 2 AS {{0}}_estimate_ok"
    out = exact.join(est, ["country", "channel"]).selectExpr(
        "country", "channel", "sessions", "purchasers", near.format("sessions"), near.format("purchasers"))
    return order_small(out, "country", "channel")


def sessions_approx(events: DataFrame, rsd: float = 0.05) -> DataFrame:
    """HyperLogLog++ estimate of distinct users per cell (scale variant)."""
    agg = events.groupBy("country", "channel").agg(
        F.expr(f"approx_count_distinct(user_id, {rsd}) AS sessions_approx"),
        F.expr(f"approx_count_distinct(CASE WHEN event_type = 'purchase' THEN user_id END, {rsd})"
               " AS purchasers_approx"))
    return order_small(agg, "country", "channel")
