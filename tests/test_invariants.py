"""Invariants between reports and determinism under different partitionings."""

from __future__ import annotations

import pytest

from funnelkit.plans import channel, cohort, funnel, home, trend
from funnelkit.sources.fixtures import clickstream, order_events
from tests.conftest import SF_CHECK
from tests.helpers import as_dicts, canon


@pytest.fixture(scope="module")
def click(spark):
    return clickstream(spark, SF_CHECK)


def test_sequential_stages_are_nested(click):
    for r in as_dicts(funnel.country_funnel_seq(click)):
        assert r["purchasers"] <= r["carted"] <= r["viewers"]


def test_rollup_totals_equal_detail_sums(click):
    rows = as_dicts(channel.channel_country_rollup(click))
    detail = [r for r in rows if r["row_type"] == "detail"]
    totals = {r["channel"]: r for r in rows if r["row_type"] == "channel_total"}
    for ch, t in totals.items():
        assert t["sessions"] == sum(r["sessions"] for r in detail if r["channel"] == ch)
        assert t["purchasers"] == sum(r["purchasers"] for r in detail if r["channel"] == ch)
    grand = [r for r in rows if r["row_type"] == "grand_total"][0]
    assert grand["sessions"] == sum(r["sessions"] for r in detail)


def test_running_carts_end_at_total_and_lag_starts_null(click):
    hours = as_dicts(trend.hourly_abandonment(click))
    assert hours[-1]["running_carts"] == sum(r["cart_users"] for r in hours)
    weeks = as_dicts(trend.weekly_trend(click))
    assert weeks[0]["prev_week_cvr"] is None and weeks[0]["wow_cvr_change_pp"] is None


def test_home_viewers_sum_to_overall(click):
    overall = as_dicts(funnel.overall_funnel(click))[0]
    for dim in ("country", "device"):
        assert sum(r["viewers"] for r in as_dicts(home.home_funnel(click, dim))) == overall["viewers"]


def test_flags_equal_distinct(click):
    for r in as_dicts(channel.distinct_vs_flags(click)):
        assert r["sessions_distinct"] == r["sessions_flags"]
        assert r["purchasers_distinct"] == r["purchasers_flags"]


def test_one_pass_cohort_equals_selfjoin(spark):
    ev = order_events(spark, SF_CHECK)
    assert as_dicts(cohort.cohort_retention(ev)) == as_dicts(cohort.cohort_selfjoin(ev))


@pytest.mark.parametrize("report", [funnel.country_funnel, channel.channel_vs_average, cohort.cohort_retention,
                                    home.channel_country_matrix])
def test_same_result_for_1_and_200_partitions(spark, click, report):
    results = []
    for parts in ("1", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            df = report(click)
            results.append(canon([tuple(r) for r in df.collect()], df.columns))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]
