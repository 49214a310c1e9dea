"""Hand-made micro tables for the edge cases each report must get right."""

from __future__ import annotations

import datetime as dt

from funnelkit.functions.timefmt import year_week
from funnelkit.operators import flags, standardise
from funnelkit.plans import channel, cohort, depth, funnel, home, trend
from tests.helpers import T0, as_dicts, events_df

DAY = dt.timedelta(days=1)


def _buyer(spark, *times):
    return events_df(spark, [("u1", "purchase", t, "DE", "mobile", "email", 10) for t in times])


def _cohort(df):
    return as_dicts(cohort.cohort_retention(df, min_cohort=1))


def test_repeat_exactly_60_days_counts(spark):
    rows = _cohort(_buyer(spark, T0, T0 + 60 * DAY))
    assert rows == [{"cohort_month": "2024-01", "cohort_size": 1, "repeat_buyers": 1, "retention_60d_pct": 100.0}]


def test_repeat_60_days_plus_one_second_does_not(spark):
    rows = _cohort(_buyer(spark, T0, T0 + 60 * DAY + dt.timedelta(seconds=1)))
    assert rows[0]["repeat_buyers"] == 0


def test_same_instant_twice_is_not_a_repeat(spark):
    assert _cohort(_buyer(spark, T0, T0))[0]["repeat_buyers"] == 0


def test_selfjoin_form_agrees_on_edges(spark):
    for times in [(T0, T0 + 60 * DAY), (T0, T0 + 61 * DAY), (T0, T0), (T0, T0 + DAY, T0 + 90 * DAY)]:
        df = _buyer(spark, *times)
        assert _cohort(df) == as_dicts(cohort.cohort_selfjoin(df, min_cohort=1))


def test_week_numbering_is_monday_first_not_iso(spark):
    df = spark.createDataFrame([(dt.datetime(2023, 1, 1),), (dt.datetime(2024, 1, 1),), (dt.datetime(2023, 1, 2),)],
                               "t timestamp_ntz")
    got = [r[0] for r in df.select(year_week("t")).collect()]
    assert got == ["2023-00", "2024-01", "2023-01"]


def test_mode_tie_takes_smallest_value(spark):
    df = events_df(spark, [("u1", "view", T0, "FR", "mobile", "email"),
                           ("u1", "view", T0, "DE", "mobile", "email")])
    assert as_dicts(flags.user_mode_dims(df))[0]["home_country"] == "DE"


def test_purchase_without_cart_lenient_vs_sequential(spark):
    df = events_df(spark, [("u1", "view", T0, "DE", "mobile", "email"),
                           ("u1", "purchase", T0, "DE", "mobile", "email")])
    lenient = as_dicts(funnel.country_funnel(df))[0]
    sequential = as_dicts(funnel.country_funnel_seq(df))[0]
    assert lenient["purchasers"] == 1
    assert sequential["purchasers"] == 0


def test_user_without_view(spark):
    df = events_df(spark, [("u1", "cart", T0, "DE", "mobile", "email")])
    lenient = as_dicts(funnel.country_funnel(df))[0]
    assert lenient["viewers"] == 0
    assert lenient["view_to_cart_pct"] is None and lenient["overall_cvr_pct"] is None
    assert lenient["cart_to_purchase_pct"] == 0.0
    sequential = as_dicts(funnel.country_funnel_seq(df))[0]
    assert sequential["viewers"] == 1 and sequential["view_to_cart_pct"] == 100.0


def test_negative_abandonment(spark):
    df = events_df(spark, [("u1", "purchase", T0, "DE", "mobile", "email")])
    row = as_dicts(trend.hourly_abandonment(df))[0]
    assert row["abandoned"] == -1 and row["abandonment_rate_pct"] is None


def test_rank_ties_share_and_do_not_skip(spark):
    rows = []
    for ch, buyers in [("email", 25), ("direct", 25), ("influencer", 10)]:
        for i in range(50):
            etype = "purchase" if i < buyers else "view"
            rows.append((f"{ch}-{i}", etype, T0, "DE", "mobile", ch))
    ranks = {r["channel"]: r["rank_in_country"] for r in as_dicts(channel.channel_rank(events_df(spark, rows)))}
    assert ranks == {"direct": 1, "email": 1, "influencer": 2}


def test_rounding_tie_goes_up(spark):
    rows = [(f"u{i}", "view", T0, "DE", "mobile", "email") for i in range(800)]
    rows.append(("u0", "purchase", T0, "DE", "mobile", "email"))
    row = as_dicts(funnel.country_funnel(events_df(spark, rows)))[0]
    assert row["overall_cvr_pct"] == 0.13


def test_null_country_gets_null_average(spark):
    df = events_df(spark, [("u1", "view", T0, None, "mobile", "email"),
                           ("u2", "purchase", T0, "DE", "mobile", "email")])
    for report in (depth.session_quality, depth.session_quality_full):
        by_user = {r["user_id"]: r for r in as_dicts(report(df))}
        assert by_user["u1"]["country_avg_depth"] is None
        assert by_user["u2"]["country_avg_depth"] == 3.0
        assert by_user["u1"]["rank_in_country"] == 1


def test_null_user_id(spark):
    df = events_df(spark, [(None, "view", T0, "DE", "mobile", "email"),
                           ("u1", "view", T0, "DE", "mobile", "email")])
    assert as_dicts(funnel.country_funnel(df))[0]["viewers"] == 2  # GROUP BY makes NULL one user
    assert {r["sessions"] for r in as_dicts(channel.channel_rank(df, min_sessions=1))} == {1}


def test_bad_timestamp_text_is_dropped(spark):
    raw = spark.createDataFrame(
        [(1, "2024-01-01 10:00:00", "view", "a"), (2, "bad", "view", "b"), (3, "2019-11-01 00:00:00 UTC", "cart", "c")],
        "event_id bigint, event_time string, event_type string, user_id string")
    out = as_dicts(standardise.standardise(raw))
    assert sorted(r["event_id"] for r in out) == [1, 3]
    assert {r["event_id"]: r["event_time"] for r in out}[3] == dt.datetime(2019, 11, 1)


def test_home_funnel_counts_each_user_once(spark):
    df = events_df(spark, [("u1", "view", T0, "DE", "mobile", "email"),
                           ("u1", "view", T0, "DE", "mobile", "email"),
                           ("u1", "cart", T0, "FR", "desktop", "direct")])
    rows = as_dicts(home.home_funnel(df, "country"))
    assert rows == [{"country": "DE", "viewers": 1, "carted": 1, "purchasers": 0,
                     "v2c_pct": 100.0, "c2p_pct": 0.0, "overall_cvr": 0.0}]


def test_rollup_subtotals_sum_cells(spark):
    rows = [(f"u{i}", "purchase" if i % 3 == 0 else "view", T0, c, "mobile", ch)
            for i in range(40) for c in ("DE", "NL") for ch in ("email",)]
    out = as_dicts(channel.channel_country_rollup(events_df(spark, rows)))
    by_type = {}
    for r in out:
        by_type.setdefault(r["row_type"], []).append(r)
    assert len(by_type["detail"]) == 2
    assert by_type["channel_total"][0]["sessions"] == sum(r["sessions"] for r in by_type["detail"])
    assert by_type["grand_total"][0]["country"] == "ALL" and by_type["grand_total"][0]["channel"] == "ALL"
    # the true distinct rollup does not double count the users seen in both countries
    cube = {r["row_type"]: r for r in as_dicts(channel.segment_cube(events_df(spark, rows)))}
    assert cube["grand_total"]["sessions"] == 40


def test_dims_are_partition_independent(spark):
    base = spark.range(0, 2000).withColumnRenamed("id", "event_id")
    a = standardise.assign_dims(base.repartition(1), "event_id").orderBy("event_id").collect()
    b = standardise.assign_dims(base.repartition(7), "event_id").orderBy("event_id").collect()
    assert a == b
    shares = {r["country"]: r["count"] / 2000 for r in
              standardise.assign_dims(base, "event_id").groupBy("country").count().collect()}
    assert abs(shares["DE"] - 0.45) < 0.05 and abs(shares["FR"] - 0.15) < 0.05


def test_week_bucket_matches_strftime_over_decades(spark):
    import duckdb

    from funnelkit.functions.timefmt import year_week_sql

    df = spark.sql(f"SELECT CAST(d AS STRING) AS d, {year_week_sql('CAST(d AS TIMESTAMP_NTZ)')} AS w "
                   "FROM (SELECT explode(sequence(DATE'1990-01-01', DATE'2035-12-31')) AS d)")
    got = {r.d: r.w for r in df.collect()}
    want = {str(d)[:10]: w for d, w in duckdb.sql(
        "SELECT d, strftime(d, '%Y-%W') FROM (SELECT unnest(range(DATE '1990-01-01', DATE '2036-01-01', "
        "INTERVAL 1 DAY)) AS d)").fetchall()}
    assert got == want


def test_value_counts_of_an_unbounded_column(spark):
    from funnelkit.operators import quality

    df = events_df(spark, [("u1", "view", T0, "DE", "mobile", "email"),
                           ("u1", "cart", T0, "DE", "mobile", "email"),
                           ("u2", "view", T0, "NL", "mobile", "email")])
    rows = as_dicts(quality.value_counts(df, ["user_id"]))
    assert rows == [{"column_name": "user_id", "value": "u1", "n": 2}, {"column_name": "user_id", "value": "u2", "n": 1}]


def test_ladder_ranks_many_event_counts_over_many_partitions(spark):
    rows = spark.range(3000).selectExpr("id AS event_id_base", "CAST(id AS STRING) AS user_id", "CAST(1 + id * 7 % 2500 AS INT) AS n",
                                        "CASE WHEN id % 3 = 0 THEN 'DE' WHEN id % 3 = 1 THEN 'NL' END AS country",
                                        "CAST(1 + id % 3 AS INT) AS depth_score")
    ud = rows.selectExpr("user_id", "country", "'email' AS channel", "'mobile' AS device", "depth_score",
                         "CAST(n AS BIGINT) AS total_events").repartition(200)
    got = {(r.country, r.depth_score, r.total_events): r.rank_in_country for r in depth.rank_ladder(ud).collect()}
    triples = {(r.country, r.depth_score, r.total_events) for r in ud.collect()}
    want = {}
    for country in {t[0] for t in triples}:
        own = sorted({t[1:] for t in triples if t[0] == country}, reverse=True)
        want |= {(country, *t): i + 1 for i, t in enumerate(own)}
    assert got == want


def test_epoch_text_is_read_as_milliseconds(spark):
    df = spark.createDataFrame([("1577836800000",), ("2020-01-01 00:00:00",), ("20200101",), ("x",)], "t string")
    got = [r[0] for r in df.select(standardise.parse_time(df.t, df.schema["t"].dataType)).collect()]
    assert got[0] == got[1] == dt.datetime(2020, 1, 1) and got[3] is None


def test_busy_user_spreads_over_salts(spark):
    times = [T0 + dt.timedelta(minutes=i) for i in range(300)]
    df = _buyer(spark, *times)
    assert as_dicts(cohort.cohort_selfjoin(df, min_cohort=1)) == _cohort(df)
