"""Random small event sets: reports against brute-force Python definitions."""

from __future__ import annotations

import datetime as dt
from collections import Counter, defaultdict
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from funnelkit.plans import cohort, depth, funnel
from tests.helpers import T0, as_dicts, events_df

SETTINGS = settings(max_examples=50, deadline=None, suppress_health_check=list(HealthCheck))

event = st.tuples(
    st.sampled_from(["u1", "u2", "u3", "u4", "u5"]),
    st.sampled_from(["view", "cart", "purchase"]),
    st.integers(min_value=0, max_value=120 * 24).map(lambda h: T0 + dt.timedelta(hours=h)),
    st.sampled_from(["DE", "NL", "FR"]),
    st.sampled_from(["mobile", "desktop"]),
    st.sampled_from(["email", "direct"]),
)
events = st.lists(event, min_size=1, max_size=40)


def r2(x: Decimal) -> float:
    return float(x.quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))


def pct(n, d):
    return None if d == 0 else r2(Decimal(100) * Decimal(n) / Decimal(d))


@SETTINGS
@given(events)
def test_lenient_and_sequential_country_funnel(spark, rows):
    types = defaultdict(set)
    for u, t, _, c, *_ in rows:
        types[(u, c)].add(t)
    expected_len, expected_seq = {}, {}
    for c in {r[3] for r in rows}:
        sets = [s for (u, cc), s in types.items() if cc == c]
        v = sum("view" in s for s in sets)
        ca = sum("cart" in s for s in sets)
        p = sum("purchase" in s for s in sets)
        ps = sum("purchase" in s and "cart" in s for s in sets)
        expected_len[c] = (v, ca, p, pct(ca, v), pct(p, ca), pct(p, v))
        expected_seq[c] = (len(sets), ca, ps, pct(ca, len(sets)) or 0.0, pct(ps, ca) or 0.0, pct(ps, len(sets)) or 0.0)
    df = events_df(spark, rows)
    got = {r["country"]: (r["viewers"], r["carted"], r["purchasers"], r["view_to_cart_pct"],
                          r["cart_to_purchase_pct"], r["overall_cvr_pct"]) for r in as_dicts(funnel.country_funnel(df))}
    assert got == expected_len
    got = {r["country"]: (r["viewers"], r["carted"], r["purchasers"], r["view_to_cart_pct"],
                          r["cart_to_purchase_pct"], r["overall_cvr_pct"]) for r in as_dicts(funnel.country_funnel_seq(df))}
    assert got == expected_seq


@SETTINGS
@given(events)
def test_cohort_retention_brute_force(spark, rows):
    times = defaultdict(list)
    for u, t, ts, *_ in rows:
        if t == "purchase":
            times[u].append(ts)
    cohorts = defaultdict(lambda: [0, 0])
    for u, ts in times.items():
        t0 = min(ts)
        key = t0.strftime("%Y-%m")
        cohorts[key][0] += 1
        cohorts[key][1] += any(t0 < t <= t0 + dt.timedelta(days=60) for t in ts)
    expected = {k: (n, r, pct(r, n)) for k, (n, r) in cohorts.items()}
    got = {r["cohort_month"]: (r["cohort_size"], r["repeat_buyers"], r["retention_60d_pct"])
           for r in as_dicts(cohort.cohort_retention(events_df(spark, rows), min_cohort=1))}
    assert got == expected


@SETTINGS
@given(events)
def test_session_quality_ranks_brute_force(spark, rows):
    score = {"purchase": 3, "cart": 2, "view": 1}
    depth_of, count = defaultdict(int), Counter()
    for u, t, _, c, d, ch in rows:
        depth_of[(u, c, ch, d)] = max(depth_of[(u, c, ch, d)], score[t])
        count[(u, c, ch, d)] += 1
    expected = {}
    for key in depth_of:
        c = key[1]
        pairs = sorted({(depth_of[k], count[k]) for k in depth_of if k[1] == c}, reverse=True)
        same = [depth_of[k] for k in depth_of if k[1] == c]
        avg = r2(Decimal(sum(same)) / Decimal(len(same)))
        expected[key] = (pairs.index((depth_of[key], count[key])) + 1, avg)
    got = {(r["user_id"], r["country"], r["channel"], r["device"]): (r["rank_in_country"], r["country_avg_depth"])
           for r in as_dicts(depth.session_quality_full(events_df(spark, rows)))}
    assert got == expected
    top = as_dicts(depth.session_quality(events_df(spark, rows), limit=3))
    assert [(r["user_id"], r["country"], r["channel"], r["device"]) for r in top] == [
        k for k, _ in sorted(expected.items(), key=lambda kv: (kv[0][1], kv[1][0], kv[0][0], kv[0][2], kv[0][3]))][:3]
