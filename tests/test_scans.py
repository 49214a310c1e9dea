"""Sorted scans, time joins, quantiles, heavy hitters and sketches against brute force."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from funnelkit.operators import heavy, prefix, quantiles
from funnelkit.operators.intervals import DAY, HOUR, interval_join, next_after
from funnelkit.plans import cohort, depth, followup, runs, sketches
from funnelkit.session import saved
from tests.helpers import T0, as_dicts, events_df


@pytest.fixture
def partitions(spark):
    """Small data spread over many partitions."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


def scan_brute(rows):
    """rows (g, a, b, v) -> per row dense rank of a, running sum of v and the v before, in (g, a, b) order."""
    out, state = [], {}
    for g, a, b, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", -r[1], r[2])):
        s = state.get(g)
        rank = 1 if s is None else s["rank"] + (s["a"] != a)
        total = (s["sum"] if s else 0) + (v or 0)
        out.append((g, a, b, v, rank, total, s["v"] if s else None))
        state[g] = {"rank": rank, "a": a, "sum": total, "v": v}
    return out


@pytest.mark.parametrize("shape", ["mixed", "one group", "one hot tie", "many groups", "two rows", "none"])
def test_sorted_scan_against_brute_force(spark, partitions, shape):
    rng = random.Random(4)
    n = {"two rows": 2, "none": 0}.get(shape, 700)
    group = {"one group": lambda i: "g", "one hot tie": lambda i: "g", "many groups": lambda i: f"g{i // 2}"}.get(
        shape, lambda i: rng.choice([None, "a", "b", "b", "b", "b"]))
    rank = (lambda i: 7 if i % 50 else i) if shape == "one hot tie" else lambda i: rng.randrange(9)
    rows = [(group(i), rank(i), i, rng.choice([None, 1, 2, 3])) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, a bigint, b int, v int").repartition(7)
    got = prefix.sorted_scan(df, ["g"], ["a DESC", "b"], rank="r", rank_by=["a"], sums={"s": "v"}, lags={"p": "v"})
    assert [tuple(r) for r in got.collect()] == scan_brute(rows)  # values and global order
    assert dict(got.dtypes)["r"] == "int" and dict(got.dtypes)["p"] == "int"
    if shape in ("mixed", "one group", "one hot tie"):
        assert got.select(F.spark_partition_id()).distinct().count() > 8


def test_sorted_scan_without_a_group_has_no_one_task_window(spark, partitions):
    rows = [(T0 + dt.timedelta(seconds=20 * i), "view" if i % 3 else "purchase") for i in range(900)]
    df = events_df(spark, [("u", t, at, "DE", "mobile", "email") for at, t in rows])
    out = runs.running_events_by_minute(df)
    got = as_dicts(out)
    assert [r["running_events"] for r in got] == [3 * (i + 1) for i in range(300)]
    assert [r["prev_minute"] for r in got[1:]] == [r["minute"] for r in got[:-1]] and got[0]["prev_events"] is None
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.rdd.getNumPartitions() > 1


def test_ranks_equal_a_window_over_many_partitions(spark, partitions):
    rows = [(f"u{i}", "purchase" if i % 7 == 0 else "view", T0, "DE" if i % 3 else None, "mobile", "email") for i in range(400) for _ in range(1 + i % 4)]
    ud = depth.user_depth(events_df(spark, rows))
    want = ud.selectExpr("*", "dense_rank() OVER (PARTITION BY country ORDER BY depth_score DESC, total_events DESC) AS r")
    got = depth.ranked(ud).select("user_id", "rank_in_country")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.select("user_id", "r").collect()}


# ------------------------------------------------------------- joins over time

TIMES = "k string, at bigint, id int"


def times(spark, rows, prefix_):
    return spark.createDataFrame(rows, TIMES).withColumnsRenamed({"at": f"{prefix_}at", "id": f"{prefix_}id"})


@pytest.mark.parametrize("lo, hi, splits", [(0, 10, 1), (1, 10, 3), (-5, 5, 2), (-20, -1, 1), (4, 4, 1), (0, 1, 50)])
def test_interval_join_against_brute_force(spark, lo, hi, splits):
    rng = random.Random(lo * 31 + hi)
    make = lambda n: [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(-60, 60)]), i) for i in range(n)]
    left, right = make(150), make(150)
    got = interval_join(times(spark, left, "l"), times(spark, right, "r"), ["k"], "lat", "rat", lo, hi, splits)
    want = [(k, a, i, b, j) for k, a, i in left for k2, b, j in right
            if k is not None and k == k2 and a is not None and b is not None and lo <= b - a <= hi]
    assert got.columns == ["k", "lat", "lid", "rat", "rid"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_interval_join_of_an_empty_window_is_an_error(spark):
    with pytest.raises(ValueError):
        interval_join(times(spark, [], "l"), times(spark, [], "r"), ["k"], "lat", "rat", 2, 1)


def test_selfjoin_with_a_user_that_holds_a_third(spark):
    rows = [("busy", "purchase", T0 + dt.timedelta(minutes=7 * i), "DE", "mobile", "email") for i in range(300)]
    rows += [(f"u{i % 150}", "purchase", T0 + dt.timedelta(days=i % 90), "DE", "mobile", "email") for i in range(600)]
    df = events_df(spark, rows)
    assert as_dicts(cohort.cohort_selfjoin(df, min_cohort=1)) == as_dicts(cohort.cohort_retention(df, min_cohort=1))


@pytest.mark.parametrize("slot", [1, 7, 1000])
def test_next_after_against_brute_force(spark, slot):
    rng = random.Random(slot)
    make = lambda n: [(rng.choice(["a", "a", "b", "c", None]), rng.choice([None, *range(-50, 50)]), i) for i in range(n)]
    left, right = make(120), [r for r in make(40) if r[0] != "c"]
    got = next_after(times(spark, left, "l"), times(spark, right, "r"), ["k"], "lat", "rat", slot)
    want = [(k, a, i, min((b for k2, b, _ in right if k2 == k and k is not None and a is not None and b is not None and b >= a), default=None))
            for k, a, i in left]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_cart_with_a_purchase_exactly_two_hours_later_is_not_abandoned(spark):
    late = dt.timedelta(hours=2)
    rows = [("exact", "cart", T0, "DE", "mobile", "email"), ("exact", "purchase", T0 + late, "DE", "mobile", "email"),
            ("over", "cart", T0, "DE", "mobile", "email"), ("over", "purchase", T0 + late + dt.timedelta(microseconds=1), "DE", "mobile", "email"),
            ("never", "cart", T0, "DE", "mobile", "email"), ("before", "purchase", T0 - dt.timedelta(microseconds=1), "DE", "mobile", "email"),
            ("before", "cart", T0, "DE", "mobile", "email"), ("same", "cart", T0, "DE", "mobile", "email"),
            ("same", "purchase", T0, "FR", "tablet", "direct"), (None, "cart", T0, "DE", "mobile", "email")]
    got = {r["user_id"]: r["next_purchase_time"] for r in as_dicts(followup.cart_abandoners(events_df(spark, rows)))}
    assert got == {"over": T0 + late + dt.timedelta(microseconds=1), "never": None, "before": None}


def test_carts_of_a_busy_user(spark):
    rng = random.Random(8)
    rows = [("busy", rng.choice(["cart", "cart", "cart", "purchase"]), T0 + dt.timedelta(minutes=rng.randrange(40_000)), "DE", "mobile", "email")
            for _ in range(600)]
    buys = sorted(r[2] for r in rows if r[1] == "purchase")
    want = sorted((r[2], next((b for b in buys if b >= r[2]), None)) for r in rows if r[1] == "cart"
                  and not any(r[2] <= b <= r[2] + dt.timedelta(hours=2) for b in buys))
    got = sorted((r["cart_time"], r["next_purchase_time"]) for r in as_dicts(followup.cart_abandoners(events_df(spark, rows))))
    assert [g[0] for g in got] == [w[0] for w in want] and got == want


# ------------------------------------------------------------- quantiles

def disc(values, percent):
    return sorted(values)[max(1, -(-len(values) * percent // 100)) - 1]


@pytest.mark.parametrize("shape", ["wide", "ties", "one value", "negative", "extremes"])
def test_quantiles_against_sorting(spark, monkeypatch, shape):
    monkeypatch.setattr(quantiles, "BUCKETS", 1 << (16 if shape == "extremes" else 8))
    rng = random.Random(1)
    draw = {"wide": lambda: rng.randrange(10 ** 7), "ties": lambda: rng.choice([0, 0, 0, 5, 10 ** 6]), "one value": lambda: 42,
            "negative": lambda: rng.randrange(-1000, 1000), "extremes": lambda: rng.choice([-(1 << 61), 0, 1 << 61])}[shape]
    rows = [(rng.choice(["a", "b", None]), draw()) for _ in range(333)] + [("only nulls", None), ("single", draw())]
    df = spark.createDataFrame(rows, "g string, v bigint")
    got = {r.g: tuple(r)[1:] for r in quantiles.quantile_disc(df, ["g"], "v", [1, 25, 50, 90, 100]).collect()}
    groups = {g: [v for h, v in rows if h == g and v is not None] for g, _ in rows if g != "only nulls"}
    assert got == {g: (len(v), *[disc(v, p) for p in (1, 25, 50, 90, 100)]) for g, v in groups.items()}
    whole = quantiles.quantile_disc(df, [], "v", [50]).collect()
    assert [tuple(r) for r in whole] == [(334, disc([v for _, v in rows if v is not None], 50))]


def test_quantiles_of_nothing_and_of_too_much(spark):
    assert quantiles.quantile_disc(spark.createDataFrame([("a", None)], "g string, v bigint"), ["g"], "v", [50]).collect() == []
    with pytest.raises(ValueError):
        quantiles.quantile_disc(spark.createDataFrame([(-(1 << 63),), ((1 << 63) - 1,)], "v bigint"), [], "v", [50])


def test_time_to_purchase_counts_the_first_view(spark):
    at = lambda **k: T0 + dt.timedelta(**k)
    rows = [("u1", "view", T0, "DE", "mobile", "email"), ("u1", "view", at(hours=5), "DE", "mobile", "email"),
            ("u1", "purchase", at(hours=6), "DE", "mobile", "email"), ("u2", "view", T0, "DE", "mobile", "email"),
            ("u2", "purchase", at(days=1), "DE", "mobile", "email"), ("u3", "view", T0, "DE", "mobile", "email"),
            ("u3", "purchase", at(days=1), "DE", "mobile", "direct"), ("u4", "purchase", T0, "DE", "mobile", "email")]
    assert as_dicts(followup.time_to_purchase(events_df(spark, rows))) == [
        {"channel": "email", "n": 2, "p25_s": 21600.0, "p50_s": 21600.0, "p75_s": 86400.0, "p90_s": 86400.0, "same_day_pct": 50.0}]


# ------------------------------------------------------------- heavy hitters and sketches

@pytest.mark.parametrize("shape", ["zipf", "flat", "few", "ties"])
def test_top_values_are_exact(spark, shape):
    rng = random.Random(3)
    draw = {"zipf": lambda i: f"v{int(1 / (rng.random() + 1e-4))}", "flat": lambda i: f"v{i}", "few": lambda i: f"v{i % 3}",
            "ties": lambda i: f"v{i % 60}"}[shape]
    values = [draw(i) for i in range(3000)] + [None] * 50
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(6)
    want = sorted(((v, n) for v, n in Counter(v for v in values if v is not None).items()), key=lambda t: (-t[1], t[0]))[:10]
    assert [tuple(r) for r in heavy.top_values(df, "v", 10, capacity=40).collect()] == want
    chosen, others = heavy.candidates(df.where("v IS NOT NULL").selectExpr("v AS value"), 40)
    kept = {r.value for r in chosen.collect()}
    assert len(kept) <= 40 and all(n <= others for v, n in Counter(v for v in values if v).items() if v not in kept)


def test_top_values_of_nothing(spark):
    assert heavy.top_values(spark.createDataFrame([(None,)], "v string"), "v").collect() == []


def test_stored_sketches_merge_without_counting_twice(spark):
    rows = [(f"u{i}", "view" if w else "purchase", T0 + dt.timedelta(weeks=w), c, "mobile", "email")
            for i in range(500) for w in range(3) for c in ("DE", "NL")]
    df = events_df(spark, rows)
    stored = saved(sketches.session_sketches(df), "sketch-test")
    assert stored.count() == 6
    by = {(r.country, r.channel): r for r in sketches.sketch_rollup(stored).collect()}
    for key in (("DE", "email"), ("ALL", "email"), ("ALL", "ALL")):  # 500 users everywhere, not 1500 or 3000
        assert abs(by[key].sessions_estimate - 500) <= 40 and abs(by[key].purchasers_estimate - 500) <= 40
    assert all(r.sessions_estimate_ok and r.purchasers_estimate_ok for r in sketches.sketch_check(df, stored).collect())


def test_slot_constants():
    assert DAY == 24 * HOUR == 86_400_000_000
