from __future__ import annotations

import os
import shutil

from pyspark.sql import functions as F

from funnelkit.session import scratch_path
from funnelkit.sources.fixtures import clickstream
from funnelkit.streaming import hourly
from tests.conftest import SF_SMALL


def _batch(spark):
    """The same counts as a plain aggregate over the whole table."""
    keys = hourly.hour_keys(clickstream(spark, SF_SMALL))
    per_hour = keys.groupBy("hour_start").agg(
        F.expr("count(DISTINCT CASE WHEN event_type = 'cart' THEN user_id END) AS c"),
        F.expr("count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS p"))
    return {r.hour_start: (r.c, r.p) for r in per_hour.collect()}


def _rows(df):
    return {r.hour_start: (r.cart_users, r.purchase_users) for r in df.collect()}


def test_stream_equals_batch(spark):
    assert _rows(hourly.hourly_abandonment_from_files(spark, SF_SMALL)) == _batch(spark)


def test_files_newest_first_one_per_trigger(spark, tmp_path):
    raw = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    cuts = [str(x) for x in raw.selectExpr("percentile_approx(cast(ts as timestamp), array(0.33, 0.66)) AS q").first().q]
    parts = [raw.where(f"ts >= timestamp_ntz'{cuts[1]}'"),
             raw.where(f"ts >= timestamp_ntz'{cuts[0]}' AND ts < timestamp_ntz'{cuts[1]}'"),
             raw.where(f"ts < timestamp_ntz'{cuts[0]}'")]
    for i, part in enumerate(parts):  # the newest events are in the file that is read first
        part.coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        source = next((tmp_path / f"w{i}").glob("part-*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        shutil.copy(source, tmp_path / "in" / f"events{i}.parquet")
        os.utime(tmp_path / "in" / f"events{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    base = scratch_path(spark, "hourly-test")
    got = _rows(hourly.hourly_abandonment_from_files(spark, str(tmp_path / "in"), 1, base))
    assert got == _batch(spark)
    assert spark.read.parquet(f"{base}/hours").select("batch_id").distinct().count() == 3
    # a batch that runs again leaves the report as it is
    again = hourly.hour_keys(clickstream(spark, SF_SMALL)).limit(0)
    hourly._add_batch(base)(again, 3)
    assert _rows(hourly.hourly_report(spark, base)) == got
