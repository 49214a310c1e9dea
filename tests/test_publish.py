"""Versioned tables, rows set aside by the ingestion, and the stream's merged key levels."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from funnelkit.operators import standardise
from funnelkit.session import scratch_path
from funnelkit.sources import adapters, files, ingest
from funnelkit.sources.fixtures import clickstream
from funnelkit.streaming import hourly
from tests.conftest import SF_SMALL
from tests.helpers import as_dicts


def _version(spark, path, n):
    version = files.new_version(path)
    spark.range(n).write.parquet(version)
    return version


def _rows(spark, path):
    return spark.read.parquet(files.current_version(spark, path)).count()


def test_a_failure_between_the_steps_leaves_the_old_table(spark, monkeypatch):
    path = scratch_path(spark, "publish")
    files.publish(spark, _version(spark, path, 3))
    assert _rows(spark, path) == 3
    _version(spark, path, 5)  # written, never published: the writer died here
    assert _rows(spark, path) == 3
    reader = spark.read.parquet(files.current_version(spark, path))
    good = lambda: adapters.adapt_multistore(adapters.raw_multistore(spark, SF_SMALL))

    def dies(*_):
        raise RuntimeError("lost before the marker")

    monkeypatch.setattr(files, "publish", dies)
    with pytest.raises(RuntimeError):
        ingest.ingest([good], path, min_rows=1)
    with pytest.raises(RuntimeError):
        files.replace_table(spark, spark.range(9), "never", path)
    assert _rows(spark, path) == 3
    monkeypatch.undo()
    files.publish(spark, _version(spark, path, 7))
    assert _rows(spark, path) == 7 and reader.count() == 3  # who had resolved the old version still reads it
    assert files.clean_versions(spark, path, keep=1) == 1 and _rows(spark, path) == 7


def test_versions_are_numbered_and_cleaned_from_the_oldest(spark):
    path = scratch_path(spark, "publish-many")
    for n in range(1, 13):
        files.publish(spark, _version(spark, path, n))
    assert _rows(spark, path) == 12
    assert files.clean_versions(spark, path, keep=3) == 9 and files.clean_versions(spark, path, keep=3) == 0
    assert len(files.list_folder(spark, f"{path}/{files.VERSIONS}")) == 3 and _rows(spark, path) == 12


def test_a_refused_first_version_leaves_no_folder_and_a_plain_table_alone(spark):
    good = lambda: adapters.adapt_multistore(adapters.raw_multistore(spark, SF_SMALL))
    path = scratch_path(spark, "plain")
    clickstream(spark, SF_SMALL).write.parquet(path)
    before = files.read_canonical(spark, path).count()
    ingest.ingest([good], path)  # too few rows
    assert files.read_canonical(spark, path).count() == before > 0
    ingest.ingest([lambda: good().where("event_id % 2 = 0")], path, min_rows=1)
    assert 0 < files.read_canonical(spark, path).count() < before


def test_each_damage_lands_in_the_rejects(spark, tmp_path):
    (tmp_path / "export.csv").write_text("\n".join([
        "event_time,event_type,user_id,price,event_id",
        "2024-01-01 00:00:00,view,u1,1.50,1",
        "2024-01-01 00:00:00,purchase,u1,n/a,2",
        "yesterday,view,u1,1.50,3",
        "2024-01-01 00:00:00,cart,,2,4",
        "2024-01-01 00:00:00,view,u1",
        "2024-01-01 00:00:00,view,u1,1,6,7",
        "yesterday,remove_from_cart,,n/a,8",
        "never,cart,,x,9",
        '2024-01-01 00:00:00,view,"u,1",,10']) + "\n")
    path = scratch_path(spark, "rejects")
    checks = ingest.ingest([adapters.export_sources(spark, str(tmp_path))["multistore"]], path, min_rows=1)
    assert not all(r.passed for r in checks.collect())  # no cart is left
    rows = standardise.standardise_with_rejects(adapters.export_sources(spark, str(tmp_path))["multistore"]())
    events = {r.event_id: r.price for r in rows.where("NOT rejected").collect()}
    assert set(events) == {1, 2, 10} and events[2] is None and float(events[1]) == 1.5
    bad = sorted((r.reason, r.record) for r in rows.where("rejected").collect())
    assert [r for r, _ in bad] == ["column_count"] * 2 + ["event_time"] * 2 + ["price"] * 2 + ["user_id"] * 2
    assert [t for r, t in bad if r == "column_count"] == ["2024-01-01 00:00:00,view,u1", "2024-01-01 00:00:00,view,u1,1,6,7"]
    assert all(r.event_id is None and r.event_time is None for r in rows.where("rejected").collect())


def test_events_and_rejects_are_published_together(spark):
    raw = adapters.raw_multistore(spark, SF_SMALL).withColumn("price", F.expr("CASE WHEN event_id = 5 THEN 'n/a' ELSE CAST(price AS STRING) END"))
    path = scratch_path(spark, "together")
    assert all(r.passed for r in ingest.ingest([lambda: adapters.adapt_multistore(raw)], path, min_rows=1).collect())
    assert as_dicts(ingest.reject_counts(spark, path)) in ([{"reason": "price", "n": 1}], [])
    got, want = files.read_canonical(spark, path), clickstream(spark, SF_SMALL)
    assert got.count() == want.count()
    assert got.drop("price").exceptAll(want.drop("price")).count() == 0


def test_a_bad_price_does_not_end_the_job(spark):
    raw = spark.createDataFrame([("2024-01-01 00:00:00", "view", "u", "n/a", 1)], "event_time string, event_type string, user_id string, price string, event_id int")
    assert standardise.standardise(raw).collect()[0].price is None


def test_epoch_units_go_by_their_digits(spark):
    df = spark.createDataFrame([("1577836800",), ("1577836800000",), ("1577836800000000",), ("157783680",)], "t string")
    got = [r[0] for r in df.select(standardise.parse_time(df.t, df.schema["t"].dataType)).collect()]
    assert got[:3] == [dt.datetime(2020, 1, 1)] * 3 and got[3] == dt.datetime(1975, 1, 1, 4, 48)


# ------------------------------------------------------------- merged key levels

def test_many_small_batches_read_few_runs(spark):
    keys = hourly.hour_keys(clickstream(spark, SF_SMALL)).withColumn("part", F.expr("pmod(hash(user_id, hour_start), 24)")).cache()
    base = scratch_path(spark, "levels")
    add = hourly._add_batch(base)
    most = 0
    for n in range(24):
        add(keys.where(F.col("part") == n).drop("part").coalesce(1), n)
        live = hourly.live_runs(spark, base, n + 1)
        levels = [level for level, _ in live]
        assert all(levels.count(x) < hourly.FAN for x in levels)
        most = max(most, len(live))
    assert most <= 3 * 3  # 24 batches, fan of 4: three levels of at most three runs
    assert len(files.list_folder(spark, f"{base}/keys")) <= most + hourly.FAN + 3  # merged runs are removed
    want = {r.hour_start: (r.c, r.p) for r in keys.groupBy("hour_start").agg(
        F.expr("count(DISTINCT CASE WHEN event_type = 'cart' THEN user_id END) AS c"),
        F.expr("count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS p")).collect()}
    report = lambda: {r.hour_start: (r.cart_users, r.purchase_users) for r in hourly.hourly_report(spark, base).collect()}
    assert report() == want
    add(keys.where("part = 23").drop("part").coalesce(1), 23)  # the last batch runs again
    assert report() == want and hourly.live_runs(spark, base, 24) == live
    keys.unpersist()
