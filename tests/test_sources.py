"""Sources, adapters, sinks and the segment filter."""

from __future__ import annotations

import pytest

from funnelkit.operators import quality, segment
from funnelkit.session import scratch_path, shared_dir
from funnelkit.operators import standardise
from funnelkit.sources import adapters, files
from funnelkit.sources.fixtures import clickstream
from tests.conftest import SF_SMALL
from tests.helpers import T0, as_dicts, events_df


def test_heuristic_names_first_match_wins():
    names = adapters.heuristic_names(["Event Type", "Event_Date", "user_session", "Visitor", "created_time", "price"])
    assert names == {"Event Type": "event_type", "Event_Date": "event_time", "user_session": "user_id"}


def test_retail_adapter_maps_vocabulary_and_millis(spark):
    raw = spark.createDataFrame([(1704103200123, "v1", "addtocart", 7), (1704103200999, "v2", "transaction", 8)],
                                "timestamp bigint, visitorid string, event string, event_id bigint")
    out = as_dicts(adapters.adapt_retail(raw).select("event_type", "user_id"))
    assert [r["event_type"] for r in out] == ["cart", "purchase"]


def test_multistore_adapter_requires_columns(spark):
    raw = spark.createDataFrame([(1, "x")], "event_id bigint, other string")
    with pytest.raises(ValueError):
        adapters.adapt_multistore(raw)


def test_first_successful_falls_through(spark):
    good = spark.createDataFrame([("2024-01-01 00:00:00", "view", "u")], "event_time string, event_type string, user_id string")

    def broken():
        raise FileNotFoundError("no such export")

    def wrong_shape():
        return spark.createDataFrame([(1,)], "x int")

    assert adapters.first_successful([broken, wrong_shape, lambda: good]) is good
    with pytest.raises(RuntimeError):
        adapters.first_successful([broken, wrong_shape])


def test_heuristic_source_prefers_named_file_then_first_csv(spark):
    folder = scratch_path(spark, "heur-test")
    raw = adapters.raw_heuristic(spark, SF_SMALL)
    files.write_csv(raw, f"{folder}/b_export.csv")
    files.write_csv(raw.limit(3), f"{folder}/a_export.csv")
    assert adapters.read_heuristic_source(spark, folder).count() == 3  # first *.csv by name
    files.write_csv(raw, f"{folder}/events.csv")
    assert adapters.read_heuristic_source(spark, folder).count() == raw.count()


def test_csv_round_trip_is_exact(spark):
    ev = clickstream(spark, SF_SMALL)
    path = files.write_csv(ev, scratch_path(spark, "rt"))
    back = files.read_events_csv(spark, path)
    assert back.exceptAll(ev).count() == 0 and ev.exceptAll(back).count() == 0


def test_shared_dir_is_the_checkpoint_dir(spark):
    d = shared_dir(spark)
    assert d and scratch_path(spark, "x").startswith(d)


def test_segment_filter_guards(spark):
    df = events_df(spark, [("u1", "view", T0, "DE", "mobile", "email")])
    with pytest.raises(ValueError):
        segment.segment_filter(df, [], ["mobile"])
    assert segment.segment_filter(df, ["FR"], ["mobile"]).count() == 0


def test_quality_checks_fail_on_small_input_and_missing_columns(spark):
    df = events_df(spark, [("u1", "view", T0, "DE", "mobile", "email")])
    checks = {r["check_name"]: r for r in as_dicts(quality.quality_checks(df))}
    assert not checks["row_count"]["passed"] and checks["has_view_events"]["passed"]
    assert not checks["has_cart_events"]["passed"]
    no_dims = {r["check_name"]: r for r in as_dicts(quality.quality_checks(df.drop("channel")))}
    assert not no_dims["channel_present"]["passed"]


def test_ingest_validates_before_writing(spark):
    from funnelkit.sources import ingest

    good = lambda: adapters.adapt_multistore(adapters.raw_multistore(spark, SF_SMALL))
    refused = scratch_path(spark, "ingest-refused")
    checks = {r["check_name"]: r["passed"] for r in ingest.ingest([good], refused).collect()}
    assert checks["row_count"] is False and not files.path_exists(spark, refused)
    accepted = scratch_path(spark, "ingest-ok")
    ingest.ingest([good], accepted, min_rows=1).collect()
    back = files.read_canonical(spark, accepted)
    assert back.where("event_type = 'purchase'").count() == clickstream(spark, SF_SMALL).where(
        "event_type = 'purchase'").count()


def test_shuffle_sizing_from_input_bytes(spark):
    from funnelkit import session

    n = session.size_shuffles(spark, [f"{SF_SMALL}/events.parquet"])
    assert n == spark.sparkContext.defaultParallelism  # tiny input: one partition per core
    assert session.input_bytes(spark, [f"{SF_SMALL}/events.parquet", f"{SF_SMALL}/missing.parquet"]) > 0
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("event,extra,visitorid,timestamp\nview,x,u1,1577836800000\n")
    assert files.read_csv(spark, str(tmp_path / "a.csv"), adapters.RETAIL_SCHEMA).collect() == [(1577836800000, "u1", "view")]
    (tmp_path / "b.csv").write_text("event,visitorid\nview,u1\n")
    with pytest.raises(ValueError, match="timestamp"):
        files.read_csv(spark, str(tmp_path / "b.csv"), adapters.RETAIL_SCHEMA)


def test_unknown_export_reaches_the_heuristic_source(spark, tmp_path, caplog):
    (tmp_path / "export.csv").write_text("Event_Type,Visitor_Session,Event_Time\nview,u1,1577836800000\naddtocart,u2,1577840400000\n")
    with caplog.at_level("WARNING", logger="funnelkit"):
        raw = adapters.first_successful(list(adapters.export_sources(spark, str(tmp_path)).values()))
    assert sum("refused" in r.message for r in caplog.records) == 2
    got = sorted((r.event_type, str(r.event_time)) for r in standardise.standardise(raw).collect())
    assert got == [("cart", "2020-01-01 01:00:00"), ("view", "2020-01-01 00:00:00")]


def test_failed_ingest_leaves_the_former_output(spark):
    from funnelkit.sources import ingest

    good = lambda: adapters.adapt_multistore(adapters.raw_multistore(spark, SF_SMALL))
    out = scratch_path(spark, "ingest-again")
    ingest.ingest([good], out, min_rows=1)
    before = files.read_canonical(spark, out).count()
    ingest.ingest([lambda: good().limit(3)], out, min_rows=10)
    assert files.read_canonical(spark, out).count() == before
    ingest.ingest([lambda: good().where("event_id % 2 = 0")], out, min_rows=1)
    assert 0 < files.read_canonical(spark, out).count() < before


def test_read_canonical_of_partitioned_ingest_output(spark):
    from funnelkit.sources import ingest

    good = lambda: adapters.adapt_multistore(adapters.raw_multistore(spark, SF_SMALL))
    out = scratch_path(spark, "canon")
    ingest.ingest([good], out, min_rows=1).collect()
    back = files.read_canonical(spark, out)
    ref = clickstream(spark, SF_SMALL)
    assert back.columns == ref.columns
    assert back.exceptAll(ref).count() == 0 and ref.exceptAll(back).count() == 0
