"""Command line: ingest an export, run a report over the written table."""

from __future__ import annotations

from funnelkit.__main__ import main
from funnelkit.session import scratch_path
from funnelkit.sources import adapters, files
from tests.conftest import SF_SMALL


def test_cli_ingest_then_run(spark, capsys):
    export = files.write_csv(adapters.raw_multistore(spark, SF_SMALL), scratch_path(spark, "cli-export"))
    table = scratch_path(spark, "cli-events")
    assert main(["ingest", "--path", export, "--out", table, "--min-rows", "1"]) == 0
    out = scratch_path(spark, "cli-report")
    assert main(["run", "order_value", "--events", table, "--out", out]) == 0
    assert spark.read.parquet(out).count() == 4
    assert main(["list"]) == 0 and "session_quality" in capsys.readouterr().out
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_cli_segment_selection(spark):
    from funnelkit.sources.fixtures import clickstream

    table = scratch_path(spark, "cli-seg")
    clickstream(spark, SF_SMALL).write.parquet(table)
    out = scratch_path(spark, "cli-seg-out")
    assert main(["run", "country_funnel_seq", "--events", table, "--countries", "DE,NL", "--devices", "mobile",
                 "--out", out]) == 0
    assert {r.country for r in spark.read.parquet(out).collect()} == {"DE", "NL"}
    out = scratch_path(spark, "cli-dev-out")  # one dimension given: the other is not restricted
    spark.read.parquet(table).selectExpr("* EXCEPT (country)", "'AT' AS country").write.parquet(scratch := scratch_path(spark, "cli-at"))
    assert main(["run", "country_funnel_seq", "--events", scratch, "--devices", "mobile", "--out", out]) == 0
    assert {r.country for r in spark.read.parquet(out).collect()} == {"AT"}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
