"""Ingestion: first working source -> canonical events and rejects -> new version -> validation -> published.

The source is read once: the standardised events and the rows set aside are
written by the same job into a fresh version of the output table, the checks run
as one column-pruned aggregate over its events, and only if all pass is the
version published (`files.publish`). Until then, and if anything fails on the
way, readers see the former version. Events are partitioned by `event_type`, so
reports filtering one stage (purchases for cohorts and order value) read only
that partition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit import schema
from funnelkit.operators.quality import quality_checks
from funnelkit.operators.standardise import standardise_with_rejects
from funnelkit.sources import files
from funnelkit.sources.adapters import first_successful


def ingest(candidates: Sequence[Callable[[], DataFrame]], output: str,
           min_rows: int = schema.MIN_ROWS) -> DataFrame:
    """The evaluated check table; `output` gets a new current version only when all checks pass."""
    rows = standardise_with_rejects(first_successful(candidates))
    spark = rows.sparkSession
    version = files.new_version(output)
    rows.write.partitionBy("rejected", "event_type").parquet(version)
    checks = quality_checks(files.read_canonical(spark, version), min_rows)
    found = checks.collect()
    if all(r.passed for r in found):
        files.publish(spark, version)
    else:
        files.discard(spark, version)
    return spark.createDataFrame(found, checks.schema)


def reject_counts(spark: SparkSession, output: str) -> DataFrame:
    """reason, n: how many rows the current version set aside for each reason."""
    return files.read_rejects(spark, output).groupBy("reason").agg(F.expr("count(1) AS n"))
