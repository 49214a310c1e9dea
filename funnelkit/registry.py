"""Named queries: each is `(spark, sf_dir) -> DataFrame` over the driver tables.

`clickstream` / `order_events` (sources.fixtures) derive canonical events from
the given parquet tables, so every query's work grows with the data. Decimal
money columns of event-level outputs are presented as DOUBLE so results
compare engine-neutrally; all sums inside the reports stay DECIMAL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit.operators import heavy, quality, segment, standardise as std
from funnelkit.plans import channel, cohort, depth, followup, funnel, home, runs, sketches, spend, trend
from funnelkit.session import configure, saved, scratch_path
from funnelkit.sources import adapters, files, ingest
from funnelkit.sources.fixtures import clickstream, order_events, table
from funnelkit.reports import REPORTS
from funnelkit.streaming import hourly

Query = Callable[[SparkSession, str], DataFrame]


# The selection of the filtered reports.
SELECTION = (("DE", "NL"), ("mobile", "tablet"))


def _prepare(spark: SparkSession, sf_dir: str) -> None:
    """Session options that the results depend on (UTC, zone-free times) and adaptive execution."""
    configure(spark)


def _click(report: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _prepare(spark, sf_dir)
        return report(clickstream(spark, sf_dir))
    run.__name__ = getattr(report, "__name__", "report")
    return run


def _orders(report: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _prepare(spark, sf_dir)
        return report(order_events(spark, sf_dir))
    run.__name__ = getattr(report, "__name__", "report") + "_orders"
    return run


def _selected(report: Callable[[DataFrame], DataFrame]) -> Query:
    """The report over a country x device selection of the clickstream."""
    return _click(lambda events: report(segment.segment_filter(events, *SELECTION)))


def _money_as_double(df: DataFrame) -> DataFrame:
    return df.withColumn("price", F.col("price").cast("double"))


# ------------------------------------------------------------ source queries

def q_canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    _prepare(spark, sf_dir)
    raw = adapters.adapt_multistore(adapters.raw_multistore(spark, sf_dir))
    return _money_as_double(std.standardise(raw))


def q_adapt_multistore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw multi-store export written as CSV, read back as text, adapted, standardised."""
    _prepare(spark, sf_dir)
    path = files.write_csv(adapters.raw_multistore(spark, sf_dir), scratch_path(spark, "multistore"))
    raw = adapters.adapt_multistore(files.read_csv(spark, path))
    return _money_as_double(std.standardise(raw))


def q_adapt_retail(spark: SparkSession, sf_dir: str) -> DataFrame:
    _prepare(spark, sf_dir)
    raw = adapters.adapt_retail(adapters.raw_retail(spark, sf_dir))
    return _money_as_double(std.standardise(raw))


def q_adapt_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown export in a folder without the preferred file: first *.csv wins."""
    _prepare(spark, sf_dir)
    folder = scratch_path(spark, "heuristic")
    files.write_csv(adapters.raw_heuristic(spark, sf_dir), f"{folder}/export.csv")
    chosen = adapters.first_successful([
        lambda: adapters.read_heuristic_source(spark, folder, preferred="events.csv"),
    ])
    return _money_as_double(std.standardise(chosen))


def q_adapt_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unknown export tried as every source: two refuse its header, the heuristic one takes it."""
    _prepare(spark, sf_dir)
    folder = scratch_path(spark, "unknown")
    files.write_csv(adapters.raw_heuristic(spark, sf_dir), f"{folder}/export.csv")
    chosen = adapters.first_successful(list(adapters.export_sources(spark, folder).values()))
    return _money_as_double(std.standardise(chosen))


def q_ingest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source fallback (missing export, then the multi-store export) -> staged -> validated -> the published table."""
    _prepare(spark, sf_dir)

    def missing_export() -> DataFrame:
        return adapters.read_heuristic_source(spark, scratch_path(spark, "no-export"))

    def multistore() -> DataFrame:
        return adapters.adapt_multistore(adapters.raw_multistore(spark, sf_dir))

    path = scratch_path(spark, "events-ingested")
    ingest.ingest([missing_export, multistore], path, min_rows=1)
    return _money_as_double(files.read_canonical(spark, path))


def _ingested_damaged(spark: SparkSession, sf_dir: str) -> str:
    """The damaged export written as CSV, ingested; the path of the published table."""
    export = scratch_path(spark, "damaged-export")
    adapters.raw_damaged_lines(spark, sf_dir).write.option("header", True).option("sep", "\u0001").option("quote", "").csv(export)
    path = scratch_path(spark, "events-damaged")
    ingest.ingest([adapters.export_sources(spark, export)["multistore"]], path, min_rows=1)
    return path


def q_ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reason, n: rows set aside by the ingestion of a damaged export."""
    _prepare(spark, sf_dir)
    return ingest.reject_counts(spark, _ingested_damaged(spark, sf_dir))


def q_ingest_reject_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reason, line or JSON of each row set aside."""
    _prepare(spark, sf_dir)
    return files.read_rejects(spark, _ingested_damaged(spark, sf_dir))


def q_ingest_damaged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that the damaged export still gives."""
    _prepare(spark, sf_dir)
    return _money_as_double(files.read_canonical(spark, _ingested_damaged(spark, sf_dir)))


def q_sessions_sketch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches stored per week x country x channel, rolled up from the table and held against the exact rollup."""
    _prepare(spark, sf_dir)
    events = clickstream(spark, sf_dir)
    return sketches.sketch_check(events, saved(sketches.session_sketches(events), "session-sketches"))


def _top_users(events: DataFrame) -> DataFrame:
    return heavy.top_values(events, "user_id", 20)


def q_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    _prepare(spark, sf_dir)
    path = files.write_csv(clickstream(spark, sf_dir), scratch_path(spark, "events-csv"))
    return _money_as_double(files.read_events_csv(spark, path))


def q_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    _prepare(spark, sf_dir)
    t = files.replace_table(spark, clickstream(spark, sf_dir), "events_canonical", scratch_path(spark, "events-tbl"))
    return _money_as_double(t)


def q_assign_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    _prepare(spark, sf_dir)
    ev = table(spark, sf_dir, "events").select("event_id")
    return std.assign_dims(ev, "event_id")


def q_parse_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    _prepare(spark, sf_dir)
    raw = adapters.raw_multistore(spark, sf_dir).select("event_id", F.col("event_time").alias("event_time_text"))
    return raw.withColumn("event_time", std.parse_time(F.col("event_time_text"), raw.schema["event_time_text"].dataType))


def q_preview_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    _prepare(spark, sf_dir)
    return _money_as_double(quality.preview_head(clickstream(spark, sf_dir)))


def q_segment_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    _prepare(spark, sf_dir)
    return _money_as_double(segment.segment_filter(clickstream(spark, sf_dir), ["DE", "NL"], ["mobile", "tablet"]))


def q_hourly_abandonment_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event files -> streaming job (availableNow) -> its report, open hours included."""
    _prepare(spark, sf_dir)
    return hourly.hourly_abandonment_from_files(spark, sf_dir)


QUERIES: dict[str, Query] = {
    # every catalogue report over the clickstream fixture
    **{name: _click(report) for name, report in REPORTS.items() if name != "preview_head"},
    "canonical_events": q_canonical_events,
    "ingest_events": q_ingest_events,
    "adapt_multistore": q_adapt_multistore,
    "adapt_retail": q_adapt_retail,
    "adapt_heuristic": q_adapt_heuristic,
    "adapt_auto": q_adapt_auto,
    "sessions_approx": _click(channel.sessions_approx_check),
    # dashboard reports over a selection
    "country_funnel_seq_selected": _selected(funnel.country_funnel_seq),
    "funnel_kpis_selected": _selected(funnel.funnel_kpis),
    "channel_cvr_seq_selected": _selected(funnel.channel_cvr_seq),
    "worst_market_selected": _selected(funnel.worst_market),
    # rows that the ingestion sets aside
    "ingest_rejects": q_ingest_rejects,
    "ingest_reject_rows": q_ingest_reject_rows,
    "ingest_damaged_events": q_ingest_damaged_events,
    "sessions_sketch_rollup": q_sessions_sketch_rollup,
    "top_users": _click(_top_users),
    "top_users_orders": _orders(_top_users),
    "csv_roundtrip": q_csv_roundtrip,
    "table_roundtrip": q_table_roundtrip,
    "assign_dims": q_assign_dims,
    "parse_times": q_parse_times,
    "preview_head": q_preview_head,
    "segment_filter": q_segment_filter,
    # the country average as a join of its own
    "depth_correlated": _click(depth.depth_correlated),
    # streaming re-aim of the hourly report (event-time hours)
    "hourly_abandonment_stream": q_hourly_abandonment_stream,
    # order-based fixture: long date range, real dimension joins
    "country_funnel_orders": _orders(funnel.country_funnel),
    "channel_rank_orders": _orders(channel.channel_rank),
    "weekly_trend_orders": _orders(trend.weekly_trend),
    "cohort_retention_orders": _orders(cohort.cohort_retention),
    "order_value_orders": _orders(spend.order_value),
    "device_funnel_orders": _orders(funnel.device_funnel),
    "channel_country_rollup_orders": _orders(channel.channel_country_rollup),
    "channel_vs_average_orders": _orders(channel.channel_vs_average),
    "session_quality_orders": _orders(depth.session_quality),
    "country_funnel_seq_orders": _orders(funnel.country_funnel_seq),
    "channel_cvr_seq_orders": _orders(funnel.channel_cvr_seq),
    "device_cvr_seq_orders": _orders(funnel.device_cvr_seq),
    "home_country_funnel_orders": _orders(lambda ev: home.home_funnel(ev, "country")),
    "channel_country_matrix_orders": _orders(home.channel_country_matrix),
    "cohort_selfjoin_orders": _orders(cohort.cohort_selfjoin),
    "cart_abandoners_2h_orders": _orders(followup.cart_abandoners),
    "time_to_purchase_orders": _orders(followup.time_to_purchase),
    "running_events_by_minute_orders": _orders(runs.running_events_by_minute),
    "purchase_sequence_orders": _orders(runs.purchase_sequence),
}

# The flagship query returned by `entry`.
FLAGSHIP = "country_funnel"
