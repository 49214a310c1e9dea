"""The user-facing report catalogue: name -> function(events DataFrame) -> DataFrame.

`events` is any DataFrame with the canonical columns (see `schema`), e.g. the
table written by `sources.ingest.ingest` or a fixture from `sources.fixtures`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from funnelkit.operators import flags, quality
from funnelkit.plans import channel, cohort, depth, followup, funnel, home, runs, spend, trend

Report = Callable[[DataFrame], DataFrame]

REPORTS: dict[str, Report] = {
    # SQL reports
    "country_funnel": funnel.country_funnel,
    "channel_rank": channel.channel_rank,
    "weekly_trend": trend.weekly_trend,
    "device_funnel": funnel.device_funnel,
    "cohort_retention": cohort.cohort_retention,
    "channel_country_rollup": channel.channel_country_rollup,
    "hourly_abandonment": trend.hourly_abandonment,
    "order_value": spend.order_value,
    "channel_vs_average": channel.channel_vs_average,
    "session_quality": depth.session_quality,
    "session_quality_full": depth.session_quality_full,
    # dashboard (sequential funnel)
    "funnel_kpis": funnel.funnel_kpis,
    "funnel_stages": funnel.funnel_stages,
    "country_funnel_seq": funnel.country_funnel_seq,
    "channel_cvr_seq": funnel.channel_cvr_seq,
    "device_cvr_seq": funnel.device_cvr_seq,
    "worst_market": funnel.worst_market,
    # notebook (home segment)
    "home_country_funnel": lambda ev: home.home_funnel(ev, "country"),
    "home_device_funnel": lambda ev: home.home_funnel(ev, "device"),
    "home_channel_funnel": home.home_channel_funnel,
    "channel_country_matrix": home.channel_country_matrix,
    "channel_conversion_summary": home.channel_conversion_summary,
    "overall_funnel": funnel.overall_funnel,
    # follow-up of carts and views
    "cart_abandoners_2h": followup.cart_abandoners,
    "time_to_purchase": followup.time_to_purchase,
    # long series
    "running_events_by_minute": runs.running_events_by_minute,
    "purchase_sequence": runs.purchase_sequence,
    # quality and profile
    "quality_checks": quality.quality_checks,
    "dataset_profile": quality.dataset_profile,
    "value_counts": quality.value_counts,
    "null_profile": quality.null_profile,
    "preview_head": quality.preview_head,
    # building blocks
    "user_flags": lambda ev: flags.user_flags(ev, ["country"]),
    "event_sets": flags.event_sets,
    "user_mode_dims": flags.user_mode_dims,
    "distinct_vs_flags": channel.distinct_vs_flags,
    "segment_cube": channel.segment_cube,
    "rollup_union": channel.rollup_union,
    "cohort_selfjoin": cohort.cohort_selfjoin,
    "depth_window": depth.depth_window,
    "sessions_approx": channel.sessions_approx,
}
