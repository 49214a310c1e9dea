"""Benchmark the headline reports; prints ONE JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each report runs on both fixtures (clickstream, order_events): one warm-up run,
then one timed run including building the report and `collect()`, the same
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from funnelkit.plans import channel, cohort, depth, funnel, home, spend, trend  # noqa: E402
from funnelkit.session import local_session  # noqa: E402
from funnelkit.sources.fixtures import clickstream, order_events  # noqa: E402

REPORTS = {
    "q01": funnel.country_funnel,
    "q02": channel.channel_rank,
    "q03": trend.weekly_trend,
    "q04": funnel.device_funnel,
    "q05": cohort.cohort_retention,
    "q06": channel.channel_country_rollup,
    "q07": trend.hourly_abandonment,
    "q08": spend.order_value,
    "q09": channel.channel_vs_average,
    "q10": depth.session_quality,
    # the same top-500 report, ranking every row through the ladder first
    "q10s": lambda ev: depth.session_quality_full(ev).limit(500),
    "app_country": funnel.country_funnel_seq,
    "app_channel": funnel.channel_cvr_seq,
    "app_device": funnel.device_cvr_seq,
    "nb_mode": lambda ev: home.home_funnel(ev, "country"),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, cpus, app_name="funnelkit-bench")
    fixtures = {"click": clickstream, "orders": order_events}
    timings: dict[str, float] = {}
    # the events tables are defined once, as a user would; they are not cached,
    # every run below re-reads the parquet files
    tables = {name: fixture(spark, sf_dir) for name, fixture in fixtures.items()}
    for events in tables.values():  # warm-up pass: one run of every report
        for report in REPORTS.values():
            report(events).collect()
    for fx_name, events in tables.items():
        for qid, report in REPORTS.items():
            key = qid if fx_name == "click" else f"{qid}_orders"
            t0 = time.perf_counter()
            report(events).collect()
            timings[key] = round(time.perf_counter() - t0, 4)
    spark.stop()
    total = round(sum(timings.values()), 4)
    sf = Path(sf_dir).name.replace("sf", "")
    print(json.dumps({"metric": "total_report_seconds", "value": total, "unit": "sec",
                      "queries": timings, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
