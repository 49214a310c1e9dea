"""Command line: list and run reports, ingest raw exports.

  python -m funnelkit list
  python -m funnelkit run country_funnel --events /data/events_canonical [--out /data/reports/cf]
                      [--countries DE,NL] [--devices mobile,tablet]
  python -m funnelkit ingest --source multistore --path /data/export/ --out /data/events_canonical

`run` reads a canonical events table (parquet; `--csv` for a CSV written by the
CSV sink), prints the report or writes it as parquet with `--out`.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from funnelkit.reports import REPORTS
from funnelkit.session import configure, size_shuffles


def _session() -> SparkSession:
    from pyspark import SparkConf

    builder = SparkSession.builder.appName("funnelkit")
    if not SparkConf().contains("spark.master"):  # plain `python -m`, not spark-submit
        builder = builder.master("local[*]").config("spark.ui.enabled", "false")
    return configure(builder.getOrCreate())


def _split(text: str | None) -> list[str]:
    return [x for x in (text or "").split(",") if x]


def _run(args) -> int:
    spark = _session()
    from funnelkit.sources.files import current_version
    size_shuffles(spark, [current_version(spark, args.events)])
    if args.csv:
        from funnelkit.sources.files import read_events_csv
        events = read_events_csv(spark, args.events)
    else:
        from funnelkit.sources.files import read_canonical
        events = read_canonical(spark, args.events)
    for column, chosen in (("country", _split(args.countries)), ("device", _split(args.devices))):
        if chosen:
            events = events.where(F.col(column).isin(*chosen))
    df = REPORTS[args.report](events)
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
        return 0
    df = df.cache()
    df.show(args.rows, truncate=False)
    more = df.count() - args.rows
    if more > 0:
        print(f"{more} more rows; use --rows or --out for all of them")
    df.unpersist()
    return 0


def _ingest(args) -> int:
    from funnelkit.sources import adapters
    from funnelkit.sources.ingest import ingest, reject_counts

    spark = _session()
    sources = adapters.export_sources(spark, args.path)
    order = [args.source] if args.source != "auto" else list(sources)
    checks = ingest([sources[name] for name in order], args.out, min_rows=args.min_rows)
    rows = checks.collect()
    for r in rows:
        print(f"{'ok  ' if r.passed else 'FAIL'} {r.check_name}: {r.observed}")
    passed = all(r.passed for r in rows)
    for r in reject_counts(spark, args.out).orderBy("reason").collect() if passed else []:
        print(f"set aside ({r.reason}): {r.n}")
    return 0 if passed else 1


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="funnelkit")
    sub = p.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("report", choices=sorted(REPORTS))
    run.add_argument("--events", required=True)
    run.add_argument("--csv", action="store_true")
    run.add_argument("--out")
    run.add_argument("--rows", type=int, default=50)
    run.add_argument("--countries", help="comma-separated selection, e.g. DE,NL (default: all)")
    run.add_argument("--devices", help="comma-separated selection, e.g. mobile (default: all)")
    ing = sub.add_parser("ingest")
    ing.add_argument("--source", choices=["auto", "multistore", "retail", "heuristic"], default="auto")
    ing.add_argument("--path", required=True)
    ing.add_argument("--out", required=True)
    ing.add_argument("--min-rows", type=int, default=100_000)
    args = p.parse_args(argv)
    if args.cmd == "list":
        print("\n".join(sorted(REPORTS)))
        return 0
    return _run(args) if args.cmd == "run" else _ingest(args)


if __name__ == "__main__":
    sys.exit(main())
