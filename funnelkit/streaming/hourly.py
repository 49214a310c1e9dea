"""Hourly checkout abandonment as a Structured Streaming job.

The batch report groups by hour of day; as a stream the natural bucket is the
event-time hour. Per hour it counts *distinct* carting and purchasing users.
Files may arrive in any order, so there is no watermark: nothing is late, and
the newest hours are reported while they are still open.

The keys seen so far - distinct (hour, user, type) - are kept as sorted-out *runs*
in merged levels: a batch adds a run of level 0, and as soon as a level has `FAN`
runs they become one run of the next level. After n batches there are at most
(FAN - 1) * log_FAN(n) + 1 runs, so a batch reads that many small folders for its
days, however many batches went before, and a key is rewritten once a level.

Every micro-batch

1. writes its distinct keys to `keys/run=b<n>`, split by day, replacing what an
   earlier attempt of the same batch left there;
2. recounts the hours it touched from the live runs of their days and writes them
   to `hours/batch_id=<n>`, likewise replaced on a retry;
3. merges full levels into new runs and lists the live ones in `manifest/batch=<n>`.

The report is the newest count of each hour. A restart resumes from the
checkpoint; a batch that runs again starts from the manifest before it, whose runs
are only removed once a later batch has begun.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from funnelkit.functions.rates import pct_sql
from funnelkit.session import scratch_path
from funnelkit.sources import files
from funnelkit.sources.fixtures import clickstream_from

RAW_EVENTS_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
KEYS_SCHEMA = "hour_start TIMESTAMP, user_id STRING, event_type STRING, run STRING, day DATE"
MANIFEST_SCHEMA = "level INT, run STRING"
HOURS_SCHEMA = "hour_start TIMESTAMP, cart_users BIGINT, purchase_users BIGINT, batch_id BIGINT"
FAN = 4


def read_event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet",
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Raw event files arriving in `folder` as a stream (explicit schema)."""
    reader = spark.readStream.schema(RAW_EVENTS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(f"{folder.rstrip('/')}/{pattern}")


def hour_keys(events: DataFrame) -> DataFrame:
    """(hour_start, user_id, event_type, day) of the cart and purchase events."""
    return events.where("event_type IN ('cart', 'purchase') AND user_id IS NOT NULL AND event_time IS NOT NULL").selectExpr(
        "CAST(date_trunc('HOUR', event_time) AS TIMESTAMP) AS hour_start", "user_id", "event_type",
        "CAST(event_time AS DATE) AS day")


def keys_of(spark: SparkSession, base: str, runs: list[str]) -> DataFrame:
    """The keys of some runs."""
    reader = spark.read.schema(KEYS_SCHEMA).option("basePath", f"{base}/keys")
    return reader.parquet(*[f"{base}/keys/run={run}" for run in runs])


def _write_run(keys: DataFrame, base: str, run: str) -> None:
    keys.select("hour_start", "user_id", "event_type", "day").distinct().write.mode("overwrite").partitionBy("day").parquet(
        f"{base}/keys/run={run}")


def live_runs(spark: SparkSession, base: str, before: int) -> list[tuple[int, str]]:
    """(level, run) of the runs that hold all keys of the batches before batch `before`."""
    ids = [int(name.split("=")[1]) for name in files.list_folder(spark, f"{base}/manifest") if name.startswith("batch=")]
    last = max((i for i in ids if i < before), default=None)
    if last is None:
        return []
    return [(r.level, r.run) for r in spark.read.schema(MANIFEST_SCHEMA).parquet(f"{base}/manifest/batch={last}").collect()]


def _add_batch(base: str):
    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        live = live_runs(spark, base, batch_id)
        for name in set(files.list_folder(spark, f"{base}/keys")) - {f"run={run}" for _, run in live}:
            files.remove(spark, f"{base}/keys/{name}")  # merged by a batch that is done, or left by a broken attempt
        own = f"b{batch_id}"
        _write_run(batch, base, own)
        new = keys_of(spark, base, [own])
        touched = new.select("hour_start", "day").distinct()
        days = [r.day for r in touched.select("day").distinct().collect()]  # calendar days of one batch
        known = keys_of(spark, base, [own, *[run for _, run in live]]).where(F.col("day").isin(days))
        every = known.join(touched, ["day", "hour_start"], "left_semi").select("hour_start", "user_id", "event_type").distinct()
        hours = every.groupBy("hour_start").agg(
            F.expr("count_if(event_type = 'cart') AS cart_users"),
            F.expr("count_if(event_type = 'purchase') AS purchase_users"))
        hours.write.mode("overwrite").parquet(f"{base}/hours/batch_id={batch_id}")
        live, level = [*live, (0, own)], 0
        while len(full := [run for at, run in live if at == level]) >= FAN:
            merged = f"m{batch_id}-{level + 1}"
            _write_run(keys_of(spark, base, full), base, merged)
            live = [r for r in live if r[0] != level] + [(level + 1, merged)]
            level += 1
        spark.createDataFrame(live, MANIFEST_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{base}/manifest/batch={batch_id}")
    return add


def start_hourly_abandonment(events: DataFrame, base: str) -> StreamingQuery:
    """Process everything available now into the tables under `base`, then stop."""
    return (hour_keys(events).writeStream.foreachBatch(_add_batch(base))
            .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())


def hourly_report(spark: SparkSession, base: str) -> DataFrame:
    """hour_start, cart_users, purchase_users, abandoned, abandonment_rate_pct: the newest count of each hour."""
    hours = spark.read.schema(HOURS_SCHEMA).option("basePath", f"{base}/hours").parquet(f"{base}/hours")
    newest = hours.groupBy("hour_start").agg(
        F.expr("max_by(cart_users, batch_id) AS cart_users"), F.expr("max_by(purchase_users, batch_id) AS purchase_users"))
    return newest.selectExpr(
        "hour_start", "cart_users", "purchase_users", "cart_users - purchase_users AS abandoned",
        f"{pct_sql('cart_users - purchase_users', 'cart_users')} AS abandonment_rate_pct")


def hourly_abandonment_from_files(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None,
                                  base: str | None = None) -> DataFrame:
    """Run the stream over the event files once and read its report."""
    base = base or scratch_path(spark, "hourly-stream")
    events = clickstream_from(read_event_stream(spark, folder, max_files_per_trigger=max_files_per_trigger))
    start_hourly_abandonment(events, base).awaitTermination()
    return hourly_report(spark, base)
