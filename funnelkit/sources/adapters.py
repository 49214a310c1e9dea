"""Source adapters: three raw clickstream shapes -> raw frame `standardise` accepts.

A  multi-store export: already has event_time / event_type / user_id (+ price).
B  retail export: epoch-millisecond `timestamp`, `visitorid`, `event` with
   view / addtocart / transaction.
C  unknown export: columns renamed by name heuristics; the named file, else the
   first `*.csv` of the folder.

Adapters only rename / map values (per-row projections). `first_successful`
tries them in order; an adapter succeeds when its output resolves to the
required columns (checked on the schema, no data is read).

`raw_*` build each raw shape from the driver's `events` table so the adapters
are exercised on data that grows with the scale factor.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit import schema
from funnelkit.sources import files
from funnelkit.sources.fixtures import USER_SPLIT, table

LOG = logging.getLogger("funnelkit")

REQUIRED = ("event_time", "event_type", "user_id")

# Raw event vocabularies of the three sources built from the
# driver's event types (error rows are non-funnel events in every source).
MULTISTORE_EVENTS = {"view": "view", "click": "view", "signup": "cart", "purchase": "purchase",
                     "error": "remove_from_cart"}
RETAIL_EVENTS = {"view": "view", "click": "view", "signup": "addtocart", "purchase": "transaction",
                 "error": "error"}
RETAIL_COLUMNS = ("timestamp", "visitorid", "event")
RETAIL_SCHEMA = "timestamp BIGINT, visitorid STRING, event STRING"
# Heuristic renaming rules, tried in this order per column (first rule wins)
HEURISTIC_RULES = (
    ("event_type", (("event", "type"),)),
    ("event_time", (("time",), ("date",))),
    ("user_id", (("user",), ("visitor",), ("session",))),
)


def _map(col: str, mapping: dict[str, str]):
    expr = None
    for raw, mapped in mapping.items():
        cond = F.col(col) == F.lit(raw)
        expr = F.when(cond, F.lit(mapped)) if expr is None else expr.when(cond, F.lit(mapped))
    return expr.otherwise(F.col(col))


def _user():
    return F.concat(F.col("user_id").cast("string"), F.lit("-"), (F.col("event_id") % USER_SPLIT).cast("string"))


# ---------------------------------------------------------------- raw shapes

def raw_multistore(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.date_format("ts", files.TS_FORMAT).alias("event_time"),
        _map("event_type", MULTISTORE_EVENTS).alias("event_type"),
        _user().alias("user_id"),
        F.col("value").alias("price"),
        F.col("event_id"),
        F.col("props"),
    )


def raw_retail(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
        _user().alias("visitorid"),
        _map("event_type", RETAIL_EVENTS).alias("event"),
        F.col("event_id"),
    )


def raw_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id"),
        F.date_format("ts", files.TS_FORMAT).alias("Event_Date"),
        _map("event_type", RETAIL_EVENTS).alias("Event_Type"),
        _user().alias("Visitor_Session"),
        F.col("value").alias("price"),
    )


def raw_damaged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The multi-store export as CSV lines (column `line`, header as its name), some damaged by a rule of event_id.

    Of the ids divisible by 97 the time is no time, by 89 the price is no number,
    by 83 the line lacks its last column, by 79 it has one more, by 73 it has no user.
    """
    ev = raw_multistore(spark, sf_dir)
    time = F.expr("CASE WHEN event_id % 97 = 0 THEN 'yesterday' ELSE event_time END")
    price = F.expr("CASE WHEN event_id % 89 = 0 THEN 'n/a' ELSE CAST(price AS STRING) END")
    user = F.expr("CASE WHEN event_id % 73 = 0 THEN '' ELSE user_id END")
    line = F.expr("CASE WHEN event_id % 83 = 0 THEN line WHEN event_id % 79 = 0 THEN concat(line, ',', event_id, ',surplus')"
                  " ELSE concat(line, ',', event_id) END")
    return ev.select("event_id", F.concat_ws(",", time, "event_type", user, price).alias("line")).select(
        line.alias("event_time,event_type,user_id,price,event_id"))


# ---------------------------------------------------------------- adapters

def _need(raw: DataFrame, columns: Sequence[str]) -> None:
    lacking = sorted(set(columns) - set(raw.columns))
    if lacking:
        raise ValueError(f"this export has no {', '.join(lacking)} among {raw.columns}")


def adapt_multistore(raw: DataFrame) -> DataFrame:
    _need(raw, REQUIRED)
    return raw


def adapt_retail(raw: DataFrame) -> DataFrame:
    _need(raw, RETAIL_COLUMNS)
    renamed = raw.withColumnsRenamed({"event": "event_type", "visitorid": "user_id", "timestamp": "event_time"})
    return renamed.withColumn("event_type", _map("event_type", schema.RAW_EVENT_MAP))


def heuristic_names(columns: Sequence[str]) -> dict[str, str]:
    """{raw name: canonical name}; a canonical name is given to its first match only."""
    out, taken = {}, set()
    for col in columns:
        lc = col.lower()
        for target, patterns in HEURISTIC_RULES:
            if any(all(p in lc for p in pattern) for pattern in patterns):
                if target not in taken and col != target:
                    out[col] = target
                taken.add(target)
                break
    return out


def adapt_heuristic(raw: DataFrame) -> DataFrame:
    df = raw.withColumnsRenamed(heuristic_names(raw.columns))
    if "event_type" in df.columns:
        df = df.withColumn("event_type", _map("event_type", schema.RAW_EVENT_MAP))
    return df


def read_heuristic_source(spark: SparkSession, folder: str, preferred: str = "events.csv") -> DataFrame:
    """The preferred file if present, else the first `*.csv` in the folder."""
    path = f"{folder.rstrip('/')}/{preferred}"
    if not files.path_exists(spark, path):
        found = files.list_files(spark, folder, ".csv")
        if not found:
            raise FileNotFoundError(f"{folder} holds no .csv file")
        path = found[0]
    return adapt_heuristic(files.read_csv_lenient(spark, path))


def export_sources(spark: SparkSession, path: str) -> dict[str, Callable[[], DataFrame]]:
    """The known readers of an export at `path`, in the order in which they are tried.

    A folder with a single `.csv` entry stands for that entry, any other folder
    for all its files.
    """
    def multistore() -> DataFrame:
        return adapt_multistore(files.read_csv_lenient(spark, _only_csv(spark, path)))

    def retail() -> DataFrame:
        raw = files.read_csv_lenient(spark, _only_csv(spark, path))
        _need(raw, RETAIL_COLUMNS)
        return adapt_retail(raw.withColumn("timestamp", F.col("timestamp").try_cast("bigint")))

    def heuristic() -> DataFrame:
        return read_heuristic_source(spark, path)

    return {f.__name__: f for f in (multistore, retail, heuristic)}


def _only_csv(spark: SparkSession, path: str) -> str:
    found = files.list_files(spark, path, ".csv")
    return found[0] if len(found) == 1 else path


def first_successful(candidates: Sequence[Callable[[], DataFrame]]) -> DataFrame:
    """The first candidate whose frame resolves with the required columns; refusals are logged."""
    errors = []
    for make in candidates:
        try:
            df = make()
            missing = [c for c in REQUIRED if c not in df.columns]
            if missing:
                raise ValueError(f"missing {missing}")
            return df
        except Exception as exc:  # noqa: BLE001 - any failing source falls through
            errors.append(f"{getattr(make, '__name__', make)}: {exc}")
            LOG.warning("source refused: %s", errors[-1])
    raise RuntimeError("no source succeeded: " + "; ".join(errors))
