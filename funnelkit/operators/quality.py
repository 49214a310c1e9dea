"""Data quality checks and dataset profile.

Each check family is one global aggregate (a single pass, partial aggregation
per task, one row to the driver) turned into rows with `stack`, so the checks
scale with the data but return a fixed, tiny result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit import schema
from funnelkit.operators.flags import is_type
from funnelkit.sources.files import TS_FORMAT
from funnelkit.operators.ordering import order, order_small

PROFILE_COLUMNS = ("event_time", "user_id", "event_type", "country", "device", "channel")
VALUE_COUNT_COLUMNS = ("event_type", "country", "device", "channel")


def _stack(df: DataFrame, rows: Sequence[tuple[str, str, str]], names: Sequence[str]) -> DataFrame:
    """stack(n, 'label', expr_a, expr_b, ...) over a one-row frame."""
    args = ", ".join(f"'{label}', {a}, {b}" for label, a, b in rows)
    return df.selectExpr(f"stack({len(rows)}, {args}) AS ({', '.join(names)})")


def quality_checks(events: DataFrame, min_rows: int = schema.MIN_ROWS) -> DataFrame:
    """check_name, passed, observed — the post-ingest validation rules.

    Row count; each funnel event type present; each dimension column present
    and not entirely NULL; no NULL event_time / user_id. A missing dimension,
    event_time or user_id column fails its check instead of raising (the
    event_type column itself is required).
    """
    cols = set(events.columns)
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.count(F.when(is_type(t), 1)).alias(f"n_{t}") for t in schema.EVENT_TYPES]
    aggs += [(F.count(d) if d in cols else F.lit(0).cast("bigint")).alias(f"nn_{d}") for d in schema.DIMENSIONS]
    aggs += [(F.count(F.lit(1)) - F.count(c) if c in cols else F.count(F.lit(1))).alias(f"null_{c}")
             for c in ("event_time", "user_id")]
    one = events.agg(*aggs)
    rows = [("row_count", f"n_rows >= {int(min_rows)}", "n_rows")]
    rows += [(f"has_{t}_events", f"n_{t} > 0", f"n_{t}") for t in schema.EVENT_TYPES]
    rows += [(f"{d}_present", f"nn_{d} > 0", f"nn_{d}") for d in schema.DIMENSIONS]
    rows += [(f"{c}_no_nulls", f"null_{c} = 0", f"null_{c}") for c in ("event_time", "user_id")]
    return _stack(one, rows, ["check_name", "passed", "observed"])


def value_counts(events: DataFrame, columns: Sequence[str] = VALUE_COUNT_COLUMNS) -> DataFrame:
    """column_name, value, n — non-NULL value frequencies of several columns in one pass.

    Dimension columns: the events are grouped once by all of them, then the
    cells are unpivoted. Any other column may have as many values as rows: its
    values are unpivoted before the aggregate, and the sort is distributed.
    """
    if set(columns) <= {"event_type", *schema.DIMENSIONS}:
        counts = _unpivoted(events.groupBy(*columns).agg(F.expr("count(1) AS n")), columns)
        return order_small(counts, "column_name", "n DESC", "value")
    pairs = ", ".join(f"'{c}', CAST({c} AS STRING)" for c in columns)
    long = events.selectExpr(f"stack({len(columns)}, {pairs}) AS (column_name, value)")
    counts = long.where("value IS NOT NULL").groupBy("column_name", "value").agg(F.expr("count(1) AS n"))
    return order(counts, "column_name", "n DESC", "value")


def _unpivoted(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, value, n from cells that carry a count n."""
    pairs = ", ".join(f"'{c}', CAST({c} AS STRING)" for c in columns)
    long = cells.selectExpr("n AS cell_n", f"stack({len(columns)}, {pairs}) AS (column_name, value)")
    return long.where("value IS NOT NULL").groupBy("column_name", "value").agg(F.expr("sum(cell_n) AS n"))


def null_profile(events: DataFrame, columns: Sequence[str] = PROFILE_COLUMNS) -> DataFrame:
    """column_name, null_count."""
    one = events.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(f"nulls_{c}") for c in columns])
    pairs = ", ".join(f"'{c}', nulls_{c}" for c in columns)
    return one.selectExpr(f"stack({len(columns)}, {pairs}) AS (column_name, null_count)")


def dataset_profile(events: DataFrame) -> DataFrame:
    """section, column_name, value, n: value counts, NULL counts and the time range.

    One grouped scan: the cells of the dimension columns carry counts, NULL
    counts and times, and both parts of the profile are taken from them.
    """
    open_columns = [c for c in PROFILE_COLUMNS if c not in VALUE_COUNT_COLUMNS]
    cells = events.groupBy(*VALUE_COUNT_COLUMNS).agg(
        F.expr("count(1) AS n"), *[F.expr(f"count_if({c} IS NULL) AS nulls_{c}") for c in open_columns],
        F.expr("min(event_time) AS t_min"), F.expr("max(event_time) AS t_max"))
    vc = order_small(_unpivoted(cells, VALUE_COUNT_COLUMNS), "column_name", "n DESC", "value").select(
        F.lit("value_count").alias("section"), "column_name", "value", "n")
    one = cells.agg(
        *[F.expr(f"coalesce(sum(nulls_{c}), 0) AS nulls_{c}") for c in open_columns],
        *[F.expr(f"coalesce(sum(CASE WHEN {c} IS NULL THEN n ELSE 0 END), 0) AS nulls_{c}") for c in VALUE_COUNT_COLUMNS],
        F.date_format(F.min("t_min"), TS_FORMAT).alias("t_min"),
        F.date_format(F.max("t_max"), TS_FORMAT).alias("t_max"),
    )
    rows = [f"'null_count', '{c}', CAST(NULL AS STRING), nulls_{c}" for c in PROFILE_COLUMNS]
    rows += ["'min_time', 'event_time', t_min, CAST(NULL AS BIGINT)",
             "'max_time', 'event_time', t_max, CAST(NULL AS BIGINT)"]
    tail = one.selectExpr(f"stack({len(rows)}, {', '.join(rows)}) AS (section, column_name, value, n)")
    return vc.unionByName(tail)


def preview_head(events: DataFrame, n: int = 5) -> DataFrame:
    """First n events by (event_time, event_id): a deterministic head()."""
    return events.orderBy("event_time", "event_id").limit(n)
