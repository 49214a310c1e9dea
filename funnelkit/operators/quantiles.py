"""Exact quantiles of a BIGINT per group, without collecting or sorting a group's values.

Values collapse to (group, value) counts first, so ties and hot groups are
combined before the shuffle. A histogram of fixed-width buckets finds the bucket
that holds each wanted rank; the bucket is cut into narrower ones, and so on
until a bucket is one value wide. A level reads the counts of the open buckets
only, windows over at most `BUCKETS` rows of each and writes the ranks it leaves,
one a group and percent, to the shared folder; the number of levels depends on
the range of the values alone (4 for any 64-bit range).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.session import saved

BUCKETS = 1 << 16


def quantile_disc(df: DataFrame, group: Sequence[str], value: str, percents: Sequence[int]) -> DataFrame:
    """(group..., n, p<percent>...): the smallest value with at least percent % of the values up to it.

    NULL values do not count; a group without values has no row; NULL is a group
    of its own. `group` may be empty (one row, none if there is no value).
    """
    spark, g = df.sparkSession, [f"__g{i}" for i in range(len(group))]
    named = df.where(f"{value} IS NOT NULL").select(*[F.col(c).alias(a) for c, a in zip(group, g)],
                                                    F.col(value).cast("bigint").alias("__v"))
    cells = saved(named.groupBy(*g, "__v").agg(F.count(F.lit(1)).alias("__n")), "quantile-cells")
    ends = cells.agg(F.min("__v").alias("low"), F.max("__v").alias("high")).first()
    if ends["low"] is None:
        columns = [*[f"{c} {df.schema[c].dataType.simpleString()}" for c in group], "n bigint", *[f"p{p} bigint" for p in percents]]
        return spark.createDataFrame([], ", ".join(columns))
    low, span = ends["low"], ends["high"] - ends["low"] + 1
    if span >= 1 << 63:
        raise ValueError("the values span more than a BIGINT")
    placed = cells.selectExpr(*g, "__n", f"__v - ({low}L) AS __at")
    totals = cells.groupBy(*g).agg(F.sum("__n").alias("n"))
    # wanted: the rank inside the open bucket, numbered at the current width
    wanted = totals.withColumn("percent", F.explode(F.array(*[F.lit(int(p)) for p in percents]))).selectExpr(
        *g, "n", "percent", "greatest(1L, (n * percent + 99) DIV 100) AS rank", "0L AS bucket")
    width = 1
    while width < span:
        width *= BUCKETS
    while width > 1:
        wide, width = width, width // BUCKETS
        opened = wanted.select(*[F.col(c).alias(f"o{c}") for c in g], F.col("bucket").alias("__open")).distinct()
        inside = placed.withColumn("__in", F.expr(f"__at DIV {wide}")).join(opened, _same(g, "o") & (F.col("__in") == F.col("__open")))
        hist = inside.groupBy(*g, "__in", F.expr(f"__at DIV {width} AS __sub")).agg(F.sum("__n").alias("__n"))
        by = ", ".join([*g, "__in"])
        steps = hist.selectExpr(*[f"{c} AS h{c}" for c in g], "__in", "__sub", "__n",
                                f"sum(__n) OVER (PARTITION BY {by} ORDER BY __sub) AS __upto")
        wanted = saved(wanted.join(steps, _same(g, "h") & F.expr("bucket = __in AND rank > __upto - __n AND rank <= __upto")).selectExpr(
            *g, "n", "percent", "rank - (__upto - __n) AS rank", "__sub AS bucket"), "quantile-ranks")
    return wanted.groupBy(*g).agg(F.max("n").alias("n"), *[
        F.max(F.expr(f"CASE WHEN percent = {int(p)} THEN bucket + ({low}L) END")).alias(f"p{p}") for p in percents]).select(
            *[F.col(a).alias(c) for c, a in zip(group, g)], "n", *[f"p{p}" for p in percents])


def _same(g: Sequence[str], prefix: str) -> F.Column:
    on = F.lit(True)
    for c in g:
        on = on & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return on
