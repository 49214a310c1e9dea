"""Scans over globally sorted rows: dense rank, running sums and lag without a one-task window.

A window over a whole country, user or time series brings its rows into one
task. Here the rows are range-partitioned and sorted by (group, order) - the
order should be unique, so that a hot value spreads over several partitions -
and three steps follow:

1. every partition is scanned on its own (dense rank, sums and lag counted from
   its first row) and the sorted rows are checkpointed, which keeps partitions,
   their order and the range boundaries fixed;
2. two rows a partition - its first and last one with the totals there - are
   folded on the driver into what each partition must carry in. Their number is
   that of the partitions, whatever the number of rows or groups;
3. the carries are broadcast and added to the rows of a partition's first group,
   the only one that can have begun before.

The result is in global order, so a report needs no further sort. One shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from funnelkit.operators.ordering import sort_key
from funnelkit.session import shared_dir

PART, POS, HEAD, EDGE = "__part", "__pos", "__head", "__edge"


def _changes(column: pa.Array, before: pa.Array | None) -> np.ndarray:
    """Whether each value differs from the one above it (nulls are equal); `before` is the row above the first."""
    above = pa.concat_arrays([before if before is not None else column.slice(0, 1), column.slice(0, len(column) - 1)])
    differs = pc.fill_null(pc.not_equal(column, above), False)
    differs = pc.or_(differs, pc.xor(pc.is_null(column), pc.is_null(above)))
    out = np.array(differs.to_numpy(zero_copy_only=False), bool)
    if before is None:
        out[0] = True
    return out


def _scan_partition(group: Sequence[str], rank_by: Sequence[str], rank: str | None, sums: Mapping[str, str],
                    lags: Mapping[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, pos, groups = TaskContext.get().partitionId(), 0, 0
        last: dict[str, pa.Array] = {}
        last_rank, totals = 0, {name: 0 for name in sums}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts = np.zeros(n, bool)
            if not last:
                starts[0] = True
            for c in group:
                starts |= _changes(batch.column(c), last.get(c))
            index = np.arange(n)
            since = np.maximum.accumulate(np.where(starts, index, -1))
            began = since >= 0  # else the group began in an earlier batch of this partition
            at = np.maximum(since, 0)
            extra: dict[str, pa.Array] = {}
            if rank:
                new = starts.copy()
                for c in rank_by:
                    new |= _changes(batch.column(c), last.get(c))
                count = np.cumsum(new)
                ranks = np.where(began, count - count[at] + 1, last_rank + count)
                last_rank = int(ranks[-1])
                extra[rank] = pa.array(ranks, pa.int64())
            for name, source in sums.items():
                values = pc.fill_null(batch.column(source).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
                run_sum = np.cumsum(values)
                total = np.where(began, run_sum - run_sum[at] + values[at], totals[name] + run_sum)
                totals[name] = int(total[-1])
                extra[name] = pa.array(total, pa.int64())
            for name, source in lags.items():
                column = batch.column(source)
                first = last[source] if last else pa.nulls(1, column.type)
                above = pa.concat_arrays([first, column.slice(0, n - 1)])
                extra[name] = pc.if_else(pa.array(starts), pa.nulls(n, column.type), above)
            seen = groups + np.cumsum(starts)
            groups = int(seen[-1])
            extra |= {PART: pa.array(np.full(n, part, np.int32)), POS: pa.array(pos + index, pa.int64()),
                      HEAD: pa.array(seen <= 1), EDGE: pa.array(np.zeros(n, bool))}
            pos += n
            last = {c: batch.column(c).slice(n - 1, 1) for c in {*group, *rank_by, *lags.values()}}
            out = pa.RecordBatch.from_arrays([*batch.columns, *extra.values()], names=[*batch.schema.names, *extra])
            yield out
        if pos:  # the last row once more, marked
            edge = out.slice(out.num_rows - 1, 1)
            yield edge.set_column(edge.num_columns - 1, EDGE, pa.array([True]))
    return run


def sorted_scan(df: DataFrame, group: Sequence[str], order: Sequence[str], rank: str | None = None,
                rank_by: Sequence[str] = (), sums: Mapping[str, str] | None = None,
                lags: Mapping[str, str] | None = None) -> DataFrame:
    """`df` in the order (group ASC NULLS FIRST, order) with scan columns added.

    rank:  name of the dense rank of `rank_by` (leading columns of `order`) within the group, INT
    sums:  {new column: integer column}, running sums within the group, BIGINT, NULL counting as 0
    lags:  {new column: column}, the value of the row before within the group, NULL on its first row
    `order` takes specs like "col DESC"; where it ties, the order of the tied rows is open.
    """
    sums, lags = dict(sums or {}), dict(lags or {})
    spark = df.sparkSession
    shared_dir(spark)
    keys = [sort_key(f"{c} ASC NULLS FIRST") for c in group] + [sort_key(s) for s in order]
    added = [T.StructField(rank, T.LongType())] if rank else []
    added += [T.StructField(name, T.LongType()) for name in sums]
    added += [T.StructField(name, df.schema[source].dataType) for name, source in lags.items()]
    helpers = [T.StructField(PART, T.IntegerType()), T.StructField(POS, T.LongType()), T.StructField(HEAD, T.BooleanType()),
               T.StructField(EDGE, T.BooleanType())]
    local = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
             .mapInArrow(_scan_partition(group, rank_by, rank, sums, lags), T.StructType([*df.schema.fields, *added, *helpers]))
             .checkpoint(eager=True))
    carries = _carries(local, group, rank_by, rank, sums, lags)
    schema = T.StructType([T.StructField("__in", T.IntegerType()), T.StructField("__rank", T.LongType()),
                           *[T.StructField(f"__sum{i}", T.LongType()) for i in range(len(sums))],
                           *[T.StructField(f"__lag{i}", df.schema[s].dataType) for i, s in enumerate(lags.values())]])
    joined = local.where(~F.col(EDGE)).join(F.broadcast(spark.createDataFrame(carries, schema)), F.col(PART) == F.col("__in"))
    out = [F.col(c) for c in df.columns]
    if rank:
        out.append((F.col(rank) + F.when(F.col(HEAD), F.col("__rank")).otherwise(0)).cast("int").alias(rank))
    out += [(F.col(name) + F.when(F.col(HEAD), F.col(f"__sum{i}")).otherwise(0)).alias(name) for i, name in enumerate(sums)]
    out += [F.when(F.col(POS) == 0, F.col(f"__lag{i}")).otherwise(F.col(name)).alias(name) for i, name in enumerate(lags)]
    return joined.select(*out)


def _carries(local: DataFrame, group, rank_by, rank, sums, lags) -> list[tuple]:
    """(partition, rank, sums..., lags...) to add: the fold of the partitions' edge rows."""
    def row(columns) -> F.Column:
        return F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]) if columns else F.struct(F.lit(0).alias("c0"))

    rows = local.where((F.col(POS) == 0) | F.col(EDGE)).select(
        PART, EDGE, HEAD, row(group).alias("group"), row(rank_by).alias("key"), row([rank] if rank else []).alias("rank"),
        row(list(sums)).alias("sums"), row(list(lags.values())).alias("lags")).collect()
    firsts, lasts = ({r[PART]: r for r in rows if r[EDGE] == edge} for edge in (False, True))
    out, before = [], None
    for part, first in sorted(firsts.items()):
        e = lasts[part]
        goes_on = before is not None and before["group"] == first["group"]
        add_rank = before["rank"] - (before["key"] == first["key"]) if goes_on else 0
        add_sums = before["sums"] if goes_on else [0] * len(sums)
        out.append((part, add_rank, *add_sums, *(before["lags"] if goes_on else [None] * len(lags))))
        whole = goes_on and e[HEAD]  # the partition ends in the group that it began with
        before = {"group": e["group"], "key": e["key"], "lags": list(e["lags"])[:len(lags)],
                  "rank": (e["rank"][0] if rank else 0) + (add_rank if whole else 0),
                  "sums": [s + (a if whole else 0) for s, a in zip(list(e["sums"])[:len(sums)], add_sums)]}
    return out
