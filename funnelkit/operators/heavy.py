"""Most frequent values of an open column (user ids, urls), exactly and without sorting all values.

1. Every task keeps a Misra-Gries summary of at most 2 x `capacity` counters. What
   a value's counters lack of its true count is at most the sum of what the tasks
   took off, which is at most rows / capacity.
2. The `capacity` values with the largest summed counters are the candidates;
   they are broadcast (bounded by the parameter) and counted exactly in a second
   pass with partial sums in each task.
3. If the k-th exact count exceeds what any other value can have, the first k are
   proven. If not - a flat distribution has no heavy hitters - all values are
   counted, hash-aggregated, and each task keeps its first k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.session import saved

CAPACITY = 4096


def _summary(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        lacking = 0
        for batch in batches:
            found = pc.value_counts(batch.column("value"))
            for value, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist()):
                counts[value] = counts.get(value, 0) + n
            if len(counts) > 2 * capacity:
                every = np.fromiter(counts.values(), np.int64, len(counts))
                off = int(np.partition(every, len(every) - capacity - 1)[len(every) - capacity - 1])
                counts = {v: n - off for v, n in counts.items() if n > off}
                lacking += off
        yield pa.record_batch({"value": pa.array([None, *counts], pa.string()),
                               "n": pa.array([lacking, *counts.values()], pa.int64())})
    return run


def candidates(values: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(candidate values, the most often that any other value can occur) of the text column `value`."""
    merged = saved(values.mapInArrow(_summary(capacity), "value string, n bigint").groupBy("value").agg(F.sum("n").alias("n")),
                   "heavy-summary")
    lacking = merged.where("value IS NULL").first()
    largest = merged.where("value IS NOT NULL").orderBy(F.desc("n"), "value").limit(capacity + 1).collect()
    chosen = merged.sparkSession.createDataFrame([(r.value,) for r in largest[:capacity]], "value string")
    beyond = largest[capacity].n if len(largest) > capacity else 0
    return chosen, beyond + (lacking.n if lacking else 0)


def top_values(df: DataFrame, column: str, k: int = 20, capacity: int = CAPACITY) -> DataFrame:
    """value, n: the k most frequent non-NULL values of `column` as text, ties by the smaller value."""
    values = df.where(f"{column} IS NOT NULL").selectExpr(f"CAST({column} AS STRING) AS value")

    def first(rows: DataFrame) -> DataFrame:
        return rows.groupBy("value").agg(F.expr("count(1) AS n")).orderBy(F.desc("n"), "value").limit(k)

    chosen, others = candidates(values, capacity)
    exact = first(values.join(F.broadcast(chosen), "value"))
    rows = exact.collect()
    if others == 0 or (len(rows) == k and rows[-1].n > others):
        return df.sparkSession.createDataFrame(rows, exact.schema)
    return first(values)
