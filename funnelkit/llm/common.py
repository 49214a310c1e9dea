"""Helpers shared by the operators: scratch tables, hash folds, row filters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from funnelkit.session import scratch_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole `documents` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write `df` to a fresh table in the shared folder and read it back.

    Cuts lineage: what follows re-reads the files, so a lost executor costs a
    re-read and never the work before it. `session.drop_scratch` deletes the
    tables of this process once their results were consumed.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(_nullable(df.schema)).parquet(path)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def fold(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(folds)


def fold_of(doc_id: int | None, folds: int) -> int:
    """`fold` in plain Python, for tests."""
    import zlib

    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def text_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that a task holds few long texts as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


_KEPT: dict = {}


def kept(key, make):
    """The worker process's object for `key`, kept from task to task.

    A process keeps one: another key's object replaces it, so the memories of
    a pipeline's stages never add up in a reused worker.
    """
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


MAX_STRATA = 100_000


def sample_by_hash(rows: DataFrame, key: Column, strata: list[str], n: int, seed: int) -> DataFrame:
    """At most `n` rows of each stratum, those with the smallest hash of `key`: a fixed, bounded sample.

    Counts come first, so that the ranking sees about 2 `n` rows a stratum
    rather than the table; the draw depends on `key` alone, not on partitions.
    The counts are broadcast: one row a stratum, at most `MAX_STRATA`, checked.
    """
    from pyspark.sql import Window

    names = [f"__s{i}" for i in range(len(strata))]
    sizes = rows.groupBy(*[F.col(s).alias(a) for s, a in zip(strata, names)]).agg(F.count(F.lit(1)).alias("__size"))
    held = sizes.limit(MAX_STRATA + 1).collect()
    if len(held) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata")
    sizes = F.broadcast(rows.sparkSession.createDataFrame(held, sizes.schema))
    u = (F.xxhash64(key, F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53)))
    on = [F.col(s).eqNullSafe(F.col(a)) for s, a in zip(strata, names)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    drawn = (rows.withColumn("__u", u).join(sizes, cond)
             .where(F.col("__u") * F.col("__size") <= F.lit(2.0 * n + 50)))
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy("__u", key))
    return drawn.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__u", "__size", "__rank", *names)


MAX_HOT = 100_000
HOT_ROWS = 4096


def join_by_group(rows: DataFrame, lookup: DataFrame, keys: list[str], size: str) -> DataFrame:
    """`rows` left-joined with `lookup` (unique keys, without nulls; `size` counts the rows of a key), `size` dropped.

    Keys with over `HOT_ROWS` rows are joined from a broadcast list, so that no
    task gets all rows of a hot key; if there are more than `MAX_HOT` such keys
    the bound rises until the list is short enough, which it must, as n rows
    hold at most n / bound such keys. The other keys meet by a shuffle, with no
    more rows a key than the bound.
    """
    bound = HOT_ROWS
    while (found := lookup.where(F.col(size) > bound).limit(MAX_HOT + 1).count()) > MAX_HOT:
        bound *= 16
    if not found:
        return rows.join(lookup.drop(size), keys, "left")
    hot = F.broadcast(lookup.where(F.col(size) > bound).drop(size))
    rest = rows.join(hot, keys, "left_anti").join(lookup.where(F.col(size) <= bound).drop(size), keys, "left")
    return rows.join(hot, keys).unionByName(rest)
