"""File and table sources / sinks.

CSV columns are found by their header names and cast to an explicit schema (no
inference pass over the data); timestamps are written and read with microsecond
precision so a round trip is exact. Paths are any Hadoop-compatible URI; scratch output goes under the
cluster's shared folder (`session.scratch_path`), never a machine-local one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from funnelkit import schema

TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def read_csv(spark: SparkSession, path: str, schema_: T.StructType | str | None = None) -> DataFrame:
    """Header CSV; all columns text, or those of a schema, found by name.

    A header that lacks one of the schema's columns is an error, and so is a
    file whose header differs from the first file's. Values that do not parse
    become NULL.
    """
    df = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    if schema_ is None:
        return df
    wanted = T.StructType.fromDDL(schema_) if isinstance(schema_, str) else schema_
    missing = [f.name for f in wanted.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{path}: the header lacks {missing}; it has {df.columns}")
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted.fields])


def read_events_csv(spark: SparkSession, path: str) -> DataFrame:
    """Canonical events written by `write_csv`, parsed with the canonical schema."""
    return read_csv(spark, path, schema.CANONICAL_SCHEMA)


CORRUPT = "_corrupt_record"


def read_csv_lenient(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV as text columns plus `_corrupt_record`: the whole line where its number of columns differs from the header's."""
    names = spark.read.option("header", True).csv(path).columns
    wide = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    return (spark.read.option("header", True).option("columnNameOfCorruptRecord", CORRUPT)
           .option("columnPruning", False).schema(wide).csv(path))


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """A canonical events table (parquet; a published one in its current version, partitioned by
    event_type) read with the canonical schema: no footer-based inference."""
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.CANONICAL_SCHEMA.fields])
    folder = current_version(spark, path)
    events = f"{folder}/rejected=false"
    if path_exists(spark, events):
        folder = events
    elif path_exists(spark, f"{folder}/rejected=true"):  # every row was refused
        return spark.createDataFrame([], nullable)
    return spark.read.schema(nullable).parquet(folder).select(*schema.CANONICAL_COLUMNS)


REJECTS = "reason string, record string"


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """reason, record: what `ingest` set aside when it wrote the table's current version."""
    folder = f"{current_version(spark, path)}/rejected=true"
    if not path_exists(spark, folder):
        return spark.createDataFrame([], REJECTS)
    return spark.read.schema(REJECTS).parquet(folder).select("reason", "record")


def write_csv(df: DataFrame, path: str) -> str:
    """Header CSV, replacing the folder's content."""
    (df.write.mode("overwrite").option("header", True)
       .option("timestampNTZFormat", TS_FORMAT).option("timestampFormat", TS_FORMAT).csv(path))
    return path


def replace_table(spark: SparkSession, df: DataFrame, name: str, path: str) -> DataFrame:
    """Table sink with "replace" semantics: write a new version, publish it, re-point the view."""
    version = new_version(path)
    df.write.parquet(version)
    publish(spark, version)
    spark.read.parquet(current_version(spark, path)).createOrReplaceTempView(name)
    return spark.table(name)


def list_folder(spark: SparkSession, folder: str) -> list[str]:
    """Names of what stands in `folder`, none if there is no such folder."""
    return _names(spark, folder)


def list_files(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Sorted file paths under `folder` ending in `suffix` (Hadoop FileSystem)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(folder)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return []
    names = [s.getPath().toString() for s in fs.listStatus(hpath)]
    return sorted(n for n in names if n.endswith(suffix))


# A published table is a folder of versions. A version counts from the moment its
# marker, an empty file of the same name, stands: creating that file is one step in
# any store, nothing is deleted or renamed before it, and a reader that has resolved
# a version keeps reading it until `clean_versions` removes it.
VERSIONS, MARKERS = "versions", "published"


def new_version(path: str) -> str:
    """A fresh folder to write the next version of the table `path` into."""
    return f"{path.rstrip('/')}/{VERSIONS}/{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, hpath = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(hpath)) if fs.exists(hpath) else []


def publish(spark: SparkSession, version: str) -> None:
    """Make the finished folder `version` (see `new_version`) the current version of its table."""
    path, name = version.rstrip("/").rsplit(f"/{VERSIONS}/", 1)
    last = _names(spark, f"{path}/{MARKERS}")[-1:]
    number = int(last[0].split("-")[0]) + 1 if last else 1
    fs, marker = _fs(spark, f"{path}/{MARKERS}/{number:012d}-{name}")
    fs.create(marker, False).close()


def current_version(spark: SparkSession, path: str) -> str:
    """The folder that holds the table's current version; a plain folder stands for itself."""
    markers = _names(spark, f"{path.rstrip('/')}/{MARKERS}")
    return f"{path.rstrip('/')}/{VERSIONS}/{markers[-1].split('-', 1)[1]}" if markers else path.rstrip("/")


def clean_versions(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove all but the newest `keep` published versions, markers first; folders never published stay. Returns how many."""
    old = _names(spark, f"{path.rstrip('/')}/{MARKERS}")[:-max(1, keep)]
    for marker in old:
        remove(spark, f"{path.rstrip('/')}/{MARKERS}/{marker}")
        remove(spark, f"{path.rstrip('/')}/{VERSIONS}/{marker.split('-', 1)[1]}")
    return len(old)


def discard(spark: SparkSession, version: str) -> None:
    """Remove a version that was never published, and the table's folders if that leaves them empty."""
    remove(spark, version)
    versions = version.rstrip("/").rsplit("/", 1)[0]
    for folder in (versions, versions.rsplit("/", 1)[0]):
        if path_exists(spark, folder) and not _names(spark, folder):
            remove(spark, folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder or file this library wrote."""
    fs, hpath = _fs(spark, path)
    fs.delete(hpath, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = _fs(spark, path)
    return bool(fs.exists(hpath))
