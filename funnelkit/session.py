"""Session construction and the shared working folder.

On a cluster the session is built by the platform; `configure` only sets the
SQL options the reports rely on (UTC, AQE with skew-join and partition
coalescing). `shared_dir` returns the cluster-wide folder named by
`spark.checkpoint.dir`; only when that is unset (local tests) does it create
one of its own.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # parquet timestamps without zone read as TIMESTAMP_NTZ (the fixture's type)
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
    # users whose value counts a task merges in a hash map before it sorts instead (modes)
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL options the reports assume."""
    for key, value in SQL_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


# Shuffle sizing: as if all scanned bytes were shuffled, 512 MB a partition
# (100 TB: about 200 000); AQE coalesces whatever turns out smaller.
SHUFFLE_BYTES_PER_PARTITION = 512 * 1024 * 1024


def input_bytes(spark: SparkSession, paths: Sequence[str]) -> int:
    """Total size of the given files/folders (Hadoop FileSystem, no data read)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for p in paths:
        hpath = jvm.org.apache.hadoop.fs.Path(p)
        fs = hpath.getFileSystem(conf)
        if fs.exists(hpath):
            total += fs.getContentSummary(hpath).getLength()
    return total


def size_shuffles(spark: SparkSession, paths: Sequence[str]) -> int:
    """Set `spark.sql.shuffle.partitions` from the input size and return it.

    For a session of one's own (the command line calls it). At least the
    cluster's default parallelism; with AQE on this is the *initial* number,
    coalesced at run time, so a generous value costs little while a reducer's
    share stays near the target at any input size.
    """
    try:
        measured = input_bytes(spark, paths)
        floor = spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - no JVM gateway (e.g. a Connect session): keep the session's setting
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(math.ceil(measured / SHUFFLE_BYTES_PER_PARTITION), floor)
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    return n


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app_name: str = "funnelkit", driver_memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark (UI off, no server port)."""
    parts = shuffle_partitions or (os.cpu_count() if cores == "*" else int(cores))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in SQL_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`.

    If the session names none and runs in local mode, a private folder is
    created and registered as the checkpoint dir (test setting). On a cluster
    without the setting this raises instead of silently writing to a
    machine-local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="funnelkit-ckpt-")
    sc.setCheckpointDir(folder)
    return (sc.getCheckpointDir() or folder).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused sub-folder of the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


_SCRATCH: list[str] = []


def saved(df: DataFrame, name: str) -> DataFrame:
    """`df` written to a fresh table in the shared folder and read back: computed once, lineage cut."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    return df.sparkSession.read.schema(nullable).parquet(path)


def drop_scratch(spark: SparkSession) -> int:
    """Delete the folders `scratch_path` named in this process; call it once their results were consumed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n
