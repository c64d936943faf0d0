"""Intermediate tables and index tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []
_paths: list[str] = []
#: Tables of at most so many narrow rows are broadcast once their count is known.
BROADCAST_ROWS = 500_000


def work_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; an own folder where that is unset and the master is local (tests), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="spark-quarry-", dir="/tmp"))
        base = f"file://{_own_dir[0]}"
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{work_dir(spark)}/quarry-{name}-{uuid.uuid4().hex}"
    _paths.append(path)
    return path


def drop_tables(spark: SparkSession) -> int:
    """Delete what this driver has put into the shared folder (call it when no result is read any more); the number of tables."""
    n = len(_paths)
    while _paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_paths.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a table that is used twice is computed once."""
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def sized(df: DataFrame, name: str, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, int]:
    """Store a narrow table, count it, and mark it for broadcast if it is small; else joins shuffle it."""
    kept = stored(df, name)
    n = kept.count()
    return (F.broadcast(kept) if n <= rows else kept), n


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files below a path: what a cached derivation of them is valid for."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(folder, True)
    out = []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))
