"""Small helpers shared by the operators: work tables, word splitting, label folds."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every contract of this package has it.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: list[str] = []
_tables: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Where that is unset, a local master (tests) takes a folder of its own; a cluster is an error, since its
    executors would each write to their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="spark-quarry-", dir="/tmp"))
        base = f"file://{_own_dir[0]}"
    return base.rstrip("/")


def drop_tables(spark: SparkSession) -> int:
    """Delete the intermediate tables that this driver has written (call it when no result is read any more); their number."""
    n = len(_tables)
    while _tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This ends the lineage: a lost executor costs a re-read, not a recomputation, and a table that
    is used twice is computed once.
    """
    path = f"{work_dir(df.sparkSession)}/quarry-{name}-{uuid.uuid4().hex}"
    _tables.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that Spark hands to a Python worker at once where they are whole texts.
TEXT_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """Jobs started inside hand at most ``rows`` rows at a time to Python: both sides of the pipe hold whole batches."""
    before = spark.conf.get(_BATCH)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


#: Tables of at most so many narrow rows are broadcast once their count is known.
BROADCAST_ROWS = 500_000


def sized(df: DataFrame, name: str, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, int]:
    """Store a narrow table, count it, and mark it for broadcast if it is small; else joins shuffle it."""
    stored = cut(df, name)
    n = stored.count()
    return (F.broadcast(stored) if n <= rows else stored), n


def released() -> None:
    """Give memory that a task has freed back to the machine: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the usual C library of Linux
    if trim:
        trim(0)


def turn_order() -> list[Column]:
    """Turns of a conversation: by number (null first), role and text (its beginning, then its digest)."""
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("head"), F.asc("digest")]


def turn_parts(role: Column, text: Column) -> list[Column]:
    """``role, head, digest, bytes`` of a turn: what orders and names it without its text."""
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return [role.alias("role"), F.substring(text, 1, 64).alias("head"), F.unhex(F.md5(named)).alias("digest"), F.octet_length(text).cast("long").alias("bytes")]


def label_fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``: the fold that decides what may be learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, modulus: int, held_out: int, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled documents ``(doc_id, text, label)``, none of the fold ``held_out``.

    Rows are chosen by the smallest hash of their id, so the sample does not depend on partitioning.
    Null labels are left out; a document with several labels takes the largest, one with several texts the
    smallest; null text is empty.
    The sample is the only bounded step of a classifier; everything else runs over all rows.
    """
    learn = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & (label_fold(F.col("doc_id"), modulus) != held_out))
    chosen = learn.groupBy("doc_id").agg(F.max(target).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return cut(rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")), "labelled")
