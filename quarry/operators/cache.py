"""A cache of answers by the likeness of their questions: as-of lookups with a time to live and a bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import search

THRESHOLD = 0.92
#: Units of time that one task counts over.
TIME_RANGE = 100_000


def entries_before(entries: DataFrame, lookups: DataFrame) -> DataFrame:
    """``query_id, asked_at, n``: the number of entries cached before each lookup, by running counts in ranges of time."""
    both = entries.select(F.col("cached_at").alias("t"), F.lit(1).alias("e"), F.lit(None).cast("long").alias("query_id")).unionByName(lookups.select(F.col("asked_at").alias("t"), F.lit(0).alias("e"), "query_id"))
    ranged = both.withColumn("r", F.floor(F.col("t") / TIME_RANGE))
    earlier = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = ranged.groupBy("r").agg(F.sum("e").alias("c")).select("r", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("r").orderBy("t", "e").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a lookup comes before entries of its own time
    counted = ranged.withColumn("inside", F.sum("e").over(inside)).where("e = 0").join(sums, "r")
    return counted.select("query_id", F.col("t").alias("asked_at"), (F.col("before") + F.col("inside")).alias("n"))


def _numbered(entries: DataFrame) -> DataFrame:
    """``cached_at, n``: entries counted from 1 in the order of time."""
    ranged = entries.select("cached_at", "cache_id").withColumn("r", F.floor(F.col("cached_at") / TIME_RANGE))
    earlier = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("r").agg(F.count(F.lit(1)).alias("c")).select("r", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
    return ranged.withColumn("k", F.row_number().over(Window.partitionBy("r").orderBy("cached_at", "cache_id"))).join(sums, "r").select("cached_at", (F.col("before") + F.col("k")).alias("n"))


def looked_up(lookups: DataFrame, entries: DataFrame, threshold: float = THRESHOLD, ttl: int | None = None, size: int | None = None) -> DataFrame:
    """``query_id, cache_id, score, hit`` of every lookup ``query_id, asked_at, embedding`` in the cache ``cache_id, cached_at, embedding``.

    A lookup sees entries cached before it, at most ``ttl`` ago, and no more than the ``size`` latest ones (of entries of one time
    all stay).  The most similar one counts, ties go to the smaller id; it is a hit above the threshold.  Nothing to see: nulls and no hit.
    """
    asked = lookups.select("query_id", "asked_at", "embedding", (F.lit(None).cast("double") if ttl is None else (F.col("asked_at") - ttl).cast("double")).alias("since"))
    if size is not None:
        first = entries_before(entries, lookups).select("query_id", (F.col("n") - size + 1).alias("n")).join(_numbered(entries), "n").select("query_id", F.col("cached_at").cast("double").alias("kept_from"))
        asked = asked.join(first, "query_id", "left").withColumn("since", F.greatest("since", "kept_from")).drop("kept_from")  # greatest leaves nulls out
    vectors = entries.select(F.col("cache_id").alias("vec_id"), "embedding", F.col("cached_at").cast("double").alias("cached_at"))
    # entries are no queries: ids of the two sides may be equal, so lookups are searched under ids below zero
    named = asked.select((-1 - F.col("query_id")).alias("query_id"), "embedding", "since", F.col("asked_at").cast("double").alias("until"))
    best = search.nearest(named, vectors, 1, at="cached_at").select((-1 - F.col("query_id")).alias("query_id"), F.col("vec_id").alias("cache_id"), "score")
    return lookups.select("query_id").join(best, "query_id", "left").select("query_id", "cache_id", "score", F.coalesce(F.col("score") > threshold, F.lit(False)).alias("hit"))
