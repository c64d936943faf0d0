"""Structured Streaming forms; each has a batch twin among the queries.

Event time, watermark one hour unless said otherwise; rows later than that are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_windows(events: DataFrame, gap: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """``user_id, events, first_ts, last_ts`` of sessions closed by a gap."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap))
    return s.agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("session_window")


def daily_reports(feedback: DataFrame, late: str = "1 hour") -> DataFrame:
    g = feedback.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day"))
    return g.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("rating") == 1).alias("positive")).select(F.col("window.start").alias("day"), "total", "positive")


def last_activity(messages: DataFrame) -> DataFrame:
    """Update mode: the newest time of each session."""
    return messages.groupBy("session_id").agg(F.max("created_at").alias("last_active"))


def distinct_within(events: DataFrame, keys: list[str], ttl: str) -> DataFrame:
    """First row of each key; repeats within the time to live are hits and go."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def moves(changes: DataFrame) -> DataFrame:
    """A move is a deletion of the old path and an addition of the new one."""
    pair = F.array(F.struct(F.col("path").alias("path"), F.lit("deleted").alias("change_type")), F.struct(F.col("new_path").alias("path"), F.lit("added").alias("change_type")))
    one = F.array(F.struct(F.col("path").alias("path"), F.col("change_type").alias("change_type")))
    return changes.withColumn("_c", F.explode(F.when(F.col("change_type") == "moved", pair).otherwise(one))).select("ts", "_c.path", "_c.change_type")


def debounced(changes: DataFrame, seconds: float = 2.0) -> DataFrame:
    """Accept a change of a path only if the last accepted one is at least ``seconds`` older; state: one time per path."""

    def accept(key, frames, state: GroupState):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("ts")
        keep = []
        for ts in rows["ts"]:
            now = ts.timestamp()
            ok = last is None or now - last >= seconds
            keep.append(ok)
            last = now if ok else last
        state.update((last,))
        yield rows[keep][["path", "ts", "change_type"]]

    return changes.groupBy("path").applyInPandasWithState(accept, "path string, ts timestamp, change_type string", "last double", "append", GroupStateTimeout.NoTimeout)


def debounced_with_timers(changes: DataFrame, seconds: float = 2.0, late: str = "1 hour") -> DataFrame:
    """``debounced`` whose state ends: a path's time is dropped by a timer once the watermark has passed it by ``seconds``.

    Changes older than the watermark (``late``) are dropped.  Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``); the first change after an idle time is accepted, state or not.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Debounce(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "micros long")

        def handleInputRows(self, key, rows, timerValues):
            have = self.last.get() if self.last.exists() else None
            last = have[0] if have else None
            frame = pd.concat(list(rows)).sort_values("ts", kind="stable")
            keep = []
            for ts in frame["ts"]:
                now = int(ts.value // 1000) if hasattr(ts, "value") else int(ts.timestamp() * 1e6)
                ok = last is None or now - last >= seconds * 1e6
                keep.append(ok)
                last = now if ok else last
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
            self.last.update((last,))
            self.handle.registerTimer(int(last // 1000 + seconds * 1000) + 1)
            kept = frame[keep]
            if len(kept):
                yield pd.DataFrame({"path": pd.Series(list(kept["path"]), dtype=object), "ts": list(kept["ts"]), "change_type": pd.Series(list(kept["change_type"]), dtype=object)})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.last.clear()
            return iter(())

        def close(self) -> None:
            pass

    watched = changes.withWatermark("ts", late).groupBy("path")
    return watched.transformWithStateInPandas(Debounce(), "path string, ts timestamp, change_type string", "Append", "EventTime")


def suggestion_counts(feedback: DataFrame) -> DataFrame:
    """Update mode: positive ratings of each normalised query."""
    return feedback.where("rating = 1").groupBy(F.lower(F.trim("query")).alias("query")).agg(F.count(F.lit(1)).alias("n"))


def each_batch(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a batch job (an incremental sync, say) on every micro-batch, once for each batch id."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def continuous_sync(changes: DataFrame, stored: DataFrame, path: str, checkpoint: str):
    """Keep the table of content hashes at ``path`` in step with a stream ``document_id, content_hash, seq`` (a null hash: deleted).

    Every micro-batch takes the latest change of each document and writes version ``n`` of the table from the one before,
    so a batch that is repeated after a failure writes the same version again.  After the last batch the newest version
    equals the batch sync of the final snapshot.
    """
    stored.select("document_id", "content_hash").write.mode("overwrite").parquet(f"{path}/v=-1")

    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        now = spark.read.schema("document_id long, content_hash string").parquet(f"{path}/v={n - 1}")
        last = batch.groupBy("document_id").agg(F.max_by("content_hash", "seq").alias("content_hash"))
        kept = now.join(last.select("document_id"), "document_id", "left_anti")
        kept.unionByName(last.where("content_hash is not null")).write.mode("overwrite").parquet(f"{path}/v={n}")

    return each_batch(changes, apply, checkpoint)


#: Hash parts of a synced table.
PARTS = 64


def synced_table(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """``document_id, content_hash`` as of the last batch (or the one before batch ``before``) of ``partitioned_sync``: every part's newest version."""
    written = spark.read.schema("document_id long, content_hash string, v int, part int").parquet(path)
    if before is not None:
        written = written.where(F.col("v") < before)
    # every version of a part has one row without an id, also a part that is empty now; there are at most PARTS of them
    newest = written.where("document_id is null").groupBy("part").agg(F.max("v").alias("v"))
    return written.where("document_id is not null").join(F.broadcast(newest), ["part", "v"]).select("document_id", "content_hash", "part")


def _put(rows: DataFrame, path: str, v: int, parts: list[int]) -> None:
    marks = rows.sparkSession.createDataFrame([(None, None, p) for p in parts], "document_id long, content_hash string, part int")
    whole = rows.select("document_id", "content_hash", "part").unionByName(marks).repartition("part")
    whole.write.mode("overwrite").partitionBy("part").parquet(f"{path}/v={v}")


def partitioned_sync(changes: DataFrame, stored: DataFrame, path: str, checkpoint: str, parts: int = PARTS):
    """``continuous_sync`` over a table in hash parts: a micro-batch rewrites the parts that its documents fall in, and no others.

    Version ``n`` of a part comes from its newest version before ``n``, so a batch that is repeated after a failure
    writes the same again.  Versions older than that one are deleted when the batch is through.  Read it with
    ``synced_table``; documents without an id are left out.
    """
    part = F.pmod(F.xxhash64("document_id"), F.lit(parts)).cast("int")
    _put(stored.where("document_id is not null").select("document_id", "content_hash", part.alias("part")), path, -1, list(range(parts)))

    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        last = batch.where("document_id is not null").groupBy("document_id").agg(F.max_by("content_hash", "seq").alias("content_hash")).withColumn("part", part).persist()
        try:
            touched = sorted(r["part"] for r in last.select("part").distinct().collect())  # at most ``parts``
            if not touched:
                return
            now = synced_table(spark, path, n).where(F.col("part").isin(touched))
            kept = now.join(last.select("document_id"), "document_id", "left_anti").select("document_id", "content_hash", "part")
            _put(kept.unionByName(last.where("content_hash is not null").select("document_id", "content_hash", "part")), path, n, touched)
        finally:
            last.unpersist()
        _retire(spark, path, n, touched)

    return each_batch(changes, apply, checkpoint)


def _retire(spark: SparkSession, path: str, n: int, touched: list[int]) -> None:
    """Delete the touched parts' versions before the last one before ``n``."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(folder) if s.getPath().getName().startswith("v="))
    child = lambda v, p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}/part={p}")
    for p in touched:
        there = [v for v in versions if v < n and fs.exists(child(v, p))]
        for v in there[:-1]:
            fs.delete(child(v, p), True)
