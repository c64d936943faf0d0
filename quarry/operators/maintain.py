"""Table maintenance: upsert, delete, status changes, retention, versions, snapshot differences.

Parquet tables have no row-level merge, so each operator returns the new content of a table;
``sources.files.replace_partitions`` writes back only the partitions that changed.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows without a new row of their key, and all new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def delete(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys.select(*on).distinct(), on, "left_anti")


def merge_update(old: DataFrame, new: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """Old rows with the non-null fields of new ones put over them, except ``kept`` fields."""
    changed = [c for c in old.columns if c not in keys and c not in kept and c in new.columns]
    n = new.select(*keys, *(F.col(c).alias(f"_{c}") for c in changed))
    joined = old.join(n, keys, "left")
    return joined.select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in changed else F.col(c) for c in old.columns))


def supersede(chunks: DataFrame, documents: DataFrame, now: Column) -> DataFrame:
    """Active (or unmarked) chunks of the named documents become superseded, with a time."""
    hit = chunks.join(documents.select("document_id").distinct().withColumn("_hit", F.lit(True)), "document_id", "left")
    on = F.coalesce("_hit", F.lit(False)) & (F.coalesce("status", F.lit("active")) == "active")
    return hit.withColumn("superseded_time", F.when(on, now)).withColumn("status", F.when(on, "superseded").otherwise(F.col("status"))).drop("_hit")


def deprecate(chunks: DataFrame, documents: DataFrame, now: Column) -> DataFrame:
    """All chunks of the documents (``document_id, reason, actor``) become deprecated, with reason, actor and date."""
    d = documents.select("document_id", F.col("reason").alias("_reason"), F.col("actor").alias("_actor"))
    hit = chunks.join(d, "document_id", "left")
    on = F.col("_reason").isNotNull()
    return (
        hit.withColumn("status", F.when(on, "deprecated").otherwise(F.col("status")))
        .withColumn("deprecated_reason", F.col("_reason")).withColumn("deprecated_by", F.col("_actor")).withColumn("deprecated_date", F.when(on, now.cast("date"))).drop("_reason", "_actor")
    )


def restore(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Deprecated chunks of the documents become active."""
    hit = chunks.join(documents.select("document_id").distinct().withColumn("_hit", F.lit(True)), "document_id", "left")
    on = F.coalesce("_hit", F.lit(False)) & (F.col("status") == "deprecated")
    return hit.withColumn("status", F.when(on, "active").otherwise(F.col("status"))).drop("_hit")


def expired(chunks: DataFrame, now: Column, superseded_days: int = 7, deprecated_days: int = 30) -> Column:
    """Whether retention removes a row; rows without a date stay."""
    age = lambda n: F.col("created_at") < now - F.expr(f"interval {n} days")
    gone = ((F.col("status") == "superseded") & age(superseded_days)) | ((F.col("status") == "deprecated") & age(deprecated_days))
    return F.coalesce(gone, F.lit(False))


def snapshot_diff(current: DataFrame, stored: DataFrame) -> DataFrame:
    """``document_id, change_type``: added, deleted, modified or same, by content hash (null-safe)."""
    s = stored.select("document_id", F.col("content_hash").alias("_old"), F.lit(True).alias("_in_old"))
    c = current.select("document_id", F.col("content_hash").alias("_new"), F.lit(True).alias("_in_new"))
    kind = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("modified")
    return c.join(s, "document_id", "full_outer").select("document_id", kind.alias("change_type"), F.col("_old").alias("old_hash"), F.col("_new").alias("new_hash"))


def next_version(versions: DataFrame) -> DataFrame:
    """``collection, document_id, current, next``: the latest record's version plus one."""
    last = versions.groupBy("collection", "document_id").agg(F.max_by("version", F.struct("created_at", "version")).alias("current"))
    n = F.regexp_extract("current", r"(\d+)", 1).cast("int") + 1
    return last.withColumn("next", F.concat(F.lit("v"), n))


def stale(derived: DataFrame, sources: DataFrame, key: str, digest: str) -> DataFrame:
    """Sources whose derived row is missing or was made from other content."""
    return sources.join(derived.select(key, digest), [key, digest], "left_anti")


def spaced(events: DataFrame, apart: int) -> DataFrame:
    """``event_id, user_id, first`` of rows ``event_id, user_id, t``: first if no first event of the user lies less than ``apart`` before.

    Events of a user pass in the order of ``t`` (null last) and ``event_id`` through one task, which holds one batch and
    the time of the user's last first event, however many events the user has.
    """

    def pass_on(batches):
        user, last, begun = None, None, False
        for batch in batches:
            first = []
            for who, t in zip(batch.column("user_id").to_pylist(), batch.column("t").to_pylist(), strict=True):
                if not begun or who != user:
                    begun, user, new = True, who, True
                else:
                    new = last is not None and t is not None and t - last >= apart
                last = t if new else last
                first.append(new)
            yield pa.RecordBatch.from_arrays([batch.column("event_id"), batch.column("user_id"), pa.array(first, pa.bool_())], names=["event_id", "user_id", "first"])

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    ordered = events.select("event_id", "user_id", "t").repartition("user_id").sortWithinPartitions("user_id", F.asc_nulls_last("t"), "event_id")
    return ordered.mapInArrow(pass_on, f"event_id {kinds['event_id']}, user_id {kinds['user_id']}, first boolean")


def synced(stored: DataFrame, current: DataFrame) -> DataFrame:
    """``document_id, content_hash, rewritten`` after a sync of the stored hashes with the current ones: diff, drop what is gone, rewrite what changed."""
    d = snapshot_diff(current, stored)
    changed = d.where("change_type in ('added', 'modified')").select("document_id", F.col("new_hash").alias("content_hash"))
    kept = delete(stored, d.where("change_type = 'deleted'"), ["document_id"])
    return upsert(kept.withColumn("rewritten", F.lit(False)), changed.withColumn("rewritten", F.lit(True)), ["document_id"])
