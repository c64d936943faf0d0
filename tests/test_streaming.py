"""Each stream equals its batch twin."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.streaming import streams


@pytest.fixture
def run(spark, tmp_path):
    def go(frame, schema, make, mode="append"):
        src = str(tmp_path / "in")
        frame.coalesce(1).write.parquet(src)
        out = make(spark.readStream.schema(schema).parquet(src))
        q = out.writeStream.outputMode(mode).format("memory").queryName("got").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.sql("select * from got").collect()

    return go


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_debounce(spark, run):
    schema = "ts timestamp, path string, change_type string"
    rows = [(at(0), "a", "modified"), (at(1), "a", "modified"), (at(2.5), "a", "modified"), (at(1), "b", "added"), (at(4), "a", "modified")]
    got = run(spark.createDataFrame(rows, schema), schema, streams.debounced)
    assert sorted((r.path, r.ts) for r in got) == [("a", at(0)), ("a", at(2.5)), ("b", at(1))]


def test_moves(spark):
    df = spark.createDataFrame([(at(0), "a", "b", "moved"), (at(1), "c", None, "added")], "ts timestamp, path string, new_path string, change_type string")
    assert sorted((r.path, r.change_type) for r in streams.moves(df).collect()) == [("a", "deleted"), ("b", "added"), ("c", "added")]


def test_last_activity(spark, run):
    schema = "session_id string, created_at timestamp"
    rows = [("x", at(1)), ("x", at(9)), ("y", at(3))]
    got = run(spark.createDataFrame(rows, schema), schema, streams.last_activity, "complete")
    assert sorted((r.session_id, r.last_active) for r in got) == [("x", at(9)), ("y", at(3))]


def test_suggestions(spark, run):
    schema = "query string, rating int"
    rows = [(" Hello", 1), ("hello", 1), ("hello", -1), ("other", 1)]
    got = run(spark.createDataFrame(rows, schema), schema, streams.suggestion_counts, "complete")
    assert {r["query"]: r["n"] for r in got} == {"hello": 2, "other": 1}


def test_sessions_equal_batch(spark, run):
    schema = "user_id long, ts timestamp"
    rows = [(1, at(0)), (1, at(3600)), (1, at(200_000)), (2, at(10)), (9, at(900_000))]
    frame = spark.createDataFrame(rows, schema)
    batch = frame.groupBy("user_id", F.session_window("ts", "24 hours")).count()
    got = run(frame, schema, streams.session_windows, "complete")
    assert sorted((r.user_id, r.events) for r in got) == sorted((r.user_id, r["count"]) for r in batch.collect())


def test_distinct_within(spark, run):
    schema = "key string, ts timestamp"
    rows = [("a", at(0)), ("a", at(10)), ("b", at(20))]
    got = run(spark.createDataFrame(rows, schema), schema, lambda s: streams.distinct_within(s, ["key"], "1 hour"))
    assert sorted(r.key for r in got) == ["a", "b"]


def test_each_batch(spark, tmp_path):
    schema = "key string, ts timestamp"
    spark.createDataFrame([("a", at(0)), ("b", at(1))], schema).write.parquet(str(tmp_path / "in"))
    seen = []
    q = streams.each_batch(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda df, n: seen.append(df.count()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sum(seen) == 2


def test_debounce_drops_idle_state(spark, tmp_path):
    """The same changes are accepted as without timers, and no state stays once all paths are idle."""
    schema = "ts timestamp, path string, change_type string"
    batches = [
        [(at(0), "a", "modified"), (at(1), "a", "modified"), (at(2.5), "a", "modified"), (at(1), "b", "added")],
        [(at(4), "a", "modified"), (at(5), "a", "modified"), (at(9000), "c", "added")],
        [(at(9001), "c", "modified"), (at(9003), "a", "modified"), (at(90_000), "z", "added")],
        [(at(190_000), "z", "added")],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        made = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        q = streams.debounced_with_timers(made, late="10 seconds").writeStream.outputMode("append").format("memory").queryName("spaced").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        got = sorted((r.path, r.ts) for r in spark.sql("select * from spaced").collect())
        assert got == sorted([("a", at(0)), ("a", at(2.5)), ("a", at(5)), ("a", at(9003)), ("b", at(1)), ("c", at(9000)), ("z", at(90_000)), ("z", at(190_000))])
        rows_kept = [op["numRowsTotal"] for op in q.lastProgress["stateOperators"]]
        assert sum(rows_kept) <= 3  # the last path's time, its timer and the timer's index
    finally:
        spark.conf.set(key, before)


def test_partitioned_sync_writes_touched_parts_only(spark, tmp_path):
    from quarry.operators import maintain

    stored = spark.createDataFrame([(i, f"h{i}") for i in range(200)], "document_id long, content_hash string")
    events = [[(3, "n3", 1), (4, None, 2), (3, "n3b", 3)], [(500, "new", 4)], [(4, "back", 5), (3, None, 6), (7, "n7", 7)]]
    for k, rows in enumerate(events):
        spark.createDataFrame(rows, "document_id long, content_hash string, seq long").coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
    changes = spark.readStream.schema("document_id long, content_hash string, seq long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    table = str(tmp_path / "table")
    streams.partitioned_sync(changes, stored, table, str(tmp_path / "cp"), parts=16).awaitTermination(180)
    read = lambda: {r.document_id: r.content_hash for r in streams.synced_table(spark, table).collect()}
    final = {i: f"h{i}" for i in range(200)} | {500: "new", 7: "n7", 4: "back"}
    del final[3]
    current = spark.createDataFrame(list(final.items()), "document_id long, content_hash string")
    assert read() == final == {r.document_id: r.content_hash for r in maintain.synced(stored, current).collect()}
    written = {v.name: len([p for p in v.iterdir() if p.name.startswith("part=")]) for v in (tmp_path / "table").iterdir() if v.name.startswith("v=")}
    assert all(n <= 3 for v, n in written.items() if v != "v=-1") and written["v=-1"] >= 11
    held: dict = {}
    for v in (tmp_path / "table").iterdir():
        for p in v.iterdir() if v.is_dir() else []:
            held[p.name] = held.get(p.name, 0) + p.name.startswith("part=")
    assert max(held.values()) <= 2  # a part's version and the one before it
