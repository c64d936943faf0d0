"""Scans and sinks on temporary folders."""

import json

from quarry.sources import files


def test_scan_folder(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("hello")
    (tmp_path / "b.pdf").write_text("x")
    got = files.scan_folder(spark, str(tmp_path), "*.txt").collect()
    assert [(r.name, r.size, r.md5) for r in got] == [("a.txt", 5, "5d41402abc4b2a76b9719d911017c592")]
    assert files.scan_folder(spark, str(tmp_path), content=False).count() == 2


def test_texts_fall_back_to_gbk(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("你好".encode())
    (tmp_path / "g.txt").write_bytes("你好".encode("gbk"))
    (tmp_path / "n.txt").write_bytes(b"\xff\xff\xff")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.scan_texts(spark, str(tmp_path)).collect()}
    assert got == {"u.txt": "你好", "g.txt": "你好", "n.txt": ""}


def test_evaluation_set(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"queries": [{"id": "1", "query": "q", "relevant_docs": ["d"]}, {"id": "2", "query": "r"}]}, indent=1))
    got = files.scan_evaluation_set(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.id, r.relevant_docs) for r in got] == [("1", ["d"]), ("2", None)]


def test_replace_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "x int, k string"), path, ["k"])
    files.replace_partitions(spark.createDataFrame([(3, "b")], "x int, k string"), path, ["k"])
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [1, 3]
