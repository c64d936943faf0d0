"""Search operators against brute force; nested JSON; the continuous sync against the batch one."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking, maintain, search
from quarry.plans import retrieval
from quarry.plans.fixtures import view
from quarry.sources import files
from quarry.streaming import streams


def unit_rows(n, dim, seed):
    x = np.round(np.random.default_rng(seed).normal(size=(n, dim)), 2)
    return [(i, x[i].tolist(), int(i % 3)) for i in range(n)]


@pytest.mark.parametrize("most,scores", [(10_000, 4_000_000), (6, 40)])
def test_nearest_in_passes_equals_brute_force(spark, monkeypatch, most, scores):
    monkeypatch.setattr(search, "MAX_QUERIES", most)
    monkeypatch.setattr(search, "SCORES", scores)
    rows = unit_rows(120, 3, 1)
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    q = v.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    x = {i: np.array(e) / np.linalg.norm(e) for i, e, _ in rows}
    for by in (None, "label"):
        want = set()
        for i in range(0, 120, 10):
            for part in ([0, 1, 2],) if by is None else ([0], [1], [2]):
                best = sorted((-round(float(x[i] @ x[k]), 6), k) for k in x if k != i and k % 3 in part)[:4]
                want |= {(i, k, r + 1) for r, (_, k) in enumerate(best)}
        got = search.nearest(q, v, 4, keep=["label"], by=by).collect()
        assert {(r.query_id, r.vec_id, r["rank"]) for r in got} == want


def test_stored_index_equals_the_formula(spark):
    texts = ["the cat sat", "the dog sat on the cat", "a bird", "", "the the the end", "cat"]
    chunks = spark.createDataFrame([(f"c{i}", "kb" if i < 4 else "other", t) for i, t in enumerate(texts)], "chunk_id string, collection string, content string")
    index = search.build_index(chunks)
    q = spark.createDataFrame([(1, "cat"), (1, "the"), (1, "cat"), (2, "bird"), (3, "nothing")], "query_id long, term string")
    got = {(r.query_id, r.chunk_id): r.score for r in search.bm25(q, index).collect()}
    want = {}
    for kb in (range(4), range(4, 6)):
        ts = {i: texts[i].split() for i in kb}
        n, avg = len(ts), sum(map(len, ts.values())) / len(ts)
        df = {t: sum(t in w for w in ts.values()) for w in ts.values() for t in w}
        raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
        mean = sum(raw.values()) / len(raw)
        for query, terms in ((1, ("cat", "the")), (2, ("bird",))):
            for i, w in ts.items():
                hit = [t for t in terms if t in w]
                if hit:
                    want[query, f"c{i}"] = sum((raw[t] if raw[t] >= 0 else 0.25 * mean) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in hit)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_asked_terms_prune_the_postings(spark):
    index = search.build_index(spark.range(2000).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.lit("kb").alias("collection"), F.concat(F.lit("w"), F.col("id") % 500).alias("content")))
    df = search.bm25(spark.createDataFrame([(1, "w7")], "query_id long, term string"), index)
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = next(line for line in plan.splitlines() if "PartitionFilters: [" in line and "bucket" in line.split("PartitionFilters: [")[1])
    assert df.count() == 4 and "= " in filters.split("PartitionFilters: [")[1]


def test_greedy_mmr_equals_a_plain_loop(spark, sf):
    v = {r.vec_id: np.array(r.embedding) / np.linalg.norm(r.embedding) for r in view(spark, sf, "vectors").collect()}
    hits = {}
    for r in view(spark, sf, "hits").collect():
        hits.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    from quarry.plans.retrieval import mmr

    got = {}
    for r in mmr(spark, sf).collect():
        got.setdefault(r.query_id, {})[r.mmr_rank] = r.vec_id
    for q, rows in hits.items():
        left, chosen = [i for _, i in sorted(rows)], []
        while left and len(chosen) < 5:
            value = lambda i: round(0.5 * float(v[i] @ v[q]) - 0.5 * max((float(v[i] @ v[j]) for j in chosen), default=0.0), 12)
            best = max(left, key=lambda i: (value(i), -left.index(i)))
            chosen.append(best)
            left.remove(best)
        assert [got[q][k + 1] for k in range(len(chosen))] == chosen


def test_diversity_equals_a_plain_loop(spark, sf):
    from quarry.plans.retrieval import diversity

    rows = {}
    for r in view(spark, sf, "hits").orderBy("rank").collect():
        rows.setdefault(r.query_id, []).append((r.vec_id, set(r.content[:200])))
    want = set()
    for q, items in rows.items():
        kept = []
        for i, s in items:
            if len(kept) < 5 and all(len(s & t) / len(s | t) <= 0.85 for _, t in kept):
                kept.append((i, s))
        want |= {(q, i) for i, _ in kept} if len(items) > 5 else {(q, i) for i, _ in items}
    assert {(r.query_id, r.vec_id) for r in diversity(spark, sf).collect()} == want


def packed(text, most):
    if len(text) <= most:
        return [text] if text.strip() else []
    out, now = [], ""
    for p in text.split("\n\n"):
        if len(now) + len(p) > most:
            out, now = [*out, now.strip()], p
        else:
            now += "\n\n" + p
    return [c for c in [*out, now.strip()] if c]


def test_paragraph_packs_equal_a_plain_loop(spark):
    texts = ["short", "  ", "", "\n\n".join("p" * k for k in (10, 20, 5, 60, 1, 1, 30)), "x" * 90, " \n\n" * 30, "\n\na\n\n" + "b" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.packs for r in df.select("i", chunking.paragraph_packs(F.col("t"), 40).alias("packs")).collect()}
    assert got == {i: packed(t, 40) for i, t in enumerate(texts)}


def test_exam_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"exam_id": "e1", "name": "", "topic": "t", "status": "draft", "questions": [{"question_id": "q1", "score": 2}, {"question_id": "q2"}]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"topic": "u", "total_score": 7}))
    (tmp_path / "c.json").write_text("{ no json")
    exams = files.scan_exams(spark, [str(tmp_path)])
    got = {r.exam_id: r for r in exams.collect()}
    assert set(got) == {"e1", "b"} and (got["e1"].name, got["e1"].status) == ("t", "draft") and (got["b"].status, got["b"].total_score, got["b"].total_count) == ("approved", 7.0, 0)
    assert [(r.question_order, r.question_id) for r in files.scan_exam_questions(exams).orderBy("question_order").collect()] == [(0, "q1"), (1, "q2")]
    assert [r.exam_id for r in files.scan_exams(spark, [str(tmp_path)], "draft").collect()] == ["e1"]


def test_content_lists(spark, tmp_path):
    items = [{"type": "text", "text": "Title", "text_level": 1, "page_idx": 0}, {"type": "table", "table_body": "<table/>", "table_caption": ["T", "1"], "page_idx": 2}, {"type": "image", "img_path": "i/a.png"}]
    (tmp_path / "doc.json").write_text(json.dumps(items))
    rows = files.scan_content_lists(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.source, r.pos, r.type, r.text_level, r.caption) for r in rows] == [("doc.json", 0, "text", 1, ""), ("doc.json", 1, "table", 0, "T 1"), ("doc.json", 2, "image", 0, "")]


def test_continuous_sync_equals_the_batch_sync(spark, tmp_path):
    stored = spark.createDataFrame([(i, f"h{i}") for i in range(20)], "document_id long, content_hash string")
    events = [(i, None if i % 5 == 0 else f"h{i}" if i % 3 else f"n{i}", i) for i in range(25)] + [(7, "late", 100), (10, "back", 101), (21, None, 102)]
    for k in range(3):
        spark.createDataFrame(events[k::3], "document_id long, content_hash string, seq long").coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
    changes = spark.readStream.schema("document_id long, content_hash string, seq long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    # changes of one document stay in order only if the files do, so every document has its changes in one file here or by seq
    q = streams.continuous_sync(changes.where("seq < 100"), stored, str(tmp_path / "table"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    newest = max((tmp_path / "table").iterdir(), key=lambda p: int(p.name.removeprefix("v=")))
    got = {r.document_id: r.content_hash for r in spark.read.parquet(str(newest)).collect()}
    final = {i: f"h{i}" for i in range(20)}
    for i, h, _ in events[:25]:
        final.pop(i, None)
        if h is not None:
            final[i] = h
    current = spark.createDataFrame(list(final.items()), "document_id long, content_hash string")
    assert got == final == {r.document_id: r.content_hash for r in maintain.synced(stored, current).collect()}


def test_chunks_stay_where_they_are_in_the_vector_channel(spark, sf):
    """The nearest vectors come to the chunks: with no table small enough by its size, chunks are still not shuffled for the join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = retrieval.vector_channel(spark, sf)
        assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.groupBy("query_id").count().where("count = 20").count() == 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_contents_stay_where_they_are_in_the_hybrid_search(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = retrieval.hybrid_candidates(spark, sf)
        assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert {"document_id", "chunk_index", "content"} <= set(df.columns)  # the diversity step takes vectors by these, not from all chunks
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
