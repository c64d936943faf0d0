"""Golden and property tests of single operators."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import scores, text
from quarry.operators import chunking, graph, maintain, search


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@given(st.text(max_size=3000))
@settings(max_examples=60, deadline=None)
def test_split_covers_the_text_within_the_cap(s):
    chunks = chunking.split(s, 200, 0, 260, 60)
    assert all(len(c) <= 260 for c in chunks)
    drop = lambda t: "".join(t.split())
    assert drop("".join(chunks)) == drop(s)


@given(st.lists(st.text(alphabet="ab. \n", min_size=1, max_size=90), max_size=20))
@settings(max_examples=60, deadline=None)
def test_merge_short_keeps_order_and_cap(parts):
    out = chunking.merge_short(parts, 40, 100)
    assert "\n".join(out) == "\n".join(parts)
    assert all(len(c) <= 100 for c in out)


@given(st.text(max_size=800), st.integers(5, 80))
@settings(max_examples=60, deadline=None)
def test_sentence_split_keeps_every_character(s, most):
    out = chunking.sentence_split(s, most)
    assert "".join(out) == s and all(len(c) <= most for c in out)


def test_long_text_is_cut_at_most_500(spark):
    assert all(len(c) <= 500 for c in chunking.sentence_split("这是一个测试句子很长。" * 200, 500))


def test_tokens_pair_cjk(spark):
    assert one(spark, text.tokens(F.lit("差旅补贴 Is 25 x"))) == ["差旅", "旅补", "补贴", "is", "25", "x"]


def test_heading_levels(spark):
    cases = {"第一章 总则": 1, "第三条 范围": 2, "1. Scope": 1, "Chapter 2": 1, "**Bold**": 2, "短标题": 2, "plain body text": 0, "": 0}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "s string, n int")
    assert df.where(text.heading_level(F.col("s")) != F.col("n")).count() == 0


def test_figure_numbers(spark):
    cases = {"见图2-4": "2.4", "Fig. 3.1 x": "3.1", "（图5）": "5", "none": ""}
    df = spark.createDataFrame(list(cases.items()), "s string, n string")
    assert df.where(text.figure_number(F.col("s"), F.lit(None)) != F.col("n")).count() == 0


def test_query_types(spark):
    cases = {"有哪些文件": "meta", "分析这张图": "image_reference", "今天天气": "realtime", "看 a.pdf 第三页": "file_specific", "甲和乙的区别": "comparison", "申请流程": "process", "年假几天": "simple", "天空的颜色": "fact"}
    df = spark.createDataFrame(list(cases.items()), "s string, n string")
    assert {r.s: r.t for r in df.select("s", text.query_type(F.col("s")).alias("t")).collect()} == cases


def test_html_table(spark):
    html = "<table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td><td><b>2</b></td></tr></table>"
    assert one(spark, text.html_markdown(F.lit(html))) == "| a | b\\|c |\n| --- | --- |\n| 1 | 2 |"


def test_markup_images(spark):
    assert one(spark, text.images_in_markup(F.lit("![x](d/a.png) <img src='b/c.jpg'> ![y](a.png)"))) == ["a.png", "c.jpg"]


def test_adaptive_k(spark):
    cases = [(0.3, 5, 10, True), (0.6, 5, 5, False), (0.9, 5, 3, False), (0.45, 10, 20, True), (0.8, 10, 10, False)]
    for top, k, want, again in cases:
        got = one(spark, search.adaptive_k(F.lit(top), k))
        assert (got["k"], got["retrieve_again"]) == (want, again)


def test_mmr_with_lambda_one_is_top_k(spark):
    rng = np.random.default_rng(42)
    q = rng.normal(size=8).tolist()
    rows = [(0, i, v.tolist(), q) for i, v in enumerate(rng.normal(size=(12, 8)))]
    df = spark.createDataFrame(rows, "query_id long, vec_id long, embedding array<double>, query_embedding array<double>").withColumn("score", scores.cosine(F.col("embedding"), F.col("query_embedding")))
    got = [r.vec_id for r in search.mmr(df, 5, 1.0).orderBy("mmr_rank").collect()]
    assert got == [r.vec_id for r in df.orderBy(F.desc("score")).limit(5).collect()]


def test_subgraph_hops(spark):
    edges = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "d")], "head string, relation string, tail string")
    start = spark.createDataFrame([("a",)], "name string")
    got = {r.edge.replace("\t", ""): r.hops for r in graph.subgraph(start, edges, 2).collect()}
    assert got == {"arb": 1, "brc": 2}


def test_fusion_ignores_channel_order(spark):
    rows = [(1, "x", "v", 1, 0.6), (1, "y", "v", 2, 0.6), (1, "y", "b", 1, 0.4)]
    schema = "query_id long, chunk_id string, channel string, rank int, weight double"
    a = search.fuse(spark.createDataFrame(rows, schema)).collect()
    b = search.fuse(spark.createDataFrame(rows[::-1], schema)).collect()
    assert {r.chunk_id: round(r.score, 12) for r in a} == {r.chunk_id: round(r.score, 12) for r in b}


def test_events_of_a_user_are_not_gathered(spark, sf):
    from quarry.plans import answers, ingest

    for query in (ingest.debounced, answers.distinct_within_ttl):
        assert "FlatMapGroups" not in query(spark, sf)._jdf.queryExecution().toString()
    rows = [(i, u, t) for i, (u, t) in enumerate([(1, 0), (1, 5), (1, 10), (1, 19), (1, 20), (None, 3), (None, 4), (2, None), (2, 7)])]
    got = maintain.spaced(spark.createDataFrame(rows, "event_id long, user_id long, t long"), 10)
    assert sorted(r.event_id for r in got.where("first").collect()) == [0, 2, 4, 5, 8]


def test_rows_are_numbered_by_ranges(spark, sf, monkeypatch):
    from quarry.plans import fixtures

    monkeypatch.setattr(fixtures, "KEY_RANGE", 10)
    df = spark.createDataFrame([(k,) for k in [*range(-25, 40, 3), 1000]], "k long").repartition(3)
    got = sorted((r.k, r.row_no) for r in fixtures.numbered(df, "k").collect())
    assert [n for _, n in got] == list(range(1, len(got) + 1))
    numbering = [line for line in fixtures.table_rows(spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number" in line and "Window" in line]
    assert numbering and all("_range" in line for line in numbering)


def test_folds_in_a_row_equal_those_of_gathered_rows(spark, sf):
    from quarry.operators import chunking
    from quarry.plans import structure
    from quarry.plans.fixtures import view

    lines = view(spark, sf, "doc_lines")
    by_doc = {}
    for r in lines.orderBy("doc_id", "pos").collect():
        by_doc.setdefault(r.doc_id, []).append((r.pos, r.line))
    want = {(d, i, c) for d, rows in by_doc.items() for i, c in enumerate(chunking.merge_short([line for _, line in rows], 200, 1200))}
    assert {tuple(r) for r in structure.merged_lines(spark, sf).collect()} == want
    kind = F.when(F.col("pos") % 10 == 8, "table").otherwise("text")
    items = lines.select("doc_id", "pos", F.col("line").alias("content"), kind.alias("chunk_type"), text.heading_level(F.col("line")).alias("text_level"))
    assert {tuple(r) for r in structure.heading_merge(spark, sf).collect()} == {tuple(r) for r in chunking.heading_merge(items).collect()}


def test_heading_levels_and_their_sql_hold_all_rules(spark, tmp_path):
    """Every rule of the table, with white space and line ends on which the pattern languages differ."""
    import duckdb

    from quarry.plans import structure
    from quarry.plans.registry import SQL

    lines = {
        "第一章 总则": 1, "第二条 范围": 2, "70.32.29.134 " + "x" * 77: 3, "1.2.3 third": 1, "1.2 " + "x" * 60: 2, "1. first": 1, "1\x0bfirst": 1, "1.2.3 " + "x" * 94: 0, "seCtion 2": 1, "\u017fection 2": 0,
        "**bold**": 2, "**bold**\r": 2, "**bo\rld**": 0, "简短标题": 2, "简" * 20: 0, "\u00a01. first": 0, "\u00a0": 0, "  2. padded  ": 1, "body": 0,
    }
    spark.createDataFrame([(1, "\n".join(lines), "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.level for r in structure.heading_levels(spark, str(tmp_path)).orderBy("pos").collect()]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == list(lines.values())
    assert [r[0] for r in con.execute(f"select level from ({SQL['h19_heading_levels']}) order by pos").fetchall()] == got


def test_distinct_items_of_owners(spark):
    """Distinct items over all groups of an owner, against plain sets; the plan never joins owners with items."""
    import random

    rng = random.Random(5)
    owners = [(o, f"k{rng.randrange(6)}") for o in range(40) for _ in range(3)] + [(99, None), (98, "nowhere")]
    members = [(f"k{rng.randrange(6)}", rng.randrange(300)) for _ in range(900)] + [(None, 1), ("k1", None)]
    df = graph.distinct_items(spark.createDataFrame(owners, "owner long, key string"), spark.createDataFrame(members, "key string, item long"))
    own = {o: {k for p, k in owners if p == o and k} for o, _ in owners}
    want = {o: len({i for k, i in members if k in ks and i is not None}) for o, ks in own.items()}
    assert {r.owner: r.n for r in df.collect()} == {o: n for o, n in want.items() if n}
    assert "item" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_subgraph_reads_the_edges_once(spark):
    """Edges are made once and not once a hop and direction (before: four times)."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    edges = spark.createDataFrame([("a", "R", "b"), ("b", "R", "c"), ("c", "R", "d")], "head string, relation string, tail string").mapInPandas(counted, "head string, relation string, tail string")
    got = graph.subgraph(spark.createDataFrame([("a",)], "name string"), edges, 2).collect()
    assert {(r.edge.replace("\t", ""), r.hops) for r in got} == {("aRb", 1), ("bRc", 2)} and seen.value == 3


def test_chunks_leave_a_task_in_bounded_batches(monkeypatch):
    """Rows go out by characters, whatever the size of what came in (before: a whole batch of documents at once)."""
    import pyarrow as pa

    monkeypatch.setattr(chunking, "HELD", 1000)
    rows = [(i, 0, "x" * 100) for i in range(500)]
    batches = list(chunking.packed(iter(rows), [("doc_id", pa.int64()), ("chunk_index", pa.int32()), ("content", pa.string())]))
    assert [tuple(r.values()) for b in batches for r in b.to_pylist()] == rows and max(b.num_rows for b in batches) < 10
