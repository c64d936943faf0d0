"""Extension points: models as columns, rule tables, and the chunk table function."""

import numpy as np
from pyspark.sql import functions as F

from quarry.functions import answers, hooks, text
from quarry.operators import chunking, maintain, search


def test_default_vector_is_a_signed_count(spark):
    df = spark.createDataFrame([("a b a",), ("",)], "s string").select(hooks.hashed_vector(F.col("s"), 8).alias("v"))
    first, second = (r.v for r in df.collect())
    assert sum(abs(x) for x in first) in (1.0, 3.0) and second == [0.0] * 8


def test_callers_models(spark):
    df = spark.createDataFrame([("abc", "ab"), (None, "x")], "q string, t string")
    embed = hooks.embedder(lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]))
    score = hooks.pair_scorer(lambda: lambda pairs: [float(a.startswith(b)) for a, b in pairs])
    assert [(r.v, r.s) for r in df.select(embed("q").alias("v"), score("q", "t").alias("s")).collect()] == [([3.0, 1.0], 1.0), ([0.0, 1.0], 0.0)]


def test_chunk_function_in_sql(spark):
    hooks.register(spark)
    long = "one two three. " * 40
    rows = spark.sql("select * from chunk_text({s}, 100, 0, 120, 20)".format(s=f"'{long}'")).orderBy("chunk_index").collect()
    assert [r.content for r in rows] == chunking.split(long, 100, 0, 120, 20)


def test_custom_rule_words(spark):
    df = spark.createDataFrame([("what is new today",)], "q string")
    assert df.select(text.query_type(F.col("q"), realtime=("today",)).alias("t")).first().t == "realtime"


def test_sub_queries(spark):
    q = lambda s: spark.range(1).select(answers.sub_queries(F.lit(s)).alias("x")).first().x
    assert q("年假和病假有什么区别？") == ["年假是什么？", "年假的主要特点有哪些？", "病假是什么？", "病假的主要特点有哪些？", "年假和病假的主要区别有哪些？"]
    assert q("天空") == ["天空"]


def test_lcs():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
        return row[-1]

    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = ("".join(rng.choice(list("abc"), n)) for n in rng.integers(0, 30, 2))
        assert answers.lcs(a, b) == slow(a, b)


def test_table_titles(spark):
    cases = {"| a | b |\n| --- |": "a、b", "<strong>x</strong> and <strong>y</strong>": "x、y", "【表格】 Sales\n| a |": "Sales", "word": "表格"}
    df = spark.createDataFrame(list(cases.items()), "s string, t string")
    assert df.where(answers.table_title(F.col("s")) != F.col("t")).count() == 0


def test_heading_merge_golden(spark):
    rows = [(0, "text", 1, "1. Title"), (1, "text", 0, "short"), (2, "text", 0, ""), (3, "table", 0, "| a |"), (4, "text", 0, "body " * 400), (5, "text", 0, " ")]
    df = spark.createDataFrame([(7, *r) for r in rows], "doc_id long, pos int, chunk_type string, text_level int, content string")
    got = chunking.heading_merge(df).orderBy("chunk_index").collect()
    assert [r.chunk_type for r in got].count("table") == 1
    assert got[0].content == "1. Title\nshort" and all(r.content.strip() for r in got) and all(len(r.content) <= 1200 for r in got)


def test_diversity_keeps_short_lists(spark):
    df = spark.createDataFrame([(1, i, i, t) for i, t in enumerate(["abc", "abcd", "xyz", "abc"], 1)], "query_id long, vec_id long, rank int, content string")
    assert search.diverse(df, 4).count() == 4
    assert [r.vec_id for r in search.diverse(df, 2, 0.7).orderBy("rank").collect()] == [1, 3]


def test_upsert_and_diff_with_nulls(spark):
    old = spark.createDataFrame([(1, "a"), (2, None)], "document_id long, content_hash string")
    new = spark.createDataFrame([(2, None), (3, "c")], "document_id long, content_hash string")
    assert {r.document_id: r.change_type for r in maintain.snapshot_diff(new, old).collect()} == {1: "deleted", 2: "same", 3: "added"}
    assert sorted(r.document_id for r in maintain.upsert(old, new, ["document_id"]).collect()) == [1, 2, 3]
