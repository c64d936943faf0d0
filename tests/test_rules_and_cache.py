"""Rule tables, decomposition, triples out of text, and the semantic cache."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import answers, hooks, text, triples
from quarry.operators import cache, search


def test_callers_rules_win_and_built_in_ones_are_rows(spark):
    rules = [*text.rule_rows(), ("weather", "word", "weather", -1), (r"^\d+$", "regex", "number", 99), (None, "word", "x", -9)]
    table = spark.createDataFrame(rules, "pattern string, kind string, class string, priority int")
    asked = ["今天天气 weather", "今天天气", "a和b有什么区别", "report.pdf的流程", "123", "其他", None, "审批流程"]
    rows = spark.createDataFrame(list(enumerate(asked)), "i int, q string")
    got = {r.i: (r["class"], r.rule) for r in search.classified(rows, "q", table).collect()}
    assert [got[i][0] for i in range(8)] == ["weather", "realtime", "comparison", "file_specific", "number", "fact", "fact", "process"]
    assert got[0][1] == "weather" and got[5][1] is None
    # without rows of the caller the classes are those of the built-in lists, as far as these are lists
    plain = spark.createDataFrame(text.rule_rows(), "pattern string, kind string, class string, priority int")
    both = search.classified(rows.where("q is not null"), "q", plain).withColumn("kind", text.query_type(F.col("q"))).where("kind <> 'simple'").collect()
    assert all(r["class"] == r["kind"] for r in both)


def test_too_many_rules_are_refused(spark, monkeypatch):
    monkeypatch.setattr(search, "MAX_RULES", 3)
    with pytest.raises(ValueError):
        search.classified(spark.createDataFrame([("a",)], "q string"), "q", spark.createDataFrame(text.rule_rows(), "pattern string, kind string, class string, priority int"))


def test_decomposition(spark):
    long = "为什么" + "这个问题需要很长的一段文字来说明才能让人明白" * 2
    asked = ["请问报销和出差有什么区别", "甲方和乙方和丙方的区别", "报销流程", long, "和好有什么区别"]
    rows = spark.createDataFrame(list(enumerate(asked)), "i int, q string")
    got = {r.i: (r.two, r.three) for r in rows.select("i", answers.sub_queries(F.col("q")).alias("two"), answers.sub_queries(F.col("q"), most=3).alias("three")).collect()}
    assert got[0][0] == ["报销是什么？", "报销的主要特点有哪些？", "出差是什么？", "出差的主要特点有哪些？", "报销和出差的主要区别有哪些？"]
    assert len(got[1][0]) == 5 and len(got[1][1]) == 7 and got[1][1][-1] == "甲方和乙方的主要区别有哪些？"
    assert got[2][0] == ["报销流程"] and got[3][0] == [long, long[:10] + "...的相关背景"] and got[4][0] == ["和好有什么区别"]
    own = rows.limit(1).select(answers.sub_queries(F.lit("red tea and green tea"), connectors=" and ", signs=(" and ",), asked=(" is",), together=" differ", joint=" or ").alias("q")).first().q
    assert own == ["red tea is", "green tea is", "red tea or green tea differ"]


def test_triples_in_a_lateral_join(spark):
    hooks.register_triples(spark)
    body = '{"entities": [{"name": " A ", "type": "T"}], "relations": [{"head": "A", "relation": "r", "tail": "B"}, {"head": "A", "relation": "other", "tail": "B"}, {"head": "", "relation": "r", "tail": "B"}, 7]}'
    rows = [(1, body), (2, f"Sure:\n```json\n{body}\n```"), (3, body[:-2]), (4, None), (5, "no json"), (6, '{"relations": 3}'), (7, "[1, 2]")]
    spark.createDataFrame(rows, "i int, t string").createOrReplaceTempView("answers_")
    got = spark.sql("select i, x.* from answers_, lateral text_triples(t, array('r')) x order by i").collect()
    assert [tuple(r) for r in got] == [(i, "A", "T", "r", "B", triples.UNKNOWN) for i in (1, 2)]
    more = spark.sql("select x.* from answers_, lateral text_triples(t, array('r'), 'doc') x where i = 1")
    assert more.columns[-1] == "source" and more.first().source == "doc"


@pytest.mark.parametrize("ttl,size", [(None, None), (40, None), (None, 7), (25, 4)])
def test_cache_equals_a_plain_loop(spark, monkeypatch, ttl, size):
    monkeypatch.setattr(cache, "TIME_RANGE", 16)
    r = np.random.default_rng(2)
    entries = [(i, int(r.integers(0, 120)), r.normal(size=6).tolist()) for i in range(60)]
    lookups = [(i, int(r.integers(0, 140)), (np.array(entries[i * 3 % 60][2]) + r.normal(size=6) * 0.05).tolist()) for i in range(40)]
    lookups += [(90, -5, entries[0][2]), (91, 100, None), (92, 100, [1.0, 2.0])]
    frame = lambda rows, *names: spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, ("long", "long", "array<double>"), strict=True)))
    got = {x.query_id: (x.cache_id, x.hit) for x in cache.looked_up(frame(lookups, "query_id", "asked_at", "embedding"), frame([*entries, (99, 1, None)], "cache_id", "cached_at", "embedding"), ttl=ttl, size=size).collect()}
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    hits = 0
    for q, t, e in lookups:
        best = None
        if e is not None and len(e) == 6:
            seen = sorted([*((at, i) for i, at, _ in entries), (1, 99)])
            seen = [x for x in seen if x[0] < t]
            if size is not None and len(seen) >= size:
                seen = [x for x in seen if x[0] >= seen[-size][0]]
            seen = [i for at, i in seen if i != 99 and (ttl is None or at >= t - ttl)]
            scored = [(-round(float(unit(e) @ unit(entries[i][2])), 6), i) for i in seen]
            best = min(scored, default=None)
        assert got[q] == ((None, False) if best is None else (best[1], -best[0] > 0.92)), (q, best)
        hits += got[q][1]
    assert hits > (3 if ttl is None or size is None else 1)
