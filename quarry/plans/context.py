"""Context shaping and answer checks over hits and messages, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import search
from .fixtures import view
from .registry import n_rows, query


@query("b7_score_threshold", "select query_id, vec_id, score from hits h where score >= 0.3 or not exists (select 1 from hits x where x.query_id = h.query_id and x.score >= 0.3)")
def threshold(spark, sf_dir):
    return search.keep_or_all(view(spark, sf_dir, "hits"), "query_id", F.col("score") >= 0.3).select("query_id", "vec_id", "score")


@query("b5_section_filter", "select query_id, vec_id, section from hits h where section = concat('S', query_id % 7) or not exists (select 1 from hits x where x.query_id = h.query_id and x.section = concat('S', x.query_id % 7))")
def section_filter(spark, sf_dir):
    """Sections that the query names; all rows where none matches."""
    return search.keep_or_all(view(spark, sf_dir, "hits"), "query_id", F.col("section") == F.concat(F.lit("S"), F.col("query_id") % 7)).select("query_id", "vec_id", "section")


@query("e5_token_budget", "select query_id, vec_id, rank from (select *, sum(length(content) // 2) over (partition by query_id order by rank) used from hits) where used <= 600")
def token_budget(spark, sf_dir):
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return view(spark, sf_dir, "hits").withColumn("used", F.sum(text.token_estimate(F.col("content"))).over(w)).where("used <= 600").select("query_id", "vec_id", "rank")


@query("e7_distinct_contexts", "select query_id, vec_id, cast(new_rank as int) new_rank from (select *, row_number() over (partition by query_id order by rank) new_rank from (select *, row_number() over (partition by query_id, source, page, substr(content, 1, 100) order by rank) d from hits) where d = 1) where new_rank <= 20")
def distinct_contexts(spark, sf_dir):
    d = F.row_number().over(Window.partitionBy("query_id", "source", "page", F.substring("content", 1, 100)).orderBy("rank"))
    one = view(spark, sf_dir, "hits").withColumn("d", d).where("d = 1")
    return search.topk(one, ["query_id"], [F.col("rank")], 20, "new_rank").select("query_id", "vec_id", "new_rank")


@query("m9_compressed_contexts", """
with a as (select * from hits h where score >= 0.3 or not exists (select 1 from hits x where x.query_id = h.query_id and x.score >= 0.3)),
b as (select *, row_number() over (partition by query_id, source, page, substr(content, 1, 100) order by rank) d from a)
select query_id, vec_id from (select *, sum(length(content) // 2) over (partition by query_id order by rank) used from b where d = 1) where used <= 600""")
def compressed(spark, sf_dir):
    a = search.keep_or_all(view(spark, sf_dir, "hits"), "query_id", F.col("score") >= 0.3)
    b = a.withColumn("d", F.row_number().over(Window.partitionBy("query_id", "source", "page", F.substring("content", 1, 100)).orderBy("rank"))).where("d = 1")
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumn("used", F.sum(text.token_estimate(F.col("content"))).over(w)).where("used <= 600").select("query_id", "vec_id")


@query("d17_sources", """
select query_id, source, count(*) n, list_sort(list(distinct page)) pages, list_sort(list(distinct section)) sections from hits group by query_id, source""")
def sources(spark, sf_dir):
    return view(spark, sf_dir, "hits").groupBy("query_id", "source").agg(n_rows().alias("n"), F.sort_array(F.collect_set("page")).alias("pages"), F.sort_array(F.collect_set("section")).alias("sections"))


@query("d18_best_per_source", "select query_id, source, max(score) score, arg_min(vec_id, rank) vec_id from hits group by query_id, source")
def best_per_source(spark, sf_dir):
    return view(spark, sf_dir, "hits").groupBy("query_id", "source").agg(F.max("score").alias("score"), F.min_by("vec_id", "rank").alias("vec_id"))


@query("d26_confidence_gate", """
with g as (select q.vec_id query_id, max(score) top, avg(score) filter (where rank <= 3) mean from (select vec_id from vectors where vec_id % 100 = 0) q left join (select * from hits where score >= 0.3) h on h.query_id = q.vec_id group by q.vec_id)
select query_id, coalesce(top, 0) top, round(coalesce(mean, 0), 6) mean, case when top is null then 'fallback' when top >= 0.2 then 'pass' when mean < 0.2 then 'web_search' else 'rewrite' end action from g""")
def gate(spark, sf_dir):
    """Queries without hits above the threshold fall back."""
    g = view(spark, sf_dir, "hits").where("score >= 0.3").groupBy("query_id").agg(F.max("score").alias("top"), F.avg(F.when(F.col("rank") <= 3, F.col("score"))).alias("mean"))
    q = view(spark, sf_dir, "vectors").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"))
    action = F.when(F.col("top").isNull(), "fallback").when(F.col("top") >= 0.2, "pass").when(F.col("mean") < 0.2, "web_search").otherwise("rewrite")
    return q.join(g, "query_id", "left").select("query_id", F.coalesce("top", F.lit(0.0)).alias("top"), F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("mean"), action.alias("action"))


@query("d27_quality_assessment", """
with a as (select query_id, count(*) n, sum(length(content)) chars, count(distinct source) sources, avg(case when contains(content, concat('word', query_id % 7)) then 1.0 else 0 end) cover from hits where rank <= 5 group by query_id),
s as (select query_id, case when cover >= 0.8 then 9 when cover >= 0.6 then 7 when cover >= 0.4 then 5 when cover >= 0.2 then 3 else 1 end relevance,
  least(10, least(3, n) + case when chars >= 2000 then 7 when chars >= 1000 then 5 when chars >= 500 then 3 else 1 end) completeness, case when sources >= 3 then 9 when sources >= 2 then 7 else 5 end coverage from a)
select query_id, relevance, completeness, coverage, relevance + completeness + 8 + coverage total, relevance + completeness + 8 + coverage >= 32 sufficient from s""")
def assessment(spark, sf_dir):
    hit = F.when(F.contains("content", F.concat(F.lit("word"), F.col("query_id") % 7)), 1.0).otherwise(0.0)
    a = view(spark, sf_dir, "hits").where("rank <= 5").groupBy("query_id").agg(n_rows().alias("n"), F.sum(F.length("content")).alias("chars"), F.countDistinct("source").alias("sources"), F.avg(hit).alias("cover"))
    c, n = F.col("cover"), F.col("chars")
    rel = F.when(c >= 0.8, 9).when(c >= 0.6, 7).when(c >= 0.4, 5).when(c >= 0.2, 3).otherwise(1)
    comp = F.least(F.lit(10).cast("long"), F.least(F.lit(3).cast("long"), F.col("n")) + F.when(n >= 2000, 7).when(n >= 1000, 5).when(n >= 500, 3).otherwise(1))
    cov = F.when(F.col("sources") >= 3, 9).when(F.col("sources") >= 2, 7).otherwise(5)
    total = rel + comp + 8 + cov
    return a.select("query_id", rel.alias("relevance"), comp.alias("completeness"), cov.alias("coverage"), total.alias("total"), (total >= 32).alias("sufficient"))


@query("d28_sufficiency", "select query_id, max(case when contains(content, concat('word', query_id % 7)) then 1 else 0 end) + max(case when contains(content, 'text') then 1 else 0 end) >= 1 sufficient from hits where rank <= 3 group by query_id")
def sufficiency(spark, sf_dir):
    """At least half of the query's words occur in its first three documents."""
    h = view(spark, sf_dir, "hits").where("rank <= 3")
    words = F.array(F.concat(F.lit("word"), F.col("query_id") % 7), F.lit("text"))
    found = h.select("query_id", "content", F.explode(words).alias("w")).groupBy("query_id", "w").agg(F.max(F.contains("content", "w").cast("int")).alias("hit"))
    return found.groupBy("query_id").agg((F.sum("hit") >= F.count(F.lit(1)) * 0.5).alias("sufficient"))


@query("h43_context_text", "select query_id, string_agg(concat('[', rank, '] ', source, ' p', page), chr(10) order by rank) context from hits where rank <= 5 group by query_id")
def context_text(spark, sf_dir):
    line = F.concat(F.lit("["), "rank", F.lit("] "), "source", F.lit(" p"), "page")
    rows = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return view(spark, sf_dir, "hits").where("rank <= 5").groupBy("query_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("context"))


@query("h27_citations", "select query_id, vec_id, case when source like '%.pdf' then concat('page ', page) when source like '%.docx' then concat('part ', vec_id % 5 + 1) when source like '%.xlsx' then concat('sheet page ', page) else concat('page ', page, ', ', section) end place from hits")
def citations(spark, sf_dir):
    kind = text.doc_type(F.col("source"))
    place = F.when(kind == "pdf", F.concat(F.lit("page "), "page")).when(kind == "word", F.concat(F.lit("part "), F.col("vec_id") % 5 + 1)).when(kind == "excel", F.concat(F.lit("sheet page "), "page")).otherwise(F.concat(F.lit("page "), "page", F.lit(", "), "section"))
    return view(spark, sf_dir, "hits").select("query_id", "vec_id", place.alias("place"))


_SENTENCES = r"s as (select session_id, seq, content, list_filter(list_transform(regexp_split_to_array(content, '[。！？.!?]\s*'), lambda x: trim(x)), lambda x: x <> '') ss from messages where role = 'assistant')"


@query("h29_claims", f"with {_SENTENCES} select session_id, seq, cast(len(ss) as int) n_sentences, len(list_filter(ss, lambda x: contains(x, 'the'))) n_hedged from s")
def claims(spark, sf_dir):
    ss = text.sentences(F.col("content"))
    hedged = F.size(F.filter(ss, lambda x: text.claim_type(x, hedged=("the",)) == "hedged"))
    return view(spark, sf_dir, "messages").where("role = 'assistant'").select("session_id", "seq", F.size(ss).alias("n_sentences"), hedged.cast("long").alias("n_hedged"))


@query("c18_citation_match", f"""
with {_SENTENCES}, x as (select session_id, seq, unnest(range(len(ss))) pos, unnest(ss) sentence from s),
c as (select session_id, seq ctx, content from messages where role = 'user'),
m as (select x.session_id, x.seq, x.pos, c.ctx, len(list_intersect(list_distinct(string_split(x.sentence, '')), list_distinct(string_split(c.content, '')))) / length(x.sentence) overlap from x join c using (session_id))
select session_id, seq, pos, ctx, round(overlap, 6) overlap from (select *, row_number() over (partition by session_id, seq, pos order by round(overlap, 6) desc, ctx) r from m) where r = 1 and overlap > 0.3""")
def citation_match(spark, sf_dir):
    """Best context of each sentence by shared characters over the sentence's length."""
    m = view(spark, sf_dir, "messages")
    x = m.where("role = 'assistant'").select("session_id", "seq", F.posexplode(text.sentences(F.col("content"))).alias("pos", "sentence"))
    c = m.where("role = 'user'").select("session_id", F.col("seq").alias("ctx"), text.characters(F.col("content")).alias("chars"))
    over = F.size(F.array_intersect(text.characters(F.col("sentence")), F.col("chars"))) / F.length("sentence")
    best = search.topk(x.join(c, "session_id").withColumn("overlap", over).withColumn("o", F.round("overlap", 6)), ["session_id", "seq", "pos"], [F.desc("o"), F.col("ctx")], 1)
    return best.where("overlap > 0.3").select("session_id", "seq", F.col("pos").cast("long").alias("pos"), "ctx", F.col("o").alias("overlap"))


_HISTORY = "m as (select *, sum(1.5 * length(content)) over (partition by session_id order by seq desc) used, count(*) over (partition by session_id) n from messages)"


@query("e6_history", f"with {_HISTORY} select session_id, any_value(n) - count(*) omitted, string_agg(concat(role, ': ', content), chr(10) order by seq) history from m where used <= 3000 group by session_id")
def history(spark, sf_dir):
    """Newest turns that fit the budget, in order of time, with the number left out."""
    w = Window.partitionBy("session_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    m = view(spark, sf_dir, "messages").withColumn("used", F.sum(1.5 * F.length("content")).over(w)).withColumn("n", n_rows().over(Window.partitionBy("session_id")))
    rows = F.array_sort(F.collect_list(F.struct("seq", F.concat("role", F.lit(": "), "content").alias("line"))))
    return m.where("used <= 3000").groupBy("session_id").agg((F.max("n") - n_rows()).alias("omitted"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("history"))


@query("e8_last_user_message", "select session_id, seq, last_value(case when role = 'user' then content end ignore nulls) over (partition by session_id order by seq rows between unbounded preceding and 1 preceding) last_user from messages")
def last_user(spark, sf_dir):
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return view(spark, sf_dir, "messages").select("session_id", "seq", F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(w).alias("last_user"))


@query("e9_recent_history", "select session_id, seq, coalesce(array_to_string(list(concat(role, ':', substr(content, 1, 500))) over (partition by session_id order by seq rows between 6 preceding and 1 preceding), chr(10)), '') recent from messages")
def recent_history(spark, sf_dir):
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(-6, -1)
    return view(spark, sf_dir, "messages").select("session_id", "seq", F.array_join(F.collect_list(F.concat("role", F.lit(":"), F.substring("content", 1, 500))).over(w), "\n").alias("recent"))


@query("e13_repeated_queries", r"""
with u as (select session_id, seq, content, list_distinct(list_filter(regexp_extract_all(lower(content), '[\p{L}\p{N}]+'), lambda t: length(t) >= 2)) k from messages where role = 'user')
select a.session_id, a.seq, coalesce(max(case when a.content = b.content or len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k))) >= 0.2 then 1 else 0 end), 0) = 1 repeated from u a left join u b on a.session_id = b.session_id and b.seq < a.seq group by a.session_id, a.seq""")
def repeated(spark, sf_dir):
    """Same words as an earlier query of the session (Jaccard 0.2 here, so that some are found)."""
    from ..functions.scores import jaccard

    u = view(spark, sf_dir, "messages").where("role = 'user'").select("session_id", "seq", "content", text.keywords(F.col("content")).alias("k"))
    b = u.select(F.col("session_id").alias("sid2"), F.col("seq").alias("s2"), F.col("content").alias("c2"), F.col("k").alias("k2"))
    same = F.coalesce((F.col("content") == F.col("c2")) | (jaccard(F.col("k"), F.col("k2")) >= 0.2), F.lit(False))
    return u.join(b, (F.col("session_id") == F.col("sid2")) & (F.col("s2") < F.col("seq")), "left").groupBy("session_id", "seq").agg((F.max(same.cast("int")) == 1).alias("repeated"))


@query("h1_tokens", r"select item_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) n_tokens, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda t: length(t) >= 2))) n_keywords from benchmark")
def token_counts(spark, sf_dir):
    return view(spark, sf_dir, "benchmark").select("item_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(text.keywords(F.col("text"))).cast("long").alias("n_keywords"))


@query("h4_jaccard", "select a.item_id, round(len(list_intersect(list_distinct(string_split(a.text, '')), list_distinct(string_split(b.text, '')))) / len(list_distinct(list_concat(string_split(a.text, ''), string_split(b.text, '')))), 6) jaccard from benchmark a join benchmark b on b.item_id = a.item_id + 1")
def jaccards(spark, sf_dir):
    from ..functions.scores import jaccard

    a = view(spark, sf_dir, "benchmark").select("item_id", text.characters(F.col("text")).alias("x"))
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("x").alias("y"))
    return a.join(b, "item_id").select("item_id", F.round(jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


@query("h14_coverage", "select query_id, vec_id, round(len(list_filter(['text', concat('word', query_id % 7)], lambda t: contains(lower(content), t))) / 2 * 0.8, 6) coverage from hits")
def coverage(spark, sf_dir):
    ts = F.array(F.lit("text"), F.concat(F.lit("word"), F.col("query_id") % 7))
    return view(spark, sf_dir, "hits").select("query_id", "vec_id", F.round(text.coverage(F.col("content"), ts), 6).alias("coverage"))


@query("h20_query_types", "select session_id, seq, case when contains(content, 'vs') then 'comparison' else 'fact' end query_type from messages where role = 'user' and not regexp_matches(content, '(?i)[^\\s，。？!！?？]+?\\.(?:pdf|docx?|xlsx?|txt|md|pptx?)')")
def query_types(spark, sf_dir):
    m = view(spark, sf_dir, "messages").where("role = 'user'").where(text.file_in_query(F.col("content")).isNull())
    return m.select("session_id", "seq", text.query_type(F.col("content")).alias("query_type"))


@query("h25_token_estimates", "select session_id, seq, length(content) // 2 half, 1.5::double * length(content) one_and_half from messages")
def token_estimates(spark, sf_dir):
    return view(spark, sf_dir, "messages").select("session_id", "seq", text.token_estimate(F.col("content")).alias("half"), (F.length("content") * 1.5).alias("one_and_half"))


@query("h39_complexity", r"select session_id, seq, length(content) > 50 or len(list_distinct(list_filter(regexp_extract_all(lower(content), '[\p{L}\p{N}]+'), lambda t: length(t) >= 2))) > 4 complex, length(content) < 10 or seq > 0 rewrite from messages where role = 'user'")
def complexity(spark, sf_dir):
    c = F.col("content")
    return view(spark, sf_dir, "messages").where("role = 'user'").select("session_id", "seq", ((F.length(c) > 50) | (F.size(text.keywords(c)) > 4)).alias("complex"), ((F.length(c) < 10) | (F.col("seq") > 0)).alias("rewrite"))


@query("h37_routing", "select item_id, case when contains(text, 'the') then 'public_kb' when contains(text, 'und') then 'dept_hr' when contains(text, 'les') then 'dept_finance' else 'general' end target from benchmark")
def routing(spark, sf_dir):
    """First department whose words the text holds."""
    t = F.col("text")
    rules = [("public_kb", ("the",)), ("dept_hr", ("und",)), ("dept_finance", ("les",))]
    return view(spark, sf_dir, "benchmark").select("item_id", F.coalesce(*(F.when(text.any_of(t, w), F.lit(k)) for k, w in rules), F.lit("general")).alias("target"))


@query("h38_access", "select u.user_id, c.collection from (select distinct user_id, user_id % 3 r from events) u join (values ('public_kb', -1), ('dept_hr', 1), ('dept_finance', 2)) c(collection, dept) on u.r = 0 or c.dept = -1 or c.dept = u.r")
def access(spark, sf_dir):
    """Role 0 is an administrator; others see the public and their own collection.  Collections are a small dimension."""
    users = view(spark, sf_dir, "events").select("user_id", (F.col("user_id") % 3).alias("r")).distinct()
    own = F.when(F.col("r") == 0, F.array(F.lit("public_kb"), F.lit("dept_hr"), F.lit("dept_finance"))).when(F.col("r") == 1, F.array(F.lit("public_kb"), F.lit("dept_hr"))).otherwise(F.array(F.lit("public_kb"), F.lit("dept_finance")))
    return users.select("user_id", F.explode(own).alias("collection"))


_OWN_RULES = (("the", "word", "english", -2), ("und", "word", "german", -1), (r"^\p{Lu}\p{Ll}+ ", "regex", "capital", 70), ("que", "word", "other", 80), (None, "word", "nothing", -9))


def _quoted(v) -> str:
    return "null" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


@query("j5_rule_table", f"""
with r(pattern, kind, class, priority) as (values {", ".join("(" + ", ".join(map(_quoted, row)) + ")" for row in [*text.rule_rows(), *_OWN_RULES])}),
m as (select session_id, seq, class, pattern, row_number() over (partition by session_id, seq order by priority, pattern) n from messages join r
  on pattern is not null and case when kind = 'word' then contains(content, pattern) else regexp_matches(content, pattern) end)
select session_id, seq, coalesce(m.class, 'fact') class, m.pattern rule from messages left join (select * from m where n = 1) m using (session_id, seq)""")
def rule_table(spark, sf_dir):
    """Messages by the first rule that fits: the built-in lists are rows of the table, and a caller's rows win by their priority."""
    rules = spark.createDataFrame([*text.rule_rows(), *_OWN_RULES], "pattern string, kind string, class string, priority int")
    return search.classified(view(spark, sf_dir, "messages"), "content", rules).select("session_id", "seq", "class", "rule")
