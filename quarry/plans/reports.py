"""Feedback, session, exam and call reports, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores, text
from .fixtures import NOW, view
from .registry import n_rows, query


@query("d4_feedback_statistics", """
select count(*) total, count(*) filter (where rating = 1) positive, count(*) filter (where rating = -1) negative, round(avg(rating), 2) avg_rating, round(count(*) filter (where rating = 1) * 100.0 / count(*), 1) satisfaction from feedback""")
def feedback_statistics(spark, sf_dir):
    pos = F.count_if(F.col("rating") == 1)
    return view(spark, sf_dir, "feedback").agg(
        n_rows().alias("total"), pos.alias("positive"), F.count_if(F.col("rating") == -1).alias("negative"), F.round(F.coalesce(F.avg("rating"), F.lit(0.0)), 2).alias("avg_rating"), F.round(F.coalesce(F.try_divide(pos * 100.0, n_rows()), F.lit(0.0)), 1).alias("satisfaction"))


@query("d5_frequent_queries", "select query, n, sample from (select query, count(*) n, substr(arg_max(answer, id), 1, 200) sample from feedback group by query) order by n desc, query limit 20")
def frequent(spark, sf_dir):
    g = view(spark, sf_dir, "feedback").groupBy("query").agg(n_rows().alias("n"), F.substring(F.max_by("answer", "id"), 1, 200).alias("sample"))
    return g.orderBy(F.desc("n"), "query").limit(20)


@query("d6_low_ratings", "select id, query, user_id from feedback where rating = -1 order by created_at desc, id limit 50")
def low_ratings(spark, sf_dir):
    return view(spark, sf_dir, "feedback").where("rating = -1").orderBy(F.desc("created_at"), "id").limit(50).select("id", "query", "user_id")


@query("d7_low_rated_sources", "select sources, count(*) n from feedback where rating = -1 group by sources having count(*) >= 90")
def low_sources(spark, sf_dir):
    """Per whole list, as reports count; see ``c5_blacklist`` for the exploded form."""
    return view(spark, sf_dir, "feedback").where("rating = -1").groupBy("sources").agg(n_rows().alias("n")).where("n >= 90")


@query("d8_weekly_report", """
select strftime(date_trunc('week', created_at), '%Y-%m-%d') "week", count(*) total, count(*) filter (where rating = 1) positive, round(count(*) filter (where rating = 1) * 100.0 / count(*), 1) satisfaction,
  list_filter([case when count(*) filter (where rating = 1) * 100.0 / count(*) < 70 then 'satisfaction' end, case when count(*) filter (where rating = -1) > 5 then 'low ratings' end], lambda x: x is not null) suggestions
from feedback group by 1""")
def weekly(spark, sf_dir):
    pos, neg = F.count_if(F.col("rating") == 1), F.count_if(F.col("rating") == -1)
    sat = pos * 100.0 / n_rows()
    tips = F.array_compact(F.array(F.when(sat < 70, F.lit("satisfaction")), F.when(neg > 5, F.lit("low ratings"))))
    week = F.date_format(F.date_trunc("week", "created_at"), "yyyy-MM-dd")
    return view(spark, sf_dir, "feedback").groupBy(week.alias("week")).agg(n_rows().alias("total"), pos.alias("positive"), F.round(sat, 1).alias("satisfaction"), tips.alias("suggestions"))


@query("d9_bad_cases", "select kind, name, n, 'pending' status from (select 'query' kind, query \"name\", count(*) n from feedback where rating = -1 group by query union all select 'sources', sources, count(*) from feedback where rating = -1 group by sources having count(*) >= 90)")
def bad_cases(spark, sf_dir):
    low = view(spark, sf_dir, "feedback").where("rating = -1")
    a = low.groupBy(F.col("query").alias("name")).agg(n_rows().alias("n")).select(F.lit("query").alias("kind"), "name", "n")
    b = low.groupBy(F.col("sources").alias("name")).agg(n_rows().alias("n")).where("n >= 90").select(F.lit("sources").alias("kind"), "name", "n")
    return a.unionByName(b).withColumn("status", F.lit("pending"))


@query("d10_session_statistics", "select count(distinct session_id) sessions, count(*) messages, count(*) filter (where role = 'user') user_messages from messages")
def session_statistics(spark, sf_dir):
    return view(spark, sf_dir, "messages").agg(F.countDistinct("session_id").alias("sessions"), n_rows().alias("messages"), F.count_if(F.col("role") == "user").alias("user_messages"))


@query("d11_exam_bank", "select question_type, source_file, count(*) n from questions group by grouping sets ((), (question_type), (source_file))")
def exam_bank(spark, sf_dir):
    return view(spark, sf_dir, "questions").groupingSets([[], ["question_type"], ["source_file"]], "question_type", "source_file").agg(n_rows().alias("n"))


_GRADED = """
g as (select a.exam_id, a.student_id, a.question_id, a.student_answer, q.question_type, q.score max_score,
  case when question_type = 'subjective' then null when question_type = 'fill_blank' then (case when lower(trim(student_answer)) = lower(trim(correct_answer)) then score else 0 end) when student_answer = correct_answer then score else 0 end points
  from answers a join questions q on q.id = a.question_id)"""


def graded(spark, sf_dir):
    """Answers with their points; subjective ones stay null for an outside scorer."""
    q = view(spark, sf_dir, "questions").select(F.col("id").alias("question_id"), "question_type", "correct_answer", F.col("score").alias("max_score"))
    a = view(spark, sf_dir, "answers").join(q, "question_id")
    norm = lambda c: F.lower(F.trim(c))
    right = F.when(F.col("question_type") == "fill_blank", norm("student_answer") == norm("correct_answer")).otherwise(F.col("student_answer") == F.col("correct_answer"))
    return a.withColumn("points", F.when(F.col("question_type") != "subjective", F.when(right, F.col("max_score")).otherwise(0)))


@query("c8_graded_answers", f"with {_GRADED} select exam_id, student_id, question_id, points from g where points is not null")
def graded_answers(spark, sf_dir):
    return graded(spark, sf_dir).where("points is not null").select("exam_id", "student_id", "question_id", "points")


@query("d12_grade_report", f"with {_GRADED} select exam_id, student_id, cast(sum(max_score) as bigint) total, cast(coalesce(sum(points), 0) as bigint) points, round(coalesce(sum(points), 0) * 100.0 / sum(max_score), 2) rate from g group by exam_id, student_id")
def grade_report(spark, sf_dir):
    total, got = F.sum("max_score"), F.coalesce(F.sum("points"), F.lit(0))
    return graded(spark, sf_dir).groupBy("exam_id", "student_id").agg(total.cast("long").alias("total"), got.cast("long").alias("points"), F.round(F.coalesce(F.try_divide(got * 100.0, total), F.lit(0.0)), 2).alias("rate"))


@query("m16_grading_by_type", f"with {_GRADED} select question_type, count(*) n, count(points) scored, cast(coalesce(sum(points), 0) as bigint) points from g group by question_type")
def grading_by_type(spark, sf_dir):
    return graded(spark, sf_dir).groupBy("question_type").agg(n_rows().alias("n"), F.count("points").alias("scored"), F.coalesce(F.sum("points"), F.lit(0)).cast("long").alias("points"))


@query("c7_exam_papers", "select exam_id, count(*) n, count(q.id) found, cast(sum(coalesce(score, 0)) as bigint) total, list(question_id order by question_order, question_id) question_ids from exam_questions e left join questions q on q.id = e.question_id and q.id % 7 <> 0 group by exam_id")
def exam_papers(spark, sf_dir):
    q = view(spark, sf_dir, "questions").where("id % 7 <> 0").select("id", "score")
    e = view(spark, sf_dir, "exam_questions")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("question_order", "question_id"))), lambda x: x["question_id"])
    return e.join(q, e["question_id"] == q["id"], "left").groupBy("exam_id").agg(n_rows().alias("n"), F.count("id").alias("found"), F.sum(F.coalesce("score", F.lit(0))).cast("long").alias("total"), ids.alias("question_ids"))


@query("b8_feedback_filter", "select id, user_id, rating from feedback where rating = -1 and user_id < 20 and created_at >= timestamp '2024-01-05' order by created_at desc, id limit 30")
def feedback_filter(spark, sf_dir):
    conditions = [F.col("rating") == -1, F.col("user_id") < 20, F.col("created_at") >= F.lit("2024-01-05").cast("timestamp")]
    df = view(spark, sf_dir, "feedback")
    for c in conditions:
        df = df.where(c)
    return df.orderBy(F.desc("created_at"), "id").limit(30).select("id", "user_id", "rating")


@query("b9_recent_changes", f"select event_id, event_type from events where ts >= timestamp '{NOW}' - interval 10 day and event_id % 3 = 0")
def recent_changes(spark, sf_dir):
    return view(spark, sf_dir, "events").where((F.col("ts") >= F.lit(NOW).cast("timestamp") - F.expr("interval 10 days")) & (F.col("event_id") % 3 == 0)).select("event_id", "event_type")


@query("b10_question_search", "select id, question_type, count(*) over () total from questions where lower(content) like '%7%' and difficulty <= 3 order by id limit 50")
def question_search(spark, sf_dir):
    q = view(spark, sf_dir, "questions").where(F.contains(F.lower("content"), F.lit("7")) & (F.col("difficulty") <= 3))
    total = q.agg(n_rows().alias("total"))
    return q.orderBy("id").limit(50).join(F.broadcast(total), F.lit(True)).select("id", "question_type", "total")


@query("b18_point_lookups", "select id, content, score from questions where id in (3, 17, 150)")
def lookups(spark, sf_dir):
    wanted = spark.createDataFrame([(3,), (17,), (150,)], "id long")
    return view(spark, sf_dir, "questions").join(F.broadcast(wanted), "id", "left_semi").select("id", "content", "score")


@query("c6_expired_sessions", "select session_id from messages group by session_id having max(created_at) < timestamp '2024-02-01 00:00:00' - interval 24 hour")
def expired_sessions(spark, sf_dir):
    m = view(spark, sf_dir, "messages").groupBy("session_id").agg(F.max("created_at").alias("last"))
    return m.where(F.col("last") < F.lit(NOW).cast("timestamp") - F.expr("interval 24 hours")).select("session_id")


@query("c11_similar_faqs", """
with q as (select distinct lower(query) q from feedback), f as (select distinct lower(query) f from feedback where rating = 1 and id % 3 = 0)
select q, f from (select q, f, row_number() over (partition by q order by f) r from q join f on contains(q, f) or contains(f, q)) where r <= 3""")
def similar_faqs(spark, sf_dir):
    """Either text contains the other: distinct queries first, then words in common narrow the pairs before the containment test."""
    fb = view(spark, sf_dir, "feedback")
    q = fb.select(F.lower("query").alias("q")).distinct()
    f = fb.where("rating = 1 and id % 3 = 0").select(F.lower("query").alias("f")).distinct()
    # the shorter text is a substring of the longer one, so its first two characters are among the longer one's pairs
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(2))))
    inside = q.withColumn("k", F.explode(pairs("q"))).join(f.withColumn("k", F.substring("f", 1, 2)), "k").where("contains(q, f)")
    around = f.withColumn("k", F.explode(pairs("f"))).join(q.withColumn("k", F.substring("q", 1, 2)), "k").where("contains(f, q)")
    both = inside.select("q", "f").unionByName(around.select("q", "f")).distinct()
    return both.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("f"))).where("r <= 3").select("q", "f")


@query("d16_category_report", "select category, count(*) n, round(avg(score), 2) mean, max(score) best, min(score) worst, round(avg(case when score >= 80 then 1.0 else 0 end), 4) good, round(avg(case when score >= 40 then 1.0 else 0 end), 4) fair from (select concat('c', item_id % 5) category, (item_id * 37) % 101 score from benchmark) group by rollup (category)")
def category_report(spark, sf_dir):
    b = view(spark, sf_dir, "benchmark").select(F.concat(F.lit("c"), F.col("item_id") % 5).alias("category"), ((F.col("item_id") * 37) % 101).alias("score"))
    share = lambda n: F.round(F.avg(F.when(F.col("score") >= n, 1.0).otherwise(0.0)), 4)
    return b.rollup("category").agg(n_rows().alias("n"), F.round(F.avg("score"), 2).alias("mean"), F.max("score").alias("best"), F.min("score").alias("worst"), share(80).alias("good"), share(40).alias("fair"))


@query("d23_call_usage", "select query_id, count(*) calls, cast(sum(tokens) as bigint) tokens, count(*) filter (where not success) failures, count(distinct call_type) kinds, count(*) >= 2 at_limit from call_log group by query_id")
def call_usage(spark, sf_dir):
    return view(spark, sf_dir, "call_log").groupBy("query_id").agg(n_rows().alias("calls"), F.sum("tokens").alias("tokens"), F.count_if(~F.col("success")).alias("failures"), F.countDistinct("call_type").alias("kinds"), (n_rows() >= 2).alias("at_limit"))


@query("d29_iteration_summary", "select session_id, count(*) n, round(max(confidence), 6) best, round(avg(confidence), 6) mean, cast(sum(results_count) as bigint) results, arg_max(iteration, confidence * 1000000 - iteration) best_iteration from iterations group by session_id")
def iteration_summary(spark, sf_dir):
    return view(spark, sf_dir, "iterations").groupBy("session_id").agg(
        n_rows().alias("n"), F.round(F.max("confidence"), 6).alias("best"), F.round(F.avg("confidence"), 6).alias("mean"), F.sum("results_count").alias("results"), F.max_by("iteration", F.col("confidence") * 1000000 - F.col("iteration")).cast("long").alias("best_iteration"))


_TREND = """
d as (select *, confidence - lag(confidence) over (partition by session_id order by iteration) diff from iterations),
r as (select *, count(*) filter (where diff > 0.02) over w ups, count(*) filter (where diff < -0.02) over w downs, count(diff) over w n from d window w as (partition by session_id order by iteration rows between 2 preceding and current row)),
t as (select *, case when n = 0 then 'unknown' when ups > downs then 'improving' when downs > ups then 'declining' else 'stable' end trend from r)"""


def trend(spark, sf_dir):
    w = Window.partitionBy("session_id").orderBy("iteration")
    d = view(spark, sf_dir, "iterations").withColumn("diff", F.col("confidence") - F.lag("confidence").over(w))
    last = w.rowsBetween(-2, 0)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(last)
    d = d.withColumn("ups", n(F.col("diff") > 0.02)).withColumn("downs", n(F.col("diff") < -0.02)).withColumn("n", F.count("diff").over(last))
    return d.withColumn("trend", F.when(F.col("n") == 0, "unknown").when(F.col("ups") > F.col("downs"), "improving").when(F.col("downs") > F.col("ups"), "declining").otherwise("stable"))


@query("e11_iteration_trend", f"with {_TREND} select session_id, iteration, trend from t")
def iteration_trend(spark, sf_dir):
    return trend(spark, sf_dir).select("session_id", F.col("iteration").cast("long").alias("iteration"), "trend")


@query("e12_stop_decision", f"with {_TREND} select session_id, iteration, case when iteration >= 5 then 'limit' when confidence >= 0.7 then 'sufficient' when trend = 'declining' then 'declining' when trend = 'stable' and n > 0 then 'stable' else 'continue' end decision from t")
def stop_decision(spark, sf_dir):
    c = F.col("trend")
    d = F.when(F.col("iteration") >= 5, "limit").when(F.col("confidence") >= 0.7, "sufficient").when(c == "declining", "declining").when((c == "stable") & (F.col("n") > 0), "stable").otherwise("continue")
    return trend(spark, sf_dir).select("session_id", F.col("iteration").cast("long").alias("iteration"), d.alias("decision"))


@query("e14_call_quota", "select event_id, row_number() over (partition by query_id order by ts, event_id) <= 2 and (call_type not in ('rewrite', 'reflect', 'decompose') or row_number() over (partition by query_id, call_type order by ts, event_id) <= 1) allowed from call_log")
def call_quota(spark, sf_dir):
    n = lambda *k: F.row_number().over(Window.partitionBy(*k).orderBy("ts", "event_id"))
    capped = F.col("call_type").isin("rewrite", "reflect", "decompose")
    return view(spark, sf_dir, "call_log").select("event_id", ((n("query_id") <= 2) & (~capped | (n("query_id", "call_type") <= 1))).alias("allowed"))


@query("e16_balanced_questions", "select id, question_type from (select *, row_number() over (partition by question_type order by id) n from (select *, row_number() over (partition by question_type, substr(content, 1, 50) order by id) d from questions) where d = 1) where n <= case question_type when 'single_choice' then 20 when 'true_false' then 10 when 'fill_blank' then 5 else 3 end")
def balanced(spark, sf_dir):
    target = spark.createDataFrame([("single_choice", 20), ("true_false", 10), ("fill_blank", 5), ("subjective", 3)], "question_type string, wanted int")
    one = view(spark, sf_dir, "questions").withColumn("d", F.row_number().over(Window.partitionBy("question_type", F.substring("content", 1, 50)).orderBy("id"))).where("d = 1")
    n = F.row_number().over(Window.partitionBy("question_type").orderBy("id"))
    return one.withColumn("n", n).where("n <= 20").join(F.broadcast(target), "question_type").where("n <= wanted").select("id", "question_type")


@query("f8_ordered_limit", "select query, n, mean from (select query, count(*) n, round(avg(rating), 6) mean from feedback group by query) order by n desc, mean desc, query limit 10")
def ordered_limit(spark, sf_dir):
    g = view(spark, sf_dir, "feedback").groupBy("query").agg(n_rows().alias("n"), F.round(F.avg("rating"), 6).alias("mean"))
    return g.orderBy(F.desc("n"), F.desc("mean"), "query").limit(10)


@query("f9_pagination", "select id, content, (select count(*) from questions) total from questions order by id limit 25 offset 50")
def pagination(spark, sf_dir):
    q = view(spark, sf_dir, "questions")
    return q.orderBy("id").offset(50).limit(25).join(F.broadcast(q.agg(n_rows().alias("total"))), F.lit(True)).select("id", "content", "total")


@query("h9_faq_score", "select query, round(0.4 * least(1.0, count(*) / 20.0) + 0.6 * (avg(rating) + 1) / 2, 6) score from feedback group by query")
def faq_score(spark, sf_dir):
    g = view(spark, sf_dir, "feedback").groupBy("query").agg(n_rows().alias("n"), F.avg("rating").alias("mean"))
    return g.select("query", F.round(scores.faq_score(F.col("n"), F.col("mean")), 6).alias("score"))


@query("h34_question_points", "select id, case when question_type in ('single_choice', 'true_false') then 'objective' when question_type = 'fill_blank' then 'fill' else 'open' end kind, coalesce(score, 2) points from questions")
def question_points(spark, sf_dir):
    t = F.col("question_type")
    return view(spark, sf_dir, "questions").select("id", F.when(t.isin("single_choice", "true_false"), "objective").when(t == "fill_blank", "fill").otherwise("open").alias("kind"), F.coalesce("score", F.lit(2)).alias("points"))


@query("h41_calendar_bounds", "select event_id, cast(date_trunc('week', ts) as date) week_start, cast(date_trunc('week', ts) as date) + 6 week_end, cast(date_trunc('month', ts) as date) month_start, last_day(ts) month_end from events")
def calendar_bounds(spark, sf_dir):
    w = F.date_trunc("week", "ts").cast("date")
    return view(spark, sf_dir, "events").select("event_id", w.alias("week_start"), F.date_add(w, 6).alias("week_end"), F.date_trunc("month", "ts").cast("date").alias("month_start"), F.last_day("ts").alias("month_end"))


_ISLANDS = "select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 24 hour then 0 else 1 end starts from events"


@query("i3_session_windows", f"select user_id, count(*) events, min(ts) first_ts, max(ts) last_ts from (select user_id, ts, sum(starts) over (partition by user_id order by ts rows unbounded preceding) s from ({_ISLANDS})) group by user_id, s")
def session_windows(spark, sf_dir):
    """Batch twin of the session expiry stream."""
    e = view(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "24 hours")).agg(n_rows().alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("session_window")


@query("i4_faq_suggestions", "select query, n, round(score, 6) score from (select query, count(*) n, 0.4 * least(1.0, count(*) / 20.0) + 0.6 score from feedback where rating = 1 group by query) where score > 0.5")
def faq_suggestions(spark, sf_dir):
    """Batch twin of the suggestion stream."""
    g = view(spark, sf_dir, "feedback").where("rating = 1").groupBy("query").agg(n_rows().alias("n"))
    return g.withColumn("score", F.round(scores.faq_score(F.col("n"), F.lit(1.0)), 6)).where("score > 0.5")


@query("i6_daily_report", "select strftime(created_at, '%Y-%m-%d') as \"day\", count(*) total, count(*) filter (where rating = 1) positive from feedback group by 1")
def daily(spark, sf_dir):
    g = view(spark, sf_dir, "feedback").groupBy(F.window("created_at", "1 day")).agg(n_rows().alias("total"), F.count_if(F.col("rating") == 1).alias("positive"))
    return g.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "total", "positive")


@query("i8_collection_versions", "select event_id, concat('kb', user_id % 4) collection, row_number() over (partition by user_id % 4 order by ts, event_id) version from events where event_type = 'purchase'")
def collection_versions(spark, sf_dir):
    """Numbers in order of time: inside a day of a collection, after the counts of the days before, so no collection goes to one task."""
    e = view(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "ts", F.concat(F.lit("kb"), F.col("user_id") % 4).alias("collection"), F.to_date("ts").alias("day"))
    before = Window.partitionBy("collection").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = e.groupBy("collection", "day").agg(n_rows().alias("n")).select("collection", "day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    inside = F.row_number().over(Window.partitionBy("collection", "day").orderBy("ts", "event_id"))
    return e.withColumn("inside", inside).join(days, ["collection", "day"]).select("event_id", "collection", (F.col("inside") + F.col("earlier")).alias("version"))


@query("i9_last_activity", "select session_id, max(created_at) last_active from feedback group by session_id")
def last_activity(spark, sf_dir):
    return view(spark, sf_dir, "feedback").groupBy("session_id").agg(F.max("created_at").alias("last_active"))


@query("b11_query_validity", r"select session_id, seq, case when length(trim(content)) = 0 then 'empty' when length(content) > 1000 then 'too long' when regexp_matches(content, '(?i)ignore (all|previous) instructions') then 'injection' else 'ok' end reason from messages where role = 'user'")
def validity(spark, sf_dir):
    c = F.col("content")
    r = F.when(F.length(F.trim(c)) == 0, "empty").when(F.length(c) > 1000, "too long").when(c.rlike("(?i)ignore (all|previous) instructions"), "injection").otherwise("ok")
    return view(spark, sf_dir, "messages").where("role = 'user'").select("session_id", "seq", r.alias("reason"))


@query("b12_redaction", r"select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\b(?:sk|pk|api|key)[-_][A-Za-z0-9_-]{16,}', '[removed]', 'g'), '(?i)(?:password|passwd|pwd)\s*[:=]\s*\S+', '[removed]', 'g'), '\b[A-Z][A-Z0-9]*_(?:KEY|SECRET|TOKEN|PASSWORD)\s*=\s*\S+', '[removed]', 'g'), '[\w.+-]+@[\w-]+(?:\.[\w-]+)+', '[removed]', 'g') text from documents")
def redaction(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id", text.redacted(F.col("text")).alias("text"))


@query("b16_intent_flags", "select session_id, seq, contains(lower(content), 'when') wants_time, contains(lower(content), 'with') wants_relation from messages where role = 'user'")
def intents(spark, sf_dir):
    c = F.lower("content")
    return view(spark, sf_dir, "messages").where("role = 'user'").select("session_id", "seq", text.any_of(c, ("when",)).alias("wants_time"), text.any_of(c, ("with",)).alias("wants_relation"))
