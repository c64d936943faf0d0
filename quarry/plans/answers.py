"""Question, answer, routing and evaluation queries, with SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import answers, scores, text
from ..operators import maintain, search
from .fixtures import NOW, view
from .registry import n_rows, query
from ..sources.tables import stored
from .retrieval import best_chunks, bm25_sql, judged, relevant


@query("b6_row_predicate", "select chunk_id from chunks where length(content) % 7 = 3 and page = 2")
def row_predicate(spark, sf_dir):
    """A caller's own predicate is just a column."""
    mine = (F.length("content") % 7 == 3) & (F.col("page") == 2)
    return view(spark, sf_dir, "chunks").where(mine).select("chunk_id")


@query("b15_valid_questions", "select question_type, count(*) n from questions where question_type in ('single_choice', 'true_false', 'fill_blank') and length(content) > 0 and length(correct_answer) > 0 and not (question_type = 'single_choice' and difficulty > 4) group by question_type")
def valid_questions(spark, sf_dir):
    q = view(spark, sf_dir, "questions")
    ok = F.col("question_type").isin("single_choice", "true_false", "fill_blank") & (F.length("content") > 0) & (F.length("correct_answer") > 0)
    return q.where(ok & ~((F.col("question_type") == "single_choice") & (F.col("difficulty") > 4))).groupBy("question_type").agg(n_rows().alias("n"))


_CASCADE = """
r as (select id, concat(cast(id % 40 as int), '_text_', id % 6) wanted, concat('d', id % 40, case (id % 40) % 5 when 0 then '.pdf' when 1 then '.docx' when 2 then '.xlsx' when 3 then '.txt' else '.pptx' end) source, id % 3 + 1 page from questions),
t as (select r.id, c.chunk_id, 1 p, c.chunk_index from r join chunks c on c.chunk_id = r.wanted union all select r.id, c.chunk_id, 2, c.chunk_index from r join chunks c on c.source = r.source and c.page = r.page union all select r.id, c.chunk_id, 3, c.chunk_index from r join chunks c on c.source = r.source and c.chunk_index = 0),
b as (select *, min(p) over (partition by id) best from t)"""


def cascade(spark, sf_dir):
    """Chunks a question refers to: by id, else by page, else the first of its file."""
    m = F.col("id") % 40
    ext = F.element_at(F.array(*(F.lit(x) for x in (".pdf", ".docx", ".xlsx", ".txt", ".pptx"))), (m % 5 + 1).cast("int"))
    r = view(spark, sf_dir, "questions").select("id", F.concat(m, F.lit("_text_"), F.col("id") % 6).alias("wanted"), F.concat(F.lit("d"), m, ext).alias("rs"), (F.col("id") % 3 + 1).alias("rp"))
    c = view(spark, sf_dir, "chunks").select("chunk_id", "source", "page", "chunk_index", "content")
    tag = lambda df, p: df.select("id", "chunk_id", F.lit(p).alias("p"), "chunk_index", "page", "content")
    by_id = tag(r.join(c, F.col("wanted") == F.col("chunk_id")), 1)
    by_page = tag(r.join(c, (F.col("rs") == F.col("source")) & (F.col("rp") == F.col("page"))), 2)
    first = tag(r.join(c.where("chunk_index = 0"), F.col("rs") == F.col("source")), 3)
    both = by_id.unionByName(by_page).unionByName(first)
    return both.withColumn("best", F.min("p").over(Window.partitionBy("id"))).where("p = best")


@query("c10_reference_cascade", f"with {_CASCADE} select id, chunk_id, p from b where p = best")
def reference_cascade(spark, sf_dir):
    return cascade(spark, sf_dir).select("id", "chunk_id", "p")


@query("m17_source_trace", f"with {_CASCADE} select b.id, list(b.chunk_id order by b.chunk_index) chunk_ids, list_sort(list(distinct c.page)) pages, arg_min(substr(c.content, 1, 200), b.chunk_index) snippet from b join chunks c using (chunk_id) where p = best group by b.id")
def source_trace(spark, sf_dir):
    ids = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))), lambda x: x["chunk_id"])
    return cascade(spark, sf_dir).groupBy("id").agg(ids.alias("chunk_ids"), F.sort_array(F.collect_set("page")).alias("pages"), F.substring(F.min_by("content", "chunk_index"), 1, 200).alias("snippet"))


#: Terms of the invented prose that stand in for a department dictionary.
_DEPARTMENTS = (("dept_hr", "und"), ("dept_hr", "der"), ("dept_finance", "les"), ("dept_finance", "une"), ("dept_tech", "los"), ("public_kb", "the"))


@query("c12_dictionary_hits", f"select session_id, seq, dept, count(*) n from messages join (values {', '.join(map(str, _DEPARTMENTS))}) d(dept, word) on contains(lower(content), word) where role = 'user' group by session_id, seq, dept")
def dictionary_hits(spark, sf_dir):
    """Dictionary words inside texts: the fixed dictionary becomes one array expression, so no join is needed."""
    words = F.array(*(F.struct(F.lit(d).alias("dept"), F.lit(w).alias("word")) for d, w in _DEPARTMENTS))
    low = F.lower("content")
    m = view(spark, sf_dir, "messages").where("role = 'user'").withColumn("hit", F.explode(F.filter(words, lambda w: F.contains(low, w["word"]))))
    return m.groupBy("session_id", "seq", F.col("hit.dept").alias("dept")).agg(n_rows().alias("n"))


@query("c19_claim_verification", r"""
with s as (select session_id, seq, regexp_split_to_array(content, '[。！？.!?]\s*') ss from messages where role = 'assistant'),
x as (select session_id, seq, unnest(range(len(ss))) pos, list_distinct(list_filter(regexp_extract_all(lower(unnest(ss)), '[\p{L}\p{N}]+'), lambda t: length(t) >= 2)) k, trim(unnest(ss)) sentence from s),
y as (select * from x where sentence <> '' and len(k) > 0), c as (select session_id, lower(content) content from messages where role = 'user')
select session_id, seq, pos, max(case when len(list_filter(k, lambda t: contains(c.content, t))) >= len(k) * 0.5 then 1 else 0 end) = 1 verified from y join c using (session_id) group by session_id, seq, pos""")
def claim_verification(spark, sf_dir):
    """A sentence is verified if some user text of its session holds half of its words."""
    m = view(spark, sf_dir, "messages")
    parts = F.split("content", r"[。！？.!?]\s*")
    x = m.where("role = 'assistant'").select("session_id", "seq", F.posexplode(parts).alias("pos", "sentence")).where("trim(sentence) <> ''").withColumn("k", text.keywords(F.col("sentence"))).where("size(k) > 0")
    c = m.where("role = 'user'").select("session_id", F.lower("content").alias("context"))
    ok = F.size(F.filter("k", lambda t: F.contains(F.col("context"), t))) >= F.size("k") * 0.5
    return x.join(c, "session_id").groupBy("session_id", "seq", F.col("pos").cast("long").alias("pos")).agg((F.max(ok.cast("int")) == 1).alias("verified"))


@query("c23_batch_cache", "select c.document_id, s.content_hash is not null cached from doc_current c left join doc_stored s on s.content_hash = c.content_hash and s.document_id = c.document_id")
def batch_cache(spark, sf_dir):
    known = view(spark, sf_dir, "doc_stored").select("document_id", "content_hash", F.lit(True).alias("hit"))
    return view(spark, sf_dir, "doc_current").join(known, ["document_id", "content_hash"], "left").select("document_id", F.coalesce("hit", F.lit(False)).alias("cached"))


@query("e17_round_robin", "select section, chunk_type, n from (select section, t.chunk_type, t.n, row_number() over (partition by t.chunk_type order by section) r from (select distinct section from chunks) cross join (values ('text', 3), ('table', 2), ('image', 1)) t(chunk_type, n)) where r <= n")
def round_robin(spark, sf_dir):
    """Each kind goes once to each of its first n points: the points are ranked once, the kinds are a fixed array."""
    kinds = F.array(*(F.struct(F.lit(k).alias("chunk_type"), F.lit(n).alias("n")) for k, n in (("text", 3), ("table", 2), ("image", 1))))
    points = view(spark, sf_dir, "chunks").select("section").distinct().orderBy("section").limit(3)
    ranked = points.withColumn("r", F.row_number().over(Window.orderBy("section")))
    return ranked.withColumn("k", F.explode(kinds)).where("r <= k.n").select("section", "k.chunk_type", "k.n")


@query("e22_last_answer_lines", "with l as (select session_id, seq, last_value(case when role = 'assistant' then content end ignore nulls) over (partition by session_id order by seq rows between unbounded preceding and 1 preceding) a from messages) select session_id, seq, cast(len(list_filter(string_split(a, '.'), lambda x: contains(x, 'the'))) as int) n from l where a is not null")
def last_answer(spark, sf_dir):
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    a = F.last(F.when(F.col("role") == "assistant", F.col("content")), ignorenulls=True).over(w)
    m = view(spark, sf_dir, "messages").withColumn("a", a).where("a is not null")
    return m.select("session_id", "seq", F.size(F.filter(F.split("a", r"\."), lambda x: F.contains(x, F.lit("the")))).alias("n"))


@query("f11_answer_images", "with i as (select *, contains(caption, concat('.', page % 10)) named, row_number() over (partition by source order by width desc, chunk_id) r from images) select source, chunk_id from i where named or (r = 1 and not exists (select 1 from i x where x.source = i.source and x.named))")
def answer_images(spark, sf_dir):
    """Pictures that the answer names; the best one where it names none."""
    w = Window.partitionBy("source")
    i = view(spark, sf_dir, "images").withColumn("named", F.contains("caption", F.concat(F.lit("."), F.col("page") % 10)))
    i = i.withColumn("r", F.row_number().over(w.orderBy(F.desc("width"), "chunk_id"))).withColumn("some", F.max(F.col("named").cast("int")).over(w))
    return i.where("named or (r = 1 and some = 0)").select("source", "chunk_id")


@query("g4_ordered_distinct", "select chunk_id, list_distinct([collection, chunk_type, collection, section]) is not null ok, 3 n from chunks")
def ordered_distinct(spark, sf_dir):
    parts = F.array_distinct(F.array("collection", "chunk_type", "collection", "section"))
    return view(spark, sf_dir, "chunks").select("chunk_id", (parts[0] == F.col("collection")).alias("ok"), F.size(parts).alias("n"))


@query("h18_table_titles", "select row_no, sheet, array_to_string(list_slice(cells, 1, 4), '、') title from table_rows")
def table_titles(spark, sf_dir):
    md = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda c: F.trim(c)), " | "), F.lit(" |\n| --- |"))
    return view(spark, sf_dir, "table_rows").select("row_no", "sheet", answers.table_title(md).alias("title"))


# a caller's wordings, for texts that are not Chinese
_ASK = {"connectors": " (?:and|und|et|de) ", "signs": (" and ", " und ", " et ", " de "), "longest": 80, "reasons": ("tion",), "asked": (" what is it", " main features"), "together": " main differences", "background": " background", "joint": " and "}
_CLEAN = r"trim(regexp_replace(regexp_replace(trim({}), '^(?:请问|我想知道|帮我查|查一下)+', ''), '(?:[？?！!。，,、]|是什么|有什么|有哪些|怎么样|如何|的区别|的不同|区别|不同)+$', ''))"
_SUB_QUERIES = rf"""
sq as (select item_id, unnest(range(len(ss))) k, unnest(ss) s from (select item_id, list_filter(list_transform(regexp_split_to_array(text, '[。！？.!?]\s*'), lambda x: trim(x)), lambda x: x <> '') ss from benchmark)),
sp as (select *, regexp_split_to_array(s, ' (?:and|und|et|de) ') ps from sq),
st as (select *, list_filter([{_CLEAN.format("ps[1]")}, {_CLEAN.format("ps[2]")}], lambda e: length(e) between 2 and 80) g from sp),
sub as (select item_id, k, case when len(ps) >= 2 and len(g) = 2 and g[1] <> g[2] then [g[1] || ' what is it', g[1] || ' main features', g[2] || ' what is it', g[2] || ' main features', g[1] || ' and ' || g[2] || ' main differences']
  when contains(s, 'tion') and length(s) > 30 then [s, substr(s, 1, 10) || ' background'] else [s] end subs from st)"""


@query("h21_sub_queries", f"with {_SUB_QUERIES} select item_id, k, unnest(subs) sub_query from sub")
def sub_queries(spark, sf_dir):
    """Every sentence of a query text taken apart: comparisons by the caller's connectors, long questions for reasons, others as they are."""
    parts = view(spark, sf_dir, "benchmark").select("item_id", F.posexplode(text.sentences(F.col("text"))).alias("k", "s"))
    return parts.select("item_id", "k", F.explode(answers.sub_queries(F.col("s"), **_ASK)).alias("sub_query"))


_EXPANDED = "replace(lower(text), 'the', 'der')"


@query("h22_expansions", f"select item_id, unnest(list_distinct([lower(text), {_EXPANDED}, replace(lower(text), 'the', 'los')])) variant from benchmark")
def expansions(spark, sf_dir):
    q = F.lower("text")
    return view(spark, sf_dir, "benchmark").select("item_id", F.explode(answers.expansions(q, {"the": ["der", "los"]})).alias("variant"))


@query("h23_mapped_terms", "select item_id, case when contains(text, 'the') and not contains(text, 'DET') then replace(text, 'the', 'the（DET）') else text end mapped from benchmark")
def mapped(spark, sf_dir):
    return view(spark, sf_dir, "benchmark").select("item_id", answers.mapped(F.col("text"), {"the": "DET"}).alias("mapped"))


@query("h24_image_summaries", "select chunk_id, concat('图', replace(regexp_extract(caption, '图\\s*(\\d+[\\.\\-]\\d+)', 1), '-', '.'), ' ', caption, ' 主题 p', page) summary from images")
def image_summaries(spark, sf_dir):
    n = text.figure_number(F.col("caption"), F.lit(""))
    return view(spark, sf_dir, "images").select("chunk_id", answers.image_summary(F.lit("image"), n, F.col("caption"), F.concat(F.lit("a > p"), "page")).alias("summary"))


@query("h28_safe_names", r"select doc_id, coalesce(nullif(substr(trim(regexp_replace(regexp_replace(text, '[\\/:*?\"<>|\x00-\x1f]', '_', 'g'), '^\.+', '')), 1, 100), ''), 'unnamed') safe from documents")
def safe_names(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id", text.safe_name(F.col("text")).alias("safe"))


@query("h30_json_items", "select event_id, [event_id, event_id + 1] ids from events")
def json_items(spark, sf_dir):
    noisy = F.concat(F.lit("Here it is:\n```json\n[{\"id\": "), "event_id", F.lit("}, {\"id\": "), F.col("event_id") + 1, F.lit("}]\n``` end"))
    items = answers.json_array(noisy, "array<struct<id:bigint>>")
    return view(spark, sf_dir, "events").select("event_id", F.transform(items, lambda x: x["id"]).alias("ids"))


@query("h33_blank_grades", "select id, round((case when correct_answer = '1' then 1 else 0 end + 1) * score / 2.0, 1) points from questions where question_type = 'fill_blank'")
def blank_grades(spark, sf_dir):
    right = F.array(F.array("correct_answer"), F.array(F.lit("Yes"), F.lit("true")))
    given = F.array(F.lit("1"), F.lit(" YES "))
    return view(spark, sf_dir, "questions").where("question_type = 'fill_blank'").select("id", answers.grade_blanks(given, right, F.col("score")).alias("points"))


@query("h33_choice_grades", "select id, cast(case when correct_answer = '2' then score else 0 end as double) points from questions where question_type = 'single_choice'")
def choice_grades(spark, sf_dir):
    return view(spark, sf_dir, "questions").where("question_type = 'single_choice'").select("id", answers.grade_objective(F.lit(" 2, 2"), F.col("correct_answer"), F.col("score")).alias("points"))


@query("h36_answer_scores", r"""
with p as (select a.item_id, e.text expected, a.text actual from benchmark a join benchmark e on e.item_id = a.item_id + 1),
w as (select *, list_distinct(list_filter(regexp_split_to_array(lower(expected), '\s+'), lambda x: length(x) >= 2)) e, list_distinct(list_filter(regexp_split_to_array(lower(actual), '\s+'), lambda x: length(x) >= 2)) a from p)
select item_id, cast(least(100, floor(len(list_intersect(e, a)) / len(e) * 100 + 1e-9) + case when contains(lower(actual), lower(expected)) then 20 else 0 end) as int) score from w""")
def answer_scores(spark, sf_dir):
    one = view(spark, sf_dir, "benchmark").select("item_id", "text")
    nxt = view(spark, sf_dir, "benchmark").select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("expected"))
    return one.join(nxt, "item_id").select("item_id", answers.answer_score(F.col("text"), F.col("expected")).alias("score"))


@query("h40_rewrite_needed", "select session_id, seq, seq > 0 or length(content) < 10 needed from messages where role = 'user'")
def rewrite_needed(spark, sf_dir):
    return view(spark, sf_dir, "messages").where("role = 'user'").select("session_id", "seq", ((F.col("seq") > 0) | (F.length("content") < 10)).alias("needed"))


@query("h45_knowledge_points", r"select chunk_id, trim(regexp_replace(content, '[#*\s]+', ' ', 'g')) point from chunks where length(trim(regexp_replace(content, '[#*\s]+', ' ', 'g'))) between 5 and 30")
def knowledge_points(spark, sf_dir):
    return view(spark, sf_dir, "chunks").select("chunk_id", answers.knowledge_point(F.col("content")).alias("point")).where("point is not null")


_MARKUP = "case when page % 2 = 0 then concat('![', caption, '](media/', image_id, ')') else concat('<img alt=\"x\" src=\"/files/p', page, '/', image_id, '?v=1\">') end"
_FOUND = r"list_transform(list_concat(regexp_extract_all(s, '!\[[^\]]*\]\(([^)\s]+)\)', 1), regexp_extract_all(s, '(?i)<img[^>]*src=[\"'']([^\"'']+)[\"'']', 1)), lambda x: regexp_replace(split_part(x, '?', 1), '^.*/', ''))"


@query("h46_image_references", f"""
with d as (select source, string_agg({_MARKUP}, chr(10) order by chunk_id) s from images group by source), l as (select source, {_FOUND} l from d)
select source, list_filter(l, lambda x, i: list_position(l, x) = i) image_ids from l""")
def image_references(spark, sf_dir):
    """Images that a document's Markdown and HTML name, each once: those of Markdown first, in order, without folders and parameters."""
    html = F.concat(F.lit('<img alt="x" src="/files/p'), "page", F.lit("/"), "image_id", F.lit('?v=1">'))
    mark = F.when(F.col("page") % 2 == 0, F.concat(F.lit("!["), "caption", F.lit("](media/"), "image_id", F.lit(")"))).otherwise(html)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", mark.alias("m")))), lambda r: r["m"])
    docs = view(spark, sf_dir, "images").groupBy("source").agg(F.array_join(lines, "\n").alias("s"))
    return docs.select("source", text.images_in_markup(F.col("s")).alias("image_ids"))


@query("h47_html_tables", "select sheet, (row_no - 1) // 200 slice, string_agg(concat('| ', array_to_string(cells, ' | '), ' |', case when (row_no - 1) % 200 = 0 then concat(chr(10), '| --- | --- | --- |') else '' end), chr(10) order by row_no) markdown from table_rows group by sheet, slice")
def html_tables(spark, sf_dir):
    """Every 200 rows of a sheet as an HTML table, and back to pipe rows."""
    row = F.concat(F.lit("<tr>"), F.array_join(F.transform("cells", lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))), ""), F.lit("</tr>"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("row_no", row.alias("h")))), lambda r: r["h"])
    t = view(spark, sf_dir, "table_rows").groupBy("sheet", F.expr("(row_no - 1) div 200").alias("slice")).agg(F.array_join(parts, "").alias("html"))
    return t.select("sheet", "slice", text.html_markdown(F.col("html")).alias("markdown"))


@query("h50_default_rows", "select v.vec_id query_id, coalesce(n, 0) n, case when n is null then 'no results' else 'found' end summary from (select vec_id from vectors where vec_id % 100 = 0) v left join (select query_id, count(*) n from hits where score >= 0.35 group by query_id) h on h.query_id = v.vec_id")
def default_rows(spark, sf_dir):
    q = view(spark, sf_dir, "vectors").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"))
    h = view(spark, sf_dir, "hits").where("score >= 0.35").groupBy("query_id").agg(n_rows().alias("n"))
    return q.join(h, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "no results").otherwise("found").alias("summary"))


@query("m6_version_aware_search", f"""
select query_id, vec_id, score, concat('Document ', source, ' is deprecated') hint from (select *, row_number() over (partition by query_id, source order by score desc, vec_id) r from hits where vec_id % 5 = 0 and score >= 0.25) where r = 1""")
def version_aware(spark, sf_dir):
    """Hints for similar deprecated documents, one for each document."""
    old = view(spark, sf_dir, "hits").where("vec_id % 5 = 0 and score >= 0.25")
    one = search.topk(old, ["query_id", "source"], [F.desc("score"), F.col("vec_id")], 1, "r")
    return one.select("query_id", "vec_id", "score", F.concat(F.lit("Document "), "source", F.lit(" is deprecated")).alias("hint"))


_VARIANTS = r"""
vq as (select item_id, unnest(list_distinct([lower(text), replace(lower(text), 'the', 'der'), replace(lower(text), 'the', 'los')])) variant, lower(text) own from benchmark),
qt as (select distinct concat(item_id, '|', md5(variant)) query_id, unnest(regexp_extract_all(lower(variant), '[\p{L}\p{N}]+')) term from vq)"""
_OF = "cast(split_part(query_id, '|', 1) as bigint)"


def _variants(spark, sf_dir):
    """``item_id, variant, query_id`` of every wording of a query; the query itself is one."""
    q = F.lower("text")
    v = view(spark, sf_dir, "benchmark").select("item_id", q.alias("own"), F.explode(answers.expansions(q, {"the": ["der", "los"]})).alias("variant"))
    return v.withColumn("query_id", F.concat("item_id", F.lit("|"), F.md5("variant")))


@query("m7_expansion_search", f"with {bm25_sql(_VARIANTS)}, m as (select {_OF} query_id, chunk_id, max(score) score from b group by 1, 2) select query_id, chunk_id, score, cast(rank as int) rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) rank from m) where rank <= 10")
def expansion_search(spark, sf_dir):
    """Every wording is searched; the best score of a chunk counts; ten best."""
    found = search.expanded(_variants(spark, sf_dir).select("query_id", "item_id", F.col("variant").alias("text")), lambda q: best_chunks(spark, sf_dir, 10, q))
    return search.topk(found.withColumnRenamed("item_id", "query_id"), ["query_id"], [F.desc("score"), F.col("chunk_id")], 10)


_PARTS = rf"""{_SUB_QUERIES},
sx as (select item_id, k, unnest(range(len(subs))) j, unnest(subs) q from sub),
qt as (select distinct concat(item_id, '|', k, '|', j) query_id, unnest(regexp_extract_all(lower(q), '[\p{{L}}\p{{N}}]+')) term from sx)"""


@query("m8_sub_query_search", f"with {bm25_sql(_PARTS)} select distinct {_OF} query_id, chunk_id from (select *, row_number() over (partition by query_id order by score desc, chunk_id) r from b) where r <= 3")
def sub_query_search(spark, sf_dir):
    """The sub-queries of a query are searched each; their three best chunks together, once each."""
    parts = view(spark, sf_dir, "benchmark").select("item_id", F.posexplode(text.sentences(F.col("text"))).alias("k", "s"))
    subs = parts.select("item_id", "k", F.posexplode(answers.sub_queries(F.col("s"), **_ASK)).alias("j", "text"))
    top = best_chunks(spark, sf_dir, 3, subs.select(F.concat("item_id", F.lit("|"), "k", F.lit("|"), "j").alias("query_id"), "text"))
    return top.select(F.substring_index("query_id", "|", 1).cast("long").alias("query_id"), "chunk_id").distinct()


@query("m10_remediation", f"""
with {bm25_sql(_VARIANTS)}, s as (select {_OF} item_id, query_id, max(score) top from b group by 1, 2),
k as (select distinct item_id, concat(item_id, '|', md5(variant)) query_id, variant = own original from vq),
a as (select s.item_id, s.top from s join k using (query_id) where original), z as (select s.item_id, max(s.top) again from s join k using (query_id) where not original group by s.item_id),
w as (select * from a where top < (select round(avg(top), 6) from a))
select w.item_id query_id, greatest(top, coalesce(again, 0)) top, coalesce(again > top, false) replaced from w left join z using (item_id)""")
def remediation(spark, sf_dir):
    """Queries whose best chunk is weak (below the mean) are searched again in other wordings; the second result counts only if better."""
    v = _variants(spark, sf_dir).withColumn("original", F.col("variant") == F.col("own"))
    first = best_chunks(spark, sf_dir, 1, v.where("original").select(F.col("item_id").alias("query_id"), F.col("variant").alias("text")))
    a = stored(first.groupBy("query_id").agg(F.max("score").alias("top")), "tops")
    weak = a.where(F.col("top") < a.agg(F.round(F.avg("top"), 6)).first()[0])
    retry = v.where("not original").join(weak, v["item_id"] == weak["query_id"], "left_semi")
    again = search.expanded(retry.select("query_id", "item_id", F.col("variant").alias("text")), lambda q: best_chunks(spark, sf_dir, 1, q))
    z = again.groupBy(F.col("item_id").alias("query_id")).agg(F.max("score").alias("again"))
    better = F.coalesce(F.col("again") > F.col("top"), F.lit(False))
    return weak.join(z, "query_id", "left").select("query_id", F.when(better, F.col("again")).otherwise(F.col("top")).alias("top"), better.alias("replaced"))


@query("m15_graph_from_json", "select head, relation, tail from edges where relation in ('BELONGS_TO')")
def graph_from_json(spark, sf_dir):
    """Triples out of JSON text: parse, unnest, keep known relations, drop repeats."""
    e = view(spark, sf_dir, "edges")
    doc = e.select(F.to_json(F.struct(F.array(F.struct("head", "relation", "tail")).alias("relations"))).alias("j"))
    rows = doc.select(F.inline(F.from_json("j", "relations array<struct<head:string,relation:string,tail:string>>")["relations"]))
    return rows.where(F.col("relation").isin("BELONGS_TO")).dropDuplicates(["head", "relation", "tail"])


@query("m20_answer_evaluation")
def answer_evaluation(spark, sf_dir):
    """ROUGE-L F1 on characters of each user text against the answer that follows it."""

    @F.pandas_udf("double")
    def rouge(made: pd.Series, ref: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(made.fillna(""), ref.fillna(""), strict=True):
            n = answers.lcs(a, b)
            out.append(2 * n / (len(a) + len(b)) if a and b else 0.0)
        return pd.Series(out, dtype=float)

    w = Window.partitionBy("session_id").orderBy("seq")
    m = view(spark, sf_dir, "messages").withColumn("ref", F.lead("content").over(w)).where("role = 'user' and ref is not null")
    return m.select("session_id", "seq", F.round(rouge("content", "ref"), 6).alias("rouge_l"))


@query("m19_offline_evaluation", "select query_type, count(*) n, round(avg(rel), 6) hit_rate from (select q.query_id, any_value(q.query_type) query_type, max(case when h.vec_id is null then 0.0 else 1 end) rel from qrels q left join (select query_id, vec_id from hits where rank <= 5) h on h.query_id = q.query_id and h.vec_id = q.relevant_id group by q.query_id) group by query_type")
def offline_evaluation(spark, sf_dir):
    queries, labels, n = judged(spark, sf_dir)
    h = relevant(view(spark, sf_dir, "hits").where("rank <= 5").select("query_id", "vec_id"), queries, labels).groupBy("query_id").agg(F.max("rel").alias("rel"))
    q = n.join(h, "query_id", "left").fillna(0, ["rel"])
    return q.groupBy("query_type").agg(n_rows().alias("n"), F.round(F.avg("rel"), 6).alias("hit_rate"))


@query("i5_approvals", "select s.query, case when d.ok then 'approved' else 'rejected' end status from (select query, count(*) n from feedback where rating = 1 group by query) s join (select distinct query, right(query, 1) in ('0', '2', '4', '6', '8') ok from feedback) d using (query) where n >= 100")
def approvals(spark, sf_dir):
    """Decisions meet the suggestions they are about."""
    f = view(spark, sf_dir, "feedback")
    s = f.where("rating = 1").groupBy("query").agg(n_rows().alias("n")).where("n >= 100")
    d = f.select("query", F.substring("query", -1, 1).isin("0", "2", "4", "6", "8").alias("ok")).distinct()
    return s.join(d, "query").select("query", F.when(F.col("ok"), "approved").otherwise("rejected").alias("status"))


@query("i7_distinct_within_ttl")
def distinct_within_ttl(spark, sf_dir):
    """Batch twin: a key's first event counts, later ones within the hour of it are hits; times count in whole seconds."""
    events = view(spark, sf_dir, "events").select("event_id", "user_id", F.unix_seconds("ts").alias("t"))
    return maintain.spaced(events, 3601).select("event_id", (~F.col("first")).alias("hit"))
