"""Chunk, version and document life cycle, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import maintain
from .fixtures import NOW, view
from .registry import query


def now():
    return F.lit(NOW).cast("timestamp")


_STATUS_COUNT = "select collection, coalesce(status, 'none') status, count(*) n from t group by all"


def _by_status(df):
    return df.groupBy("collection", F.coalesce("status", F.lit("none")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def _some(spark, sf_dir, n=3):
    return view(spark, sf_dir, "documents").where(F.col("doc_id") % n == 0).select(F.col("doc_id").alias("document_id"))


@query("a5_chunk_upsert", "select chunk_id, version, length(content) n_chars from chunks where chunk_index % 4 <> 0 union all select chunk_id, 'v9', length(content) + 1 from chunks where chunk_index % 4 = 0")
def upsert(spark, sf_dir):
    c = view(spark, sf_dir, "chunks").select("chunk_id", "version", "chunk_index", "content")
    new = c.where("chunk_index % 4 = 0").withColumn("version", F.lit("v9")).withColumn("content", F.concat("content", F.lit("!")))
    return maintain.upsert(c, new, ["chunk_id"]).select("chunk_id", "version", F.length("content").cast("long").alias("n_chars"))


@query("a7_latest_hash", "select document_id, coalesce(c.content_hash, s.content_hash) content_hash from doc_current c full join doc_stored s using (document_id)")
def latest_hash(spark, sf_dir):
    """INSERT OR REPLACE as the latest row of each key."""
    rows = view(spark, sf_dir, "doc_current").withColumn("at", F.lit(2)).unionByName(view(spark, sf_dir, "doc_stored").withColumn("at", F.lit(1)))
    return maintain.latest(rows, ["document_id"], [F.desc("at")]).select("document_id", "content_hash")


@query("a8_delete_documents", "select collection, count(*) n from chunks where document_id % 3 <> 0 group by collection")
def delete_documents(spark, sf_dir):
    return maintain.delete(view(spark, sf_dir, "chunks"), _some(spark, sf_dir), ["document_id"]).groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


@query("a9_supersede", "with t as (select collection, case when document_id % 3 = 0 and coalesce(status, 'active') = 'active' then 'superseded' else status end status from chunks) " + _STATUS_COUNT)
def supersede(spark, sf_dir):
    return _by_status(maintain.supersede(view(spark, sf_dir, "chunks"), _some(spark, sf_dir), now()))


@query("a10_deprecate", "with t as (select collection, case when document_id % 3 = 0 then 'deprecated' else status end status from chunks) " + _STATUS_COUNT)
def deprecate(spark, sf_dir):
    d = _some(spark, sf_dir).withColumn("reason", F.lit("old")).withColumn("actor", F.lit("admin"))
    return _by_status(maintain.deprecate(view(spark, sf_dir, "chunks"), d, now()))


@query("a11_restore", "with t as (select collection, case when document_id % 3 = 0 and status = 'deprecated' then 'active' else status end status from chunks) " + _STATUS_COUNT)
def restore(spark, sf_dir):
    return _by_status(maintain.restore(view(spark, sf_dir, "chunks"), _some(spark, sf_dir)))


@query("a12_retention", f"""
select collection, count(*) filter (where not gone) kept, count(*) filter (where gone) removed from (select collection,
  coalesce((status = 'superseded' and created_at < timestamp '{NOW}' - interval 7 day) or (status = 'deprecated' and created_at < timestamp '{NOW}' - interval 30 day), false) gone from chunks) group by collection""")
def retention(spark, sf_dir):
    gone = maintain.expired(None, now())
    return view(spark, sf_dir, "chunks").groupBy("collection").agg(F.count_if(~gone).alias("kept"), F.count_if(gone).alias("removed"))


@query("a13_version_log", """
select document_id, collection, version, case when version = 'v1' then 'create' when status = 'deprecated' then 'deprecate' else 'update' end change from doc_versions""")
def version_log(spark, sf_dir):
    change = F.when(F.col("version") == "v1", "create").when(F.col("status") == "deprecated", "deprecate").otherwise("update")
    return view(spark, sf_dir, "doc_versions").select("document_id", "collection", "version", change.alias("change"))


@query("a14_backfill", "select collection, count(*) filter (where status is null) migrated, count(*) filter (where coalesce(status, 'active') = 'active') active from chunks group by collection")
def backfill(spark, sf_dir):
    filled = F.coalesce("status", F.lit("active"))
    return view(spark, sf_dir, "chunks").groupBy("collection").agg(F.count_if(F.col("status").isNull()).alias("migrated"), F.count_if(filled == "active").alias("active"))


@query("a15_path_repair", "select chunk_id, image_id fixed, path <> image_id changed from (select *, case when page % 2 = 0 then 'old/dir/' || image_id else image_id end path from images)")
def path_repair(spark, sf_dir):
    path = F.when(F.col("page") % 2 == 0, F.concat(F.lit("old/dir/"), "image_id")).otherwise(F.col("image_id"))
    i = view(spark, sf_dir, "images").withColumn("path", path)
    return i.select("chunk_id", text.basename(F.col("path")).alias("fixed"), (text.basename(F.col("path")) != F.col("path")).alias("changed"))


@query("a16_figure_prefix", r"select chunk_id, case when number <> '' then '[图' || number || '] ' || caption else caption end description from (select chunk_id, caption, replace(regexp_extract(caption, '图\s*(\d+[\.\-]\d+)', 1), '-', '.') number from images)")
def figure_prefix(spark, sf_dir):
    n = text.figure_number(F.col("caption"), F.lit(""))
    return view(spark, sf_dir, "images").select("chunk_id", F.when(n != "", F.concat(F.lit("[图"), n, F.lit("] "), "caption")).otherwise(F.col("caption")).alias("description"))


@query("a17_faq_variants", "select concat('faq_', id, '_v', v) variant_id, case v when 0 then query else concat(query, ' ', v) end question, answer, v > 0 is_variant from feedback, range(3) r(v) where rating = 1")
def faq_variants(spark, sf_dir):
    f = view(spark, sf_dir, "feedback").where("rating = 1")
    words = F.array(F.col("query"), F.concat("query", F.lit(" 1")), F.concat("query", F.lit(" 2")))
    return f.select("id", "answer", F.posexplode(words).alias("v", "question")).select(F.concat(F.lit("faq_"), "id", F.lit("_v"), "v").alias("variant_id"), "question", "answer", (F.col("v") > 0).alias("is_variant"))


@query("a18_summary_rows", "select chunk_id, false is_summary, chunk_type = 'table' has_summary from chunks union all select concat(chunk_id, '_summary'), true, false from chunks where chunk_type = 'table'")
def summary_rows(spark, sf_dir):
    c = view(spark, sf_dir, "chunks").select("chunk_id", "chunk_type")
    own = c.select("chunk_id", F.lit(False).alias("is_summary"), (F.col("chunk_type") == "table").alias("has_summary"))
    more = c.where("chunk_type = 'table'").select(F.concat("chunk_id", F.lit("_summary")).alias("chunk_id"), F.lit(True).alias("is_summary"), F.lit(False).alias("has_summary"))
    return own.unionByName(more)


@query("a20_stale_derivations", "select document_id from doc_current c where not exists (select 1 from doc_stored s where s.document_id = c.document_id and s.content_hash = c.content_hash)")
def stale(spark, sf_dir):
    return maintain.stale(view(spark, sf_dir, "doc_stored"), view(spark, sf_dir, "doc_current"), "document_id", "content_hash").select("document_id")


@query("a21_route_documents", "select collection, count(*) n from (select case when lang = 'en' then 'public_kb' else 'dept_' || lang end collection from documents) group by collection")
def route(spark, sf_dir):
    """Collection from the first path segment."""
    path = F.concat(F.when(F.col("lang") == "en", "public").otherwise(F.concat(F.lit("dept_"), "lang")), F.lit("/"), F.col("doc_id"), F.lit(".txt"))
    first = F.element_at(F.split(path, "/"), 1)
    return view(spark, sf_dir, "documents").groupBy(F.when(first == "public", "public_kb").otherwise(first).alias("collection")).agg(F.count(F.lit(1)).alias("n"))


@query("a23_missing_collections", "select distinct collection from chunks where collection not in ('public_kb', 'dept_hr')")
def missing_collections(spark, sf_dir):
    known = spark.createDataFrame([("public_kb",), ("dept_hr",)], "collection string")
    return view(spark, sf_dir, "chunks").select("collection").distinct().join(F.broadcast(known), "collection", "left_anti")


@query("a24_merge_update", "select id, content, case when id % 2 = 0 then difficulty + 1 else difficulty end difficulty, score from questions")
def merge_update(spark, sf_dir):
    q = view(spark, sf_dir, "questions").select("id", "content", "difficulty", "score")
    new = q.where("id % 2 = 0").select("id", F.lit(None).cast("string").alias("content"), (F.col("difficulty") + 1).alias("difficulty"), F.lit(0).alias("score"))
    return maintain.merge_update(q, new, ["id"], kept=["score"])


@query("a25_originals", "select chunk_id, image_id, width * height pixels from images where width > 300")
def originals(spark, sf_dir):
    return view(spark, sf_dir, "images").where("width > 300").select("chunk_id", "image_id", (F.col("width") * F.col("height")).alias("pixels"))


@query("a27_cascade_delete", "select relation, count(*) n from edges where head not like 'N:%' and tail not like 'N:%' group by relation")
def cascade(spark, sf_dir):
    """Delete entities together with their edges on either end."""
    gone = view(spark, sf_dir, "entities").where("type = 'nation'").select("name")
    e = view(spark, sf_dir, "edges")
    left = e.join(gone, e["head"] == gone["name"], "left_anti").join(gone, e["tail"] == gone["name"], "left_anti")
    return left.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("c4_snapshot_diff", """
select document_id, case when s.document_id is null then 'added' when c.document_id is null then 'deleted' when s.content_hash is not distinct from c.content_hash then 'same' else 'modified' end change_type
from doc_current c full join doc_stored s using (document_id)""")
def snapshot_diff(spark, sf_dir):
    return maintain.snapshot_diff(view(spark, sf_dir, "doc_current"), view(spark, sf_dir, "doc_stored")).select("document_id", "change_type")


@query("d32_sync_summary", """
with t as (select case when s.document_id is null then 'added' when c.document_id is null then 'deleted' when s.content_hash = c.content_hash then 'same' else 'modified' end k from doc_current c full join doc_stored s using (document_id))
select count(*) filter (where k <> 'same') processed, count(*) filter (where k = 'added') added, count(*) filter (where k = 'modified') modified, count(*) filter (where k = 'deleted') deleted from t""")
def sync_summary(spark, sf_dir):
    d = maintain.snapshot_diff(view(spark, sf_dir, "doc_current"), view(spark, sf_dir, "doc_stored"))
    n = lambda k: F.count_if(F.col("change_type") == k).alias(k)
    return d.agg(F.count_if(F.col("change_type") != "same").alias("processed"), n("added"), n("modified"), n("deleted"))


@query("m18_incremental_sync", """
with t as (select coalesce(c.document_id, s.document_id) document_id, case when s.document_id is null then 'added' when c.document_id is null then 'deleted' when s.content_hash = c.content_hash then 'same' else 'modified' end k, coalesce(c.content_hash, s.content_hash) h from doc_current c full join doc_stored s using (document_id))
select document_id, h content_hash, k <> 'same' rewritten from t where k <> 'deleted'""")
def incremental_sync(spark, sf_dir):
    """The new hash table."""
    return maintain.synced(view(spark, sf_dir, "doc_stored"), view(spark, sf_dir, "doc_current"))


@query("c20_active_version", "select d.doc_id document_id, max(case when status = 'active' then version end) version from documents d left join doc_versions v on v.document_id = d.doc_id group by d.doc_id")
def active_version(spark, sf_dir):
    v = maintain.latest(view(spark, sf_dir, "doc_versions").where("status = 'active'"), ["document_id"], [F.desc("created_at")]).select("document_id", "version")
    return view(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id")).join(v, "document_id", "left")


@query("e10_next_version", "select collection, document_id, concat('v', 1 + document_id % 3) current, concat('v', 2 + document_id % 3) next from (select distinct collection, document_id from doc_versions)")
def next_version(spark, sf_dir):
    return maintain.next_version(view(spark, sf_dir, "doc_versions"))


@query("e10_version_history", "select document_id, version, cast(rank as int) rank from (select *, row_number() over (partition by document_id order by created_at desc, version desc) rank from doc_versions) where rank <= 2")
def version_history(spark, sf_dir):
    w = Window.partitionBy("document_id").orderBy(F.desc("created_at"), F.desc("version"))
    return view(spark, sf_dir, "doc_versions").withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("document_id", "version", "rank")


@query("b1_metadata_filter", "select chunk_id from chunks where collection = 'public_kb' and chunk_type in ('table', 'image') and page >= 2")
def metadata_filter(spark, sf_dir):
    return view(spark, sf_dir, "chunks").where((F.col("collection") == "public_kb") & F.col("chunk_type").isin("table", "image") & (F.col("page") >= 2)).select("chunk_id")


@query("b2_security_filter", "select security_level, count(*) n from chunks where coalesce(security_level, 'public') in ('public', 'internal') group by all")
def security_filter(spark, sf_dir):
    return view(spark, sf_dir, "chunks").where(F.coalesce("security_level", F.lit("public")).isin("public", "internal")).groupBy("security_level").agg(F.count(F.lit(1)).alias("n"))


@query("b3_source_filter", "select chunk_id from chunks where source in ('d10.pdf', 'd21.docx')")
def source_filter(spark, sf_dir):
    return view(spark, sf_dir, "chunks").where(F.col("source").isin("d10.pdf", "d21.docx")).select("chunk_id")


@query("b4_status_filter", "select collection, count(*) n from chunks where coalesce(status, 'active') = 'active' group by all")
def status_filter(spark, sf_dir):
    return view(spark, sf_dir, "chunks").where(F.coalesce("status", F.lit("active")) == "active").groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


@query("b19_min_length", "select chunk_id, source, page from chunks where length(trim(content)) >= 50 and chunk_type = 'table'")
def min_length(spark, sf_dir):
    return view(spark, sf_dir, "chunks").where((F.length(F.trim("content")) >= 50) & (F.col("chunk_type") == "table")).select("chunk_id", "source", "page")


@query("b20_topic_chapters", "select document_id, chunk_id, cast(rank as int) rank from (select *, row_number() over (partition by document_id order by chunk_index) rank from chunks where content like '%the%' or content like '%und%') where rank <= 2")
def topic_chapters(spark, sf_dir):
    words = F.split(F.lit("the und"), " ")
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    return view(spark, sf_dir, "chunks").where(F.exists(words, lambda x: F.contains(F.col("content"), x))).withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("document_id", "chunk_id", "rank")


@query("c5_blacklist", """
with bad as (select source from (select trim(both '"' from unnest(json_extract(sources, '$[*]'))::varchar) source, rating from feedback) where rating = -1 group by source having count(*) >= 90)
select collection, count(*) n from (select collection, concat('src', document_id % 20) source from chunks) where source not in (select source from bad) group by collection""")
def blacklist(spark, sf_dir):
    f = view(spark, sf_dir, "feedback").where("rating = -1").select(F.explode(F.from_json("sources", "array<string>")).alias("source"))
    bad = f.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n >= 90").select("source")
    c = view(spark, sf_dir, "chunks").select("collection", F.concat(F.lit("src"), F.col("document_id") % 20).alias("source"))
    return c.join(bad, "source", "left_anti").groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


@query("c21_collection_probe", "select source, case min(case collection when 'dept_hr' then 1 when 'dept_finance' then 2 when 'public_kb' then 3 when 'dept_tech' then 4 end) when 1 then 'dept_hr' when 2 then 'dept_finance' when 3 then 'public_kb' else 'dept_tech' end collection from chunks group by source")
def probe(spark, sf_dir):
    """The first collection of an ordered list that has a file."""
    order = spark.createDataFrame([("dept_hr", 1), ("dept_finance", 2), ("public_kb", 3), ("dept_tech", 4)], "collection string, priority int")
    return view(spark, sf_dir, "chunks").join(F.broadcast(order), "collection").groupBy("source").agg(F.min_by("collection", "priority").alias("collection"))


@query("d1_chunks_per_source", "select source, count(*) n from chunks group by source")
def per_source(spark, sf_dir):
    return view(spark, sf_dir, "chunks").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("d2_document_status", """
select document_id, count(*) n_chunks, count(*) filter (where coalesce(status, 'active') = 'active') active, count(*) filter (where status = 'superseded') superseded, count(*) filter (where status = 'deprecated') deprecated,
  case when count(*) filter (where status = 'deprecated') > count(*) filter (where coalesce(status, 'active') = 'active') then 'deprecated' when count(*) filter (where status = 'superseded') > 0 then 'superseded' else 'active' end status
from chunks group by document_id""")
def document_status(spark, sf_dir):
    s = F.coalesce("status", F.lit("active"))
    n = lambda k: F.count_if(s == k)
    main = F.when(n("deprecated") > n("active"), "deprecated").when(n("superseded") > 0, "superseded").otherwise("active")
    return view(spark, sf_dir, "chunks").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"), n("active").alias("active"), n("superseded").alias("superseded"), n("deprecated").alias("deprecated"), main.alias("status"))


@query("d3_collections", "select c.collection, count(ch.chunk_id) n from (values ('public_kb'), ('dept_hr'), ('empty_kb')) c(collection) left join chunks ch on ch.collection = c.collection group by c.collection")
def collections(spark, sf_dir):
    dim = spark.createDataFrame([("public_kb",), ("dept_hr",), ("empty_kb",)], "collection string")
    counts = view(spark, sf_dir, "chunks").groupBy("collection").agg(F.count(F.lit(1)).alias("n"))
    return dim.join(counts, "collection", "left").fillna(0, ["n"])


@query("d20_chunk_profile", "select collection, count(*) n, max(length(content)) longest, min(length(content)) shortest, round(avg(length(content)), 4) mean, count(*) filter (where length(content) < 20) below_20, count(*) filter (where length(content) < 50) below_50, count(*) filter (where length(content) > 1000) above_1000 from chunks group by collection")
def chunk_profile(spark, sf_dir):
    n = F.length("content")
    return view(spark, sf_dir, "chunks").groupBy("collection").agg(
        F.count(F.lit(1)).alias("n"), F.max(n).cast("long").alias("longest"), F.min(n).cast("long").alias("shortest"), F.round(F.avg(n), 4).alias("mean"),
        F.count_if(n < 20).alias("below_20"), F.count_if(n < 50).alias("below_50"), F.count_if(n > 1000).alias("above_1000"))


@query("d30_section_groups", "select document_id, coalesce(nullif(trim(section), ''), '未分类') section, count(*) n, list(chunk_id order by chunk_index) chunk_ids from chunks group by all")
def section_groups(spark, sf_dir):
    s = F.coalesce(F.nullif(F.trim(F.replace("section", F.lit("**"), F.lit(""))), F.lit("")), F.lit("未分类"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))), lambda x: x["chunk_id"])
    return view(spark, sf_dir, "chunks").groupBy("document_id", s.alias("section")).agg(F.count(F.lit(1)).alias("n"), ids.alias("chunk_ids"))


@query("d35_catalogue", "select source, count(*) n, list_sort(list(distinct collection)) collections, case when count(distinct page) <= 5 then array_to_string(list_sort(list(distinct page)), ',') else concat(count(distinct page), ' pages') end pages from chunks where security_level in ('public', 'internal') group by source")
def catalogue(spark, sf_dir):
    pages = F.sort_array(F.collect_set("page"))
    shown = F.when(F.size(pages) <= 5, F.array_join(pages.cast("array<string>"), ",")).otherwise(F.concat(F.size(pages), F.lit(" pages")))
    return view(spark, sf_dir, "chunks").where(F.col("security_level").isin("public", "internal")).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("collection")).alias("collections"), shown.alias("pages"))


@query("g2_restricted_levels", "select distinct security_level from chunks where security_level not in ('public', 'internal')")
def restricted_levels(spark, sf_dir):
    allowed = spark.createDataFrame([("public",), ("internal",)], "security_level string")
    return view(spark, sf_dir, "chunks").select("security_level").subtract(allowed)


@query("h13_doc_type", "select distinct source, case when source like '%.pdf' then 'pdf' when source like '%.docx' then 'word' when source like '%.xlsx' then 'excel' when source like '%.pptx' then 'ppt' else 'other' end doc_type from chunks")
def doc_types(spark, sf_dir):
    return view(spark, sf_dir, "chunks").select("source", text.doc_type(F.col("source")).alias("doc_type")).distinct()


@query("h15_preview", "select chunk_id, case when length(content) > 80 then substr(content, 1, 80) || '...' else content end preview from chunks")
def previews(spark, sf_dir):
    return view(spark, sf_dir, "chunks").select("chunk_id", text.preview(F.col("content"), 80).alias("preview"))


@query("h16_semantic_text", "select chunk_id, concat(source, chr(10), '主题：', section, chr(10), trim(content)) semantic from chunks where chunk_type = 'text'")
def semantic(spark, sf_dir):
    return view(spark, sf_dir, "chunks").where("chunk_type = 'text'").select("chunk_id", text.semantic_text(F.col("source"), F.col("section"), F.col("content")).alias("semantic"))


@query("h26_keys", "select chunk_id, md5(concat(collection, '|', version, '|', content)) key from chunks")
def keys(spark, sf_dir):
    return view(spark, sf_dir, "chunks").select("chunk_id", text.cache_key(F.col("collection"), F.col("version"), F.col("content")).alias("key"))


@query("h42_deprecation_hint", "select distinct source, concat('Document ', source, ' (', version, ') is ', status) hint from chunks where status in ('deprecated', 'superseded')")
def hints(spark, sf_dir):
    c = view(spark, sf_dir, "chunks").where("status in ('deprecated', 'superseded')")
    return c.select("source", F.concat(F.lit("Document "), "source", F.lit(" ("), F.coalesce("version", F.lit("?")), F.lit(") is "), "status").alias("hint")).distinct()
