"""Ingest and composite searches, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hooks, scores, text
from ..operators import bm25, graph, maintain, search
from ..sources import files
from ..sources.tables import stored
from .fixtures import view
from .registry import n_rows, query
from .retrieval import _BM25, asked, best_chunks, index_of


@query("a22_ingest", r"""
select concat(source, '_', chunk_type, '_', chunk_index) id, case when source like '%.pdf' then 'pdf' when source like '%.docx' then 'word' when source like '%.xlsx' then 'excel' when source like '%.pptx' then 'ppt' else 'other' end doc_type,
  cast(row_number() over (partition by source, section order by case chunk_type when 'text' then 0 when 'table' then 1 else 2 end, chunk_index, chunk_id) as int) section_chunk_id,
  case when length(content) > 200 then substr(content, 1, 200) || '...' else content end preview, length(content) n_chars from chunks""")
def ingest(spark, sf_dir):
    """Parsed items to typed chunk rows: id, document type, number in its section, preview."""
    from pyspark.sql import Window

    kind = F.when(F.col("chunk_type") == "text", 0).when(F.col("chunk_type") == "table", 1).otherwise(2)
    n = F.row_number().over(Window.partitionBy("source", "section").orderBy(kind, "chunk_index", "chunk_id"))
    return view(spark, sf_dir, "chunks").select(
        F.concat_ws("_", "source", "chunk_type", "chunk_index").alias("id"), text.doc_type(F.col("source")).alias("doc_type"), n.alias("section_chunk_id"),
        text.preview(F.col("content"), 200).alias("preview"), F.length("content").cast("long").alias("n_chars"))


@query("a19_manual_edits", "select chunk_id, case when chunk_index % 10 = 1 then 'edited' else 'kept' end state from chunks where chunk_index % 10 <> 2 union all select concat(chunk_id, '_new'), 'created' from chunks where chunk_index % 10 = 3")
def manual_edits(spark, sf_dir):
    """An edits table of created, updated and deleted chunks put over the chunk table."""
    c = view(spark, sf_dir, "chunks").select("chunk_id", "chunk_index")
    edits = c.where("chunk_index % 10 in (1, 2, 3)").withColumn("op", F.element_at(F.array(F.lit("update"), F.lit("delete"), F.lit("create")), (F.col("chunk_index") % 10).cast("int")))
    base = maintain.delete(c, edits.where("op = 'delete'"), ["chunk_id"]).select("chunk_id", F.lit("kept").alias("state"))
    changed = edits.where("op = 'update'").select("chunk_id", F.lit("edited").alias("state"))
    made = edits.where("op = 'create'").select(F.concat("chunk_id", F.lit("_new")).alias("chunk_id"), F.lit("created").alias("state"))
    return maintain.upsert(base, changed.unionByName(made), ["chunk_id"])


@query("a26_event_log", "select event_type, count(*) n, count(*) filter (where event_id % 3 = 0) processed from events group by event_type")
def event_log(spark, sf_dir):
    """Appended log with a later processed mark: the latest row of each key counts."""
    e = view(spark, sf_dir, "events").select("event_id", "event_type")
    log = e.withColumn("processed", F.lit(False)).withColumn("at", F.lit(1))
    marks = e.where("event_id % 3 = 0").withColumn("processed", F.lit(True)).withColumn("at", F.lit(2))
    now = maintain.latest(log.unionByName(marks), ["event_id"], [F.desc("at")])
    return now.groupBy("event_type").agg(n_rows().alias("n"), F.count_if("processed").alias("processed"))


@query("d37_document_view", "select document_id, count(*) n_chunks, count(distinct collection) n_collections, coalesce(max(case when status = 'deprecated' then 'deprecated' end), 'active') status from chunks group by document_id")
def document_view(spark, sf_dir):
    return view(spark, sf_dir, "chunks").groupBy("document_id").agg(n_rows().alias("n_chunks"), F.countDistinct("collection").alias("n_collections"), F.coalesce(F.max(F.when(F.col("status") == "deprecated", "deprecated")), F.lit("active")).alias("status"))


@query("m2_multi_collection_search", f"""
with {_BM25}, s as (select query_id, collection, chunk_id, score, row_number() over (partition by query_id, collection order by score desc, chunk_id) r from b where collection in ('public_kb', 'dept_hr')),
f as (select query_id, chunk_id, round(sum(0.5 / (60 + r)), 9) score from s where r <= 10 group by query_id, chunk_id)
select query_id, chunk_id, score, cast(rank as int) rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) rank from f) where rank <= 5""")
def multi_collection(spark, sf_dir):
    """Search in the allowed collections only, ranks per collection, fused over them."""
    order = [F.desc("score"), F.col("chunk_id")]
    top = best_chunks(spark, sf_dir, 10, per_collection=True, where=F.col("collection").isin("public_kb", "dept_hr"))
    fused = search.fuse(top.select("query_id", "chunk_id", "rank", F.lit(0.5).alias("weight"))).withColumn("score", F.round("score", 9))
    return search.topk(fused, ["query_id"], order, 5)


@query("m3_image_channel", f"with {_BM25} select query_id, chunk_id, score, cast(rank as int) rank from (select b.*, row_number() over (partition by query_id order by b.score desc, b.chunk_id) rank from b join chunks c using (chunk_id) where c.chunk_type = 'image') where rank <= 5")
def image_channel(spark, sf_dir):
    return bm25.top(asked(spark, sf_dir), index_of(spark, sf_dir), {"image": (5, ["image"])}).select("query_id", "chunk_id", "score", "rank")


@query("m13_multi_hop", f"""
with {_BM25}, top as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) r from b) where r <= 3),
m as (select distinct query_id, concat('Supplier#', lpad(cast(1 + document_id % 10 as varchar), 9, '0')) start from top join chunks using (chunk_id)),
g as (select head as "name", tail other, concat_ws(chr(9), head, relation, tail) edge from edges union all select tail, head, concat_ws(chr(9), head, relation, tail) from edges),
h1 as (select distinct m.start, g.other, g.edge from (select distinct start from m) m join g on g.name = m.start), h2 as (select distinct h1.start, g.edge from h1 join g on g.name = h1.other)
select query_id, count(distinct edge) n from m join (select start, edge from h1 union all select start, edge from h2) using (start) group by query_id""")
def multi_hop(spark, sf_dir):
    """Two hops from the entities of a query's three best chunks (each document names a supplier)."""
    top = best_chunks(spark, sf_dir, 3)
    named = view(spark, sf_dir, "chunks").select("chunk_id", F.concat(F.lit("Supplier#"), F.lpad((1 + F.col("document_id") % 10).cast("string"), 9, "0")).alias("start"))
    m = stored(top.join(named, "chunk_id").select("query_id", "start").distinct(), "named")
    walked = graph.subgraph(m.select(F.col("start").alias("name")).distinct(), view(spark, sf_dir, "edges"), 2)
    counted = graph.distinct_items(m.select(F.col("query_id").alias("owner"), F.col("start").alias("key")), walked.select(F.col("start").alias("key"), F.col("edge").alias("item")))
    return counted.withColumnRenamed("owner", "query_id")


@query("m4_single_collection_search", f"""
with {_BM25}, s as (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) r from b where collection = 'public_kb'),
t9 as (select query_id, chunk_id, round(0.5 / (60 + r) + 0.5 * score / 10, 6) score from s where r <= 20)
select query_id, chunk_id, score, cast(rank as int) rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) rank from t9) where rank <= 10""")
def single_collection(spark, sf_dir):
    """One collection: its statistics are its own in the index."""
    order = [F.desc("score"), F.col("chunk_id")]
    top = best_chunks(spark, sf_dir, 20, where=F.col("collection") == "public_kb").withColumnRenamed("rank", "r")
    mixed = top.select("query_id", "chunk_id", F.round(scores.blended(F.col("r"), F.col("score") / 10), 6).alias("score"))
    return search.topk(mixed, ["query_id"], order, 10)


@query("h6_type_weights", "select session_id, seq, case when content like '%the%' then 0.4 when content like '%und%' then 0.7 else 0.5 end::double vector_weight from messages where role = 'user'")
def type_weights(spark, sf_dir):
    kind = F.when(F.contains("content", F.lit("the")), "fact").when(F.contains("content", F.lit("und")), "process").otherwise("other")
    return view(spark, sf_dir, "messages").where("role = 'user'").select("session_id", "seq", scores.type_weights(kind)[0].alias("vector_weight"))


@query("h48_recommendation_scores", "select query_id, vec_id, round(0.7 * score + case when query_id % 2 = vec_id % 2 then 0.15 else 0 end, 8) score from hits")
def recommendation_scores(spark, sf_dir):
    tag = lambda c: F.array(F.col(c) % 2)
    return view(spark, sf_dir, "hits").select("query_id", "vec_id", F.round(scores.recommendation_score(F.col("score"), tag("query_id"), tag("vec_id")), 8).alias("score"))


@query("a1_folder_scan")
def folder_scan(spark, sf_dir):
    """The listing of the table files themselves; their content is not read."""
    return files.scan_folder(spark, sf_dir, "*.parquet", content=False).select("name", "size")


@query("b17_document_listing")
def document_listing(spark, sf_dir):
    return files.scan_folder(spark, sf_dir, "*.parquet", content=False).orderBy(F.desc("modified"), "name").select("name", "size", "modified")


@query("i1_debounced_changes")
def debounced(spark, sf_dir):
    """Batch twin of the debouncing stream: an event counts if none of its user was accepted within two hours before."""
    events = view(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros("ts").alias("t"))
    return maintain.spaced(events, 7_200_000_000).where("first").select("event_id", "user_id")


@query("j1_default_embeddings")
def default_embeddings(spark, sf_dir):
    v = hooks.hashed_vector(F.col("text"), 16)
    return view(spark, sf_dir, "benchmark").select("item_id", scores.normalized(v).alias("embedding"))


@query("j7_chunk_function")
def chunk_function(spark, sf_dir):
    hooks.register(spark)
    return spark.sql("select doc_id, c.* from {docs} d, lateral chunk_text(d.text, 500, 50, 600, 100) c", docs=view(spark, sf_dir, "documents"))


@query("j8_text_triples", """
select head, case when substr(head, 1, 2) = 'N:' then 'nation' else '未知' end head_type, relation, tail, case when substr(tail, 1, 2) = 'N:' then 'nation' else '未知' end tail_type, 'edges' source
from edges where relation = 'BELONGS_TO' and length(head) % 5 <> 0""")
def text_triples(spark, sf_dir):
    """Triples in noisy JSON answers, by a table function in a lateral join; every fifth answer is cut off and gives none."""
    hooks.register_triples(spark)
    e = view(spark, sf_dir, "edges")
    known = lambda c: F.when(F.substring(c, 1, 2) == "N:", F.array(F.struct(F.concat(F.lit(" "), c).alias("name"), F.lit("nation").alias("type")))).otherwise(F.array().cast("array<struct<name:string,type:string>>"))
    body = F.to_json(F.struct(F.concat(known(F.col("head")), known(F.col("tail"))).alias("entities"), F.array(F.struct("head", "relation", "tail")).alias("relations")))
    answer = F.when(F.length("head") % 5 == 0, F.expr("substring(_b, 1, length(_b) - 2)")).when(F.length("head") % 5 == 1, F.concat(F.lit("Here: ```json\n"), F.col("_b"), F.lit("\n``` as asked"))).otherwise(F.concat(F.lit("Sure. "), F.col("_b"), F.lit(" done")))
    texts = e.withColumn("_b", body).select(answer.alias("answer"))
    return spark.sql("select t.* from {texts} x, lateral text_triples(x.answer, array('BELONGS_TO'), 'edges') t", texts=texts)
