"""Knowledge-base views over the given tables, in Spark SQL and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The reference time of every age rule.
NOW = "2024-02-01 00:00:00"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_CHUNKS = """
select concat(doc_id, '_text_', pos) chunk_id, doc_id document_id,
  concat('d', doc_id, case doc_id % 5 when 0 then '.pdf' when 1 then '.docx' when 2 then '.xlsx' when 3 then '.txt' else '.pptx' end) source,
  case lang when 'en' then 'public_kb' when 'de' then 'dept_hr' when 'fr' then 'dept_finance' else 'dept_tech' end collection,
  case when pos % 10 = 7 then 'image' when pos % 10 = 8 then 'table' else 'text' end chunk_type,
  pos chunk_index, pos {div} 4 + 1 page, pos {div} 4 + 1 + (case when pos % 4 = 3 then 1 else 0 end) page_end, concat('S', pos {div} 8) section,
  case doc_id % 4 when 0 then 'public' when 1 then 'internal' when 2 then 'confidential' else 'secret' end security_level,
  case doc_id % 10 when 0 then 'deprecated' when 1 then 'superseded' when 2 then null else 'active' end status,
  concat('v', 1 + doc_id % 3) version, line content, {created} created_at
from {doc_lines}"""
_ENTITIES = """
select concat('R:', r_name) name, 'region' type, 'public/region' source from {region}
union all select concat('N:', n_name), 'nation', 'internal/nation' from {nation}
union all select s_name, 'supplier', 'public/supplier' from {supplier}
union all select c_name, 'customer', null from {customer}"""
_EDGES = """
select concat('N:', n_name) head, 'BELONGS_TO' relation, concat('R:', r_name) tail from {nation} join {region} on n_regionkey = r_regionkey
union all select s_name, 'BELONGS_TO', concat('N:', n_name) from {supplier} join {nation} on s_nationkey = n_nationkey
union all select c_name, 'BELONGS_TO', concat('N:', n_name) from {customer} join {nation} on c_nationkey = n_nationkey
union all select distinct s_name, 'MANAGES', p_name from {lineitem} join {supplier} on l_suppkey = s_suppkey join {part} on l_partkey = p_partkey where l_linenumber = 1"""
_QUESTIONS = """
select p_partkey id, case p_partkey % 4 when 0 then 'single_choice' when 1 then 'true_false' when 2 then 'fill_blank' else 'subjective' end question_type,
  p_name content, substr(p_brand, -1, 1) correct_answer, p_size % 5 + 1 difficulty, 2 + p_size % 4 score, p_type source_file from {part}"""
_QRELS = """
select q.vec_id query_id, e.vec_id relevant_id, concat('type', q.label % 3) query_type, case when q.vec_id % 2 = 0 then 'easy' else 'hard' end difficulty
from {embeddings} q join {embeddings} e on e.label = q.label and e.vec_id <> q.vec_id where q.vec_id % 100 = 0"""
_CALLS = """
select concat(user_id, '-', {day}) query_id,
  case event_type when 'click' then 'rewrite' when 'view' then 'generate' when 'purchase' then 'reflect' when 'signup' then 'decompose' else 'classify' end call_type,
  cast(round(value * 10) as bigint) tokens, event_type <> 'error' success, ts, event_id from {events}"""
_FEEDBACK = """
select event_id id, concat('s', user_id, '_', {day}) session_id, concat('q', (event_id * 7) % 40) query, concat('answer ', event_id) answer,
  concat('["src', cast({k} as int) % 20, '"]') sources, case when event_type = 'error' then -1 else 1 end rating, user_id, ts created_at
from {events} where event_type in ('purchase', 'signup', 'click', 'error')"""
_VERSIONS = """
select d.doc_id document_id, case lang when 'en' then 'public_kb' else concat('dept_', lang) end collection, concat('v', v) version,
  case when v = 1 + doc_id % 3 then (case when doc_id % 10 = 0 then 'deprecated' else 'active' end) else 'superseded' end status, {created} created_at
from {source} where v <= 1 + doc_id % 3"""
_IMAGES = """
select chunk_id, source, page, concat('img_', document_id, '_', chunk_index % 6, '.png') image_id, 50 + (document_id * 37 + chunk_index * 91) % 2200 width,
  50 + (document_id * 53 + chunk_index * 29) % 2200 height, md5(cast(chunk_index % 13 as {text})) hash, concat('图', 1 + chunk_index {div} 8, '.', chunk_index % 10) caption
from {chunks} where chunk_type = 'image'"""
_ITERATIONS = """
select concat('s', user_id) session_id, row_number() over (partition by user_id order by ts, event_id) iteration,
  least(1.0{d}, value / 100.0{d}) confidence, event_id % 7 results_count from {events}"""
_MESSAGES = """
select concat('s', conv_id) session_id, turn seq, role, text content, {created} created_at from {conversations}"""
_TABLE_ROWS = """
select 'supplier' sheet, row_number() over (order by s_suppkey) row_no, {cells_s} cells from {supplier}
union all select 'customer', row_number() over (order by c_custkey), {cells_c} from {customer}"""

_SPARK: dict[str, str] = {
    "doc_lines": r"select doc_id, source, lang, pos, line from {documents} lateral view posexplode(split(text, '\n')) x as pos, line where trim(line) <> ''",
    "chunks": _CHUNKS.replace("{div}", "div").replace("{created}", "timestamp '2023-01-01' + make_dt_interval(cast(doc_id % 400 as int))"),
    "qrels": _QRELS,
    "messages": _MESSAGES.replace("{created}", "timestamp '2024-01-01' + make_dt_interval(cast(conv_id as int), 0, cast(turn as int))"),
    "feedback": _FEEDBACK.replace("{day}", "date_format(ts, 'yyyyMMdd')").replace("{k}", "get_json_object(props, '$.k')"),
    "call_log": _CALLS.replace("{day}", "date_format(ts, 'yyyyMMdd')"),
    "iterations": _ITERATIONS.replace("{d}", "D"),
    "doc_current": "select doc_id document_id, md5(text) content_hash from {documents} where doc_id % 11 <> 0",
    "doc_stored": "select doc_id document_id, case when doc_id % 5 = 0 then md5(concat(text, 'x')) else md5(text) end content_hash from {documents} where doc_id % 7 <> 0",
    "doc_versions": _VERSIONS.replace("{source}", "(select *, explode(sequence(1, 3)) v from {documents}) d").replace("{created}", "timestamp '2023-01-01' + make_dt_interval(cast(30 * v + doc_id % 28 as int))"),
    "entities": _ENTITIES,
    "edges": _EDGES,
    "exam_questions": "select l_orderkey exam_id, l_linenumber question_order, l_partkey question_id from {lineitem}",
    "questions": _QUESTIONS,
    "answers": "select l_orderkey exam_id, l_suppkey student_id, l_partkey question_id, cast(l_linenumber as string) student_answer from {lineitem}",
    "images": _IMAGES.replace("{div}", "div").replace("{text}", "string"),
    "vectors": "select vec_id, cast(embedding as array<double>) embedding, label from {embeddings}",
}

SQL_VIEWS: dict[str, str] = {
    "doc_lines": "select doc_id, source, lang, pos, line from (select doc_id, source, lang, unnest(range(len(l))) pos, unnest(l) line from (select *, string_split(text, chr(10)) l from documents)) where trim(line) <> ''",
    "chunks": _CHUNKS.replace("{div}", "//").replace("{created}", "timestamp '2023-01-01' + to_days(cast(doc_id % 400 as int))"),
    "qrels": _QRELS,
    "messages": _MESSAGES.replace("{created}", "timestamp '2024-01-01' + to_days(cast(conv_id as int)) + to_minutes(cast(turn as int))"),
    "feedback": _FEEDBACK.replace("{day}", "strftime(ts, '%Y%m%d')").replace("{k}", "json_extract(props, '$.k')"),
    "call_log": _CALLS.replace("{day}", "strftime(ts, '%Y%m%d')"),
    "iterations": _ITERATIONS.replace("{d}", ""),
    "doc_current": _SPARK["doc_current"],
    "doc_stored": _SPARK["doc_stored"],
    "doc_versions": _VERSIONS.replace("{source}", "documents d, range(1, 4) r(v)").replace("{created}", "timestamp '2023-01-01' + to_days(cast(30 * v + doc_id % 28 as int))"),
    "entities": _ENTITIES,
    "edges": _EDGES,
    "exam_questions": _SPARK["exam_questions"],
    "questions": _QUESTIONS,
    "answers": "select l_orderkey exam_id, l_suppkey student_id, l_partkey question_id, cast(l_linenumber as varchar) student_answer from lineitem",
    "images": _IMAGES.replace("{div}", "//").replace("{text}", "varchar"),
    "table_rows": _TABLE_ROWS.replace("{cells_s}", "[cast(s_suppkey as varchar), s_name, cast(s_acctbal as varchar)]").replace("{cells_c}", "[cast(c_custkey as varchar), c_name, c_mktsegment]"),
    "vectors": "select vec_id, embedding::double[] embedding, label from embeddings",
    # the twenty nearest vectors of each query vector, as C1 and F1 give them
    "hits": """select query_id, vec_id, label, round(score, 6) score, cast(rk as int) rank, concat('d', vec_id % 40, case vec_id % 4 when 0 then '.pdf' when 1 then '.docx' when 2 then '.xlsx' else '.txt' end) source,
      vec_id % 9 + 1 page, concat('S', vec_id % 5) section, concat('text of ', vec_id, ' ', repeat('word' || (vec_id % 7) || ' ', cast(vec_id % 60 as int))) content
      from (select q.vec_id query_id, e.vec_id, e.label, list_cosine_similarity(q.embedding, e.embedding) score,
        row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding, e.embedding), 6) desc, e.vec_id) rk
        from vectors q join vectors e on e.vec_id <> q.vec_id where q.vec_id % 100 = 0) where rk <= 20""",
}
SQL_VIEWS = {k: v.replace("{", "").replace("}", "") for k, v in SQL_VIEWS.items()}


def spread(df: DataFrame) -> DataFrame:
    """Deal a table of fewer splits than cores out once, so that work on its texts is parallel; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; ``events.ts`` as a timestamp with the session's (UTC) zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "documents":
        df = spread(df)
    if name == "events":
        df = df.withColumn("ts", df["ts"].cast("timestamp"))
    return df


#: Keys that are numbered in one task.
KEY_RANGE = 100_000


def numbered(df: DataFrame, key: str) -> DataFrame:
    """Add ``row_no``, the place of a row in the order of a whole-number key: its place in its range of keys after the counts of those before."""
    ranged = df.withColumn("_range", F.floor(F.col(key) / KEY_RANGE))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = ranged.join(counts, F.col("_range").eqNullSafe(F.col("_of")))
    return placed.withColumn("row_no", (F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(key))).cast("int")).select(*df.columns, "row_no")


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sheet, row_no, cells``: suppliers and customers as rows of two sheets."""
    sheets = []
    for sheet, key, cells in (("supplier", "s_suppkey", ("s_suppkey", "s_name", "s_acctbal")), ("customer", "c_custkey", ("c_custkey", "c_name", "c_mktsegment"))):
        rows = numbered(table(spark, sf_dir, sheet), key)
        sheets.append(rows.select(F.lit(sheet).alias("sheet"), "row_no", F.array(*(F.col(c).cast("string") for c in cells)).alias("cells")))
    return sheets[0].unionByName(sheets[1])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a view over them."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    if name == "hits":
        from ..operators import search

        return search.described_hits(view(spark, sf_dir, "vectors"))
    if name == "table_rows":
        return table_rows(spark, sf_dir)
    text = _SPARK[name]
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in [*TABLES, *_SPARK] if "{" + n + "}" in text})
