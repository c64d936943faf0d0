"""Scans and sinks: folders of files, nested JSON, partition replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_folder(spark: SparkSession, path: str, pattern: str = "*", content: bool = True) -> DataFrame:
    """``path, name, size, modified`` (and ``md5``) of all files below a folder; without content only the listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    cols = [F.col("path"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    return files.select(*cols, F.md5("content").alias("md5")) if content else files.select(*cols)


def scan_texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """``path, text``: UTF-8, else GBK, else empty."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)

    @F.pandas_udf("string")
    def decode(parts):
        import pandas as pd

        def one(data: bytes) -> str:
            for code in ("utf-8", "gbk"):
                try:
                    return data.decode(code)
                except UnicodeDecodeError:
                    pass
            return ""

        return pd.Series([one(p) for p in parts])

    return files.select("path", F.when(F.expr("is_valid_utf8(cast(content as string))"), F.col("content").cast("string")).otherwise(decode("content")).alias("text"))


def scan_evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``{queries: [{id, query, query_type, difficulty, relevant_docs, relevant_chunks}]}`` files."""
    schema = "queries array<struct<id:string,query:string,query_type:string,difficulty:string,relevant_docs:array<string>,relevant_chunks:array<string>,reference_answer:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("queries"))


_QUESTION = "question_id:string,question_type:string,content:string,answer:string,score:double"


def scan_exams(spark: SparkSession, paths: list[str], status: str | None = None) -> DataFrame:
    """Exam files of some folders: ``exam_id, name, topic, status, total_count, total_score, created_at, filename, questions``.

    Missing fields take the file's name as id, the topic as name, ``approved`` as status and 0 as counts; files that are no JSON are left out.
    """
    schema = f"exam_id string, name string, topic string, status string, total_count int, total_score double, created_at string, questions array<struct<{_QUESTION}>>, _corrupt_record string"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(paths)
    rows = rows.withColumn("filename", F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1)).where("_corrupt_record is null")
    found = rows.select(
        F.coalesce("exam_id", F.regexp_replace("filename", r"\.json$", "")).alias("exam_id"), F.coalesce(F.nullif("name", F.lit("")), "topic").alias("name"), F.coalesce("topic", F.lit("")).alias("topic"),
        F.coalesce("status", F.lit("approved")).alias("status"), F.coalesce("total_count", F.lit(0)).alias("total_count"), F.coalesce("total_score", F.lit(0.0)).alias("total_score"),
        F.coalesce("created_at", F.lit("")).alias("created_at"), "filename", "questions",
    )
    return found.where(F.col("status") == status) if status else found


def scan_exam_questions(exams: DataFrame) -> DataFrame:
    """One row for each question of scanned exams, in order."""
    return exams.select("exam_id", F.posexplode("questions").alias("question_order", "q")).select("exam_id", "question_order", "q.*")


def scan_content_lists(spark: SparkSession, path: str) -> DataFrame:
    """Layout items of parsers' content lists (a JSON array a file): ``source, pos, type, text, text_level, page_idx, table_body, img_path, caption``.

    ``pos`` is the place in the file; captions of tables and images are put together; null levels are 0.
    """
    item = "struct<type:string,text:string,text_level:int,page_idx:int,table_body:string,table_caption:array<string>,image_caption:array<string>,img_path:string>"
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path)
    rows = files.select(F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1).alias("source"), F.posexplode(F.from_json("value", f"array<{item}>")).alias("pos", "i"))
    caption = F.array_join(F.concat(*(F.coalesce(F.col(f"i.{c}"), F.array().cast("array<string>")) for c in ("table_caption", "image_caption"))), " ")
    return rows.select("source", "pos", "i.type", "i.text", F.coalesce("i.text_level", F.lit(0)).alias("text_level"), "i.page_idx", "i.table_body", "i.img_path", caption.alias("caption"))


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite only the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
