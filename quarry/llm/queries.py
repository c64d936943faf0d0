"""The thin queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.fixtures import spread
from . import chat, common, jaccard, mixing, neardup, packing, quality, repair, rules, token_files, tokens, topk, toxicity, trie, warc


def vocabulary() -> str:
    """The vocabulary file that the token contracts name."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.windows(turns))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.filtered(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(tokens.with_digest(tokens.pieces(table(spark, sf_dir, "documents"), vocabulary())))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select("doc_id", (common.label_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.new_path(spark)
    token_files.write(table(spark, sf_dir, "documents"), path, vocabulary())
    return token_files.read(spark, path).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.new_path(spark)
    warc.write(table(spark, sf_dir, "pages"), path)
    captures = common.cut(warc.transactions(warc.read(spark, path, payloads=False)), "captures")
    page = lambda block: F.nullif(F.regexp_extract(block.cast("string"), r"page-id: (-?\d+)", 1), F.lit("")).cast("long")
    # revisits are few enough to carry their original's page id into the rows by a join of narrow rows
    refers = warc.originals(captures).select(F.col("record_id").alias("_revisit"), page(F.col("original.block")).alias("refers_to"))
    rows = captures.where("response.type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(
        captures.where("response.type = 'revisit'").join(refers, F.col("record_id") == F.col("_revisit"), "left").drop("_revisit")
    )
    return rows.select(
        page(F.col("metadata.block")).alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        "refers_to",
    )


def op8_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.scored(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (common.label_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op9_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(trie.rebuilt(trie.numbered(table(spark, sf_dir, "conversations"))))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair.repaired(repair.damaged(turns), turns)


QUERIES = {f.__name__: f for f in (op1_chat_windows, op2_quality_rules, op3_packing, op4_toxicity, op5_token_files, op6_minhash, op7_warc, op8_quality_network, op9_pivot_top_k, op10_mixing, op11_ngram_join, op12_prefix_trie, op13_structure_repair)}

ORACLE_SQL = {
    "op11_ngram_join": jaccard.oracle(),
    "op12_prefix_trie": trie.oracle(),
    "op13_structure_repair": repair.oracle(),
    "op2_quality_rules": rules.oracle(),
    "op6_minhash": neardup.oracle(),
    "op7_warc": """
select page_id, n payload_bytes, h payload_digest, case when page_id = first then 'response' else 'revisit' end record_type,
  case when page_id <> first then first end refers_to
from (select page_id, strlen(coalesce(html, '')) n, min(page_id) over (partition by coalesce(html, '')) first,
  array_to_string(list_transform(range(8), lambda k: array_to_string(list_transform([32768, 1024, 32, 1], lambda m:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (cast('0x' || substr(sha1(coalesce(html, '')), 5 * k + 1, 5) as bigint) // m) % 32 + 1, 1)), '')), '') h from pages)""",
    "op9_pivot_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) v from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
select query_id, rank, vec_id, score from (
  select q.vec_id query_id, x.vec_id, cast(list_dot_product(q.v, x.v) as bigint) score,
    cast(row_number() over (partition by q.vec_id order by list_dot_product(q.v, x.v) desc, x.vec_id) as int) rank
  from (select * from v where vec_id % 100 = 0) q join v x on x.vec_id <> q.vec_id) where rank <= 10""",
}
