"""The corpus pipeline: five stages over ``documents``, each stored before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import common, mixing, neardup, packing, quality, queries, tokens, toxicity


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network predicts to be good.

    Rows pass unchanged, with all their columns.  A null, empty or blank text has a score like any other; repeated
    rows are judged alike; texts of any length are read whole; a score on the threshold is good; no rows give no rows.
    """
    return quality.kept(docs, queries.table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not predict to be toxic.

    Rows pass unchanged, with all their columns.  A null or empty text has a score like any other; repeated rows are
    judged alike; texts of any length are read whole; a score on the threshold is toxic; no rows give no rows.
    """
    model = toxicity.fit(docs.select("doc_id", "text"), queries.table(spark, sf_dir, "labels"))
    return toxicity.kept(docs, model)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similarities of 0.8 or more: the one with the smallest id.

    A row without an id stays, as do null and blank texts, which resemble nothing.  Of rows that repeat an id the one
    with the smallest text stays.  Columns pass unchanged; texts of any length are compared whole; no rows give no rows.
    """
    return neardup.deduplicated(docs, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them (up to three times), with their columns unchanged.

    A null, empty or blank text has no words and is not taken; a null source is a source of its own; of equal rows
    single copies are taken; ties follow a seeded hash; a very long document is one piece; no rows give no rows.
    """
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces ``doc_id, piece, start, length, ids_crc32`` with their ``sequence_id`` and ``offset``.

    A null or empty text is its end mark alone; only documents of more than 4096 tokens are cut; repeated rows are
    packed each; pieces of equal length may swap places; other columns are left behind; no rows give no rows.
    """
    return packing.pack(tokens.with_digest(tokens.pieces(docs, queries.vocabulary())))


STAGES = [
    ("quality_classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("minhash_near_dedup", neardup_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: The stages learn models and tokenize, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; the result of each but the last is written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.cut(docs, name)
    return docs
