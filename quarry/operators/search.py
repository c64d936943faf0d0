"""Retrieval: nearest vectors, BM25, fusion, filters around the two, and diversity."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..sources.tables import stored

#: Query vectors that a task keeps in memory; a larger query set is searched in several passes.
MAX_QUERIES = 10_000
#: Scores that a task holds at once.
SCORES = 4_000_000


def topk(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark cuts groups before the shuffle because the limit stands right above the rank."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, keep: list[str] | None = None, by: str | None = None, at: str | None = None) -> DataFrame:
    """``query_id, vec_id, score, rank`` (and ``keep``): each query's k most similar vectors by cosine (per value of ``by``).

    Queries (``query_id, embedding``) are a stated set; each pass takes at most about ``MAX_QUERIES`` of them, dealt
    by hash.  Each task multiplies its batches with all queries of the pass and passes on only the best k of a
    stretch, so few rows a query and task are shuffled.  A query does not find its own id.  With ``at``, a column of
    numbers of the vectors, a query sees only those from its ``since`` on and before its ``until``.  Scores are rounded to
    six places, ties go to the smaller id.  Vectors that are null or hold nulls take no part; a query meets vectors of its own length.
    """
    keep = keep or []
    queries = queries.where(_whole())
    lengths = [r["n"] for r in queries.select(F.size("embedding").alias("n")).distinct().limit(MAX_LENGTHS + 1).collect()]
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"query vectors of more than {MAX_LENGTHS} lengths")
    found = []
    for n in sorted(lengths) or [0]:
        own, there = (df.where(_whole() & (F.size("embedding") == n)) for df in (queries, vectors))
        passes = max(1, -(-own.count() // (MAX_QUERIES // 2)))
        parts = [own] if passes == 1 else [own.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p) for p in range(passes)]
        found += [_nearest(part, there, k, keep, by, at) for part in parts]
    return topk(reduce(DataFrame.unionByName, found), ["query_id", *([by] if by else [])], [F.desc("score"), F.col("vec_id")], k)


#: Different lengths of query vectors in one search.
MAX_LENGTHS = 16


def _whole() -> Column:
    return F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))


def _nearest(queries: DataFrame, vectors: DataFrame, k: int, keep: list[str], by: str | None, at: str | None) -> DataFrame:
    limits = ["since", "until"] if at else []
    rows = queries.select("query_id", "embedding", *limits).orderBy("query_id").collect()  # one pass of queries
    ids = np.array([r["query_id"] for r in rows], np.int64)
    q = np.array([r["embedding"] for r in rows], float)
    seen = np.array([[-np.inf if r["since"] is None else r["since"], r["until"]] for r in rows], float) if at and rows else None
    shared = vectors.sparkSession.sparkContext.broadcast((ids, unit(q) if len(rows) else q, seen))
    fields = {f.name: f for f in vectors.schema}
    schema = "query_id long, vec_id long, score double" + "".join(f", {c} {fields[c].dataType.simpleString()}" for c in keep)
    if seen is not None:
        vectors = vectors.where(F.col(at).between(float(seen[:, 0].min()), float(seen[:, 1].max())))

    def search(batches):
        own_ids, own, within = shared.value
        for batch in batches:
            if not len(batch) or not len(own_ids):
                continue
            batch = batch.sort_values("vec_id", kind="stable")
            for part in [batch] if by is None else [g for _, g in batch.groupby(by, sort=False)]:
                step = max(k, SCORES // len(own_ids))
                for begin in range(0, len(part), step):
                    some = part.iloc[begin : begin + step]
                    names = some["vec_id"].to_numpy()
                    s = np.round(own @ unit(np.stack(some["embedding"].to_numpy()).astype(float)).T, 6) + 0.0
                    s[own_ids[:, None] == names] = -np.inf
                    if within is not None:
                        when = some[at].to_numpy(float)
                        s[(when < within[:, :1]) | (when >= within[:, 1:])] = -np.inf
                    least = np.partition(s, -k, 1)[:, -k] if len(names) > k else np.full(len(own_ids), -np.inf)
                    i, j = np.nonzero((s >= least[:, None]) & (s > -np.inf))  # j ascends, and with it the id
                    order = np.lexsort((j, -s[i, j], i))
                    i, j = i[order], j[order]
                    place = np.arange(len(i)) - np.searchsorted(i, i)
                    i, j = i[place < k], j[place < k]
                    yield pd.DataFrame({"query_id": own_ids[i], "vec_id": names[j], "score": s[i, j], **{c: some[c].to_numpy()[j] for c in keep}})

    columns = dict.fromkeys(["vec_id", "embedding", *([at] if at else []), *keep])
    return vectors.select(*columns).mapInPandas(search, schema)


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def described_hits(vectors: DataFrame, k: int = 20) -> DataFrame:
    """The twenty nearest vectors of every query vector (ids divisible by 100), with made-up chunk fields (see the ``hits`` view)."""
    queries = vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    found = nearest(queries, vectors, k, keep=["label"])
    ext = F.element_at(F.array(F.lit(".pdf"), F.lit(".docx"), F.lit(".xlsx"), F.lit(".txt")), (F.col("vec_id") % 4 + 1).cast("int"))
    return found.select(
        "query_id", "vec_id", "label", "score", "rank", F.concat(F.lit("d"), F.col("vec_id") % 40, ext).alias("source"),
        (F.col("vec_id") % 9 + 1).alias("page"), F.concat(F.lit("S"), F.col("vec_id") % 5).alias("section"),
        F.concat(F.lit("text of "), F.col("vec_id"), F.lit(" "), F.expr("repeat(concat('word', vec_id % 7, ' '), cast(vec_id % 60 as int))")).alias("content"),
    )


# --- BM25 -----------------------------------------------------------------

K1, B, EPSILON = 1.5, 0.75, 0.25


def postings(chunks: DataFrame) -> DataFrame:
    """``collection, term, chunk_id, tf, dl``: one row for each term of a chunk; chunks without terms have none.

    The outer form of explode keeps Spark from evaluating the tokens once more to filter empty ones.
    """
    words = chunks.select("collection", "chunk_id", text.tokens(F.col("content")).alias("ts"))
    return (
        words.select("collection", "chunk_id", F.explode_outer("ts").alias("term"), F.size("ts").alias("dl")).where("term is not null")
        .groupBy("collection", "term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    )


def collection_stats(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """``collection, n, avgdl``: one row for each collection; texts are not read again, lengths come from the index."""
    n = chunks.groupBy("collection").agg(F.count(F.lit(1)).alias("n"))
    length = index.groupBy("collection").agg(F.sum("tf").alias("tokens"))
    return n.join(length, "collection", "left").select("collection", "n", (F.coalesce("tokens", F.lit(0)) / F.col("n")).alias("avgdl"))


def term_stats(index: DataFrame, collections: DataFrame) -> DataFrame:
    """``collection, term, df, idf``; a negative idf becomes a quarter of the collection's mean idf."""
    df = index.groupBy("collection", "term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(collections), "collection")
    raw = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("collection").agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean), "collection").select("collection", "term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


#: Partitions of stored postings by a hash of the term.
BUCKETS = 64


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class Index(NamedTuple):
    """BM25 tables of a chunk table: ``postings``, ``terms`` and ``collections``."""

    postings: DataFrame
    terms: DataFrame
    collections: DataFrame


def build_index(chunks: DataFrame) -> Index:
    """Write the BM25 tables once.  Postings lie by a hash of their term and sorted by it, so searches read only the parts of asked terms."""
    index = postings(chunks).withColumn("bucket", bucket(F.col("term")))
    index = stored(index.repartition("bucket", "term").sortWithinPartitions("bucket", "term"), "postings", "bucket")
    collections = stored(collection_stats(chunks, index).coalesce(1), "collections")
    return Index(index, stored(term_stats(index, collections), "terms"), collections)


def bm25(query_terms: DataFrame, index: Index) -> DataFrame:
    """``query_id, collection, chunk_id, score``: sums over distinct query terms; chunks without any are absent.

    The buckets of the asked terms (at most ``BUCKETS`` numbers) prune the scan of the postings; in what is read the
    terms filter before anything is summed, so postings of other terms are neither shuffled nor aggregated.
    """
    asked = query_terms.select("query_id", "term").distinct()
    buckets = sorted(r["b"] for r in asked.select(bucket(F.col("term")).alias("b")).distinct().collect())
    facts = index.terms.join(asked, "term").join(F.broadcast(index.collections), "collection").withColumn("bucket", bucket(F.col("term")))
    tf, dl = F.col("tf"), F.col("dl")
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))
    return index.postings.where(F.col("bucket").isin(buckets)).join(facts, ["bucket", "collection", "term"]).groupBy("query_id", "collection", "chunk_id").agg(F.sum(part).alias("score"))


# --- fusion and shaping ----------------------------------------------------


def ranked(df: DataFrame, keys: list[str], score: str = "score", tie: str = "chunk_id") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie)))


def fuse(channels: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of long rows ``query_id, chunk_id, channel, rank, weight``: one shuffle, no full outer join."""
    return channels.groupBy("query_id", "chunk_id").agg(F.sum(scores.rrf(F.col("weight"), F.col("rank"), k)).alias("score"))


def expanded(queries: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``item_id, chunk_id, score``: the best score of every chunk over all wordings ``query_id, item_id, text`` of an item.

    ``find`` is the caller's search: rows ``query_id, text`` in, ``query_id, chunk_id, score`` out, for all wordings in one plan.
    """
    found = find(queries.select("query_id", "text"))
    return found.join(queries.select("query_id", "item_id").distinct(), "query_id").groupBy("item_id", "chunk_id").agg(F.max("score").alias("score"))


def adaptive_k(top: Column, k: int, low: float = 0.5, high: float = 0.8) -> Column:
    """``struct(k, retrieve_again, reason)`` from a query's best score."""
    row = lambda n, again, why: F.struct(F.lit(n).alias("k"), F.lit(again).alias("retrieve_again"), F.lit(why).alias("reason"))
    return F.when(top < low, row(min(2 * k, 20), True, "low")).when(top > high, row(max(k // 2, 3), False, "high")).otherwise(row(k, False, "medium"))


def keep_or_all(df: DataFrame, key: str, keep: Column) -> DataFrame:
    """Rows that satisfy ``keep``; all rows of a query of which none does."""
    flag = F.coalesce(keep, F.lit(False))
    any_ = F.max(flag.cast("int")).over(Window.partitionBy(key))
    return df.withColumn("_any", any_).where(flag | (F.col("_any") == 0)).drop("_any")


def mmr(candidates: DataFrame, k: int, lam: float = 0.5) -> DataFrame:
    """Greedy maximal marginal relevance over ``query_id, vec_id, embedding, query_embedding``; adds ``mmr_rank``.

    With k candidates or fewer the order stays; rows without a vector come last.  Candidate lists are short
    (some hundred rows a query at most); queries run in parallel.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "vec_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        have = pdf["embedding"].notna().to_numpy()
        if len(pdf) <= k:
            chosen = list(range(len(pdf)))
        else:
            rows = np.flatnonzero(have)
            x = unit(np.stack(pdf["embedding"][rows].to_numpy()).astype(float))
            rel = x @ unit(np.array([pdf["query_embedding"][0]], float))[0]
            twin = np.full(len(rows), -np.inf)
            left, chosen = np.ones(len(rows), bool), []
            while left.any() and len(chosen) < k:
                value = lam * rel - (1 - lam) * np.where(np.isinf(twin), 0, twin)
                i = int(np.argmax(np.where(left, np.round(value, 12), -np.inf)))
                left[i] = False
                chosen.append(int(rows[i]))
                twin = np.maximum(twin, x @ x[i])
            chosen += [int(i) for i in np.flatnonzero(~have)][: k - len(chosen)]
        out = pdf.iloc[chosen][["query_id", "vec_id", "score"]].copy()
        out["mmr_rank"] = np.arange(1, len(out) + 1, dtype=np.int32)
        return out

    return candidates.groupBy("query_id").applyInPandas(pick, "query_id long, vec_id long, score double, mmr_rank int")


def diverse(candidates: DataFrame, k: int, threshold: float = 0.85, chars: int = 200) -> DataFrame:
    """Drop, in rank order, rows whose character set is too like one kept before (Jaccard of the first 200 characters); k at most.

    Queries with k rows or fewer stay as they are.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        if len(pdf) > k:
            kept, sets = [], []
            for i, content in zip(pdf.index, pdf["content"], strict=True):
                own = set((content or "")[:chars])
                if all(len(own & s) / len(own | s) <= threshold if own | s else True for s in sets):
                    kept.append(i)
                    sets.append(own)
                if len(kept) == k:
                    break
            pdf = pdf.loc[kept]
        return pdf[["query_id", "vec_id", "rank"]]

    return candidates.groupBy("query_id").applyInPandas(pick, "query_id long, vec_id long, rank int")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


#: Rules of one table; every row of text is held against all of them.
MAX_RULES = 10_000


def classified(texts: DataFrame, column: str, rules: DataFrame, otherwise: str = "fact") -> DataFrame:
    """``texts`` with ``class`` and ``rule``: the first row of a rule table ``pattern, kind, class, priority`` that fits a text.

    The rules are counted and gathered to one array, which is broadcast with the plan; more than ``MAX_RULES`` are an error.  Rows without
    a pattern or class are no rules; a null text is of no class but ``otherwise``.
    """
    valid = rules.where("pattern is not null and class is not null")
    if (n := valid.count()) > MAX_RULES:
        raise ValueError(f"{n} rules, at most {MAX_RULES}")
    gathered = valid.agg(F.collect_list(F.struct("priority", "pattern", "class", "kind")).alias("_rules"))
    named = texts.join(F.broadcast(gathered), F.lit(True)).withColumn("_first", text.first_rule(F.col(column), F.col("_rules")))
    return named.select(*texts.columns, F.coalesce("_first.class", F.lit(otherwise)).alias("class"), F.col("_first.pattern").alias("rule"))
