"""Property graph work as self-joins of an edge table ``head, relation, tail``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import sized, stored


def both_ways(edges: DataFrame) -> DataFrame:
    """``name, other, relation, edge``: every edge seen from either end."""
    edge = F.concat_ws("\t", "head", "relation", "tail")
    out = edges.select(F.col("head").alias("name"), F.col("tail").alias("other"), "relation", edge.alias("edge"))
    back = edges.select(F.col("tail").alias("name"), F.col("head").alias("other"), "relation", edge.alias("edge"))
    return out.unionByName(back)


def subgraph(names: DataFrame, edges: DataFrame, depth: int = 2, allowed: DataFrame | None = None) -> DataFrame:
    """``start, edge, hops``: edges on undirected paths of 1 to ``depth`` hops from each start, least hops first seen.

    An edge lies on a path without repeated edges exactly if a shortest walk reaches one of its ends, so reached
    nodes suffice and paths are not listed: a step keeps one row for each (start, node).  The edges are stored once.  ``allowed`` (``name``)
    restricts the nodes.  The depth is small (3 at most), so the loop only builds the plan.
    """
    edges = stored(edges.select("head", "relation", "tail"), "edges")  # made once, not once a hop and direction
    seen = both_ways(edges)
    if allowed is not None:
        ok = allowed.select("name").distinct()
        seen = seen.join(ok, "name", "left_semi").join(ok.withColumnRenamed("name", "other"), "other", "left_semi")
    front = names.select(F.col("name").alias("start"), "name").distinct()
    found = None
    for hop in range(1, min(depth, 3) + 1):
        front, _ = sized(front, "front")  # a small front is broadcast, so that edges stay where they are
        step = front.join(seen, "name").select("start", "other", "edge", F.lit(hop).alias("hops"))
        found = step if found is None else found.unionByName(step)
        front = step.select("start", F.col("other").alias("name")).distinct()
    return found.groupBy("start", "edge").agg(F.min("hops").alias("hops"))


def distinct_items(owners: DataFrame, members: DataFrame) -> DataFrame:
    """``owner, n``: how many distinct items the groups of each owner hold, from ``owners (owner, key)`` and ``members (key, item)``.

    Items are counted by the set of groups that they are in, and an owner adds up the sets that meet its groups, so
    owners and items are never joined.  Owners without items and null keys give no rows.
    """
    within = members.where("key is not null and item is not null").groupBy("item").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    sets = stored(within.groupBy("keys").agg(F.count(F.lit(1)).alias("n")), "key-sets")
    meets = owners.distinct().join(sets.select(F.explode("keys").alias("key"), "keys", "n"), "key").select("owner", "keys", "n").distinct()
    return meets.groupBy("owner").agg(F.sum("n").alias("n"))


def merge_entities(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (last properties win) and distinct edges of ``seq, head, relation, tail``."""
    ends = triples.select("seq", F.col("head").alias("name")).unionByName(triples.select("seq", F.col("tail").alias("name")))
    return ends.groupBy("name").agg(F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("mentions")), triples.dropDuplicates(["head", "relation", "tail"]).select("head", "relation", "tail")


#: Relation codes by label.
RELATION_CODES = {"属于": "BELONGS_TO", "管理": "MANAGES", "包含": "CONTAINS", "负责": "RESPONSIBLE_FOR", "位于": "LOCATED_IN"}


def relation_code(label):
    """Known labels by table; else upper case with other signs as '_', purely CJK labels as RELATED_TO."""
    upper = F.regexp_replace(F.upper(label), r"[^A-Z0-9_]", "_")
    return F.coalesce(*(F.when(label == k, F.lit(v)) for k, v in RELATION_CODES.items()), F.when(label.rlike("^[一-鿿]+$"), F.lit("RELATED_TO")), upper)
