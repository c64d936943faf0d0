"""Graph queries, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from .fixtures import view
from .registry import n_rows, query


@query("c14_edge_lookup", "select head, relation, tail from edges where head = 'N:NATION_7' or tail = 'N:NATION_7' or head = 'N:NATION_12' or tail = 'N:NATION_12'")
def edge_lookup(spark, sf_dir):
    names = ["N:NATION_7", "N:NATION_12"]
    return view(spark, sf_dir, "edges").where(F.col("head").isin(names) | F.col("tail").isin(names))


@query("c15_neighbours", "select x.name, x.relation, x.other, n.type from (select head as \"name\", relation, tail other from edges union all select tail, relation, head from edges) x join entities n on n.name = x.other where x.name like 'N:%' and x.relation = 'BELONGS_TO'")
def neighbours(spark, sf_dir):
    e = graph.both_ways(view(spark, sf_dir, "edges")).where("name like 'N:%' and relation = 'BELONGS_TO'")
    n = view(spark, sf_dir, "entities").select(F.col("name").alias("other"), "type")
    return e.join(n, "other").select("name", "relation", "other", "type")


_TWO_HOPS = """
b as (select head as "name", tail other, concat_ws(chr(9), head, relation, tail) edge from edges union all select tail, head, concat_ws(chr(9), head, relation, tail) from edges),
h1 as (select s.name start, b.other, b.edge, 1 hops from (select name from entities where name in ('R:ASIA', 'R:AFRICA')) s join b on b.name = s.name),
h2 as (select distinct h1.start, b.other, b.edge, 2 hops from (select distinct start, other from h1) h1 join b on b.name = h1.other),
g as (select start, edge, min(hops) hops from (select start, edge, hops from h1 union all select start, edge, hops from h2) group by start, edge)"""


@query("c16_subgraph", f"with {_TWO_HOPS} select start, edge, hops from g")
def subgraph(spark, sf_dir):
    names = view(spark, sf_dir, "entities").where("name in ('R:ASIA', 'R:AFRICA')").select("name")
    return graph.subgraph(names, view(spark, sf_dir, "edges"), 2)


@query("c16_subgraph_limit", f"with {_TWO_HOPS} select start, edge, cast(rank as int) rank from (select *, row_number() over (partition by start order by hops, edge) rank from g) where rank <= 100")
def subgraph_limit(spark, sf_dir):
    """The first hundred edges of each start."""
    from ..operators.search import topk

    names = view(spark, sf_dir, "entities").where("name in ('R:ASIA', 'R:AFRICA')").select("name")
    g = graph.subgraph(names, view(spark, sf_dir, "edges"), 2)
    return topk(g, ["start"], [F.col("hops"), F.col("edge")], 100).select("start", "edge", "rank")


@query("c17_relation_scan", "select e.head, e.tail, n.type from edges e join entities n on n.name = e.head where relation = 'MANAGES' and n.type = 'supplier'")
def relation_scan(spark, sf_dir):
    e = view(spark, sf_dir, "edges").where("relation = 'MANAGES'")
    n = view(spark, sf_dir, "entities").where("type = 'supplier'").select(F.col("name").alias("head"), "type")
    return e.join(n, "head").select("head", "tail", "type")


@query("d19_graph_statistics", "select 'entity' kind, type label, count(*) n from entities group by type union all select 'edge', relation, count(*) from edges group by relation")
def statistics(spark, sf_dir):
    a = view(spark, sf_dir, "entities").groupBy(F.col("type").alias("label")).agg(n_rows().alias("n")).select(F.lit("entity").alias("kind"), "label", "n")
    b = view(spark, sf_dir, "edges").groupBy(F.col("relation").alias("label")).agg(n_rows().alias("n")).select(F.lit("edge").alias("kind"), "label", "n")
    return a.unionByName(b)


@query("g5_distinct_triples", "select distinct head, relation, tail from edges")
def distinct_triples(spark, sf_dir):
    e = view(spark, sf_dir, "edges")
    return e.unionByName(e.where("relation = 'BELONGS_TO'")).dropDuplicates(["head", "relation", "tail"])


_MERGED = "e as (select *, row_number() over (order by head, relation, tail) seq from edges)"


@query("g6_entity_merge", "select name, count(*) mentions from (select head as \"name\" from edges union all select tail from edges) group by name")
def entity_merge(spark, sf_dir):
    e = view(spark, sf_dir, "edges").withColumn("seq", F.xxhash64("head", "relation", "tail"))
    return graph.merge_entities(e)[0].select("name", "mentions")


@query("h32_relation_codes", "select distinct relation, relation code, case relation when 'BELONGS_TO' then 'belongs to' else 'manages' end label from edges")
def relation_codes(spark, sf_dir):
    label = F.replace(F.lower("relation"), F.lit("_"), F.lit(" "))
    return view(spark, sf_dir, "edges").select("relation", graph.relation_code(F.col("relation")).alias("code"), label.alias("label")).distinct()


@query("m12_graph_context", """
select name, array_to_string(list_slice(list(s order by s), 1, 20), chr(10)) context from (
  select n.name, concat(e.head, ' ', lower(replace(relation, '_', ' ')), ' ', e.tail) s from entities n join edges e on e.head = n.name or e.tail = n.name where n.type = 'nation') group by name""")
def graph_context(spark, sf_dir):
    """At most twenty sentences about each matched entity."""
    from ..operators.search import topk

    e = graph.both_ways(view(spark, sf_dir, "edges"))
    parts = F.split("edge", "\t")
    s = F.concat_ws(" ", parts[0], F.lower(F.replace(parts[1], F.lit("_"), F.lit(" "))), parts[2])
    n = view(spark, sf_dir, "entities").where("type = 'nation'").select("name")
    told = topk(e.join(n, "name").select("name", s.alias("s")), ["name"], [F.col("s")], 20)
    return told.groupBy("name").agg(F.array_join(F.sort_array(F.collect_list("s")), "\n").alias("context"))


@query("m14_relation_triples", "select relation, head, tail, cast(rank as int) rank from (select *, row_number() over (partition by relation order by head, tail) rank from edges) where rank <= 10")
def relation_triples(spark, sf_dir):
    from ..operators.search import topk

    return topk(view(spark, sf_dir, "edges"), ["relation"], [F.col("head"), F.col("tail")], 10).select("relation", "head", "tail", "rank")
