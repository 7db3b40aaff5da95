"""Graph queries over works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.operators import graph
from docloom.plans.base import query
from docloom.session import table
from docloom.sources import adapters

_NODE = "coalesce(nullif(doi, ''), 's2:' || nullif(s2_id, ''), 't:' || lower(left(title, 60)))"
EDGES_SQL = f"SELECT DISTINCT source, target FROM (SELECT {_NODE} AS source, unnest(list_distinct(referenced_dois)) AS target FROM works) WHERE source IS NOT NULL AND target IS NOT NULL"
#: Graph seeds: at most twenty (a bound of the feature), the most cited works.
SEEDS_SQL = f"SELECT node, row_number() OVER (ORDER BY cited_by DESC, work_id) - 1 AS ord FROM (SELECT {_NODE} AS node, cited_by, work_id FROM works WHERE doi <> '' AND cited_by IS NOT NULL ORDER BY cited_by DESC, work_id LIMIT 20)"


@query(EDGES_SQL)
def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.citation_edges(table(spark, folder, "works"))


@query(f"SELECT node, count(*) AS degree FROM (SELECT source AS node FROM ({EDGES_SQL}) UNION ALL SELECT target FROM ({EDGES_SQL})) GROUP BY node")
def edge_degree(spark: SparkSession, folder: str) -> DataFrame:
    return graph.degrees(graph.citation_edges(table(spark, folder, "works")))


def _seeds(spark: SparkSession, folder: str) -> DataFrame:
    w = table(spark, folder, "works").where("doi <> '' and cited_by is not null")
    top = w.orderBy(F.desc("cited_by"), "work_id").limit(20)
    ranked = top.withColumn("at", (F.row_number().over(Window.orderBy(F.desc("cited_by"), "work_id")) - 1).cast("bigint"))  # twenty rows
    return ranked.select(graph.node_id(F.col("doi"), F.col("s2_id"), F.col("title")).alias("node"), "at")


NEIGHBOURS_SQL = (
    f"WITH e AS ({EDGES_SQL}), s AS ({SEEDS_SQL}), n AS (SELECT ord, 0 AS way, source, target, target AS other FROM e JOIN s ON e.source = s.node UNION ALL SELECT ord, 1, source, target, source FROM e JOIN s ON e.target = s.node), "
    "r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ord, way ORDER BY other) AS r FROM n) WHERE r <= 6), f AS (SELECT other, min(ord * 100000 + way * 1000 + r) AS o FROM r WHERE other NOT IN (SELECT node FROM s) GROUP BY other), "
    "a AS (SELECT other FROM f ORDER BY o, other LIMIT 20), x AS (SELECT node FROM s UNION SELECT other FROM a) SELECT DISTINCT source, target, 'cites' AS kind, 1.0::DOUBLE AS weight FROM r WHERE source IN (SELECT node FROM x) AND target IN (SELECT node FROM x)"
)


@query(NEIGHBOURS_SQL)
def graph_neighbourhood(spark: SparkSession, folder: str) -> DataFrame:
    return graph.neighbourhood(table(spark, folder, "works"), _seeds(spark, folder))[1]


@query()
def graph_similar(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of a graph with those between works of similar titles; the hashing encoder stands in for a model."""
    works = table(spark, folder, "works")
    nodes, edges = graph.neighbourhood(works, _seeds(spark, folder))
    titles = works.select(graph.node_id(F.col("doi"), F.col("s2_id"), F.col("title")).alias("node"), "title").join(F.broadcast(nodes.select("node")), "node", "left_semi").groupBy("node").agg(F.min("title").alias("title"))
    return edges.unionByName(graph.similar_edges(titles, adapters.hashing_encoder()))


@query()
def graph_layout(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = graph.neighbourhood(table(spark, folder, "works"), _seeds(spark, folder))
    return graph.layout(nodes, edges)
