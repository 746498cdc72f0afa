"""What stands around a node, and samples for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Graph
from ..session import materialise
from .analytics import community_of
from .search import find_by_label

EXPLAIN_NODES, EXPLAIN_EDGES, SAMPLE_NODES = 10, 8, 20


def _around(g: Graph, ids: DataFrame) -> DataFrame:
    """node, direction, peer, relation, confidence of the edges at ``ids`` (id); a loop is there both ways."""
    out = g.edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("source").alias("node"), F.lit("out").alias("direction"), F.col("target").alias("peer"), "relation", "confidence")
    into = g.edges.join(ids.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("target").alias("node"), F.lit("in").alias("direction"), F.col("source").alias("peer"), "relation", "confidence")
    return out.unionByName(into)


def _peer_label(df: DataFrame, nodes: DataFrame, unknown: str) -> DataFrame:
    named = df.join(nodes.select(F.col("id").alias("peer"), F.col("label").alias("peer_label")), "peer", "left")
    return named.withColumn("peer_label", F.coalesce("peer_label", F.format_string(unknown, "peer")))


def explain_edges(g: Graph, concept: str, nodes: int = EXPLAIN_NODES, edges: int = EXPLAIN_EDGES) -> DataFrame:
    """For the first matches by id, the first edges each way by peer and relation, with how many there are."""
    ids = find_by_label(g.nodes, concept).orderBy("id").limit(nodes).select("id")
    by = Window.partitionBy("node", "direction")
    ranked = _around(g, ids).withColumn("rank", F.row_number().over(by.orderBy("peer", "relation", "confidence")).cast("bigint")).withColumn("total", F.count("*").over(by))
    return _peer_label(ranked.where(F.col("rank") <= edges), g.nodes, "<id %d>")


def explain_communities(g: Graph, concept: str, nodes: int = EXPLAIN_NODES) -> DataFrame:
    ids = find_by_label(g.nodes, concept).orderBy("id").limit(nodes).select("id", "label")
    own = g.members.join(g.communities.select(F.col("id").alias("community"), F.col("label").alias("community_label")), "community")
    return ids.join(own.withColumnRenamed("node", "id"), "id", "left").select("id", "label", "community", "community_label")


def neighbourhood(g: Graph, label: str) -> DataFrame:
    """All edges at all nodes that match ``label``."""
    if not label:
        raise ValueError("a label is needed")
    # written, so that Spark knows how few they are: edges aren't shuffled for them then. Nodes are hashed at every size.
    ids = materialise(g.nodes.sparkSession, find_by_label(g.nodes, label).select("id"), "matches")
    return _peer_label(_around(g, ids), g.nodes.hint("shuffle_hash"), "<unknown:%d>")


def community_members(g: Graph, community: str) -> DataFrame:
    """Members of a community in rising order with labels; a ValueError for what isn't its number."""
    if not community.strip().isdigit():
        raise ValueError("not a community")
    own = g.members.where(F.col("community") == int(community)).select(F.col("node").alias("id"))
    named = own.join(g.nodes.select("id", "label"), "id", "left").withColumn("label", F.coalesce("label", F.format_string("<unknown:%d>", "id")))
    return named.withColumn("rank", F.row_number().over(Window.orderBy("id")).cast("bigint"))


def report_sample(g: Graph, top: int = SAMPLE_NODES) -> DataFrame:
    first = g.nodes.orderBy("id").limit(top).select("id", F.format_string("%s (%s:%d)", "label", "source_file", "start_line").alias("line"))
    return first.withColumn("rank", F.row_number().over(Window.orderBy("id")).cast("bigint"))


def health(g: Graph) -> str:
    """The graph's sizes in one line."""
    n, e, c = (df.count() for df in (g.nodes, g.edges, g.communities))
    return f"nodes={n} edges={e} communities={c} schema={g.schema}"


def node_communities(g: Graph) -> DataFrame:
    return g.nodes.join(community_of(g.members).withColumnRenamed("node", "id"), "id", "left")
