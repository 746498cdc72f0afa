"""Degrees, hubs, communities, bridges and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import question_label
from ..model import Graph
from ..session import materialise
from .components import components, components_of_many
from .leiden import leiden
from .ranks import ranked
from .skew import ROWS, dealt_join
from .trust import TRUSTED, trusted_edges

HUB_QUESTIONS, HUB_DEGREE = 5, 5
REPORT_HUBS = 10


def degree_centrality(g: Graph) -> DataFrame:
    """id, degree of every node and of ends that aren't nodes; a loop counts twice."""
    ends = g.edges.select(F.explode(F.array("source", "target")).alias("id"), F.lit(1).alias("n"))
    return g.nodes.select("id", F.lit(0).alias("n")).unionByName(ends).groupBy("id").agg(F.sum("n").cast("bigint").alias("degree"))


def god_nodes(g: Graph, top: int) -> DataFrame:
    """The ``top`` nodes by degree, ties by id, with rank; an unknown end has the label ''."""
    best = degree_centrality(g).orderBy(F.desc("degree"), "id").limit(top)
    named = best.join(g.nodes.select("id", "label"), "id", "left").withColumn("label", F.coalesce("label", F.lit("")))
    return named.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("degree"), "id")).cast("bigint"))


def report_hubs(g: Graph, top: int = REPORT_HUBS) -> DataFrame:
    """As ``god_nodes``, but ends that aren't nodes are left out first."""
    best = degree_centrality(g).join(g.nodes.select("id", "label"), "id").orderBy(F.desc("degree"), "id").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("degree"), "id")).cast("bigint"))


def undirected_pairs(edges: DataFrame) -> DataFrame:
    """a < b: each two linked nodes once, without loops."""
    return edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()


def component_of(nodes: DataFrame, pairs: DataFrame, many: bool = False) -> DataFrame:
    """id, component: the smallest node that can be reached, itself included. many: pairs (repeats allowed) are stored, and far more than nodes."""
    reached = (components_of_many if many else components)(pairs.select("a", "b"))
    return nodes.select("id").join(reached.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def label_propagation(nodes: DataFrame, pairs: DataFrame, rounds: int, rows: int = ROWS) -> DataFrame:
    """id, label after ``rounds`` synchronous rounds: each node takes the commonest label of its neighbours, the smallest of equals.

    The count by node and label is a partial aggregate, so hubs are reduced before they are shuffled;
    links of nodes with more than ``rows`` of them are dealt to several parts of the join.
    """
    spark = nodes.sparkSession
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("peer")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("peer")))
    now = nodes.select("id", F.col("id").alias("label")).join(both.groupBy("id").agg(F.count("*").alias("links")), "id", "left").na.fill(0, ["links"])
    now = materialise(spark, now, "labels")
    for _ in range(rounds):
        votes = dealt_join(both, now.withColumnRenamed("id", "peer"), "peer", "links", ["id"], rows).groupBy("id", "label").agg(F.count("*").alias("n"))
        won = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("best")).select("id", F.col("best.label").alias("new"))
        now = now.join(won, "id", "left").select("id", F.coalesce("new", "label").alias("label"), "links")
        now = materialise(spark, now, "labels")
    return now.select("id", "label")


def number_communities(assigned: DataFrame) -> DataFrame:
    """community (from 0, by smallest member) and node, of id, label."""
    first = assigned.groupBy("label").agg(F.min("id").alias("least"))
    number = ranked(first, ["least"], name="community").withColumn("community", F.col("community") - 1)
    return assigned.join(number, "label").select("community", F.col("id").alias("node"))


def community_labels(members: DataFrame) -> DataFrame:
    return members.select("community").distinct().select(F.col("community").alias("id"), F.concat(F.lit("community-"), F.col("community")).alias("label"))


def community_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("community").agg(F.count("*").alias("members"))


def detect_communities(g: Graph) -> tuple[DataFrame, DataFrame]:
    """communities and members of the trusted graph by the Leiden method: every node in exactly one connected community, unlinked nodes alone.

    Links of nodes that the graph doesn't have, loops and repeats don't count.
    """
    spark = g.nodes.sparkSession
    pairs = undirected_pairs(trusted_edges(g.edges).join(g.nodes.select(F.col("id").alias("source")), "source", "left_semi").join(g.nodes.select(F.col("id").alias("target")), "target", "left_semi"))
    pairs = materialise(spark, pairs, "pairs")
    found = materialise(spark, leiden(pairs), "leiden")
    of = lambda e: found.select(F.col("id").alias(e), F.col("label").alias(f"label_{e}"), F.col("n").alias(f"n_{e}"))
    inner = dealt_join(dealt_join(pairs, of("a"), "a", "n_a", ["b"]), of("b"), "b", "n_b", ["a"]).where("label_a = label_b")
    parts = component_of(g.nodes, inner.select("a", "b"))
    members = materialise(spark, number_communities(parts.select("id", F.col("component").alias("label"))), "members")
    return community_labels(members), members


def broken_communities(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """community, parts of those communities that links inside them don't connect."""
    of = lambda e: members.select(F.col("node").alias(e), F.col("community").alias(f"community_{e}"))
    inner = pairs.join(of("a"), "a").join(of("b"), "b").where("community_a = community_b").select("a", "b")
    parts = component_of(members.select(F.col("node").alias("id")).distinct(), inner).join(members.withColumnRenamed("node", "id"), "id")
    return parts.groupBy("community").agg(F.count_distinct("component").alias("parts")).where("parts > 1")


def modularity(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row: the modularity of a partition of the simple graph."""
    m = members.select("community", "node")
    of = lambda c: m.select(F.col("node").alias(c), F.col("community").alias(f"{c}_community"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    ends = both.select(F.explode(F.array("a_community", "b_community")).alias("community"), (F.col("a_community") == F.col("b_community")).cast("double").alias("inner"))
    per = ends.groupBy("community").agg((F.sum("inner") / 2).alias("inside"), F.count("*").cast("double").alias("degree"))
    total = F.sum("degree") / 2
    return per.agg((F.sum("inside") / total - F.sum(F.col("degree") * F.col("degree")) / (4 * total * total)).alias("modularity"))


def community_of(members: DataFrame) -> DataFrame:
    """node, community; of several the last."""
    return members.groupBy("node").agg(F.max("community").alias("community"))


def surprising_connections(g: Graph) -> DataFrame:
    """Trusted edges between different communities."""
    c = community_of(g.members)
    # nodes are hashed at every size, so edges aren't sorted; their one confidence isn't shuffled
    s = c.select(F.col("node").alias("source"), F.col("community").alias("source_community")).hint("shuffle_hash")
    t = c.select(F.col("node").alias("target"), F.col("community").alias("target_community")).hint("shuffle_hash")
    own = trusted_edges(g.edges).select("source", "target", "relation").join(s, "source").join(t, "target").where("source_community <> target_community")
    return own.select("source", "target", "relation", F.lit(TRUSTED).alias("confidence"), "source_community", "target_community")


# The questions' wording.
HUB_QUESTION = "What are the responsibilities of `%s` (degree %d)?"
SPLIT_QUESTION = "Is `%s` a structural hub that should be decomposed?"
BRIDGE_QUESTION = "Why does `%s` %s `%s` across community boundaries?"
INTENT_QUESTION = "Is the cross-community `%s` link from `%s` to `%s` intentional?"


def suggested_questions(g: Graph) -> DataFrame:
    """Questions about the first hubs, then about each bridge, repeats once; their order is that of part, a, b, relation, k."""
    hubs = god_nodes(g, HUB_QUESTIONS).where("label <> ''").withColumn("name", question_label(F.col("label")))
    asked = F.array(F.format_string(HUB_QUESTION, "name", "degree"), F.when(F.col("degree") >= HUB_DEGREE, F.format_string(SPLIT_QUESTION, "name")))
    zero = F.lit(0).cast("bigint")
    first = hubs.select(F.lit(0).alias("part"), F.col("rank").alias("a"), zero.alias("b"), F.lit("").alias("relation"), F.posexplode(asked).alias("k", "question"))
    named = lambda c: g.nodes.select(F.col("id").alias(c), question_label(F.col("label")).alias(f"{c}_name"))
    best = surprising_connections(g).join(named("source"), "source", "left").join(named("target"), "target", "left").na.fill("<unnamed>", ["source_name", "target_name"])
    best = best.withColumn("verb", question_label(F.col("relation")))
    pair = F.array(F.format_string(BRIDGE_QUESTION, "source_name", "verb", "target_name"), F.format_string(INTENT_QUESTION, "verb", "source_name", "target_name"))
    second = best.select(F.lit(1).alias("part"), F.col("source").alias("a"), F.col("target").alias("b"), "relation", F.posexplode(pair).alias("k", "question"))
    order = F.struct("part", "a", "b", "relation", "k")
    found = first.unionByName(second).where("question IS NOT NULL").groupBy("question").agg(F.min(order).alias("o"))
    return found.select("o.part", "o.a", "o.b", "o.relation", "o.k", "question")


def suggested_queries(hubs: list[str]) -> list[str]:
    """Three suggestions that name the first hubs. Fixed wording."""
    if not hubs:
        return ["List all nodes in the graph", "Show all edges between nodes", "Find isolated nodes with no connections"]
    if len(hubs) == 1:
        return [f"Show all edges connected to `{hubs[0]}`", f"Which nodes does `{hubs[0]}` depend on?", "Find the shortest path between any two nodes"]
    return [f"Show all edges connected to `{hubs[0]}`", f"Which community contains `{hubs[1]}`?", f"Find the path between `{hubs[0]}` and `{hubs[1]}`"]
