"""Shortest paths: of all shortest ones the smallest in the order of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph
from ..session import materialise


def endpoint(nodes: DataFrame, label: str) -> int | None:
    return nodes.where(F.col("label") == label).agg(F.min("id")).first()[0]


def shortest_path(g: Graph, start: str, end: str, most: int | None = None) -> DataFrame:
    """position, id of each node on the path; no row if there is none.

    Level by level, from both ends, the smaller last level first, until they meet: a node
    that is reached first in a level keeps the smallest path to it, which is what visiting
    neighbours in the order of ids gives. Each level is an aggregate, written once; ``most``
    limits the levels of both. Edges aren't copied, nor shuffled where the last level is small.
    """
    spark = g.nodes.sparkSession
    a, b = endpoint(g.nodes, start), endpoint(g.nodes, end)
    none = spark.createDataFrame([], "position bigint, id bigint")
    if a is None or b is None:
        return none
    if a == b:
        return spark.createDataFrame([(0, a)], "position bigint, id bigint")
    own = g.edges.where("source <> target")
    # a side's last level (id, path: from the side's end on), its size, and all that it has seen
    sides = [_first(spark, a), _first(spark, b)]
    level = 0
    while most is None or level < most:
        k = 0 if sides[0][1] <= sides[1][1] else 1
        frontier, _, seen = sides[k]
        # edges are read where they lie, once from each end; a small frontier is broadcast, and repeats end in the aggregate
        out, into = (frontier.join(own.select(F.col(x).alias("id"), F.col(y).alias("peer")), "id") for x, y in (("source", "target"), ("target", "source")))
        longer = F.concat("path", F.array("peer")) if k == 0 else F.concat(F.array("peer"), "path")
        step = out.unionByName(into).select(F.col("peer").alias("id"), longer.alias("path")).join(seen, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path"))
        frontier = materialise(spark, step, "frontier")
        size, level = frontier.count(), level + 1
        if not size:
            break
        sides[k] = frontier, size, seen.unionByName(frontier.select("id"))
        # no path is as short as the levels before, so one that meets here is a shortest one
        met = sides[0][0].select("id", F.col("path").alias("head")).join(sides[1][0], "id").select(F.concat("head", F.slice("path", F.lit(2), F.size("path"))).alias("path"))
        hit = met.agg(F.min("path").alias("path")).first()
        if hit.path:
            return spark.createDataFrame(list(enumerate(hit.path)), "position bigint, id bigint")
    return none


def _first(spark: SparkSession, node: int) -> tuple[DataFrame, int, DataFrame]:
    """A side that has seen its own end only. A range, as Spark doesn't know the size of local rows."""
    one = F.lit(node).cast("bigint")
    own = spark.range(1).select(one.alias("id"), F.array(one).alias("path"))
    return own, 1, own.select("id")


def render_path(path: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: the labels joined by arrows, and the number of hops; no row without a path."""
    # a path is short: its nodes are found without a shuffle of all
    own = nodes.select("id", "label").join(F.broadcast(path.select("id")), "id", "left_semi")
    named = path.join(F.broadcast(own), "id", "left").withColumn("label", F.coalesce("label", F.concat(F.lit("<id "), F.col("id"), F.lit(">"))))
    one = named.agg(F.array_sort(F.collect_list(F.struct("position", "label"))).alias("steps"))
    return one.where(F.size("steps") > 0).select(F.array_join(F.transform("steps", lambda s: s["label"]), " -> ").alias("path"), (F.size("steps") - 1).cast("bigint").alias("hops"))
