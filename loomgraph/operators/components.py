"""Connected components of a graph of links, in DataFrames only.

Alternating rounds: *large star* hangs every larger neighbour of a node on the
smallest node of its neighbourhood, *small star* does so with the smaller ones.
Each round is an aggregation and a join on the node; hubs are pre-aggregated and
their links dealt to several parts of the join. Every round is written to the
shared folder, so a lost executor costs no earlier round; the one before it is
deleted then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise
from .skew import frequent, salted_join

#: Links below which a job that looks for hubs costs more than the hubs.
FEW = 20_000


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """edges (u, v) with the smallest v of each u."""
    by = edges.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n"))
    hubs = frequent(by, "u", "n", total) if total > FEW else []
    return salted_join(edges, by.select("u", "least"), ["u"], hubs, ["v"])


def components(links: DataFrame) -> DataFrame:
    """links: a, b of one type, any direction, repeats and loops allowed.

    Returns node, root for every node that has a link to another: root is the
    smallest node that can be reached. Links with a null end are no links.
    """
    spark = links.sparkSession
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(spark, edges, "links")
    count = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = count(edges)
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * now[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v"))
        large = large.where("u <> v").distinct()
        if now[0] > FEW:  # it is read twice
            large = materialise(spark, large, "links")
        small = _with_least(large, now[0])
        small = small.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(small.select("u", F.col("least").alias("v")))
        after = materialise(spark, small.where("u <> v").distinct(), "links")
        discard(edges, *([large] if now[0] > FEW else []))
        edges, before, now = after, now, count(after)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )


def _roots(parents: DataFrame) -> DataFrame:
    """u, p: each node with the end of its chain. parents: u, p, stored; p is no larger than u, and has a row itself. Chains halve in each round."""
    spark = parents.sparkSession
    ended, going = None, parents
    while True:
        now = going.select("u", "p") if ended is None else going.select("u", "p").unionByName(ended)
        further = going.select("u", "p").join(now.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved"))
        going = materialise(spark, further, "chains")
        own = going.where("NOT moved").select("u", "p")
        ended, going = own if ended is None else ended.unionByName(own), going.where("moved")
        if not going.take(1):
            return ended


def components_of_many(links: DataFrame) -> DataFrame:
    """As ``components``, for far more links than nodes. links is read twice, and has to be cheap to read.

    First only the links to the smallest and to the largest neighbour of each node count.
    Each node hangs on its smallest neighbour, and what hangs together becomes one node for
    the other links, which are treated likewise. That puts most nodes in one component already.
    All links at nodes outside it are looked at then, and join what the first ones left apart, so none is lost.
    """
    spark = links.sparkSession
    own = links.where("a <> b").select("a", "b")
    both = own.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(own.select(F.col("b").alias("u"), F.col("a").alias("v")))
    few = materialise(spark, both.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high")), "few-links")
    own_root = _roots(few.select("u", F.least("u", "low").alias("p")))
    at = lambda e, name: own_root.select(F.col("u").alias(e), F.col("p").alias(name))
    rest = few.select("u", "high").join(at("u", "a"), "u").join(at("high", "b"), "high").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    rest = materialise(spark, rest.distinct(), "links")
    tops = (components_of_many if rest.count() > FEW else components)(rest)
    found = own_root.join(tops.select(F.col("node").alias("p"), "root"), "p", "left").select(F.col("u").alias("node"), F.coalesce("root", "p").alias("root"))
    found = materialise(spark, found, "found")
    most = found.groupBy("root").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").first()
    if most is None:
        return found
    # written, so that Spark knows its size: a small one is broadcast, and links aren't shuffled
    outside = materialise(spark, found.where(F.col("root") != most["root"]), "outside")
    if not outside.take(1):
        return found
    of = lambda e: outside.select(F.col("node").alias(e), F.col("root").alias(f"root_{e}"))
    apart = own.join(of("a"), "a", "left").join(of("b"), "b", "left").select(*[F.coalesce(f"root_{e}", F.lit(most["root"])).alias(e) for e in ("a", "b")])
    joined = components(apart.where("a <> b")).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return found.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
