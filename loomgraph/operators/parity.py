"""Comparing a graph with an expected one, by labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from .build import keyed_sides, labelled_edges, sided, sides_of, with_labels

EDGE = ["source_label", "target_label", "relation"]


def label_sets(g: Graph) -> tuple[DataFrame, DataFrame]:
    return g.nodes.select("label").distinct(), labelled_edges(g).select(*EDGE).distinct()


def classify(ours: DataFrame, golden: DataFrame) -> DataFrame:
    """Each row of either set with ``status``: matched, missing (golden only) or extra (ours only)."""
    key = ours.columns
    status = F.element_at(F.array(F.lit("extra"), F.lit("missing"), F.lit("matched")), sides_of())
    return sided(ours, golden.select(*key)).groupBy(*key).agg(status.alias("status"))


def classify_edges(ours: Graph, golden: Graph, by: str | None = None) -> DataFrame:
    """As ``classify`` of both graphs' edges by labels and relation, under the names source, target and relation; whole graphs' edges keep their ids, which ``named_edges`` turns into labels. by: the end that rows lie by, so that a join on it doesn't shuffle them again."""
    key = ["source", "target", "relation"]
    status = F.element_at(F.array(F.lit("extra"), F.lit("missing"), F.lit("matched")), sides_of())
    sides = keyed_sides(ours, golden)
    if by:
        sides = sides.select(*key, "side").repartition(by)
    return sides.groupBy(*key).agg(status.alias("status"))


def named_edges(classified: DataFrame, ours: Graph, golden: Graph) -> DataFrame:
    """Edges of ``classify_edges`` with labels, as ``classify`` has them."""
    return with_labels(classified, ours, golden, ends=("source", "target")).withColumnsRenamed({"source": "source_label", "target": "target_label"})


def regression_free(*classified: DataFrame) -> DataFrame:
    """One row: whether nothing is missing."""
    one = None
    for df in classified:
        own = df.select("status")
        one = own if one is None else one.unionByName(own)
    return one.agg((F.count_if(F.col("status") == "missing") == 0).alias("regression_free"))


def relation_coverage(classified_edges: DataFrame) -> DataFrame:
    """relation, matched, total of the golden's edges, and the rounded percentage."""
    per = classified_edges.where("status <> 'extra'").groupBy("relation").agg(F.count_if(F.col("status") == "matched").alias("matched"), F.count("*").alias("total"))
    return per.withColumn("percent", F.floor((100 * F.col("matched") + F.floor(F.col("total") / 2)) / F.col("total")))


def co_clustering(ours: DataFrame, golden: DataFrame) -> DataFrame:
    """One row: the members of the largest golden community, and how many of them share the commonest of our communities.

    Both sides: community, label. Ties go to the smaller number.
    """
    largest = golden.groupBy("community").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "community").limit(1).select("community")
    own = golden.join(largest, "community", "left_semi").select("label")
    met = own.join(ours.select("label", F.col("community").alias("c")), "label", "left")
    per = met.groupBy("c").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("members"), F.coalesce(F.max(F.when(F.col("c").isNotNull(), F.col("n"))), F.lit(0)).alias("together"))
