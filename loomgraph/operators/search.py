"""Search by label, with a trigram index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Graph

QUERY_CAP, QUERY_ROWS = 256, 50


def find_by_label(nodes: DataFrame, needle: str) -> DataFrame:
    """Nodes whose label holds ``needle``, whatever the case; the empty needle is in all."""
    return nodes.where(F.contains(F.lower("label"), F.lower(F.lit(needle))))


def trigram_index(nodes: DataFrame) -> DataFrame:
    """trigram, id: the different trigrams of each label in lower case."""
    low = F.lower(F.col("label"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(low) - 2), lambda k: F.substring(low, k, F.lit(3))))
    return nodes.where(F.char_length(low) >= 3).select(F.explode(grams).alias("trigram"), "id")


def trigrams_of(needle: str) -> list[str]:
    low = needle.lower()
    return sorted({low[k : k + 3] for k in range(len(low) - 2)})


def find_indexed(nodes: DataFrame, index: DataFrame, needle: str) -> DataFrame:
    """As ``find_by_label``, over the index: postings of all trigrams meet, then the label decides. Short needles scan."""
    grams = trigrams_of(needle)
    if not grams:
        return find_by_label(nodes, needle)
    hits = index.where(F.col("trigram").isin(grams)).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
    return find_by_label(nodes.join(hits.select("id"), "id", "left_semi"), needle)


def query(g: Graph, needle: str, rows: int = QUERY_ROWS) -> DataFrame:
    """The first ``rows`` hits by id with rank, and the number of all; a ValueError for a needle that is too long."""
    if len(needle.encode()) > QUERY_CAP:
        raise ValueError("query too long")
    hits = find_by_label(g.nodes, needle).select("id", "label", "source_file", "start_line")
    total = hits.agg(F.count("*").alias("total"))
    top = hits.orderBy("id").limit(rows).withColumn("rank", F.row_number().over(Window.orderBy("id")).cast("bigint"))
    return top.crossJoin(total)  # one row
