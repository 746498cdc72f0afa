"""Concepts and relations that a language model answered with, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sanitize_label

ANSWER = "nodes array<struct<label: string>>, edges array<struct<source: string, target: string, relation: string>>"
# Fixed value: the relation of edges that name none.
DEFAULT_RELATION = "relates_to"


def _clean(c: str):
    return sanitize_label(F.trim(F.coalesce(F.col(c), F.lit(""))))


def parse_semantic(answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """answers: source_file, answer. Raw nodes, raw edges (all INFERRED), and the answers that aren't the expected object."""
    own = answers.withColumn("a", F.from_json("answer", ANSWER))
    bad = own.where("a IS NULL OR NOT startswith(ltrim(answer), '{')").select("source_file", "answer")
    own = own.where("a IS NOT NULL AND startswith(ltrim(answer), '{')")
    n = own.select("source_file", F.posexplode("a.nodes").alias("k", "n")).select("source_file", "k", F.col("n.label").alias("raw"))
    n = n.withColumn("label", _clean("raw")).where("label <> ''").select("label", "source_file", F.col("k").cast("bigint").alias("row_ord"))
    e = own.select("source_file", F.posexplode("a.edges").alias("k", "e")).select("source_file", "k", "e.*")
    relation = _clean("relation")
    e = e.select("source_file", F.col("k").cast("bigint").alias("row_ord"), _clean("source").alias("source"), _clean("target").alias("target"), F.when(relation == "", DEFAULT_RELATION).otherwise(relation).alias("relation"), F.lit("INFERRED").alias("confidence"))
    return n, e.where("source <> '' AND target <> ''"), bad
