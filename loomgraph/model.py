"""The property graph: four DataFrames and a schema tag."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "graph.v0"
RANKS = ("EXTRACTED", "INFERRED", "AMBIGUOUS")

NODES = "id bigint, label string, source_file string, start_byte bigint, end_byte bigint, start_line bigint, end_line bigint"
EDGES = "source bigint, target bigint, relation string, confidence string"
COMMUNITIES = "id bigint, label string"
MEMBERS = "community bigint, node bigint"
INPUTS = "path string, content_hash string"
RAW_NODES = "label string, source_file string, start_byte bigint, end_byte bigint, start_line bigint, end_line bigint, file_ord bigint, row_ord bigint"
RAW_EDGES = "source string, target string, relation string, confidence string, file_ord bigint, row_ord bigint"


class GraphError(Exception):
    """Base of this package's errors."""


class SchemaError(GraphError):
    """Stored data of another schema or shape."""


def rank(confidence: Column) -> Column:
    """Order of certainty, 0 the surest; unknown values come last."""
    return F.when(confidence == RANKS[0], 0).when(confidence == RANKS[1], 1).otherwise(2)


@dataclass(frozen=True)
class Graph:
    """nodes, edges, communities and their members (both may be empty), inputs."""

    nodes: DataFrame
    edges: DataFrame
    communities: DataFrame
    members: DataFrame
    inputs: DataFrame
    schema: str = SCHEMA
    #: Ids are ``node_id`` of the labels, both ends of every edge are nodes, and confidences are of RANKS; so ids tell what versions share.
    whole: bool = False

    def with_(self, **parts) -> Graph:
        return replace(self, **parts)


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


def graph_of(nodes: DataFrame, edges: DataFrame, communities: DataFrame | None = None, members: DataFrame | None = None, inputs: DataFrame | None = None) -> Graph:
    spark = nodes.sparkSession
    return Graph(
        nodes,
        edges,
        empty(spark, COMMUNITIES) if communities is None else communities,
        empty(spark, MEMBERS) if members is None else members,
        empty(spark, INPUTS) if inputs is None else inputs,
    )
