"""Token budgets and content digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens
from ..model import Graph
from .ranks import prefix

#: Hexadecimal digits that deal rows of a digest to groups: 4096 groups.
GROUP_DIGITS = 3
#: Pieces of 60 bits of a row's digest that are summed up.
PIECES = 4


def pack(candidates: DataFrame, most: int, header: str = "", seed: str | None = None) -> DataFrame:
    """The rows (rank, piece) that fit: in order, up to the first that doesn't. Header and seed are always charged.

    Costs aren't negative, so running sums rise and what fits is a prefix; ranges of
    ranks behind the one where the budget ends aren't summed up.
    """
    base = sum(-(-len(s.encode()) // 4) for s in (header, seed or ""))
    cost = candidates.withColumn("cost", estimate_tokens(F.col("piece")))
    return prefix(cost, ["rank"], F.col("cost"), most - base).withColumn("used", F.col("used") + base)


def _part(c: Column) -> Column:
    s = c.cast("string")
    return F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)


def row_digests(df: DataFrame, section: str, columns: list[str]) -> DataFrame:
    """A digest for each row: fields with their lengths, under the section's name."""
    return df.select(F.sha2(F.concat(F.lit(f"{section}|"), *[_part(F.col(c)) for c in columns]), 256).alias("h"))


def digest_sums(rows: DataFrame) -> DataFrame:
    """One row: how many digests ``h`` there are, and sums of their ``PIECES`` pieces.

    A plain aggregate with partial results. Sums of two sets of rows add up to those of
    their union, and subtract: ``changed_sums``.
    """
    piece = lambda k: F.conv(F.substring("h", 15 * k + 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").cast("decimal(38,0)").alias("n"), *[F.coalesce(F.sum(piece(k)), F.lit(0)).cast("decimal(38,0)").alias(f"s{k}") for k in range(PIECES)])


def changed_sums(sums: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """``sums`` of one row after rows (digests h) came and went."""
    names = ["n", *[f"s{k}" for k in range(PIECES)]]
    parts = [(sums, 1), (digest_sums(added), 1), (digest_sums(removed), -1)]
    every = None
    for df, sign in parts:
        own = df.select(*[(F.col(c) * sign).cast("decimal(38,0)").alias(c) for c in names])
        every = own if every is None else every.unionByName(own)
    return every.agg(*[F.sum(c).cast("decimal(38,0)").alias(c) for c in names])


def digest_of(sums: DataFrame) -> DataFrame:
    """One row: the digest that the sums, modulo 2 ** 60, give."""
    parts = [F.col("n").cast("string"), *[F.pmod(F.col(f"s{k}"), F.lit(1 << 60).cast("decimal(38,0)")).cast("decimal(38,0)").cast("string") for k in range(PIECES)]]
    return sums.select(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16).alias("generation"))


def set_digest(rows: DataFrame) -> DataFrame:
    """One row: a digest of all digests ``h``, whatever their order; repeats count."""
    return digest_of(digest_sums(rows))


def ordered_digest(rows: DataFrame) -> DataFrame:
    """One row: a digest over all digests ``h`` in their order, repeats included.

    In two steps, by leading digits and then over the groups, so no task holds
    more than its share.
    """
    groups = rows.groupBy(F.substring("h", 1, GROUP_DIGITS).alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"))
    whole = groups.agg(F.array_sort(F.collect_list(F.concat("g", F.lit("="), "d"))).alias("all"))
    return whole.select(F.substring(F.sha2(F.array_join("all", ";"), 256), 1, 16).alias("generation"))


def graph_rows(g: Graph) -> DataFrame:
    """The digests of a graph's rows."""
    nodes = row_digests(g.nodes, "node", ["id", "label", "source_file", "start_byte", "end_byte", "start_line", "end_line"])
    edges = row_digests(g.edges, "edge", ["source", "target", "relation", "confidence"])
    communities = row_digests(g.communities, "community", ["id", "label"])
    members = row_digests(g.members, "member", ["community", "node"])
    return nodes.unionByName(edges).unionByName(communities).unionByName(members)


def generation_id(g: Graph) -> DataFrame:
    """Digest of nodes, edges and communities; not of inputs and schema. All rows' digests are put in order; sums of them would be easier to meet by other rows."""
    return ordered_digest(graph_rows(g))
