"""Keying, resolving, deduplicating and reconciling graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import node_id
from ..model import RANKS, Graph, graph_of
from .ranks import ranked

NODE_COLUMNS = ["label", "source_file", "start_byte", "end_byte", "start_line", "end_line"]
EDGE_KEY = ["source", "target", "relation"]


def first_wins(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key. An aggregate with partial results, so a hot key is reduced before it is shuffled.

    Nulls in the order come first; rows that tie on the whole order are told apart by their other columns.
    """
    rest = [c for c in df.columns if c not in key]
    first = F.min(F.struct(*[F.col(o).alias(f"o{k}") if isinstance(o, str) else o.alias(f"o{k}") for k, o in enumerate(order)], *rest))
    return df.groupBy(*key).agg(first.alias("__first")).select(*key, *[F.col(f"__first.{c}").alias(c) for c in rest]).select(*df.columns)


def intern_nodes(raw: DataFrame) -> DataFrame:
    """Nodes by label, the first occurrence wins; the id is a hash of the label."""
    kept = first_wins(raw.select(*NODE_COLUMNS, "file_ord", "row_ord"), ["label"], ["file_ord", "row_ord"])
    return kept.select(node_id(F.col("label")).alias("id"), *NODE_COLUMNS)


def id_collisions(nodes: DataFrame) -> DataFrame:
    """Number of nodes, of different ids, and of ids that several labels share."""
    per = nodes.groupBy("id").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.count("*").alias("ids"), F.count_if(F.col("n") > 1).alias("collisions"))


def _ends(raw: DataFrame, nodes: DataFrame, how: str) -> DataFrame:
    # nodes are hashed, so the many edges aren't sorted, which spilled
    s = nodes.select(F.col("label").alias("source"), F.col("id").alias("source_id")).hint("shuffle_hash")
    t = nodes.select(F.col("label").alias("target"), F.col("id").alias("target_id")).hint("shuffle_hash")
    return raw.join(s, "source", how).join(t, "target", how)


def resolve_edges(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """Labels of edges to ids; edges without both ends go. Other columns stay."""
    rest = [c for c in raw.columns if c not in ("source", "target")]
    return _ends(raw, nodes, "inner").select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), *rest)


def at_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose ends are both ids of ``nodes``; the rows then lie by source, and nodes are hashed, so edges are never sorted."""
    order = edges.columns
    for end in ("target", "source"):
        # not a semi join, which Spark moves below unions and aggregates, where it shuffles more rows
        edges = edges.join(nodes.select(F.col("id").alias(end)).distinct().hint("shuffle_hash"), end)
    return edges.select(*order)


def key_edges(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """As ``resolve_edges``, for nodes whose ids are ``node_id`` of their labels: ids come from the labels themselves, so no label is shuffled."""
    rest = [c for c in raw.columns if c not in ("source", "target")]
    ids = raw.select(node_id(F.col("source")).alias("source"), node_id(F.col("target")).alias("target"), *rest)
    return at_nodes(ids, nodes).select("source", "target", *rest)


def dangling_edges(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges that ``resolve_edges`` drops."""
    return _ends(raw, nodes, "left").where("source_id IS NULL OR target_id IS NULL").select(*raw.columns)


def dedup_edges(edges: DataFrame, order: list[Column | str]) -> DataFrame:
    """One edge for source, target and relation; the first one's confidence counts, not the best."""
    return first_wins(edges, EDGE_KEY, order)


def first_confidence(edges: DataFrame, order: str, tiers: tuple[str, ...] = RANKS) -> DataFrame:
    """As ``dedup_edges`` where confidences are of ``tiers`` and the order is one number without nulls.

    The first place of each tier is kept, so all that is aggregated has a fixed width, and Spark
    hashes keys; the struct of ``first_wins`` it sorts, before the shuffle and behind it.
    """
    places = [F.min(F.when(F.col("confidence") == t, F.col(order))).alias(f"__{t}") for t in tiers]
    first = F.least(*[F.when(F.col(f"__{t}").isNotNull(), F.struct(F.col(f"__{t}").alias("o"), F.lit(t).alias("confidence"))) for t in tiers])
    return edges.groupBy(*EDGE_KEY).agg(*places).select(*EDGE_KEY, first["confidence"].alias("confidence"))


def assemble(raw_nodes: DataFrame, raw_edges: DataFrame) -> Graph:
    nodes = intern_nodes(raw_nodes)
    edges = dedup_edges(resolve_edges(raw_edges, nodes), ["file_ord", "row_ord"])
    return graph_of(nodes, edges.select(*EDGE_KEY, "confidence"))


def counts(g: Graph) -> DataFrame:
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(g.nodes, "nodes").crossJoin(n(g.edges, "edges")).crossJoin(n(g.communities, "communities"))  # one row each


def labelled_edges(g: Graph) -> DataFrame:
    """Edges with labels for ids; unresolved ones go."""
    s = g.nodes.select(F.col("id").alias("source"), F.col("label").alias("source_label"))
    t = g.nodes.select(F.col("id").alias("target"), F.col("label").alias("target_label"))
    return g.edges.join(s, "source").join(t, "target").select("source_label", "target_label", "relation", "confidence")


def labelled_sides(*graphs: Graph) -> DataFrame:
    """Edges of several versions with labels for ids, and ``side``: two joins for all of them."""
    names = sided(*(g.nodes.select("id", "label") for g in graphs))
    out = sided(*(g.edges.select(*EDGE_KEY, "confidence") for g in graphs))
    for end in ("source", "target"):
        out = out.join(names.select("side", F.col("id").alias(end), F.col("label").alias(f"{end}_label")), ["side", end])
    return out.select("side", "source_label", "target_label", "relation", "confidence")


def keyed_sides(*graphs: Graph) -> DataFrame:
    """side, source, target, relation, confidence of several versions, with nodes named by what versions share: by ids, if all graphs are whole, else by labels."""
    if all(g.whole for g in graphs):
        return sided(*(g.edges.select(*EDGE_KEY, "confidence") for g in graphs))
    return labelled_sides(*graphs).withColumnsRenamed({"source_label": "source", "target_label": "target"})


def with_labels(edges: DataFrame, *graphs: Graph, ends: tuple[str, str] = ("target", "source")) -> DataFrame:
    """Edges of ``keyed_sides``, or what was made of them, with labels for source and target, which are looked up in the order of ``ends``."""
    if not all(g.whole for g in graphs):
        return edges
    names = None
    for g in graphs:
        own = g.nodes.select("id", "label")
        names = own if names is None else names.unionByName(own)
    names = names.distinct() if len(graphs) > 1 else names
    order = edges.columns
    for end in ends:
        edges = edges.withColumnRenamed(end, "__id").join(names.select(F.col("id").alias("__id"), F.col("label").alias(end)).hint("shuffle_hash"), "__id").drop("__id")
    return edges.select(*order)


def merge(a: Graph, b: Graph) -> Graph:
    """Both graphs in one; nodes are the same by label, and what a says of them counts.

    Communities are put behind each other unchanged, and so are inputs.
    """
    nodes = first_wins(sided(a.nodes.select(*NODE_COLUMNS), b.nodes.select(*NODE_COLUMNS)), ["label"], ["side"])
    nodes = nodes.select(node_id(F.col("label")).alias("id"), *NODE_COLUMNS)
    whole = a.whole and b.whole
    named = keyed_sides(a, b)
    edges = first_confidence(named, "side") if whole else dedup_edges(resolve_edges(named, nodes), ["side"]).select(*EDGE_KEY, "confidence")
    return Graph(nodes, edges, a.communities.unionByName(b.communities), a.members.unionByName(b.members), a.inputs.unionByName(b.inputs), a.schema, whole)


def sided(*parts: DataFrame) -> DataFrame:
    """Rows of several versions in one table, with ``side``, their version's place."""
    out = None
    for k, df in enumerate(parts):
        own = df.withColumn("side", F.lit(k))
        out = own if out is None else out.unionByName(own)
    return out


def sides_of(side: str = "side") -> Column:
    """An aggregate: the versions that hold a key, bit k for version k."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1), F.col(side)))


def _survivors(ours: DataFrame, theirs: DataFrame, base: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ours (side 0), or else of theirs (1), whose keys are new or were kept by both. One aggregate by the key over all three."""
    rest = [c for c in ours.columns if c not in key]
    first = F.min(F.when(F.col("side") < 2, F.struct("side", *rest)))  # a null, which min leaves out, for the base
    own = sided(ours, theirs, base).groupBy(*key).agg(first.alias("__first"), sides_of().alias("__sides"))
    kept = own.where((F.col("__sides") == 7) | F.col("__sides").between(1, 3))
    return kept.select(*key, *[F.col(f"__first.{c}").alias(c) for c in ["side", *rest]])


def merge3_nodes(base: Graph, ours: Graph, theirs: Graph) -> DataFrame:
    rows = _survivors(*(g.nodes.select(*NODE_COLUMNS) for g in (ours, theirs, base)), ["label"])
    return rows.select(node_id(F.col("label")).alias("id"), *NODE_COLUMNS)


def merge3_edges(base: Graph, ours: Graph, theirs: Graph, nodes: DataFrame) -> DataFrame:
    """The same rule for edges by labels and relation; both ends must have survived.

    Ends of all three versions are put in terms of the surviving nodes at once, so
    edges are shuffled by source, by target and by key, whatever the number of versions.
    """
    all_ = (ours, theirs, base)
    if all(g.whole for g in all_):
        return _merge3_whole(all_, nodes)
    ends = sided(*(g.nodes.select("id", "label") for g in all_)).join(nodes.select("label", F.col("id").alias("now")), "label")
    edges = sided(*(g.edges.select(*EDGE_KEY, "confidence") for g in all_))
    for end in ("source", "target"):
        edges = edges.join(ends.select("side", F.col("id").alias(end), F.col("now").alias(f"{end}_now")), ["side", end])
    named = edges.select("side", F.col("source_now").alias("source"), F.col("target_now").alias("target"), "relation", "confidence")
    first = F.min(F.when(F.col("side") < 2, F.struct("side", "confidence")))
    own = named.groupBy(*EDGE_KEY).agg(first.alias("__first"), sides_of().alias("__sides"))
    kept = own.where((F.col("__sides") == 7) | F.col("__sides").between(1, 3))
    return kept.select(*EDGE_KEY, F.col("__first.confidence").alias("confidence"))


def _merge3_whole(sides: tuple[Graph, Graph, Graph], nodes: DataFrame) -> DataFrame:
    """``merge3_edges`` by ids, in one aggregate that hashes. Edges that all versions hold have ends in all, which survive; only the ends of new ones are looked up."""
    own = keyed_sides(*sides).where("source IS NOT NULL AND target IS NOT NULL")  # as the joins below ask, so that both parts read one shuffle
    places = [F.min(F.when((F.col("side") < 2) & (F.col("confidence") == t), F.col("side"))).alias(f"__{t}") for t in RANKS]
    first = F.least(*[F.when(F.col(f"__{t}").isNotNull(), F.struct(F.col(f"__{t}").alias("o"), F.lit(t).alias("confidence"))) for t in RANKS])
    own = own.groupBy(*EDGE_KEY).agg(*places, sides_of().alias("__sides")).where((F.col("__sides") == 7) | F.col("__sides").between(1, 3))
    own = own.select(*EDGE_KEY, first["confidence"].alias("confidence"), "__sides")
    new = F.col("__sides") != 7
    return own.where(~new).select(*EDGE_KEY, "confidence").unionByName(at_nodes(own.where(new), nodes).select(*EDGE_KEY, "confidence"))


def _named_members(g: Graph) -> DataFrame:
    c = g.communities.select(F.col("id").alias("community"), F.col("label").alias("community_label"))
    n = g.nodes.select(F.col("id").alias("node"), F.col("label").alias("node_label"))
    return g.members.join(c, "community").join(n, "node").select("community_label", "node_label")


def merge3_communities(base: Graph, ours: Graph, theirs: Graph, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Communities by label under the same rule, ours' members first, numbered from 0, ours' before theirs'.

    Members that didn't survive go.
    """
    order = _survivors(*(g.communities.select("label", "id") for g in (ours, theirs, base)), ["label"])
    numbered = ranked(order, ["side", "id", "label"], name="number").withColumn("number", F.col("number") - 1)
    both = sided(_named_members(ours), _named_members(theirs))
    own = both.join(numbered.select(F.col("label").alias("community_label"), "side", "number"), ["community_label", "side"])
    own = own.join(nodes.select(F.col("label").alias("node_label"), F.col("id").alias("node")), "node_label")
    return numbered.select(F.col("number").alias("id"), "label"), own.select(F.col("number").alias("community"), "node").distinct()


def merge3(base: Graph, ours: Graph, theirs: Graph) -> Graph:
    nodes = merge3_nodes(base, ours, theirs)
    communities, members = merge3_communities(base, ours, theirs, nodes)
    return Graph(nodes, merge3_edges(base, ours, theirs, nodes), communities, members, ours.inputs.unionByName(theirs.inputs), ours.schema)


def prune(g: Graph, stale: DataFrame) -> Graph:
    """Without the nodes of stale files (a column path), the edges at them, and all communities."""
    nodes = g.nodes.join(stale.select(F.col("path").alias("source_file")), "source_file", "left_anti").select(*g.nodes.columns)
    return graph_of(nodes, at_nodes(g.edges, nodes).select(*g.edges.columns), inputs=g.inputs.join(stale.select("path"), "path", "left_anti"))
