"""Arcs between labels, and what changed between two versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from .analytics import community_sizes
from .build import keyed_sides, labelled_edges, sided, sides_of, with_labels

# The relations that count as arcs.
DEFAULT_RELATIONS = ("calls", "imports_from", "method", "defines")
ARC = ["producer", "consumer", "relation"]


def extract_arcs(g: Graph, relations: tuple[str, ...] = DEFAULT_RELATIONS) -> DataFrame:
    chosen = g.with_(edges=g.edges.where(F.col("relation").isin(*relations)))
    return labelled_edges(chosen).select(F.col("source_label").alias("producer"), F.col("target_label").alias("consumer"), "relation").distinct()


def diff_arcs(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """The expected arcs, repeats included, with ``present``."""
    marked = actual.select(*ARC).distinct().withColumn("present", F.lit(True))
    return expected.join(marked, ARC, "left").select(*ARC, F.coalesce("present", F.lit(False)).alias("present"))


def coherence(diff: DataFrame) -> DataFrame:
    """One row: present and expected arcs, and their ratio, 1 if none is expected."""
    one = diff.agg(F.count_if("present").alias("n_present"), F.count("*").alias("n_expected"))
    return one.withColumn("coherence", F.when(F.col("n_expected") == 0, 1.0).otherwise(F.col("n_present") / F.col("n_expected")))


def diff_reports(before: DataFrame, after: DataFrame) -> DataFrame:
    """Arcs that were severed or healed between two diffs, with ``change``."""
    b, a = (d.where("NOT present").select(*ARC) for d in (before, after))
    new = a.join(b, ARC, "left_anti").withColumn("change", F.lit("severed"))
    return new.unionByName(b.join(a, ARC, "left_anti").withColumn("change", F.lit("healed")))


def coherence_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: the change of coherence, and whether it is a regression or a recovery.

    A regression has newly severed arcs, a recovery newly healed and no newly severed ones.
    """
    kinds = diff_reports(before, after).agg(F.count_if(F.col("change") == "severed").alias("n_severed"), F.count_if(F.col("change") == "healed").alias("n_healed"))
    b = coherence(before).select(F.col("coherence").alias("was"))
    a = coherence(after).select(F.col("coherence").alias("now"))
    one = kinds.crossJoin(b).crossJoin(a)  # one row each
    return one.select("n_severed", "n_healed", (F.col("now") - F.col("was")).alias("delta"), (F.col("n_severed") > 0).alias("is_regression"), ((F.col("n_healed") > 0) & (F.col("n_severed") == 0)).alias("is_recovery"))


def _has(k: int) -> Column:
    return F.col("sides").bitwiseAND(F.lit(1 << k)) != 0


def _by_side(graphs: tuple[Graph, ...], relations: tuple[str, ...]) -> DataFrame:
    """The arcs of the first graph, with the graphs that have them."""
    chosen = [g.with_(edges=g.edges.where(F.col("relation").isin(*relations))) for g in graphs]
    rows = keyed_sides(*chosen).select("side", F.col("source").alias("producer"), F.col("target").alias("consumer"), "relation")
    return rows.groupBy(*ARC).agg(sides_of().alias("sides")).where(_has(0))


def arcs_of_versions(expected: Graph, before: Graph, after: Graph, relations: tuple[str, ...] = DEFAULT_RELATIONS) -> DataFrame:
    """Each expected arc once, with whether it is present ``before`` and ``after``: what two diffs say, in one aggregate.

    Arcs of whole graphs are told apart by ids; ``named_arcs`` gives them their labels.
    """
    return _by_side((expected, before, after), relations).select(*ARC, _has(1).alias("before"), _has(2).alias("after"))


def named_arcs(arcs: DataFrame, expected: Graph, *others: Graph) -> DataFrame:
    """Rows of ``arcs_of_versions`` of these graphs, or some of them, with labels. Each arc is in the expected graph, so are its ends."""
    if not all(g.whole for g in (expected, *others)):
        return arcs
    return with_labels(arcs.withColumnsRenamed({"producer": "source", "consumer": "target"}), expected).withColumnsRenamed({"source": "producer", "target": "consumer"})


def version_diff(expected: Graph, actual: Graph, relations: tuple[str, ...] = DEFAULT_RELATIONS) -> DataFrame:
    """What ``diff_arcs`` says of the arcs of two graphs, each expected arc once, in one aggregate; arcs are told apart as in ``arcs_of_versions``."""
    return _by_side((expected, actual), relations).select(*ARC, _has(1).alias("present"))


def version_changes(arcs: DataFrame) -> DataFrame:
    """Arcs that were severed or healed between the two versions of ``arcs_of_versions``, with ``change``."""
    return arcs.where(F.col("before") != F.col("after")).select(*ARC, F.when(F.col("before"), "severed").otherwise("healed").alias("change"))


def version_summary(arcs: DataFrame) -> DataFrame:
    """What ``coherence_delta`` says of the two versions of ``arcs_of_versions``."""
    b, a = F.col("before"), F.col("after")
    one = arcs.agg(F.count_if(b & ~a).alias("n_severed"), F.count_if(a & ~b).alias("n_healed"), F.count_if(b).alias("was"), F.count_if(a).alias("now"), F.count("*").alias("n"))
    ratio = lambda c: F.when(F.col("n") == 0, 1.0).otherwise(F.col(c) / F.col("n"))
    return one.select("n_severed", "n_healed", (ratio("now") - ratio("was")).alias("delta"), (F.col("n_severed") > 0).alias("is_regression"), ((F.col("n_healed") > 0) & (F.col("n_severed") == 0)).alias("is_recovery"))


def live_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Arcs of one version that the other lacks, with ``change``."""
    own = sided(before.select(*ARC), after.select(*ARC)).groupBy(*ARC).agg(sides_of().alias("sides"))
    return own.where("sides < 3").select(*ARC, F.when(F.col("sides") == 1, "severed").otherwise("healed").alias("change"))


def live_coherence(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: the change in the number of arcs, relative to the larger number, 0 for two empty versions."""
    n = lambda df, c: df.select(*ARC).distinct().agg(F.count("*").alias(c))
    both = n(before, "n_before").crossJoin(n(after, "n_after"))  # one row each
    most = F.greatest("n_before", "n_after")
    return both.withColumn("delta", F.when(most == 0, 0.0).otherwise((F.col("n_after") - F.col("n_before")) / most))


def registrations(members: DataFrame, communities: DataFrame, prefix: str = "graph.community.") -> DataFrame:
    """A record for each community: its name, label without controls, and size."""
    from ..functions.text import sanitize_label

    sizes = community_sizes(members).withColumnRenamed("community", "id")
    return communities.join(sizes, "id", "left").select(F.concat(F.lit(prefix), F.col("id")).alias("sphere"), sanitize_label(F.col("label")).alias("label"), F.coalesce("members", F.lit(0)).alias("members"))
