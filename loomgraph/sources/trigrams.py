"""A stored trigram index of labels, for searches that read only what the needle names.

Posting lists lie in blocks of ``BLOCK`` ids, delta-coded, in folders by a hash of the
trigram. A block's row begins with a skip entry: its first and last id and how many it
holds, so that a search sums up list lengths from three narrow columns, begins with
the rarest list and reads no block outside of the ids that are left. Batches of
labels are appended as numbered versions; lists of several batches are read together.

Defined cases: labels that are null or shorter than three characters have no trigrams
(a needle of fewer than three characters scans the labels); rows that repeat are one posting; an index
without batches finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from ..operators.search import find_by_label, trigram_index, trigrams_of
from ..session import scratch_path
from ..versions import Versions

#: Ids of a block, and folders of a batch.
BLOCK, BUCKETS = 128, 64
SKIP = "trigram string, block bigint, first bigint, last bigint, n bigint"


def bucket(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(BUCKETS)).cast("int")


def blocks(postings: DataFrame) -> DataFrame:
    """trigram, block, first, last, n, deltas of postings (trigram, id): a list of any length is ranked over ranges and cut."""
    placed = ranked(postings.distinct(), ["id"], ["trigram"], "rank").withColumn("block", F.floor((F.col("rank") - 1) / BLOCK).cast("bigint"))
    ids = F.array_sort(F.collect_list("id"))
    own = placed.groupBy("trigram", "block").agg(ids.alias("ids"))
    before = F.concat(F.slice("ids", 1, 1), F.slice("ids", 1, F.size("ids") - 1))
    deltas = F.zip_with("ids", before, lambda x, y: x - y)
    return own.select("trigram", "block", F.col("ids")[0].alias("first"), F.element_at("ids", -1).alias("last"), F.size("ids").cast("bigint").alias("n"), deltas.alias("deltas"))


def decoded(rows: DataFrame) -> DataFrame:
    """trigram, id of blocks."""
    start = F.array(F.col("first"))
    ids = F.aggregate(F.slice("deltas", 2, BLOCK), start, lambda done, d: F.concat(done, F.array(F.element_at(done, -1) + d)))
    return rows.select("trigram", F.explode(ids).alias("id"))


class TrigramIndex:
    """Batches of labels below ``path``."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.versions = Versions(spark, path or scratch_path(spark, "trigrams"))

    def _batches(self) -> tuple[int | None, list[str]]:
        n, note = self.versions.latest() or (None, {"batches": []})
        return n, note["batches"]

    def add(self, nodes: DataFrame) -> None:
        """A batch of nodes (id, label)."""
        base, batches = self._batches()
        name = self.versions.fresh("postings")
        rows = blocks(trigram_index(nodes)).withColumn("bucket", bucket(F.col("trigram")))
        rows.repartition("bucket").sortWithinPartitions("bucket", "trigram", "block").write.partitionBy("bucket").parquet(f"{self.versions.path}/{name}")
        self.versions.commit({"batches": [*batches, name]}, base)

    def lists(self, grams: list[str]) -> DataFrame:
        """Blocks of these trigrams; only their folders are read."""
        _, batches = self._batches()
        ddl = f"{SKIP}, deltas array<bigint>, bucket int"
        if not batches:
            return self.spark.createDataFrame([], ddl)
        rows = None
        for name in batches:
            own = self.spark.read.schema(ddl).parquet(f"{self.versions.path}/{name}")
            rows = own if rows is None else rows.unionByName(own)
        named = self.spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(g).alias("g"), bucket(F.lit(g)).alias("b")) for g in grams])).alias("x")).select("x.*").collect()
        return rows.where(F.col("bucket").isin(sorted({r.b for r in named})) & F.col("trigram").isin(grams))

    def candidates(self, needle: str) -> DataFrame | None:
        """id of the labels that hold all trigrams of the needle; None for a needle without any."""
        grams = trigrams_of(needle)
        if not grams:
            return None
        rows = self.lists(grams)
        skip = rows.groupBy("trigram").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")).collect()  # a row for each trigram
        if len(skip) < len(grams):
            return self.spark.createDataFrame([], "id bigint")
        rarest, *others = sorted(skip, key=lambda r: (r.n, r.trigram))
        low, high = max(r["first"] for r in skip), min(r["last"] for r in skip)
        near = rows.where((F.col("last") >= low) & (F.col("first") <= high))
        found = decoded(near.where(F.col("trigram") == rarest.trigram)).select("id").distinct()
        for r in others:
            found = found.join(decoded(near.where(F.col("trigram") == r.trigram)).select("id"), "id", "left_semi")
        return found

    def find(self, nodes: DataFrame, needle: str) -> DataFrame:
        """As ``find_by_label``: lists meet, then the label decides."""
        found = self.candidates(needle)
        return find_by_label(nodes if found is None else nodes.join(found, "id", "left_semi"), needle)
