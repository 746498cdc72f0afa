"""Exact similarity join of texts by their sets of word n-grams.

A text's words are lower-cased (A to Z); each ``size`` words in a row are a shingle,
known by a 64-bit hash. Two sets link when their Jaccard similarity is ``over`` /
``under`` or more; equal sets are one node, known by 128 bits.

*Tiles.* Sets that are similar enough share one of their first n - ceil(t n) + 1
shingles in any order that all sets follow, and their sizes lie in the same or in
neighbouring *bands*. A tile is such a shingle and a band: a set resides in the tiles
of its own band and visits those of the band below. The order puts frequent shingles
last, by a table of ``BUCKETS`` counts over all texts, which has one size whatever
the corpus; a wrong guess of frequency costs comparisons, never a link.

*Company.* Prefixes that are longer by some shingles have to share as many more. So
the prefix of each set is longer by one for every ``EXTRA`` shingles that a set like it
has to share, and sets of which too few first shingles are in another prefix leave
before there are tiles: those that met others by shingles whose frequency was guessed
wrong.

*Signatures.* Rows of tiles carry a hashed bitmap of the set. A bit that only one of
two sets has stands for a shingle, at least, that the other lacks, so bit counts
bound from above what two sets share. The join that meets the tiles leaves out pairs
that the small map of fixed size rules out; maps of four bits for each shingle rule
out most others. What is left is decided on the sorted arrays of both sets.

*Not all pairs.* What matters is who is reachable. First every set of a tile meets the
one that has most company, its *hub*, as the text that others were copied from does. Near copies
share dozens of tiles with one hub, so tiles of a band that have the same hub are put
together: what meets in any of them meets once. Then only sets in different components
meet. So a large group of near copies costs a comparison for each set, and no link
between two components is left out.

Defined cases: fewer than ``size`` words are one shingle; texts without words, and
null, have the empty set and are linked with nothing; every row of an id that
repeats is a document; rows without an id get the component of their text; an empty
table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.skew import frequent, salted_join
from ..session import discard, materialise
from .memory import tidy
from .near import Hashes, bitmap, may_share, most_shared, shingles, small_maps
from .near import words as map_words
from .rows import numbered
from .simhash import first_of

SHINGLE = 4
#: The least similarity as a fraction.
OVER, UNDER = 17, 20
#: Counts that the order of shingles rests on; a power of two.
BUCKETS = 1 << 18
#: A set's prefix is longer by one shingle for so many that it has to share.
EXTRA = 20
#: 64-bit words of a small map; a power of two.
WORDS = 8
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)


def _texts(named: DataFrame) -> DataFrame:
    return named.select("__row", F.encode(F.coalesce(F.col("__text"), F.lit("")), "UTF-8").alias("__bytes"))


def frequencies(named: DataFrame, size: int) -> np.ndarray:
    """How many shingles of all texts fall in each bucket."""

    def run(batches):
        memo, total = Hashes(), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                sets = [shingles(t, memo, size) for t in b.column(1).slice(lo, 512).to_pylist()]
                if sets:
                    total += np.bincount((np.concatenate(sets) >> _SHIFT).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counts = _texts(named).mapInArrow(tidy(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    t = counts.toArrow()  # BUCKETS rows at most
    out[t.column("bucket").to_numpy()] = t.column("n").to_numpy()
    return out


def fewest(n, over: int, under: int):
    """How many first shingles two sets share at least, if both have ``n``; no more than what they share."""
    return 1 + n * over // under // EXTRA


def sketches(named: DataFrame, size: int, over: int, under: int) -> DataFrame:
    """__row, set (128 bits of it), n (its size), keys (the first shingles in the order, ``fewest`` of its size more than a pair has to share one of, less one), bits (its bitmap), small (its small map)."""
    sent = named.sparkSession.sparkContext.broadcast(frequencies(named, size).astype(np.int64))

    def run(batches):
        from xxhash import xxh3_128_digest

        memo, counts = Hashes(), sent.value
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                sets = [shingles(t, memo, size) for t in part.column(1).to_pylist()]
                first = [s[np.lexsort((s, counts[(s >> _SHIFT).astype(np.int64)]))[: len(s) + (-over * len(s)) // under + fewest(len(s), over, under)]] if len(s) else s for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in first])])
                keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(first).view(np.int64)))
                small = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * WORDS, pa.int32()), pa.array(small_maps(sets, WORDS).ravel()))
                own = [pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), keys, pa.array([bitmap(s) for s in sets], pa.binary()), small]
                yield pa.RecordBatch.from_arrays([part.column(0), *own], names=["__row", "set", "n", "keys", "bits", "small"])

    return _texts(named).mapInArrow(tidy(run), "__row long, set binary, n long, keys array<long>, bits binary, small array<long>")


def shingle_sets(named: DataFrame, size: int) -> DataFrame:
    """node (a row's number) and items, sorted."""

    def run(batches):
        memo = Hashes()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sets = [shingles(t, memo, size) for t in part.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))], names=["node", "items"])

    return _texts(named).mapInArrow(tidy(run), "node long, items array<long>")


def _fit(over: int, under: int):
    """Bit counts, then arrays: functions over Arrow batches of pairs."""

    def bounded(batches):  # a, b, n_a, n_b, bits_a, bits_b
        for x in batches:
            if x.num_rows:
                n_a, n_b = x.column(2).to_numpy(), x.column(3).to_numpy()
                most = most_shared(x.column(4).to_pylist(), x.column(5).to_pylist(), n_a, n_b)
                yield x.select([0, 1]).filter(pa.array(most * (over + under) >= (n_a + n_b) * over))

    def exact(batches):  # a, b, items_a, items_b
        for x in batches:
            keep = np.zeros(x.num_rows, bool)
            for k in range(x.num_rows):
                p, q = (np.asarray(x.column(c)[k].values).view(np.uint64) for c in (2, 3))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep[k] = both * under >= (len(p) + len(q) - both) * over
            yield x.select([0, 1]).filter(pa.array(keep))

    return bounded, exact


def verified(pairs: DataFrame, light: DataFrame, named: DataFrame, size: int, over: int, under: int) -> DataFrame:
    """The pairs a, b that are similar enough. light: node, n, bits; nodes that many others meet are dealt out."""
    spark = pairs.sparkSession
    bounded, exact = _fit(over, under)
    pairs = materialise(spark, pairs, "pairs")
    total = pairs.count()
    hot = {x: frequent(pairs.groupBy(x).agg(F.count("*").alias("count")), x, "count", total) for x in "ab"}
    full = pairs
    for x, y in ("ab", "ba"):
        full = salted_join(full, light.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")), [x], hot[x], [y])
    full = materialise(spark, full.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(tidy(bounded), "a long, b long"), "possible")
    rows = full.select(F.explode(F.array("a", "b")).alias("__row")).distinct()
    sets = materialise(spark, shingle_sets(named.join(rows, "__row", "left_semi"), size), "sets")
    wide = full
    for x, y in ("ab", "ba"):
        wide = salted_join(wide, sets.select(F.col("node").alias(x), F.col("items").alias(f"items_{x}")), [x], hot[x], [y])
    out = materialise(spark, wide.select("a", "b", "items_a", "items_b").mapInArrow(tidy(exact), "a long, b long"), "similar")
    discard(pairs, full, sets)
    return out


def classes(named: DataFrame, size: int = SHINGLE, over: int = OVER, under: int = UNDER) -> DataFrame:
    """named: __row (long), __text, a table that gives the same rows again. Returns __row, n_shingles, component_id: a row's number that all of a component have in common."""
    spark = named.sparkSession
    own = materialise(spark, sketches(named, size, over, under), "sketches")
    nodes = own.where("n > 0").groupBy("set").agg(F.min("__row").alias("node"), F.count("*").alias("copies"))
    nodes = materialise(spark, nodes, "sets")
    light = own.join(nodes.select(F.col("node").alias("__row")), "__row", "left_semi").withColumnRenamed("__row", "node")
    keys = light.select("node", "n", F.posexplode("keys").alias("pos", "item"))
    shared = keys.groupBy("item").agg(F.count("*").alias("count")).where("count > 1")
    shared = materialise(spark, shared, "shared")
    total = shared.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    often = frequent(shared, "item", "count", total)
    met = materialise(spark, salted_join(keys, shared.hint("merge"), ["item"], often, ["node"]), "met")  # one way at every size
    # a set similar to one of n has n * over / under shingles or more
    enough = F.expr(f"1 + (n * {over} div {under}) * {over} div {under} div {EXTRA}")
    company = met.groupBy("node", "n").agg(F.count("*").alias("met"), F.sum("count").alias("degree")).where(F.col("met") >= enough)
    company = materialise(spark, company.select("node", "degree"), "company")
    light = materialise(spark, light.join(company.select("node"), "node", "left_semi").select("node", "n", "bits", "small"), "light")

    # tiles: residents, and visitors from the band above
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(under / over)).cast("int")
    first = met.where(F.expr(f"pos <= n - (n * {over} + {under} - 1) div {under}")).drop("count", "pos")
    tiles = first.join(company, "node").withColumn("own", band).withColumn("band", F.explode(F.array("own", F.col("own") - 1)))
    tiles = materialise(spark, tiles, "tiles")
    discard(met)
    size_of = tiles.groupBy("item", "band").agg(F.max(F.struct("degree", "node", "n")).alias("top"), F.count("*").alias("count"))
    hubs = materialise(spark, size_of.where("count > 1").select("item", "band", F.col("top.node").alias("hub"), F.col("top.n").alias("hub_n")), "hubs")
    led = salted_join(tiles.drop("degree"), hubs, ["item", "band"], often, ["node"]).select("hub", "hub_n", "band", "own", "node", "n").distinct()
    led = materialise(spark, led, "led")
    discard(tiles, hubs)
    near = led.where((F.col("node") != F.col("hub")) & (F.least("n", "hub_n") * under >= F.greatest("n", "hub_n") * over))
    stars = verified(near.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), light, named, size, over, under)

    linked = materialise(spark, components(stars), "linked")
    label = F.coalesce("root", "node")
    labelled = led.join(linked, "node", "left").select("hub", "band", "own", "node", "n", label.alias("label"))
    labelled = materialise(spark, labelled, "labelled")
    # a hub whose sets are all in one component is done
    per = labelled.groupBy("hub", "band").agg(F.max(F.when(F.col("node") == F.col("hub"), F.col("label"))).alias("hub_label"), F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("count"))
    mixed = materialise(spark, per.where("least <> most").select("hub", "band", "hub_label", "count"), "mixed")
    followed = mixed.groupBy("hub").agg(F.sum("count").alias("count"))
    often = frequent(followed, "hub", "count", labelled.count())
    rest = salted_join(labelled, mixed.drop("count"), ["hub", "band"], often, ["node"])
    rest = materialise(spark, rest.join(light.select("node", *map_words(WORDS)), "node"), "rest")
    discard(led, labelled)
    x, y = rest.where("label <> hub_label").alias("x"), rest.where("node <> hub").alias("y")
    fits = F.expr(f"least(x.n, y.n) * {under} >= greatest(x.n, y.n) * {over}")
    # a pair of visitors meets in its own band
    once = F.expr("x.hub = y.hub AND x.band = y.band AND x.label <> y.label AND (y.label = y.hub_label OR x.node < y.node) AND (x.own = x.band OR y.own = y.band)")
    others = x.join(y, once & fits & may_share("x", "y", over, under, WORDS))
    second = verified(others.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct(), light, named, size, over, under)
    reached = materialise(spark, components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(second)), "reached")

    hot = frequent(nodes, "set", "copies", own.count())
    placed = salted_join(own.select("__row", "set", F.col("n").alias("n_shingles")), nodes.select("set", "node"), ["set"], hot, ["__row"], "left")
    named_nodes = nodes.select("node", "copies").join(reached, "node", "left").select("node", "copies", label.alias("component_id"))
    hot_nodes = frequent(nodes, "node", "copies", own.count())
    out = salted_join(placed, named_nodes.select("node", "component_id"), ["node"], hot_nodes, ["__row"], "left")
    return out.select("__row", "n_shingles", F.coalesce("component_id", "__row").alias("component_id"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, over: int = OVER, under: int = UNDER) -> DataFrame:
    """For every row its key, n_shingles and component_id: the smallest key that can be reached over links."""
    spark = docs.sparkSession
    named = materialise(spark, numbered(docs.select(key, text)).select(F.col("row").alias("__row"), F.col(f"cols.`{key}`").alias("__key"), F.col(f"cols.`{text}`").alias("__text")), "texts")
    found = materialise(spark, classes(named.select("__row", "__text"), size, over, under).join(named.select("__row", "__key"), "__row"), "classes")
    roots = materialise(spark, found.groupBy("component_id").agg(F.min("__key").alias("least"), F.count("*").alias("count")), "roots")
    hot = frequent(roots, "component_id", "count", found.count())
    out = salted_join(found, roots.select("component_id", "least"), ["component_id"], hot, ["__row"])
    return out.select(F.col("__key").alias(key), "n_shingles", F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, over: int = OVER, under: int = UNDER) -> DataFrame:
    """One row of each component: of its smallest key. With five words and 4/5 the exact way to drop near copies."""
    named = numbered(docs)
    own = classes(named.select(F.col("row").alias("__row"), F.col(f"cols.`{text}`").alias("__text")), size, over, under)
    return first_of(named, own.select("__row", "component_id"), key, docs.columns)
