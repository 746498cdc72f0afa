"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked.

A text's words are lower-cased (A to Z); each five words in a row are a shingle,
a text is the set of its shingles' 64-bit hashes. Equal sets are one node.

*SimHash first.* Each set has a SimHash fingerprint; fingerprints within ``DISTANCE``
bits are found by ``simhash.links``, and the pairs verified on the whole sets. That
links a part of them (a sixth on the check tables), as sets of similarity 0.8 differ
in ten of 64 bits at the mean, which no probing reaches at a bearable cost.

*What it can't reach.* Each set has ``BANDS`` keys, of ``ROWS`` minima each over hash
functions of its own. Sets of similarity s share a key with probability 1 - (1 -
s ** ROWS) ** BANDS, which leaves out one pair of similarity 0.8 in fourteen
thousand, and fewer above; ``jaccard.keep_one`` is the exact way. Sets that share a key are first compared with that of them
which shares most keys with any, as the text that others were copied from does; then those that aren't in its component are compared with all that share a key with
them and are in another, so a large group of near copies costs a comparison for each
key and set. Before whole sets are made again, bitmaps of their hashes bound from
above what two sets can share: a bit that only one has stands for a shingle, at
least, that the other lacks. Small maps of fixed size rule out most pairs as they
are joined, maps of four bits for each shingle nearly all others. What passes is
compared in full.

Sets are made from the texts where they are needed and never stored in full. Joins
deal out frequent keys and nodes with a salt.

Defined cases: a text of fewer than five words is one shingle; null texts and
those without words are equal; empty tables give empty tables; other columns may
have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from ..operators.skew import frequent as frequent_keys
from ..operators.skew import salted_join
from ..session import discard, materialise
from .memory import tidy
from .rows import numbered
from .simhash import DISTANCE, first_of, links

SHINGLE = 5
#: The least similarity as a fraction.
OVER, UNDER = 4, 5
#: Keys of a set, and minima in a key.
BANDS, ROWS = 24, 5
#: 64-bit words of a small map; a power of two.
WORDS = 16
#: Words that a worker remembers before it starts afresh.
MEMO = 50_000
#: Bits of a bitmap for each shingle, and at least.
BITS, FEWEST = 4, 64
_FAMILY = np.random.default_rng(29).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class Hashes(dict):
    """Word to hash, filled as words come."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        value = self[word] = xxh64_intdigest(word, 42)
        return value


def shingles(text: bytes, memo: Hashes, size: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of the distinct shingles of ``size`` words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(memo) > MEMO:
        memo.clear()
    w = np.array([memo[x] for x in words], np.uint64)
    n = max(1, len(w) - size + 1)
    h = np.full(n, min(len(w), size), np.uint64)
    for k in range(min(len(w), size)):
        h += w[k : k + n] * _ODD[k]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def _node(items: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(items.tobytes()) if len(items) else 0


def _texts(named: DataFrame) -> DataFrame:
    return named.select("__row", F.encode(F.coalesce(F.col("__text"), F.lit("")), "UTF-8").alias("__bytes"))


def fingerprint(items: np.ndarray) -> int:
    """Bits that are set in over half of the hashes, unsigned."""
    if not len(items):
        return 0
    ones = np.unpackbits(items.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(items)).tobytes(), "big")


def bitmap(items: np.ndarray) -> bytes:
    """A bit for each place that the leading bits of a hash name; as many places as a power of two, by the set's size."""
    width = max(FEWEST, 1 << (BITS * len(items) - 1).bit_length()) if len(items) else FEWEST
    flags = np.zeros(width, bool)
    flags[(items >> np.uint64(65 - width.bit_length())).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def _folded(maps: np.ndarray, width: int) -> np.ndarray:
    """Rows of bitmaps with neighbouring places put together until ``width`` bytes are left."""
    while maps.shape[1] > width:
        maps = np.packbits(np.unpackbits(maps, axis=1).reshape(len(maps), -1, 2).any(axis=2), axis=1)
    return maps


def most_shared(a: list[bytes], b: list[bytes], n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """For each two sets of bitmaps and sizes an upper bound of what they share."""
    out = np.zeros(len(a), np.int64)
    shapes = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    for la, lb in np.unique(shapes, axis=0).tolist():
        own = np.flatnonzero((shapes == (la, lb)).all(axis=1))
        x, y = (_folded(np.frombuffer(b"".join(s[k] for k in own.tolist()), np.uint8).reshape(len(own), -1), min(la, lb)) for s in (a, b))
        lacks = [np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64) for p, q in ((x, y), (y, x))]
        out[own] = np.minimum(n_a[own] - lacks[0], n_b[own] - lacks[1])
    return out


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """The keys of each set, a row each; without meaning for empty sets."""
    least = np.full((len(sets), BANDS * ROWS), ~np.uint64(0))
    for k, items in enumerate(sets):
        for lo in range(0, len(items), 4096):
            least[k] = np.minimum(least[k], (items[lo : lo + 4096, None] * _FAMILY).min(axis=0))
    h = (least.reshape(len(sets), BANDS, ROWS) * _ODD[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def small_maps(sets: list[np.ndarray], size: int = WORDS) -> np.ndarray:
    """A bit for each place that the leading bits of a hash name, as words, a row each."""
    flags = np.zeros((len(sets), 64 * size), bool)
    for k, items in enumerate(sets):
        flags[k, (items >> np.uint64(64 - 5 - size.bit_length())).astype(np.int64)] = True
    return np.packbits(flags, axis=1).view(np.int64)


def words(size: int = WORDS) -> list[Column]:
    """The small map as columns of its own, which compiled code reads without tests of an array's bounds."""
    return [F.coalesce(F.get("small", F.lit(k)), F.lit(0)).alias(f"s{k}") for k in range(size)]


def may_share(x: str, y: str, over: int = OVER, under: int = UNDER, size: int = WORDS) -> Column:
    """Whether the small maps of two rows let them share enough. x, y: aliases of rows with n and the map's ``words``."""
    words = [(F.col(f"{x}.s{k}"), F.col(f"{y}.s{k}")) for k in range(size)]
    lacks = [sum((F.bit_count(a.bitwiseAND(F.bitwise_not(b))) for a, b in pairs), F.lit(0)) for pairs in (words, [(b, a) for a, b in words])]
    most = F.least(F.col(f"{x}.n") - lacks[0], F.col(f"{y}.n") - lacks[1])
    return most * (over + under) >= (F.col(f"{x}.n") + F.col(f"{y}.n")) * over


def sketches(named: DataFrame) -> DataFrame:
    """__row, node (the hash of the set, 0 of none), fp, n (the set's size), bits (its bitmap), keys, small (its small map)."""

    def run(batches):
        memo = Hashes()
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                sets = [shingles(t, memo) for t in part.column(1).to_pylist()]
                longs = [np.array([f(s) for s in sets], np.uint64).view(np.int64) for f in (_node, fingerprint)]
                keys, small = (pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())) for x in (band_keys(sets), small_maps(sets)))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, longs), pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s) for s in sets], pa.binary()), keys, small], names=["__row", "node", "fp", "n", "bits", "keys", "small"])

    return _texts(named).mapInArrow(tidy(run), "__row long, node long, fp long, n long, bits binary, keys array<long>, small array<long>")


def shingle_sets(named: DataFrame) -> DataFrame:
    """node, items."""

    def run(batches):
        memo = Hashes()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                sets = [shingles(t, memo) for t in b.column(1).slice(lo, 256).to_pylist()]
                node = np.array([_node(s) for s in sets], np.uint64).view(np.int64)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                items = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node), items], names=["node", "items"])

    return _texts(named).mapInArrow(tidy(run), "node long, items array<long>")


def _sizes_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) * UNDER >= F.greatest(a, b) * OVER


def possible(pairs: DataFrame) -> DataFrame:
    """a, b and both rows, without pairs whose bitmaps rule out that they share enough."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                n_a, n_b = b.column(4).to_numpy(), b.column(5).to_numpy()
                most = most_shared(b.column(6).to_pylist(), b.column(7).to_pylist(), n_a, n_b)
                yield b.select([0, 1, 2, 3]).filter(pa.array(most * (OVER + UNDER) >= (n_a + n_b) * OVER))

    return pairs.select("a", "b", "row_a", "row_b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(tidy(run), "a long, b long, row_a long, row_b long")


def verified(pairs: DataFrame, light: DataFrame, named: DataFrame) -> DataFrame:
    """The pairs a, b whose sets are similar enough. light: node, row, n, bits of each node; named: __row, __text."""
    spark = pairs.sparkSession
    pairs = materialise(spark, pairs, "pairs")
    total, hot = pairs.count(), {}
    for x in "ab":  # a node that many others meet
        hot[x] = frequent_keys(pairs.groupBy(x).agg(F.count("*").alias("count")), x, "count", total)
    full = pairs
    for x, y in ("ab", "ba"):
        full = salted_join(full, light.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("row", "n", "bits")]), [x], hot[x], [y])
        if x == "b":
            full = full.where(_sizes_fit(F.col("n_a"), F.col("n_b")))
    full = materialise(spark, possible(full), "possible")
    rows = materialise(spark, full.select(F.col("row_a").alias("__row")).union(full.select("row_b")).distinct(), "rows")
    sets = materialise(spark, shingle_sets(named.join(rows, "__row", "left_semi")), "sets")
    one = sets.select(F.col("node").alias("a"), F.col("items").alias("__items"))
    two = sets.select(F.col("node").alias("b"), F.col("items").alias("__others"))
    both = F.size(F.array_intersect("__items", "__others"))
    wide = salted_join(salted_join(full.select("a", "b"), one, ["a"], hot["a"], ["b"]), two, ["b"], hot["b"], ["a"])
    out = materialise(spark, wide.where(both * (OVER + UNDER) >= (F.size("__items") + F.size("__others")) * OVER).select("a", "b"), "similar")
    discard(pairs, full, rows, sets)
    return out


def by_fingerprint(light: DataFrame) -> DataFrame:
    """Pairs a, b of nodes to verify: of equal fingerprints each with the smallest, of near fingerprints the smallest of either."""
    spark = light.sparkSession
    classes = materialise(spark, light.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("count")), "classes")
    same = salted_join(light.select("fp", "node"), classes.select("fp", "least"), ["fp"], frequent_keys(classes, "fp", "count", light.count()), ["node"])
    near = links(classes, DISTANCE).distinct()
    for x in "ab":
        near = near.join(classes.select(F.col("fp").alias(x), F.col("least").alias(f"node_{x}")), x)
    near = near.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    return same.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).unionByName(near)


def groups(named: DataFrame) -> DataFrame:
    """named: __row (long), __text, a table that gives the same rows again. For every row __row and component_id, a node that all rows of the component have in common."""
    spark = named.sparkSession
    own = materialise(spark, sketches(named), "sketches")
    light = own.groupBy("node").agg(F.min("__row").alias("row"), *[F.first(c).alias(c) for c in ("n", "fp", "bits", "small")])
    light = materialise(spark, light, "light")
    found = verified(by_fingerprint(light), light, named)
    # one row of each node
    first = own.join(light.select(F.col("row").alias("__row")), "__row", "left_semi").select("node", F.col("n").cast("int").alias("n"), F.explode("keys").alias("item")).where("n > 0")
    met = materialise(spark, first, "keys")
    items = met.groupBy("item").agg(F.count("*").alias("count")).where("count > 1")
    items = materialise(spark, items, "items")
    often = frequent_keys(items, "item", "count", met.count())
    several = materialise(spark, salted_join(met, items, ["item"], often, ["node"]), "several")
    degrees = several.groupBy("node").agg(F.sum("count").alias("degree"))
    several = materialise(spark, several.drop("count").join(degrees, "node"), "met")
    hubs = several.groupBy("item").agg(F.max(F.struct("degree", "node")).alias("top")).select("item", F.col("top.node").alias("hub"))
    shared = materialise(spark, salted_join(several.drop("degree"), hubs, ["item"], often, ["node"]), "met")
    discard(met, items, several)
    near = shared.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    stars = verified(near, light, named)
    linked = materialise(spark, components(found.unionByName(stars)), "linked")
    label = F.coalesce("root", "node")
    apart = materialise(spark, shared.join(linked, "node", "left").select("item", "node", "n", "hub", label.alias("label")), "labelled")
    # what isn't in the hub's component, and all it shares a key with
    hubs = apart.where("node = hub").select("item", F.col("label").alias("hub_label"))
    full = materialise(spark, salted_join(apart.drop("hub"), hubs, ["item"], often, ["node"]), "full")
    mixed = full.groupBy("item").agg(F.count_if(F.col("label") != F.col("hub_label")).alias("others")).where("others > 0").select("item")
    rest = materialise(spark, salted_join(full, mixed, ["item"], often, ["node"], "left_semi").join(light.select("node", *words()), "node"), "apart")
    discard(shared, apart, full)
    x, y = rest.where("label <> hub_label").alias("x"), rest.alias("y")
    others = x.join(y, F.expr("x.item = y.item AND x.label <> y.label AND (y.label = y.hub_label OR x.node < y.node)") & _sizes_fit(F.col("x.n"), F.col("y.n")) & may_share("x", "y"))
    second = verified(others.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct(), light, named)
    reached = materialise(spark, components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(second)), "reached")
    nodes = own.groupBy("node").agg(F.count("*").alias("count"))
    return salted_join(own.select("__row", "node"), reached, ["node"], frequent_keys(nodes, "node", "count", own.count()), ["__row"], "left").select("__row", label.alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: of its smallest key, and of rows that repeat that key one.

    Rows without a key are kept where their component has no other.
    """
    named = numbered(docs)
    return first_of(named, groups(named.select(F.col("row").alias("__row"), F.col(f"cols.`{text}`").alias("__text"))), key, docs.columns)
