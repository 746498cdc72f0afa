"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's words are lower-cased (A to Z) and taken in shingles, repeats included;
a bit of its 64-bit fingerprint is 1 if it is set in over half the shingles'
XXH64 hashes. Fingerprints that differ in at most ``distance`` bits are linked.

Search: the 64 bits are dealt to ``parts`` partitions, correlated bits together;
their number follows from that of the fingerprints by expected cost.
For thresholds t of at least -1 that sum to distance - parts + 1, two linked
fingerprints differ in at most t[i] bits within some partition i; that holds for
the thresholds of either of them alone. So every fingerprint chooses thresholds
of its own by dynamic programming on the number of candidates it must expect,
probes an index of exact partition values with all values within t[i] bits, and
verifies what it finds on the whole fingerprint. A partition in which its value
is frequent gets -1, no probe at all.

Expected candidates come from histograms of half partitions, tables of fixed
size; they steer the cost only, never the result. Texts of equal fingerprint are
one node, so copies add no links, and a fingerprint can't have more neighbours
than there are values within ``distance`` bits.

Defined cases: a text of fewer words than a shingle is one shingle; a null text
or one without words has the fingerprint 0, which links like any other; null ids
don't count as smallest id, a component of null ids alone has the id null;
repeated rows are rows of one component; empty tables give empty tables; other
columns may have any names: ``groups`` drops them, ``keep_one`` keeps them.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from ..operators.components import components
from ..operators.skew import frequent, salted_join
from .memory import tidy
from .rows import numbered, unpacked

SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Hashes that are summed up together.
TOGETHER = 1 << 17
#: What a probe and a candidate cost, relative to each other.
PROBE, VERIFY = 1.0, 0.2


def fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    from xxhash import xxh64_intdigest as xx

    ones, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held: list[int] = []
    owners: list[int] = []
    starts: list[int] = []

    def flush() -> None:
        if held:
            h = np.array(held, np.uint64)
            bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            np.add.at(ones, np.array(owners), np.add.reduceat(bits, np.array(starts), axis=0, dtype=np.int32))
            held.clear(), owners.clear(), starts.clear()

    for k, t in enumerate(texts):
        words = t.lower().split()
        if not words:
            continue
        plain = b" ".join(words)
        begin = list(accumulate((len(w) + 1 for w in words), initial=0))
        n = max(1, len(words) - shingle + 1)
        stop = begin[shingle:] if len(words) >= shingle else begin[-1:]
        total[k] = n
        for lo in range(0, n, TOGETHER):
            owners.append(k), starts.append(len(held))
            held += [xx(plain[a : b - 1], SEED) for a, b in zip(begin[lo : min(n, lo + TOGETHER)], stop[lo : lo + TOGETHER])]  # noqa: B905
            if len(held) >= TOGETHER:
                flush()
    flush()
    return np.packbits(ones * 2 > total[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def with_fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """key, fp: one narrow stage."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("fp", T.LongType())])
    slim = docs.select(F.col(f"`{key}`"), F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8").alias("__bytes"))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                fp = fingerprints(part.column(1).to_pylist(), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], names=[key, "fp"])

    return slim.mapInArrow(tidy(run), schema)


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each two bits how many have both: 64 by 64 whatever the input."""

    def run(batches):
        gram, n = np.zeros((64, 64)), 0
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            gram, n = gram + bits.T @ bits, n + len(h)
        if n:
            flat = gram.ravel().astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, 4096)), pa.array(np.concatenate([[n], flat]))], names=["k", "n"])

    sums = fps.select("fp").mapInArrow(tidy(run), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = {r.k: r.n for r in sums}
    return out.get(-1, 0), np.array([out.get(k, 0) for k in range(4096)], np.float64).reshape(64, 64)


def group_bits(n: int, gram: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of nearly equal width; each takes the bits most correlated with those it has. Bit 0 is the highest."""
    p = np.diag(gram) / max(n, 1)
    cov = gram / max(n, 1) - np.outer(p, p)
    scale = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    corr = np.abs(cov) / scale
    np.fill_diagonal(corr, 0)
    free, out = list(range(64)), []
    for k in range(parts):
        width = (64 - sum(map(len, out))) // (parts - k)
        sub = corr[np.ix_(free, free)]
        own = [free[int(sub.sum(axis=1).argmax())]]
        free.remove(own[0])
        while len(own) < width:
            best = max(free, key=lambda b: (corr[b, own].sum(), -b))
            own.append(best)
            free.remove(best)
        out.append(sorted(own))
    return out


def choose_parts(n: int, distance: int) -> int:
    """The number of partitions with the least expected cost of probes and candidates for n fingerprints of even bits.

    More fingerprints ask for fewer, wider partitions, so candidates don't grow with their square.
    """
    costs = {}
    for parts in range(2, max(2, distance + 1) + 1):
        best = [0.0] + [math.inf] * (distance + 1)  # by thresholds spent, each as t + 1
        for k in range(parts):
            width = 64 // parts + (k < 64 % parts)
            probes = [0, *accumulate(math.comb(width, t) for t in range(distance + 1))]
            cost = [m * (PROBE + VERIFY * n / 2**width) for m in probes]
            best = [min(best[total - t] + cost[t] for t in range(total + 1)) for total in range(distance + 2)]
        costs[parts] = best[distance + 1]
    return min(costs, key=lambda p: (costs[p], p))


def extract(h: np.ndarray, bits: list[int]) -> np.ndarray:
    """The named bits of each fingerprint as one number, the first named highest."""
    out = np.zeros(len(h), np.int64)
    for b in bits:
        out = out << 1 | ((h >> np.uint64(63 - b)) & np.uint64(1)).astype(np.int64)
    return out


def halves(bits: list[int]) -> tuple[list[int], list[int]]:
    return bits[: len(bits) // 2], bits[len(bits) // 2 :]


@lru_cache(maxsize=64)
def masks(width: int, most: int) -> np.ndarray:
    """All masks of at most ``most`` ones, by number of ones."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(width), k)], np.int64)


def histograms(fps: DataFrame, groups: list[list[int]]) -> list[list[np.ndarray]]:
    """For each partition and half, how often each value occurs: at most 2 ** 16 values each, as there are two partitions at least."""

    def run(batches):
        sums = [[np.zeros(1 << len(x), np.int64) for x in halves(g)] for g in groups]
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, g in enumerate(groups):
                for j, x in enumerate(halves(g)):
                    sums[k][j] += np.bincount(extract(h, x), minlength=1 << len(x))
        for k, both in enumerate(sums):
            for j, s in enumerate(both):
                v = np.flatnonzero(s)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), 2 * k + j, np.int32)), pa.array(v.astype(np.int32)), pa.array(s[v])], names=["half", "value", "n"])

    out = [[np.zeros(1 << len(x)) for x in halves(g)] for g in groups]
    found = fps.select("fp").mapInArrow(tidy(run), "half int, value int, n long").groupBy("half", "value").agg(F.sum("n").alias("n"))
    for r in found.collect():
        out[r.half // 2][r.half % 2][r.value] = r.n
    return out


def expected(histogram: list[list[np.ndarray]], groups: list[list[int]], n: int, distance: int) -> list[list[np.ndarray]]:
    """For each partition and half: by number of differing bits, how many fingerprints lie so far from each value."""
    out = []
    for g, both in zip(groups, histogram, strict=True):
        own = []
        for x, s in zip(halves(g), both, strict=True):
            at, width = np.arange(1 << len(x)), len(x)
            near = np.zeros((distance + 1, len(at)))
            for m in masks(width, min(distance, width)).tolist():
                near[m.bit_count()] += s[at ^ m]
            own.append(near)
        out.append(own)
    return out


def allocate(h: np.ndarray, groups: list[list[int]], near: list[list[np.ndarray]], n: int, distance: int) -> np.ndarray:
    """Thresholds of each fingerprint: least expected cost among all that sum to distance - partitions + 1."""
    budget = distance + 1  # a threshold t spends t + 1
    best = np.full((len(h), budget + 1), np.inf)
    best[:, 0] = 0
    chosen = []
    for g, (low, high) in zip(groups, near, strict=True):
        a, b = (extract(h, x) for x in halves(g))
        cost, within, probes = [np.zeros(len(h))], np.zeros(len(h)), 0
        for t in range(distance + 1):
            within = within + sum(low[k][a] * high[t - k][b] for k in range(t + 1)) / max(n, 1)
            probes = len(masks(len(g), t))
            cost.append(PROBE * probes + VERIFY * within)
        new, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
        for total in range(budget + 1):
            for spent in range(total + 1):
                c = best[:, total - spent] + cost[spent]
                better = c < new[:, total]
                new[better, total], pick[better, total] = c[better], spent
        best = new
        chosen.append(pick)
    out, left = np.zeros((len(h), len(groups)), np.int64), np.full(len(h), budget)
    for k in range(len(groups) - 1, -1, -1):
        spent = chosen[k][np.arange(len(h)), left]
        out[:, k], left = spent - 1, left - spent
    return out


def links(fps: DataFrame, distance: int = DISTANCE, parts: int | None = None) -> DataFrame:
    """Pairs a > b of distinct fingerprints that differ in at most ``distance`` bits. fps: fp, distinct. parts: chosen by cost if None."""
    n, gram = bit_statistics(fps)
    parts = parts or choose_parts(n, distance)
    groups = group_bits(n, gram, parts)
    near = expected(histograms(fps, groups), groups, n, distance)

    def probe(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                own = b.column(0).slice(lo, 4096).to_numpy(zero_copy_only=False)
                h = own.view(np.uint64)
                t = allocate(h, groups, near, n, distance)
                for k, g in enumerate(groups):
                    value = extract(h, g)
                    for most in np.unique(t[:, k]).tolist():
                        if most < 0:
                            continue
                        pick = np.flatnonzero(t[:, k] == most)
                        m = masks(len(g), most)
                        step = max(1, (1 << 18) // len(m))
                        for at in range(0, len(pick), step):
                            rows = pick[at : at + step]
                            key = (np.int64(k) << 60) | (value[rows][:, None] ^ m[None, :])
                            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(own[rows], len(m)))], names=["key", "fp"])

    def index(batches):
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            for k, g in enumerate(groups):
                yield pa.RecordBatch.from_arrays([pa.array((np.int64(k) << 60) | extract(own.view(np.uint64), g)), pa.array(own)], names=["key", "fp"])

    slim = fps.select("fp")
    p = slim.mapInArrow(tidy(probe), "key long, fp long").alias("p")
    i = slim.mapInArrow(tidy(index), "key long, fp long").alias("i")
    # thresholds differ between two fingerprints, so either may be the one whose probe finds the other
    near_enough = F.expr(f"p.key = i.key AND p.fp <> i.fp AND bit_count(p.fp ^ i.fp) <= {distance}")
    return p.join(i, near_enough).select(F.greatest("p.fp", "i.fp").alias("a"), F.least("p.fp", "i.fp").alias("b"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, parts: int | None = None) -> DataFrame:
    """For every row its key, fingerprint and component: the smallest key that can be reached over links."""
    spark = docs.sparkSession
    own = materialise(spark, with_fingerprint(docs, key, text, shingle), "fingerprints")
    classes = materialise(spark, own.groupBy("fp").agg(F.min(f"`{key}`").alias("least"), F.count("*").alias("n")), "classes")
    reached = materialise(spark, components(links(classes, distance, parts)), "reached")
    members = reached.join(classes, reached["node"] == classes["fp"])
    roots = materialise(spark, members.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "roots")
    linked = salted_join(reached, roots.drop("n"), ["root"], frequent(roots, "root", "n", reached.count()), ["node"])
    label = classes.join(linked.select(F.col("node").alias("fp"), "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    hot = frequent(classes, "fp", "n", own.count())  # texts that are copied very often
    return salted_join(own, label, ["fp"], hot, [F.col(f"`{key}`")]).select(
        f"`{key}`", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def first_of(named: DataFrame, own: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Of ``named`` (row, cols) the smallest (key, row) of each component, with its columns. own: __row, component_id."""
    # keys that are null come last
    place = named.select("row", F.struct(F.col(f"cols.`{key}`").isNull().alias("none"), F.col(f"cols.`{key}`").alias("key"), "row").alias("place"))
    first = own.select(F.col("__row").alias("row"), "component_id").join(place, "row").groupBy("component_id").agg(F.min("place").alias("place"))
    return unpacked(named.join(first.select(F.col("place.row").alias("row")), "row", "left_semi"), columns)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, parts: int | None = None) -> DataFrame:
    """One row of each component: of its smallest key, and of rows that repeat that key one.

    Rows without a key are kept where their component has no other.
    """
    named = numbered(docs)
    own = groups(named.select(F.col("row").alias("__row"), F.col(f"cols.`{text}`").alias("__text")), "__row", "__text", shingle, distance, parts)
    return first_of(named, own, key, docs.columns)
