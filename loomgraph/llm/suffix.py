"""Exact removal of long repeats with sparse suffix arrays in a logarithmic index family.

A byte goes when it is covered by a string of ``length`` bytes that also starts
anywhere else, in the same text or another.

*Anchors.* In each window of ``length`` bytes the gram of ``GRAM`` bytes with the
smallest hash is the window's anchor (the leftmost of equals). Equal windows have
equal anchors at equal places, so only windows of one anchor can be equal. A
*run* is a stretch of windows with one anchor; a run with the bytes of its
windows is a *fragment*. About one position in ninety is an anchor, a sparse
suffix.

*The family.* ``Index`` keeps texts and levels of suffixes in a folder. A new batch
becomes a level of its own; before, it is merged with the levels that are there
(by anchor, which is how suffixes begin) and scanned for windows that repeat. Levels
whose sizes are within a factor of two of each other merge, so there are
logarithmically many. A manifest, written last, names what is valid, so a batch
that was cut short leaves no trace and can be added again.

*Scan.* Suffixes are summed up by anchor. An anchor that occurs once repeats
nothing. Runs whose whole fragments are equal (by 128 bits: the anchor's hash and
the fragment's) repeat altogether. Only where fragments of one anchor differ are
their bytes compared: one fragment of each kind goes to the bucket of its anchor.

*Buckets.* A bucket takes its fragments in batches. A batch gets a suffix array of
the suffixes that start at anchors, is merge-scanned against the bucket's levels
(neighbours in merged order, as long as they share the anchor; what they share to
the right is the running minimum of the common prefixes, what they share to the
left is compared backwards), and becomes a level itself. Fragments of an anchor
with more than ``pairs`` kinds would meet too many neighbours: they get a dense
suffix array, sorted by ``length`` bytes by prefix doubling, whose equal
neighbours are the repeats. Both compare bytes. An anchor with more than
``hot_from`` kinds isn't brought to one task at all: its windows are summed up over
the cluster by 128 bits of hash. No group, match or text is left out at any size.

Joins deal out frequent anchors with a salt. Rows are numbered once, in the
index's own copy of the texts, and only that copy is read afterwards.

Defined cases: null texts are empty (``strip_repeats`` leaves them null); repeated rows are repeats of each other;
texts under ``length`` bytes lose nothing; empty tables give empty tables; columns
of the input may have any names.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import SchemaError
from ..operators.skew import frequent, salted_join
from ..session import discard, materialise, scratch_path
from ..versions import Conflict, Versions
from .memory import tidy
from .rows import BATCHES, number, packed

LENGTH, GRAM = 200, 24
#: Bytes of texts that are searched for anchors together, and windows of a long text taken at once.
TOGETHER = 1 << 18
#: Groups up to this size are compared by pairs in suffix order.
PAIRS = 64
#: Groups up to this size are compared inside one task.
HOT = 3_000
#: Fragments in a bucket, at the mean, and in a batch of it.
BUCKET, BATCH = 8_192, 4_096
#: Fragments whose dense suffix array is made at once, with those of the last anchor.
DENSE = 1_000

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9)]
def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _C[3]
    return h ^ (h >> np.uint64(29))


def find_runs(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of all texts: text, first window, windows, place of the anchor in the first window, anchor hash, fragment hash."""
    out: list[tuple] = []
    pieces: list[tuple[int, int, bytes]] = []
    held = 0
    for k, t in enumerate(texts):
        for at in range(0, len(t) - length + 1, TOGETHER):
            piece = t[at : at + TOGETHER + length - 1]
            pieces.append((k, at, piece))
            held += len(piece)
            if held >= TOGETHER:
                out.append(_runs(pieces, length))
                pieces, held = [], 0
    if pieces:
        out.append(_runs(pieces, length))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _runs(pieces: list[tuple[int, int, bytes]], length: int) -> tuple:
    from xxhash import xxh3_64_intdigest

    sizes = np.array([len(p) for *_, p in pieces])
    first = np.cumsum(sizes) - sizes
    buf = b"".join(p for *_, p in pieces) + bytes(GRAM + 8)
    n = int(sizes.sum())
    w = np.ndarray((n + GRAM,), "<u8", buf, 0, (1,)).copy()
    h = _mix(w[:n] * _C[0] ^ (w[8 : n + 8] * _C[1] + (w[16 : n + 16] * _C[2] >> np.uint64(7))))
    width = length - GRAM + 1
    low = np.uint64((1 << 24) - 1)
    key = (h & ~low) | np.arange(n, dtype=np.uint64)
    full = np.full(-(-n // width) * width + width, ~np.uint64(0), np.uint64)
    full[:n] = key
    grid = full.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)
    windows = sizes - length + 1
    edge = np.zeros(n + 1, np.int8)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + windows, -1)
    valid = np.cumsum(edge[:n]) > 0
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    new[first] = True
    start = np.flatnonzero(new)
    piece = np.searchsorted(first, start, side="right") - 1
    stop = np.minimum(np.append(start[1:], n), (first + windows)[piece])
    view = memoryview(buf)
    fragment = np.array([xxh3_64_intdigest(view[i:j]) for i, j in zip(start.tolist(), (stop - 1 + length).tolist(), strict=True)], np.uint64)
    text = np.array([k for k, *_ in pieces])[piece]
    base = np.array([at for _, at, _ in pieces])[piece]
    return text, base + start - first[piece], stop - start, anchor[start] - start, h[anchor[start]], fragment


class Level:
    """A sorted suffix array of fragments at their anchors, and which windows of each are repeated."""

    def __init__(self, right: np.ndarray, left: np.ndarray, sizes: np.ndarray, ids: np.ndarray, marks: np.ndarray):
        #: Bytes from the anchor on and, backwards, before it; how many of each are real; row numbers; changes of coverage by place of the anchor.
        self.right, self.left, self.sizes, self.ids, self.marks = right, left, sizes, ids, marks

    def __len__(self) -> int:
        return len(self.ids)

    @staticmethod
    def of(fragments: list[bytes], anchors: np.ndarray, ids: np.ndarray, length: int) -> Level:
        n, reach = len(fragments), length - GRAM
        right, left = np.zeros((n, length), np.uint8), np.zeros((n, reach), np.uint8)
        for k, (f, x) in enumerate(zip(fragments, anchors.tolist(), strict=True)):
            b = np.frombuffer(f, np.uint8)
            r = b[x : x + length]
            right[k, : len(r)] = r
            left[k, :x] = b[:x][::-1]
        sizes = np.stack([np.minimum([len(f) for f in fragments] - anchors, length), anchors], axis=1)
        out = Level(right, left, sizes, ids, np.zeros((n, reach + 2), np.int32))
        return out.take(out.order())

    def order(self) -> np.ndarray:
        return np.argsort(np.ascontiguousarray(self.right).view(f"S{self.right.shape[1]}").ravel(), kind="stable")

    def take(self, k: np.ndarray) -> Level:
        return Level(self.right[k], self.left[k], self.sizes[k], self.ids[k], self.marks[k])

    def merge(self, other: Level) -> Level:
        both = [np.concatenate(x) for x in zip((self.right, self.left, self.sizes, self.ids, self.marks), (other.right, other.left, other.sizes, other.ids, other.marks), strict=True)]
        out = Level(*both)
        return out.take(out.order())


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each two rows, at most so many bytes."""
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(first, most)


def scan(level: Level, side: np.ndarray | None, length: int) -> None:
    """Mark repeated windows of neighbours in suffix order that share their anchor; with ``side``, only between sides."""
    n = len(level)
    if n < 2:
        return
    sizes = level.sizes
    prefix = _common(level.right[:-1], level.right[1:], np.minimum(sizes[:-1, 0], sizes[1:, 0]))
    at, shared, gap = np.arange(n - 1), prefix.copy(), 1
    while True:
        go = shared >= GRAM
        at, shared = at[go], shared[go]
        if not len(at):
            return
        i, j = at, at + gap
        cross = slice(None) if side is None else side[i] != side[j]
        p, q, r = i[cross], j[cross], shared[cross]
        if len(p):
            lo = np.maximum(length - r, 0)  # places of the anchor in a window that is equal in both
            hi = _common(level.left[p], level.left[q], np.minimum(sizes[p, 1], sizes[q, 1]))
            found = lo <= hi
            for row in (p[found], q[found]):
                np.add.at(level.marks, (row, lo[found]), 1)
                np.add.at(level.marks, (row, hi[found] + 1), -1)
        gap += 1
        more = at + gap < n
        at, shared = at[more], shared[more]
        shared = np.minimum(shared, prefix[at + gap - 1])


class Family:
    """Levels of a bucket; each new batch is scanned against all, levels of equal size merge."""

    def __init__(self, length: int = LENGTH):
        self.length, self.levels = length, []

    def add(self, fragments: list[bytes], anchors: np.ndarray, ids: np.ndarray) -> None:
        new = Level.of(fragments, anchors, ids, self.length)
        scan(new, None, self.length)
        for k, old in enumerate(self.levels):
            both = Level(*[np.concatenate(x) for x in ((new.right, old.right), (new.left, old.left), (new.sizes, old.sizes), (np.arange(len(new)), np.arange(len(new), len(new) + len(old))), (np.zeros_like(new.marks), np.zeros_like(old.marks)))])
            both = both.take(both.order())
            scan(both, both.ids < len(new), self.length)
            own = both.ids < len(new)
            new.marks[both.ids[own]] += both.marks[own]
            self.levels[k].marks[both.ids[~own] - len(new)] += both.marks[~own]
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(a.merge(b))

    def repeated(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers with first and last place of the anchor in repeated windows, for each stretch of places."""
        out = []
        for level in self.levels:
            covered = np.cumsum(level.marks, axis=1) > 0
            edge = np.diff(covered.astype(np.int8), axis=1, prepend=0, append=0)
            row, lo = np.nonzero(edge > 0)
            _, hi = np.nonzero(edge < 0)
            out.append((level.ids[row], lo, hi - 1))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _places(fragments: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of each fragment: the fragment, the place in it, and the place in all of them joined."""
    sizes = np.array([len(f) for f in fragments])
    count = sizes - length + 1
    row = np.repeat(np.arange(len(sizes)), count)
    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return row, place, place + (np.cumsum(sizes) - sizes)[row]


def dense_ranks(fragments: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window: the fragment, the place, and its rank in the suffix array that is sorted by ``length`` bytes.

    Prefix doubling: ranks by 8 bytes, then by pairs of ranks, each sort doubling the bytes; equal ranks are equal bytes.
    """
    row, place, start = _places(fragments, length)
    buf = b"".join(fragments) + bytes(8)
    n = len(buf) - 8
    words = np.ndarray((n,), ">u8", buf, 0, (1,))
    width = min(8, length)
    if width < 8:
        words = words >> np.uint64(8 * (8 - width))
    rank = np.unique(words, return_inverse=True)[1]
    while width < length:
        step = min(width, length - width)
        ahead = np.zeros_like(rank)
        ahead[: n - step] = rank[step:]
        rank = np.unique(rank * np.int64(rank.max() + 1) + ahead, return_inverse=True)[1]
        width += step
    return row, place, rank[start]


def _stretches(row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of neighbouring places of one row, both in rising order: row, first, last."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
    at = np.flatnonzero(new)
    return row[at], place[at], place[np.append(at[1:], len(row))[: len(at)] - 1]


def compare_bucket(batches, length: int, pairs: int = PAIRS, batch: int = BATCH):
    """batches: (fragments, places of the anchor, sizes of groups, anchors). Yields numbers of fragments with stretches of repeated windows."""
    family, places, seen = Family(length), [], 0
    wide: dict[int, list[tuple[int, bytes]]] = {}
    for fragments, anchors, group, names in batches:
        small = np.flatnonzero(group <= pairs)
        for at in range(0, len(small), batch):
            k = small[at : at + batch]
            family.add([fragments[i] for i in k.tolist()], anchors[k], seen + k)
        for i in np.flatnonzero(group > pairs).tolist():
            wide.setdefault(int(names[i]), []).append((seen + i, fragments[i]))
        places.append(anchors)
        seen += len(fragments)
    ids, lo, hi = family.repeated()
    if len(ids):  # places of the anchor in windows, so a window begins at anchor - place
        x = np.concatenate(places)[ids]
        yield ids, x - hi, x - lo
    pool: list[tuple[int, bytes]] = []
    while wide:
        pool += wide.popitem()[1]
        if len(pool) >= DENSE or not wide:
            row, place, rank = dense_ranks([f for _, f in pool], length)
            twice = np.bincount(rank)[rank] > 1
            r, first, last = _stretches(row[twice], place[twice])
            yield np.array([k for k, _ in pool])[r], first, last
            pool = []


def scan_levels(new: DataFrame, levels: list[DataFrame], texts: DataFrame, length: int, pairs: int = PAIRS, hot_from: int = HOT, batch: int = BATCH) -> DataFrame:
    """Spans (row, lo, hi), which may overlap, of windows that repeat among the new suffixes or between them and the levels.

    new, levels: row, run, anchor, fragment. texts: row, bytes of all batches.
    """
    spark = new.sparkSession
    by = ["row", "run"]
    found = new
    if levels:
        begin = materialise(spark, new.select("anchor").distinct(), "new-anchors")
        for level in levels:
            found = found.unionByName(level.join(begin, "anchor", "left_semi").select(*new.columns))
    total = found.count()
    counts = materialise(spark, found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchor-counts")
    keys = frequent(counts, "anchor", "n", total)
    again = materialise(spark, salted_join(found, counts.select("anchor"), ["anchor"], keys, by, "left_semi"), "repeated-anchors")
    kinds = materialise(spark, again.groupBy("anchor", "fragment").agg(F.count("*").alias("n"), F.min(F.struct(*by)).alias("one")), "kinds")
    groups = materialise(spark, kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds-by-anchor")
    # whole fragments that repeat
    twice = kinds.where("n > 1").select("anchor", "fragment")
    whole = salted_join(again, twice, ["anchor", "fragment"], keys, by, "left_semi")
    whole = whole.select("row", F.shiftright("run", 16).alias("lo"), (F.shiftright("run", 16) + F.shiftright("run", 8).bitwiseAND(F.lit(255)) + (length - 1)).alias("hi"))
    whole = materialise(spark, whole, "whole")
    # one fragment of each kind where kinds differ
    different = salted_join(kinds, groups, ["anchor"], frequent(groups, "anchor", "kinds", kinds.count()), ["fragment"])
    asked = different.select("one.row", F.struct("one.run", "anchor", "kinds", F.col("n").alias("n")).alias("ask"))
    asked = asked.groupBy("row").agg(F.collect_list("ask").alias("asks"))
    with_text = texts.select("row", "bytes").join(asked, "row")

    def cut(batches):
        for b in batches:
            rows, data, asks = b.column(0).to_pylist(), b.column(1), b.column(2)
            for lo in range(0, b.num_rows, 256):
                out = []
                for r, t, own in zip(rows[lo : lo + 256], data.slice(lo, 256).to_pylist(), asks.slice(lo, 256).to_pylist(), strict=True):
                    for q in own:
                        at, n = q["run"] >> 16, q["run"] >> 8 & 255
                        out.append((q["anchor"], q["kinds"], q["n"] == 1, r, q["run"], t[at : at + n - 1 + length]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds_of, strict=True)], names=names)

    names = ["anchor", "kinds", "open", "row", "run", "data"]
    kinds_of = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
    cuts = materialise(spark, with_text.mapInArrow(tidy(cut), "anchor long, kinds long, open boolean, row long, run long, data binary"), "fragments")
    discard(again, kinds, counts)
    many = groups.where(f"kinds <= {hot_from}").agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
    buckets = max(1, -(-many // BUCKET), spark.sparkContext.defaultParallelism)

    def compare(batches):
        meta: list[tuple] = []

        def parts():
            for b in batches:
                run = b.column(2).to_numpy(zero_copy_only=False)
                meta.append((b.column(1).to_numpy(zero_copy_only=False), run, b.column(3).to_numpy(zero_copy_only=False)))
                yield b.column(4).to_pylist(), run & 255, b.column(0).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False)

        results = list(compare_bucket(parts(), length, pairs, batch))
        if meta:
            row, run, is_open = (np.concatenate(x) for x in zip(*meta, strict=True))
            for ids, first, last in results:
                keep = is_open[ids].astype(bool)
                k, at = ids[keep], run[ids[keep]] >> 16
                yield pa.RecordBatch.from_arrays([pa.array(row[k]), pa.array(at + first[keep]), pa.array(at + last[keep] + length)], names=["row", "lo", "hi"])

    near = cuts.where(f"kinds <= {hot_from}").repartition(buckets, "anchor").select("kinds", "row", "run", "open", "data", "anchor")
    near = near.mapInArrow(tidy(compare), "row long, lo long, hi long")

    def spread(batches):
        from xxhash import xxh3_128_digest

        for b in batches:
            run, row = b.column(1).to_numpy(zero_copy_only=False), b.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, b.num_rows, 512):
                data = b.column(2).slice(lo, 512).to_pylist()
                k, place, start = _places(data, length)
                view = memoryview(b"".join(data))
                h = [xxh3_128_digest(view[i : i + length]) for i in start.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array(row[lo + k]), pa.array((run[lo + k] >> 16) + place)], names=["h", "row", "at"])

    hot = cuts.where(f"kinds > {hot_from}").select("row", "run", "data").mapInArrow(tidy(spread), "h binary, row long, at long")
    repeated = hot.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    # a kind is one row here, so a window occurs at most once for each kind of its anchor
    far = hot.join(repeated, "h", "left_semi").select("row", F.col("at").alias("lo"), (F.col("at") + length).alias("hi"))
    out = materialise(spark, near.unionByName(far).unionByName(whole), "spans")
    discard(cuts, whole, groups)
    return out


class Index:
    """A family of levels in a folder: the numbered texts, the suffixes of each level, and the spans found so far."""

    def __init__(self, spark: SparkSession, path: str, length: int = LENGTH, **limits: int):
        self.spark, self.path, self.length, self.limits = spark, path, length, limits
        self.versions = Versions(spark, path)
        last = self.versions.latest()
        if last is None and any(not n.startswith(".") for n in self.versions._names()):
            raise SchemaError(f"{path} holds data but no whole manifest, so it is no index")
        self.base, self.state = last or (None, {"length": length, "texts": [], "levels": [], "spans": []})
        if self.state["length"] != length:
            raise ValueError("the index was built for another length")

    def _commit(self, state: dict) -> None:
        """The next numbered manifest; a batch that dies before it leaves the index as it was, and a second writer fails."""
        self.base = self.versions.commit(state, self.base)
        self.state = state

    def _write(self, df: DataFrame, name: str) -> str:
        return self.versions.write(df, name)

    def _tables(self, names: list[str]) -> list[DataFrame]:
        return [self.spark.read.parquet(f"{self.path}/{n}") for n in names]

    def add(self, docs: DataFrame, text: str = "text") -> None:
        """A batch of texts; a SchemaError if its columns aren't those of the other batches, or there are too many batches.

        One writer at a time: another that began before fails, and the index stays as the first left it.
        """
        if (self.versions.latest() or (None,))[0] != self.base:
            raise Conflict(f"{self.path} has a newer version than {self.base}")
        state = json.loads(json.dumps(self.state))
        columns = state.setdefault("columns", sorted(map(list, docs.dtypes)))
        if sorted(map(list, docs.dtypes)) != columns:
            raise SchemaError(f"the index holds {columns}, not {docs.dtypes}")
        if len(state["texts"]) >= BATCHES:
            raise SchemaError(f"an index holds {BATCHES} batches at most")
        data = docs.select(number(len(state["texts"])).alias("row"), packed(docs, text), F.encode(F.col(f"`{text}`"), "UTF-8").alias("bytes"))
        state["texts"].append(self._write(data, "texts"))
        length = self.length
        (own,) = self._tables(state["texts"][-1:])

        def runs(batches):
            for b in batches:
                rows = b.column(0).to_numpy(zero_copy_only=False)
                k, start, n, x, anchor, fragment = find_runs([t or b"" for t in b.column(1).to_pylist()], length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[k]), pa.array(start << 16 | n << 8 | x), pa.array(anchor.view(np.int64)), pa.array(fragment.view(np.int64))],
                    names=["row", "run", "anchor", "fragment"],
                )

        name = self._write(own.select("row", "bytes").mapInArrow(tidy(runs), "row long, run long, anchor long, fragment long"), "level")
        (new,) = self._tables([name])
        texts = self.texts(state)
        spans = scan_levels(new, self._tables([x["name"] for x in state["levels"]]), texts, length, **self.limits)
        state["spans"].append(self._write(spans, "spans"))
        discard(spans)
        state["levels"].append({"name": name, "suffixes": new.count()})
        stale = []
        while len(state["levels"]) > 1 and state["levels"][-2]["suffixes"] <= 2 * state["levels"][-1]["suffixes"]:
            both = [state["levels"].pop(), state["levels"].pop()]
            a, b = self._tables([x["name"] for x in both])
            state["levels"].append({"name": self._write(a.unionByName(b), "level"), "suffixes": sum(x["suffixes"] for x in both)})
            stale += [x["name"] for x in both]
        self._commit(state)
        for x in stale:
            p, fs = self.versions._place(x)
            fs.delete(p, True)

    def texts(self, state: dict | None = None) -> DataFrame:
        """row, cols (the other columns) and bytes of all batches."""
        first, *rest = self._tables((state or self.state)["texts"])
        for x in rest:
            first = first.unionByName(x)
        return first

    def found(self) -> DataFrame:
        """The spans of each row with any: row, spans."""
        first, *rest = self._tables(self.state["spans"])
        for x in rest:
            first = first.unionByName(x)
        return first.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def removed(index: Index, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, spans (array of first byte and end) and kept (the remaining bytes) of every text of the index."""
    texts = index.texts()
    both = texts.join(index.found(), "row", "left").select(F.col(f"cols.`{key}`"), "bytes", "spans")
    span = T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))
    schema = T.StructType([texts.schema["cols"].dataType[key], T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])

    def finish(batches):
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts, lists, merged, kept = [t or b"" for t in part.column(1).to_pylist()], part.column(2).to_pylist(), [], []
                for t, own in zip(texts, lists, strict=True):
                    out = joined(own)
                    merged.append([{"lo": lo, "hi": hi} for lo, hi in out])
                    kept.append(outside(t, out))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(merged, kind), pa.array(kept, pa.binary())], names=[key, "n_bytes", "spans", "kept"])

    return both.mapInArrow(tidy(finish), schema)


def joined(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Spans that overlap or touch as one, in order."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], hi)
        else:
            out.append((lo, hi))
    return out


def outside(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(hi for _, hi in spans)]
    return b"".join(data[a:z] for a, z in zip(ends, [*(lo for lo, _ in spans), len(data)], strict=True))


def _one_batch(docs: DataFrame, text: str, length: int, limits: dict) -> Index:
    index = Index(docs.sparkSession, scratch_path(docs.sparkSession, "suffix-index"), length, **limits)
    index.add(docs, text)
    return index


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, **limits: int) -> DataFrame:
    """``removed`` of an index that holds just these texts."""
    return removed(_one_batch(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), text, length, limits), key)


def strip_repeats(docs: DataFrame, text: str = "text", size: str | None = "n_chars", length: int = LENGTH, **limits: int) -> DataFrame:
    """``docs`` with repeats cut from the text; what a cut leaves of a character goes too. Texts with nothing left go.

    ``size``, if it is a column, is set to the characters of the new text.
    """
    index = _one_batch(docs, text, length, limits)
    names = docs.columns
    both = index.texts().join(index.found(), "row", "left")
    both = both.select(*[F.decode("bytes", "UTF-8").alias(c) if c == text else F.col(f"cols.`{c}`").alias(c) for c in names], F.col("spans").alias("__"))
    at = names.index(text)

    def cut(batches):
        for b in batches:
            new, keep = [], []
            for t, own in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                if own and t:
                    t = outside(t.encode(), joined(own)).decode(errors="ignore")
                new.append(t)
                keep.append(not own or bool(t))
            cols = [pa.array(new, pa.string()) if k == at else b.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep, pa.bool_()))

    out = both.mapInArrow(tidy(cut), docs.schema)
    if size in docs.columns:
        out = out.withColumn(size, F.char_length(F.col(f"`{text}`")).cast(docs.schema[size].dataType))
    return out


def digest(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    size = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["hi"] - s["lo"])
    return rows.select(F.col(f"`{key}`"), "n_bytes", size.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
