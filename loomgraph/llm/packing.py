"""Packing documents into training sequences: order-preserving dynamic programming.

Documents keep their order; each is its token ids and one end id. The stream of
a partition is cut into windows of at most ``width`` tokens. A window is padded
to ``width`` unless its length is a power of two. Cuts stand at ends of documents
(no penalty), at ends of sentences, or, in stretches without either, at forced
positions; the plan minimises padding plus penalties:

    f[j] = penalty[j] + min over i of f[i] + padding(c[j] - c[i])

For windows that are padded, padding is width - (c[j] - c[i]), so the minimum is
that of f[i] + c[i] over a sliding range of i, which a monotone queue gives in
constant time. Lengths that are powers of two are looked up one by one.

One narrow stage: every partition packs its own documents, in blocks of bounded
size, so order is kept and memory doesn't grow with the input. A table's order is
that of its partitions; where rows are to be packed in another, ``order`` names it,
and they are range-sorted first. Sequence ids rise with that order.

Defined cases: a null or empty text is the end id alone; repeated rows are
documents of their own; a document longer than a block spans several blocks and
each of its ids is still in exactly one piece; an empty table gives no piece.
Columns other than the key and the text play no part.
"""

from __future__ import annotations

import zlib
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memory import tidy
from .tokens import TOGETHER, encode_spliced, groups_of, load, memo_of, safe_slices

WIDTH = 1024
#: Cost of a cut at the end of a sentence and of a forced cut, in tokens of padding.
SENTENCE, FORCED = 2, 4
#: Without a boundary for so many tokens, forced ones are offered at this spacing.
STRETCH = 32
#: A window that is left short at a power of two counts as so many tokens of padding.
SHORT = 1
#: Powers of two at which a short window may end; shorter ones would make very many sequences.
LEAST_SHORT = 128
#: Tokens that are planned together.
BLOCK = 1 << 18


def plan_cuts(at: np.ndarray, penalty: np.ndarray, width: int) -> list[int]:
    """Indices into ``at`` where windows end. at: rising positions from 0; gaps are at most ``width``."""
    n = len(at)
    jumps: dict[int, list[int]] = {}
    size = LEAST_SHORT
    while size < width:
        k = np.searchsorted(at, at - size)
        for j in np.flatnonzero((at >= size) & (at[np.minimum(k, n - 1)] == at - size)).tolist():
            jumps.setdefault(j, []).append(int(k[j]))
        size *= 2
    pos, cost = at.tolist(), penalty.tolist()
    f, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, n):
        c = pos[j]
        while pos[queue[0][1]] < c - width:
            queue.popleft()
        key, i = queue[0]
        best = key + width - c
        for k in jumps.get(j, ()):
            if f[k] + SHORT < best:
                best, i = f[k] + SHORT, k
        best += cost[j]
        f[j], back[j] = best, i
        key = best + c
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ender: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, from 0, and their penalties."""
    n = len(ids)
    ends = np.flatnonzero(ender[ids]) + 1
    at = np.unique(np.concatenate([[0, n], ends, doc_ends]))
    gap = np.diff(at)
    step = min(STRETCH, width)
    wide = np.flatnonzero(gap > step)
    if len(wide):
        k = (gap[wide] - 1) // step
        inner = np.repeat(at[wide], k) + step * (np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + 1)
        at = np.union1d(at, inner)
    penalty = np.full(len(at), float(FORCED))
    penalty[np.isin(at, ends)] = SENTENCE
    penalty[np.isin(at, doc_ends)] = 0
    penalty[[0, -1]] = 0
    return at, penalty


@lru_cache(maxsize=4)
def sentence_enders(path: str) -> np.ndarray:
    """For each id whether its text ends a sentence: with . ! ? or a line break."""
    tok = load(path)
    if hasattr(tok, "tk"):
        n = tok.tk.get_vocab_size()
        texts = [tok.tk.decode([i], skip_special_tokens=False) for i in range(n)]
    else:
        n = tok.sp.get_piece_size()
        texts = [tok.sp.decode([i]) for i in range(n)]
    return np.array([t[-1:] in (".", "!", "?", "\n") and t != "" for t in texts])


class Packer:
    """Collects documents to blocks and gives the pieces of each block."""

    def __init__(self, path: str, width: int, end_id: int, first: int):
        self.tok, self.memo, self.width, self.end_id = load(path), memo_of(path), width, end_id
        self.ender, self.sequence = sentence_enders(path), first
        self.clear()

    def clear(self) -> None:
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []  # key, ids of the document before this part, ids in the whole document
        self.held = 0

    def encode(self, texts: list[str]):
        """Ids of each text; of a huge one as a list of parts."""
        if not self.memo:
            return [encode_spliced(self.tok, t) for t in texts]
        out: list = [None] * len(texts)
        short = [k for k, t in enumerate(texts) if len(t) <= TOGETHER]
        for k, t in enumerate(texts):
            if len(t) > TOGETHER:
                # a slice from the second on begins with its stable space
                out[k] = np.concatenate([self._slice(s) for s in safe_slices(t)])
        for k, x in zip(short, self.memo.encode([texts[k] for k in short]), strict=True):
            out[k] = x
        return out

    def _slice(self, text: str) -> np.ndarray:
        return self.memo.encode([text])[0]

    def add(self, key, ids: np.ndarray):
        """Pieces of the blocks that this document fills."""
        total, at = len(ids) + 1, 0
        ids = np.append(ids, np.uint32(self.end_id))
        while at < total:
            part = ids[at : at + BLOCK]
            self.ids.append(part)
            self.docs.append((key, at, total))
            self.held += len(part)
            at += len(part)
            if self.held >= BLOCK:
                yield from self.flush()

    def flush(self):
        if not self.held:
            return
        ids = np.concatenate(self.ids)
        ends = np.cumsum([len(x) for x in self.ids])
        at, penalty = candidates(ids, ends, self.ender, self.width)
        cuts = at[plan_cuts(at, penalty, self.width)]
        stops = np.union1d(cuts, ends)
        starts = np.concatenate([[0], stops[:-1]])
        doc = np.searchsorted(ends, starts, side="right")
        window = np.searchsorted(cuts, starts, side="right")
        window_start = np.concatenate([[0], cuts])[window]
        begin = ends - np.array([len(x) for x in self.ids])
        raw = memoryview(ids.astype("<u4").tobytes())
        for a, b, d, w, s in zip(starts.tolist(), stops.tolist(), doc.tolist(), window.tolist(), window_start.tolist(), strict=True):
            key, before, total = self.docs[d]
            yield key, before + a - int(begin[d]), b - a, zlib.crc32(raw[4 * a : 4 * b]), total, self.sequence + w, a - s
        self.sequence += len(cuts)
        self.clear()


def file_order(docs: DataFrame) -> list[Column] | None:
    """The order in which a job wrote the files of this table, and of rows inside them; None if it isn't read from files."""
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("bigint")
    try:
        own = [part, F.col("_metadata.file_path"), F.col("_metadata.row_index")]
        docs.select(*own).schema  # noqa: B018
    except AnalysisException:
        return None
    return own


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", width: int = WIDTH, end_id: int = 0, order: list[Column] | None = None) -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence."""
    kept = docs.schema[key]
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField(key, kept.dataType), *[T.StructField(c, T.LongType()) for c in names[1:]]])
    slim = docs.select(F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`"), F.lit("")))
    if order:
        places = [f"p{k}" for k in range(len(order))]
        slim = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), *[c.alias(p) for c, p in zip(order, places, strict=True)])
        slim = slim.repartitionByRange(*places).sortWithinPartitions(*places).select(F.col("id").alias(key), "text")

    def run(batches):
        packer = Packer(path, width, end_id, TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []
        kind = None

        def out():
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=names)

        for b in batches:
            kind = b.schema.field(0).type
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in groups_of([len(t) for t in texts], TOGETHER):
                for k, ids in zip(keys[lo:hi], packer.encode(texts[lo:hi]), strict=True):
                    rows.extend(packer.add(k, ids))
                if len(rows) > 10_000:
                    yield out()
                    rows.clear()
        rows.extend(packer.flush())
        if rows:
            yield out()

    return slim.mapInArrow(tidy(run), schema)
