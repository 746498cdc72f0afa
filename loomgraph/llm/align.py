"""Alignment of two tokenizers' tokens, and corpus-wide counts of linked ids.

Tokens of A and B are cut into groups at the byte offsets where tokens of both end;
tokens of one group are linked. Running sums of token lengths give the ends, ends
that both sides have are the cuts, and a token's group is the number of cuts before
its end.

*Units.* This work isn't repeated for each occurrence of a word. A single space
between characters that are neither white space nor U+2581 ends a token of either
tokenizer, and what follows is cut into tokens as if nothing stood before it. So a
text is a sequence of units between such spaces, no group crosses a unit's border,
and each distinct unit of a bundle is tokenized and aligned once.

*Bundles* are texts of up to ``BUNDLE`` characters in a task, or one longer text. A
text leaves its task as sums, a digest and the id pairs it holds linked, by their
numbers in the bundle, with how many links each has. In how many documents a pair is
linked is summed over bundles by Spark; these counts come back to each bundle's
numbers by a join, and to its texts by another on the bundle. What is shuffled are
pairs of a bundle and numbers of pairs, neither tokens nor units.

Defined cases: texts that are null, empty, or whose joined token bytes differ from
those of the space and the text, as with U+2581, have no tokens: zeros, and an empty
digest; repeated rows are documents of their own and count as such; an empty table
gives an empty table; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .memory import tidy

#: Characters of a bundle's texts.
BUNDLE = 16 << 20
#: Units that are tokenized at once.
AT_ONCE = 4096
_MARK = "▁"
_EDGE = re.compile(rf"[\s{_MARK}] | (?:[\s{_MARK}]|\Z)")
_STABLE = re.compile(rf"(?<=[^\s{_MARK}]) (?=[^\s{_MARK}])")


def units(text: str) -> list[str]:
    """What stands behind the space before the text and behind each stable space; joined by spaces they are the text."""
    if not text:
        return []
    whole = " " + text
    if _EDGE.search(whole):
        first, *rest = _STABLE.split(whole)
        return [first[1:], *rest]
    return text.split(" ")


class Tokenizers:
    """Both tokenizers, without special tokens, and the bytes of each id."""

    def __init__(self, a: str, b: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.a.no_padding()
        self.a.no_truncation()
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [x for x in range(256) if x not in printable]
        byte_of = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(others)}
        size = self.a.get_vocab_size()
        entry = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [bytes(byte_of[c] for c in e) if all(c in byte_of for c in e) else e.encode() for e in entry]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        n = self.b.get_piece_size()
        piece = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(piece)]
        self.lengths = [np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes)]
        self.names = [str(i) for i in range(max(size, n))]

    def encode(self, own: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [e.ids for e in self.a.encode_batch_fast([" " + u for u in own], add_special_tokens=False)], self.b.encode(own, num_threads=1)


@lru_cache(maxsize=2)
def load(a: str, b: str) -> Tokenizers:
    return Tokenizers(a, b)


# Bundles --------------------------------------------------------------------------------------

_SUMS, _FIGURES = ("n_a", "n_b", "n_groups", "n_links"), ("n_best", "count_sum")


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers as compressed bytes, behind their count."""
    raw = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(numbers).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(pa.decompress(data[8:], 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view("<u8").ravel().astype(np.int64)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, … of each run, one after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def _counted(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and how often each comes, or the sum of its ``n``."""
    names, at = np.unique(keys, return_inverse=True)
    out = np.zeros(len(names), np.int64)
    np.add.at(out, at, 1 if n is None else n)
    return names, out


def _faithful(both: Tokenizers, own: list[str], tokens: tuple[list[list[int]], list[list[int]]]) -> np.ndarray:
    """Which units' token bytes are those of the space and the unit."""
    ok = np.ones(len(own), bool)
    data = [b" " + u.encode() for u in own]
    sizes, whole = np.fromiter(map(len, data), np.int64, len(own)), b"".join(data)
    for ids, of, length in zip(tokens, (both.a_bytes, both.b_bytes), both.lengths, strict=True):
        flat = list(chain.from_iterable(ids))
        upto = np.concatenate([[0], np.cumsum(length[flat])])[np.cumsum(list(map(len, ids)))] if flat else np.zeros(len(own), np.int64)
        if (upto == np.cumsum(sizes)).all() and b"".join(map(of.__getitem__, flat)) == whole:
            continue  # all of them, as is usual
        ok &= np.fromiter((b"".join(map(of.__getitem__, r)) == x for r, x in zip(ids, data, strict=True)), bool, len(own))
    return ok


def aligned(both: Tokenizers, own: list[str]):
    """For units: whether they have tokens, their sums, their groups as text, and unit, pair of ids, links of each pair in a unit."""
    tokens = both.encode(own)
    ok = _faithful(both, own, tokens)
    good = np.flatnonzero(ok)
    sums, texts = np.zeros((len(own), len(_SUMS)), np.int64), [b""] * len(own)
    none = np.zeros(0, np.int64)
    if not len(good):
        return ok, sums, texts, (none, none, none)
    ids, ends, last = [], [], None
    for k, side in enumerate(tokens):
        flat = np.fromiter(chain.from_iterable(side[u] for u in good.tolist()), np.int64)
        ids.append(flat)
        ends.append(np.cumsum(both.lengths[k][flat]))  # units lie one behind another, equally long on both sides
    last = ends[0][np.cumsum([len(tokens[0][u]) for u in good.tolist()]) - 1]
    cuts = np.intersect1d(*ends)
    unit = good[np.searchsorted(last, cuts)]
    group = [np.searchsorted(cuts, e) for e in ends]
    size = [np.bincount(g, minlength=len(cuts)) for g in group]
    for k, n in enumerate((size[0], size[1], np.ones(len(cuts), np.int64), size[0] * size[1])):
        np.add.at(sums[:, k], unit, n)

    names, (at_a, at_b) = both.names, (np.cumsum(n).tolist() for n in size)
    a, b = (list(map(names.__getitem__, i.tolist())) for i in ids)
    i = j = 0
    for u, p, q in zip(unit.tolist(), at_a, at_b, strict=True):
        here = f"{','.join(a[i:p])}|{','.join(b[j:q])}".encode()
        texts[u] = texts[u] + b";" + here if texts[u] else here
        i, j = p, q

    # ids that a group holds more than once meet once, with the product of their numbers
    (one, n_a), (two, n_b) = (_counted(g << 32 | i) for g, i in zip(group, ids, strict=True))
    first = np.searchsorted(two >> 32, np.arange(len(cuts) + 1))
    met = np.diff(first)[one >> 32]
    at = _spread(first[one >> 32], met)
    pairs = (np.repeat(one, met) & 0xFFFFFFFF) << 32 | two[at] & 0xFFFFFFFF
    kinds, of = np.unique(pairs, return_inverse=True)
    found, n = _counted(np.repeat(unit[one >> 32], met) * len(kinds) + of, np.repeat(n_a, met) * n_b[at])
    return ok, sums, texts, (found // len(kinds), kinds[found % len(kinds)], n)


class Bundle:
    """The units of some texts, each tokenized and aligned once, and the id pairs they hold, by number."""

    def __init__(self, both: Tokenizers):
        self.both, self.known, self.texts = both, {}, []
        self.ok, self.sums = np.zeros(0, bool), np.zeros((0, len(_SUMS)), np.int64)
        self.starts, self.held, self.links = np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.numbers: dict[int, int] = {}
        self.found = np.zeros(0, np.int64)

    def add(self, new: list[str]) -> None:
        parts = [(self.ok, self.sums, self.starts, self.held, self.links)]
        end = int(self.starts[-1])
        for lo in range(0, len(new), AT_ONCE):
            own = new[lo : lo + AT_ONCE]
            ok, sums, texts, (unit, pair, n) = aligned(self.both, own)
            names, at = np.unique(pair, return_inverse=True)
            held = np.array([self.numbers.setdefault(x, len(self.numbers)) for x in names.tolist()], np.int32)[at]
            parts.append((ok, sums, end + np.cumsum(np.bincount(unit, minlength=len(own))), held, n.astype(np.int32)))
            end += len(pair)
            self.texts += texts
        self.ok, self.sums, self.starts, self.held, self.links = map(np.concatenate, zip(*parts, strict=True))
        self.found = np.concatenate([self.found, np.zeros(len(self.numbers) - len(self.found), np.int64)])

    def take(self, texts: list[str]) -> list[tuple]:
        """Sums, digest, numbers of pairs and links of each text."""
        split = [units(t) for t in texts]
        new = [u for u in dict.fromkeys(chain.from_iterable(split)) if u not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.add(new)
        out, none = [], _pack(np.zeros(0, np.int64))
        for own in split:
            words = np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))
            if not len(words) or not self.ok[words].all():
                out.append(([0] * len(_SUMS), "", none, none))
                continue
            digest = hashlib.sha256()
            for lo in range(0, len(words), 1 << 16):  # a text's groups aren't put together in memory
                digest.update(b";" * (lo > 0) + b";".join(map(self.texts.__getitem__, words[lo : lo + (1 << 16)].tolist())))
            at = _spread(self.starts[words], self.starts[words + 1] - self.starts[words])
            held, n = _counted(self.held[at], self.links[at])
            self.found[held] += 1
            out.append((self.sums[words].sum(axis=0).tolist(), digest.hexdigest(), _pack(np.diff(held, prepend=0)), _pack(n)))
        return out


def bundled(docs: DataFrame, a: str, b: str, key: str, text: str, most: int) -> DataFrame:
    """Rows of two kinds, written once: bundle, key, sums, digest, held and links of each text; bundle, number, pair, n of each id pair: in how many of the bundle's texts it is linked."""
    slim = docs.select(F.col(f"`{key}`").alias("__key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    long, raw = T.LongType(), T.BinaryType()
    kinds = {"bundle": long, "key": slim.schema["__key"].dataType} | {c: long for c in _SUMS} | {"digest": T.StringType(), "held": raw, "links": raw, "number": long, "pair": long, "n": long}
    schema = T.StructType([T.StructField(c, t) for c, t in kinds.items()])

    def run(batches):
        both = load(a, b)
        task, made, held, now = TaskContext.get().partitionId(), 0, 0, Bundle(both)

        def pairs():
            n = len(now.numbers)
            own = [pa.nulls(n, kind), *[pa.nulls(n, pa.int64()) for _ in _SUMS], pa.nulls(n, pa.string()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]
            names = pa.array(now.numbers.keys(), pa.int64())
            yield from pa.table([pa.array(np.full(n, (task << 20) + made)), *own, pa.array(np.arange(n)), names, pa.array(now.found)], names=schema.names).to_batches(20_000)

        for x in batches:
            kind = x.column(0).type
            for lo in range(0, x.num_rows, 256):
                part = x.slice(lo, 256)
                texts = part.column(1).to_pylist()
                n, rows = len(texts), now.take(texts)
                sums = np.array([r[0] for r in rows], np.int64)
                own = [*[pa.array(sums[:, k]) for k in range(len(_SUMS))], pa.array([r[1] for r in rows], pa.string()), *[pa.array([r[k] for r in rows], pa.binary()) for k in (2, 3)]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, (task << 20) + made)), part.column(0), *own, *[pa.nulls(n, pa.int64())] * 3], names=schema.names)
                held += sum(map(len, texts))
                if held >= most:
                    yield from pairs()
                    held, made, now = 0, made + 1, Bundle(both)
        if now.numbers:
            yield from pairs()

    return materialise(docs.sparkSession, slim.mapInArrow(tidy(run), schema), "bundled")


def _summed(left: pa.Table, right: pa.Table) -> pa.Table:
    """n_best and count_sum of each text of a bundle, from its pairs' counts."""
    count, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
    at = right.column("number").to_numpy()
    count[at], best[at] = right.column("n_docs").to_numpy(), np.asarray(right.column("best").to_numpy(), np.int64)
    sums = np.zeros((left.num_rows, 2), np.int64)
    for k, (held, links) in enumerate(zip(left.column("held"), left.column("links"), strict=True)):
        own, n = np.cumsum(_unpack(held.as_py())), _unpack(links.as_py())
        sums[k] = (n * best[own]).sum(), (n * count[own]).sum()
    out = left.select(["key", *_SUMS, "digest"])
    for k, c in enumerate(_FIGURES):
        out = out.append_column(c, pa.array(sums[:, k]))
    return out


def align(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text", bundle: int = BUNDLE) -> tuple[DataFrame, DataFrame]:
    """For every row its key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256; and the corpus' pairs a_id, b_id, n_docs, best (of the A id)."""
    spark = docs.sparkSession
    work = bundled(docs, a, b, key, text, bundle)
    texts, pairs = work.where("pair IS NULL").select("bundle", "key", *_SUMS, "digest", "held", "links"), work.where("pair IS NOT NULL").select("bundle", "number", "pair", "n")
    counts = materialise(spark, pairs.groupBy("pair").agg(F.sum("n").alias("n_docs")), "pairs")
    best = counts.groupBy(F.shiftright("pair", 32).alias("a_id")).agg(F.max("n_docs").alias("most"))
    counts = counts.withColumn("a_id", F.shiftright("pair", 32)).join(best, "a_id")
    counts = materialise(spark, counts.select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best")), "pairs")
    own = pairs.join(counts, "pair").select(F.col("bundle").alias("own_bundle"), "number", "n_docs", "best")
    kinds = T.StructType([texts.schema[c] for c in ("key", *_SUMS, "digest")] + [T.StructField(c, T.LongType()) for c in _FIGURES])
    out = texts.groupBy("bundle").cogroup(own.groupBy("own_bundle")).applyInArrow(_summed, kinds)
    out = out.select(F.col("key").alias(key), *_SUMS, *_FIGURES, F.col("digest").alias("groups_sha256"))
    table = counts.select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b_id"), "n_docs", "best")
    return out, table
