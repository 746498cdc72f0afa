"""Token counts with overlap resynchronisation.

Ordinary texts are encoded whole. A huge text is encoded in overlapping chunks
with offsets; two neighbouring chunks are spliced at a *stable common boundary*,
and where none is found the overlap is widened until one is (at worst the rest
of the text is one chunk).

Why a boundary is stable: let p hold a single space between two characters that
aren't white space. Every tokenizer accepted here splits a text into words
before it merges, no word holds a space behind its first character, and the
choice of words from p on depends on nothing before p. So when p starts a word
in both chunks, what the later chunk says from p on is what the whole text says.
The last word of a chunk, and as many characters as the longest added token has,
may still change with the text that follows, and aren't used.

The same fact lets ``WordMemo`` look up short pieces between such spaces instead
of encoding them again: texts repeat words far more often than they bring new ones.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows
each get their row; other columns, also with clashing names, are dropped by
``count_tokens`` unless named in ``keep``; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import tidy

CHUNK = 1 << 16
OVERLAP = 1 << 10
#: Characters of texts that are looked up together.
TOGETHER = 1 << 20

_STABLE = re.compile(r"(?<=\S) (?=\S)")


class JsonTokenizer:
    """A ``tokenizers`` file: ids and character offsets without special tokens of its own."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.tk.no_padding()
        self.tk.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        self.reach = max([0, *map(len, self.added)])
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        #: Words are split by the byte-level pattern alone, so pieces between stable spaces are independent.
        self.by_piece = (
            not spec.get("normalizer")
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and model.get("type") == "BPE"
            and not model.get("dropout")
            and not any(" " in x for x in self.added)
        )

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tk.encode_batch_fast(texts, add_special_tokens=False)]

    def spans(self, text: str) -> tuple[list[int], list[tuple[int, int]], list]:
        e = self.tk.encode(text, add_special_tokens=False)
        return e.ids, e.offsets, e.word_ids


class PieceTokenizer:
    """A ``sentencepiece`` file. A piece has no space behind its first character, or texts are encoded whole."""

    by_piece = False
    added: list[str] = []
    reach = 0

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        mark = "▁"
        self.stable = not any(mark in self.sp.id_to_piece(i).lstrip(mark) for i in range(self.sp.get_piece_size()))

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.sp.encode(texts, num_threads=1)

    def spans(self, text: str) -> tuple[list[int], list[tuple[int, int]], list]:
        out = self.sp.encode(text, return_type="proto")
        ids, spans = [p.id for p in out.pieces], [(p.begin, p.end) for p in out.pieces]
        if not text.isascii():  # its offsets count bytes
            size = np.fromiter((len(c.encode()) for c in text), np.int64, len(text))
            chars = np.searchsorted(np.concatenate([[0], np.cumsum(size)]), np.array(spans).ravel())
            spans = list(map(tuple, chars.reshape(-1, 2).tolist()))
        return ids, spans, list(range(len(ids)))


@lru_cache(maxsize=4)
def load(path: str) -> JsonTokenizer | PieceTokenizer:
    return PieceTokenizer(path) if path.endswith(".model") else JsonTokenizer(path)


def _cuts(text: str, at: int, end: int, spans: list[tuple[int, int]], words: list) -> dict[int, int]:
    """Stable boundaries in text[at:end] by position, with the number of tokens before each."""
    out, reached = {}, 0
    for k, (s, e) in enumerate(spans):
        # between tokens k-1 and k, of different words; the space belongs to the later word or to none
        if k and words[k] != words[k - 1]:
            p = at + reached
            if p < end and text[p] == " " and not text[p - 1].isspace() and p + 1 < len(text) and not text[p + 1].isspace() and at + s >= p:
                out[p] = k
        reached = max(reached, e)
    return out


def encode_spliced(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """The ids of the whole text, from overlapping chunks."""
    if len(text) <= chunk or not getattr(tok, "stable", True):
        return np.array(tok.ids([text])[0], dtype=np.uint32)
    parts: list[np.ndarray] = []
    at, end = 0, chunk
    ids, spans, words = tok.spans(text[:end])
    first = 0  # tokens of this chunk that stand before the splice
    while end < len(text):
        last_word = next((k for k in range(len(words) - 1, 0, -1) if words[k] != words[k - 1]), 0)
        safe = min(at + (spans[last_word][0] if spans else 0), end - tok.reach)
        here = {p: k for p, k in _cuts(text, at, end, spans, words).items() if p <= safe and k >= first}
        width, done = min(overlap, end - at - 1), False
        while not done:
            start = end - width
            stop = min(len(text), start + max(chunk, 2 * width))
            new = tok.spans(text[start:stop])
            there = _cuts(text, start, stop, new[1], new[2])
            if common := [p for p in there if p in here]:
                p = common[len(common) // 2]
                parts.append(np.array(ids[first : here[p]], dtype=np.uint32))
                at, end, first = start, stop, there[p]
                ids, spans, words = new
                done = True
            elif width < end - at - 1:
                width = min(2 * width, end - at - 1)  # alignment failed: widen the overlap
            else:  # no common boundary in the whole chunk: take a longer one
                end = min(len(text), at + 2 * (end - at))
                ids, spans, words = tok.spans(text[at:end])
                break
    parts.append(np.array(ids[first:], dtype=np.uint32))
    return np.concatenate(parts)


def safe_slices(text: str, size: int = TOGETHER) -> Iterator[str]:
    """Slices of about ``size`` characters that end before stable spaces; they encode independently."""
    at = 0
    while len(text) - at > size:
        m = _STABLE.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class WordMemo:
    """Encodes many texts at once by looking words up in a table of bounded size.

    All texts of a group stand in one byte buffer. A *word* is what stands
    between two spaces, without a final punctuation mark behind a letter or a
    digit, which the pattern splits off anyway. Words are found, hashed and
    looked up with array operations; only new words go to the library, together.
    A word is found by a 64-bit hash and known by all its bytes, which every hit is
    compared with; a word of more than ``LONGEST`` bytes goes to the library each time
    it occurs. When the table is full it is emptied.

    A text whose spaces aren't all stable, or with an added token, goes to the
    library whole. The first word of a text has no space before it and is
    encoded by itself.
    """

    SLOTS = 1 << 21
    LONGEST = 64
    MARKS = b",.;:!?"

    def __init__(self, tok: JsonTokenizer):
        self.tok = tok
        rng = np.random.default_rng(11)
        self.of_byte = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = np.uint64(0x9E3779B97F4A7C15 | 1)
        self.undo = np.uint64(pow(int(self.base), -1, 2**64))
        self.power = self.unpower = np.ones(1, np.uint64)
        self.mark = np.zeros(256, np.uint32)
        self.is_mark, self.may_precede, self.white = (np.zeros(256, bool) for _ in range(3))
        for c in self.MARKS:
            own = tok.ids([chr(c)])[0]
            if len(own) == 1:
                self.mark[c], self.is_mark[c] = own[0], True
        self.may_precede[128:] = True
        for c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
            self.may_precede[c] = True
        self.white[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
        self.clear()

    def clear(self) -> None:
        self.slot_hash = np.zeros(self.SLOTS, np.uint64)
        self.slot_word = np.full(self.SLOTS, -1, np.int32)
        self.n = self.n_ids = self.n_chunks = 0
        cap = self.SLOTS // 2
        self.where, self.size = np.zeros(cap, np.int32), np.zeros(cap, np.int32)
        self.chunks = np.zeros(1 << 16, np.uint64)  # the words' bytes, eight at a time
        self.at, self.count = np.zeros(cap, np.int64), np.zeros(cap, np.int32)  # count -1: unsafe
        self.ids = np.zeros(1 << 16, np.uint32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of known words, -1 for others."""
        out = np.full(len(h), -1, np.int32)
        slot = (h >> np.uint64(43)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            word = self.slot_word[slot]
            hit = (word >= 0) & (self.slot_hash[slot] == h[todo])
            out[todo[hit]] = word[hit]
            more = (word >= 0) & ~hit
            todo, slot = todo[more], (slot[more] + 1) & (self.SLOTS - 1)
        return out

    def _put(self, h: np.ndarray, words: np.ndarray) -> None:
        """Distinct new hashes."""
        slot = (h >> np.uint64(43)).astype(np.int64)
        while len(h):
            free = self.slot_word[slot] < 0
            own = np.zeros(len(h), bool)
            _, first = np.unique(slot, return_index=True)
            own[first] = True
            own &= free
            self.slot_word[slot[own]], self.slot_hash[slot[own]] = words[own], h[own]
            h, words, slot = h[~own], words[~own], (slot[~own] + 1) & (self.SLOTS - 1)

    def _learn(self, buf: bytes, h: np.ndarray | None, start: np.ndarray, size: np.ndarray) -> None:
        """Words of distinct new hashes; without hashes, words that are numbered from ``n`` on until the next call only."""
        raw = [buf[a : a + n] for a, n in zip(start.tolist(), size.tolist(), strict=True)]
        texts = [x.decode() for x in raw]
        added = self.tok.added
        safe = [bool(t) and not t[0].isspace() and not t[-1].isspace() and not any(x in t for x in added) for t in texts]
        found = self.tok.ids([" " + t for t, ok in zip(texts, safe, strict=True) if ok])
        n, k = self.n, len(texts)
        size_of = np.full(k, -1, np.int32)
        size_of[np.array(safe, bool)] = [len(x) for x in found]
        flat = np.array([i for x in found for i in x], np.uint32)
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        while n + k > len(self.at):
            self.at, self.count = (np.concatenate([x, np.zeros(len(x), x.dtype)]) for x in (self.at, self.count))
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        kept = np.maximum(size_of, 0)
        self.at[n : n + k] = self.n_ids + np.cumsum(kept) - kept
        self.count[n : n + k] = size_of
        if h is None:
            return
        own = np.frombuffer(b"".join(x.ljust(-(-len(x) // 8) * 8, b"\0") for x in raw), "<u8")
        while self.n_chunks + len(own) > len(self.chunks):
            self.chunks = np.concatenate([self.chunks, np.zeros(len(self.chunks), np.uint64)])
        self.chunks[self.n_chunks : self.n_chunks + len(own)] = own
        wide = (size + 7) >> 3
        self.where[n : n + k], self.size[n : n + k] = self.n_chunks + np.cumsum(wide) - wide, size
        self._put(h, np.arange(n, n + k, dtype=np.int32))
        self.n, self.n_ids, self.n_chunks = n + k, self.n_ids + len(flat), self.n_chunks + len(own)

    def _same(self, word: np.ndarray, eight: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether each word's bytes are those that stand at ``start``."""
        same = self.size[word] == size
        for k in range(0, self.LONGEST, 8):
            todo = np.flatnonzero(same & (size > k))
            if not len(todo):
                break
            here = eight[start[todo] + k].copy().view("<u8").ravel()
            spare = np.uint64(8) * (8 - np.minimum(size[todo] - k, 8)).astype(np.uint64)
            same[todo] = here & (~np.uint64(0) >> spare) == self.chunks[self.where[word[todo]] + (k >> 3)]
        return same

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            self.power = np.cumprod(np.full(n, self.base)) * self.undo
            self.unpower = np.cumprod(np.full(n, self.undo)) * self.base

    def words(self, texts: list[bytes]):
        """Word numbers, marks and the text of every word; which texts need care.

        The buffer has a space behind each text and eight more bytes.
        """
        buf = b" ".join(texts) + b" " * 9
        a = np.frombuffer(buf, np.uint8)
        ends_of = np.cumsum([len(t) + 1 for t in texts])  # behind the space of each text
        sp = np.flatnonzero(a[: ends_of[-1]] == 32)
        start, end = np.concatenate([[0], sp[:-1] + 1]), sp
        text = np.searchsorted(ends_of, start, side="right")
        first = np.zeros(len(sp), bool)
        first[np.searchsorted(start, np.concatenate([[0], ends_of[:-1]]))] = True
        empty = start == end
        odd = empty & ~first | ~empty & (self.white[a[start]] | self.white[a[np.maximum(end - 1, 0)]])
        alone = first & empty & (ends_of[text] - 1 > start)  # a text that begins with a space
        care = np.bincount(text, weights=odd | alone, minlength=len(texts)) > 0
        care |= np.array([any(x.encode() in t for x in self.tok.added) for t in texts])
        ok = ~first & ~care[text]
        start, end, text = start[ok], end[ok], text[ok]
        mark = np.where((end - start > 1) & self.is_mark[a[end - 1]] & self.may_precede[a[np.maximum(end - 2, 0)]], a[end - 1], 0)
        size = end - start - (mark > 0)
        self._powers(len(a) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.of_byte[a] * self.power[: len(a)])])
        h = (sums[start + size] - sums[start]) * self.unpower[start]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        eight = np.lib.stride_tricks.as_strided(a, (len(a) - 7, 8), (1, 1))
        brief = size <= self.LONGEST
        word = np.full(len(h), -1, np.int32)
        word[brief] = self._find(h[brief])
        if (brief & (word < 0)).any():
            pos = np.flatnonzero(brief & (word < 0))
            new, at = np.unique(h[pos], return_index=True)
            if self.n + len(new) > self.SLOTS // 2:
                self.clear()
                pos = np.flatnonzero(brief)
                new, at = np.unique(h[pos], return_index=True)
                if len(new) > self.SLOTS // 2:
                    raise ValueError("too many words in one group of texts")
            self._learn(buf, new, start[pos[at]], size[pos[at]])
            word[brief] = self._find(h[brief])
        bad = ~brief
        bad[brief] = ~self._same(word[brief], eight, start[brief], size[brief])
        if not brief.all():
            self._learn(buf, None, start[~brief], size[~brief])
            word[~brief] = self.n + np.arange(int((~brief).sum()))
            bad[~brief] = False
        # a word of the same hash but other bytes, or one that isn't safe, or a mark behind no letter: care
        bad |= self.count[word] < 0
        wide = (mark > 0) & (a[np.maximum(end - 2, 0)] >= 128)
        for k in np.flatnonzero(wide & ~bad):
            bad[k] = not buf[max(start[k], end[k] - 5) : end[k] - 1].decode(errors="ignore")[-1:].isalnum()
        if bad.any():
            care[np.unique(text[bad])] = True
        return word, mark, text, care

    def _rest(self, texts: list[str], care: np.ndarray) -> list[list[int]]:
        """Ids of the first word of each text, or of the whole text where care is needed."""
        return self.tok.ids([t if c else t.split(" ", 1)[0] for t, c in zip(texts, care.tolist(), strict=True)])

    def counts(self, texts: list[str]) -> np.ndarray:
        word, mark, text, care = self.words([t.encode() for t in texts])
        out = np.bincount(text, weights=np.where(care[text], 0, self.count[word] + (mark > 0)), minlength=len(texts))
        return out.astype(np.int64) + np.array([len(x) for x in self._rest(texts, care)], np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        word, mark, text, care = self.words([t.encode() for t in texts])
        keep = ~care[text]
        word, mark, text = word[keep], mark[keep], text[keep]
        own = self.count[word].astype(np.int64)
        size = own + (mark > 0)
        end = np.cumsum(size)
        flat = np.empty(int(end[-1]) if len(end) else 0, np.uint32)
        marked = np.zeros(len(flat), bool)
        marked[end[mark > 0] - 1] = True
        flat[marked] = self.mark[mark[mark > 0]]
        before = np.cumsum(own) - own
        flat[~marked] = self.ids[np.repeat(self.at[word] - before, own) + np.arange(int(own.sum()))]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(text, weights=size, minlength=len(texts)).astype(np.int64))])
        rest = self._rest(texts, care)
        return [
            np.concatenate([np.array(r, np.uint32), flat[bounds[k] : bounds[k + 1]]]) if bounds[k + 1] > bounds[k] else np.array(r, np.uint32)
            for k, r in enumerate(rest)
        ]


def groups_of(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose lengths add up to about ``most``."""
    at = total = 0
    for k, n in enumerate(lengths):
        total += n
        if total >= most:
            yield at, k + 1
            at, total = k + 1, 0
    if at < len(lengths):
        yield at, len(lengths)


@lru_cache(maxsize=4)
def memo_of(path: str) -> WordMemo | None:
    tok = load(path)
    return WordMemo(tok) if tok.by_piece else None


def counts(path: str, texts: list[str], chunk: int, overlap: int) -> list[int]:
    """Tokens of each text."""
    tok, memo = load(path), memo_of(path)
    out = [0] * len(texts)
    short = [k for k, t in enumerate(texts) if len(t) <= chunk]
    for k, t in enumerate(texts):
        if len(t) > chunk:
            out[k] = len(encode_spliced(tok, t, chunk, overlap))
    for a, b in groups_of([len(texts[k]) for k in short], TOGETHER):
        own = short[a:b]
        if memo:
            found = memo.counts([texts[k] for k in own])
        else:
            found = [len(x) for x in tok.ids([texts[k] for k in own])]
        for k, n in zip(own, found, strict=True):
            out[k] = int(n)
    return out


def count_tokens(
    docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``keep`` columns, ``n_bytes`` and ``n_tokens`` of every row; one narrow stage, nothing is shuffled."""
    kept = [docs.schema[c] for c in keep]
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    from pyspark.sql import types as T

    schema = T.StructType([*kept, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            n = pa.array(counts(path, texts, chunk, overlap), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], size, n], names=[*keep, "n_bytes", "n_tokens"])

    return slim.mapInArrow(tidy(run), schema)
