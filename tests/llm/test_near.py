"""Near copies against brute force over all pairs."""

from __future__ import annotations

import collections
import random

import numpy as np

import corpus_pipeline
from loomgraph.llm import near

DOCS = "doc_id long, text string, source string"


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _texts(seed, families, size, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(800)]
    line = " ".join(rng.choice(vocabulary) for _ in range(30))
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 200))]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(edits)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            base = own if rng.random() < 0.3 else base  # chains
            yield f"{line} {' '.join(own)}" if rng.random() < 0.7 else " ".join(own)


def test_keep_near_copies(spark):
    odd = [None, "", "  ", "one two", "One TWO", "one two three", "a b c d e", "a b c d e a b c d e"]
    rows = [(k, t, "s") for k, t in enumerate([*odd, *_texts(1, 40, 8, 7)])]
    sets = [_shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    direct = 0
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                direct += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {k for k in range(len(rows)) if root[k] == k}
    df = spark.createDataFrame(rows, DOCS)
    got = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()]
    assert sorted(got) == sorted(want) and direct > 100 and len(want) < len(rows) - 100
    # other rows of a key, and rows without one
    again = df.unionByName(df.limit(20)).unionByName(spark.createDataFrame([(None, rows[-1][1], "s"), (None, "quite another text", "s")], DOCS))
    assert collections.Counter(r.doc_id for r in near.keep_one(again).collect()) == collections.Counter([*want, None])
    none = near.keep_one(df.limit(0))
    assert none.count() == 0 and none.columns == df.columns


def test_bitmaps_bound_what_is_shared(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    sets = []
    for n in (1, 5, 60, 300, 900, 3000):
        base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        for share in (0.0, 0.1, 0.2, 0.5):
            own = base.copy()
            k = rng.random(len(own)) < share
            own[k] = rng.integers(0, 2**63, int(k.sum()), dtype=np.uint64)
            sets.append(np.unique(own))
    maps = near.small_maps(sets)
    rows = [(i, len(s), maps[i].tolist()) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "k long, n long, small array<long>").select("k", "n", *near.words())
    passed = {tuple(r) for r in df.alias("x").join(df.alias("y"), near.may_share("x", "y")).select("x.k", "y.k").collect()}
    ruled_out = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            shared = len(np.intersect1d(a, b))
            most = near.most_shared([near.bitmap(a)], [near.bitmap(b)], np.array([len(a)]), np.array([len(b)]))[0]
            assert most >= shared
            if 9 * shared >= 4 * (len(a) + len(b)):
                assert (i, j) in passed
            ruled_out += (i, j) not in passed
    assert ruled_out > 400
