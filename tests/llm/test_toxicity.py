"""Kneser-Ney models against a plain Python version."""

import collections
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import queries, toxicity

rng = random.Random(4)
STEMS = [f"{a}{b}{c}" for a in "bdfk" for b in "aeo" for c in ("", "ra", "stin", "lomur")]


def corpus(n=240):
    out = []
    for k in range(n):
        toxic = k % 4 == 0
        ws = [rng.choice(STEMS) + rng.choice(["", "a", "ig", "ot"]) for _ in range(rng.randint(0, 60))]
        ws += [f"rare{chr(97 + k % 26)}{chr(97 + k // 26)}word", f"{chr(97 + k // 26)}{chr(97 + k % 26)}"]
        for _ in range(4 if toxic else 0):
            ws.insert(rng.randint(0, len(ws)), rng.choice(["vileword", "vilewords", "nasty", "grim"]))
        out.append((k, " ".join(ws), int(toxic)))
    return out


def is_training(key):
    return zlib.crc32(str(key).encode()) % 5 != 0


def plain_model(rows, every):
    """Dictionaries of probabilities of both classes."""
    words = {w for t in every for w in t.lower().split()}
    shared = collections.Counter(w for t in every for w in t.lower().split())
    of_form = collections.Counter()
    for w, n in shared.items():
        of_form[toxicity.beginning(w)] += n
    total = sum(shared.values())
    out = []
    for toxic in (0, 1):
        pairs = set()
        for t in (t for _, t, y in rows if y == toxic):
            ws = t.lower().split()
            pairs |= set(zip(["^", *ws], ws))
        n = collections.Counter(w for _, w in pairs)
        m = collections.Counter()
        for w, x in n.items():
            m[toxicity.beginning(w)] += x
        cut = lambda x: min(x, toxicity.DISCOUNT * math.sqrt(x))
        size = sum(n.values())
        g, h = sum(map(cut, m.values())) / size, sum(map(cut, n.values())) / size
        begun = {b: (m[b] - cut(m[b])) / size + g * of_form[b] / total for b in of_form}
        out.append({w: (n[w] - cut(n[w])) / size + h * begun[toxicity.beginning(w)] * shared[w] / of_form[toxicity.beginning(w)] for w in words})
    return out


def test_models_are_distributions_and_equal_a_plain_version(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    model, _ = toxicity.fit(docs, labels)
    fitted = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 > 1]
    plain = plain_model(fitted, [t for _, t, _ in rows])
    shared = collections.Counter(w for _, t, _ in rows for w in t.lower().split())
    form = collections.Counter()
    for w, n in shared.items():
        form[toxicity.beginning(w)] += n
    total = sum(shared.values())
    for toxic in (0, 1):
        own = {w: model.probability(w, toxic, form[toxicity.beginning(w)] / total, n / form[toxicity.beginning(w)]) for w, n in shared.items()}
        assert sum(own.values()) == pytest.approx(1) and sum(plain[toxic].values()) == pytest.approx(1)
        assert all(own[w] == pytest.approx(plain[toxic][w]) for w in own)
    assert all(model.evidence(w) == pytest.approx(math.log(plain[1][w] / plain[0][w])) for w in shared)
    assert any(w in model.words for w in shared) and any(w not in model.words for w in shared)


def test_held_out_labels_change_no_score(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    scores = []
    for flip in (False, True):
        own = [(k, y if is_training(k) or not flip else 1 - y) for k, _, y in rows]
        scores.append(sorted(map(tuple, toxicity.score(docs, spark.createDataFrame(own, "doc_id long, toxic int")).collect())))
    assert scores[0] == scores[1]


def test_windows():
    memo = toxicity.Evidence(toxicity.Model(words={"bad": (0.0, 0.5)}, beginnings={"bad": (0.0, 0.0)}, back_words=(1.0, 0.5), back_beginnings=(1.0, 1.0), shared={"bad": 0.01}, given={"bad": 1.0}))
    text = "so " * 50 + "bad so bad " + "so " * 50
    values = [memo[w] for w in toxicity.words_of(text)]
    best = max(sum(values[k : k + toxicity.WINDOW]) for k in range(len(values) - toxicity.WINDOW + 1))
    assert toxicity.features(text, memo) == pytest.approx((sum(values) / len(values), best / toxicity.WINDOW, math.log1p(len(values))))
    assert toxicity.features("", memo) == (0.0, 0.0, 0.0)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    scored = queries.op7_toxicity(spark, sf).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = [(labels[r.doc_id], r.predicted) for r in scored if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    assert sum(b and not a for a, b in seen) / len(seen) < 0.01
    assert sum(a and b for a, b in seen) / sum(a for a, _ in seen) > 0.85


def test_odd_tables(spark):
    rows = [(1, None, None), (2, "", "a"), (None, "hello there world", "b"), (5, "hello there", "b"), (5, "hello there", "b"), (6, "x " * 5000, None), (7, "é\x00", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(7) for c in ("score", "__text", "toxic", "key", "part")})
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (7, None), (6, 0)], "doc_id long, toxic int")
    for own in (labels, labels.limit(0)):
        got = toxicity.score(df, own, keep=("doc_id", "toxic", "score", "__text"))
        assert got.columns == ["doc_id", "toxic", "__text", "score"] and got.count() == len(rows)
        assert all(0 <= r.score <= 1 for r in got.collect())
        assert toxicity.filter_toxic(df, own).columns == df.columns
    assert toxicity.score(df.limit(0), labels).count() == 0
