"""The similarity join against all pairs."""

from __future__ import annotations

import re

import pytest

from loomgraph.llm import jaccard, queries
from tests.llm.test_near import DOCS, _texts


def plain(rows, size=4, over=17, under=20):
    """doc_id, size of the set and smallest doc_id reachable, by all pairs."""
    sets = []
    for _, text, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * under >= max(len(a), len(b)) * over:
                both = len(a & b)
                if both * under >= (len(a) + len(b) - both) * over:
                    p, q = sorted((find(i), find(j)))
                    root[q] = p
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return [(r[0], len(sets[k]), least.get(find(k))) for k, r in enumerate(rows)]


def result(df):
    return sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())))


def test_same_as_all_pairs(spark):
    odd = [None, "", " \t", "one two", "One TWO", "one two three", "a b c d e", "a b c d e a b c d e", "É é", "é é"]
    rows = [(500 - k, t, "s") for k, t in enumerate([*odd, *_texts(5, 40, 9, 9)])]
    rows += [(3, rows[20][1], "s"), (3, rows[20][1], "s"), (None, rows[30][1], "s"), (None, "all alone here", "s")]
    want = plain(rows)
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    assert result(jaccard.groups(df)) == sorted(map(str, want))
    assert 50 < len({c for _, _, c in want}) < len(rows) - 50
    kept = {r.doc_id for r in jaccard.keep_one(df).collect()}
    assert kept == {c for _, _, c in want}
    assert jaccard.groups(df.limit(0)).count() == 0


def test_a_large_group_of_near_copies(spark):
    rows = [(k, t, "s") for k, t in enumerate(_texts(8, 1, 300, 14))]
    assert result(jaccard.groups(spark.createDataFrame(rows, DOCS))) == sorted(map(str, plain(rows)))


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_query_on_tables(spark, table):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{table}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.queries()["op11_ngram_jaccard"](spark, f"/root/testdata/{table}")) == sorted(map(str, plain(rows)))


def test_near_copies_meet_once(spark, monkeypatch):
    counts, write = {}, jaccard.materialise

    def counted(session, df, name):
        out = write(session, df, name)
        counts[name] = max(counts.get(name, 0), out.count())
        return out

    monkeypatch.setattr(jaccard, "materialise", counted)
    rows = [(k, t, "s") for k, t in enumerate(_texts(8, 1, 100, 14))]
    jaccard.groups(spark.createDataFrame(rows, DOCS))
    assert 0 < counts["labelled"] < 8 * len(rows)
