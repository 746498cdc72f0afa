"""Versions, updates, the store and the stored index: what is left when a writer dies, and what they compute."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.model import GraphError
from loomgraph.operators import budget, search
from loomgraph.plans import incremental, store
from loomgraph.sources import trigrams
from loomgraph.versions import Conflict, Versions


def test_a_crash_leaves_the_last_whole_version(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/v")
    assert v.latest() is None
    assert v.commit({"a": 1}, None) == 0
    with open(tmp_path / "v" / "manifest-00000001.json", "w") as f:  # a writer that died inside its manifest
        f.write(json.dumps({"a": 2})[:-2])
    assert v.latest() == (0, {"a": 1}) and v.numbers() == [0, 1]
    with pytest.raises(Conflict):
        v.commit({"a": 3}, None)
    assert v.commit({"a": 3}, 0) == 2 and v.latest() == (2, {"a": 3})
    with pytest.raises(Conflict):  # a second writer that began from the same version
        v.commit({"a": 4}, 0)
    dead = v.write(spark.range(3), "rows")
    assert dead in v.sweep(lambda note: set()) and v.latest() == (2, {"a": 3}) and v.commit({"a": 5}, 2) == 3


def _support(spark, rng, files):
    nodes, edges = [], []
    for f, seed in files.items():
        own = random.Random(seed)
        for k in range(own.randrange(1, 6)):
            nodes.append((f, k, f"n{own.randrange(12)}", k, k + 1, k, k))
            edges.append((f, k, f"n{own.randrange(12)}", f"n{own.randrange(12)}", own.choice("xy"), own.choice(["EXTRACTED", "INFERRED"])))
    return spark.createDataFrame(nodes, incremental.SUPPORT), spark.createDataFrame(edges, incremental.LINKS)


def test_random_edits_equal_a_full_build(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "BUCKETS", 4)
    rng = random.Random(4)
    state = incremental.State(spark, f"file://{tmp_path}/state")
    files = {f"d{k % 2}/f{k}": k for k in range(8)}
    rows = lambda df: sorted(map(str, df.collect()))
    for turn in range(4):
        g, changes = incremental.update_support(state, *_support(spark, rng, files))
        full, _ = incremental.update_support(incremental.State(spark), *_support(spark, rng, files))
        assert rows(g.nodes) == rows(full.nodes) and rows(g.edges) == rows(full.edges) and rows(g.inputs) == rows(full.inputs)
        assert rows(incremental.graph(state).edges) == rows(full.edges)
        if turn == 1:  # a writer dies behind its tables
            number, note = state.current()
            state.put(dict(note), "nodes", g.nodes.limit(1), ["label"], [0])
            assert state.current() == (number, note) and rows(incremental.graph(state).nodes) == rows(full.nodes)
        gone = rng.choice(sorted(files))
        del files[gone]
        files[rng.choice(sorted(files))] = 100 + turn
        files[f"d{turn}/new"] = 200 + turn
    before = state.current()[0]
    incremental.update_support(state, *_support(spark, rng, files))
    after = state.current()[0]
    incremental.update_support(state, *_support(spark, rng, files))
    assert after == before + 1 == state.current()[0]  # no change makes no version


def test_an_update_writes_the_buckets_it_touches(spark):
    state = incremental.State(spark)
    nodes = spark.range(400).select(F.concat(F.lit("f"), F.col("id") % 40).alias("path"), F.col("id").alias("row_ord"), F.concat(F.lit("n"), "id").alias("label"), *[F.lit(0).cast("bigint").alias(c) for c in incremental.SPAN])
    edges = spark.createDataFrame([], incremental.LINKS)
    incremental.update_support(state, nodes, edges)
    _, one = state.current()
    g, changes = incremental.update_support(state, nodes.where("label <> 'n7'"), edges)
    _, two = state.current()
    assert changes.count() == 1 and g.nodes.count() == 399
    new = [b for b in one["nodes"] if two["nodes"].get(b) != one["nodes"][b]]
    assert 0 < len(new) <= 10 < len(one["nodes"])  # those of the file's ten labels


def test_an_update_writes_support_once(spark, monkeypatch):
    written = []
    real = incremental.materialise
    monkeypatch.setattr(incremental, "materialise", lambda s, df, name: (written.append(name), real(s, df, name))[1])
    state = incremental.State(spark)
    nodes, edges = _support(spark, random.Random(2), {f"d{k}/f": k for k in range(5)})
    incremental.update_support(state, nodes, edges)
    assert written.count("fresh") == 2 and not {"support", "nodes", "labels", "edge-keys"} & set(written)  # a first version looks for no stored keys
    incremental.update_support(state, nodes.where("path <> 'd1/f'"), edges.where("path <> 'd1/f'"))
    assert "edge-keys" in written and not {"support", "nodes"} & set(written)


def test_store_keeps_its_bound_and_second_chances(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store", 10)
    batch = lambda a, b: spark.range(a, b).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") * 2).alias("value"))
    held = lambda: {int(r.key[1:]) for r in s.entries().collect()}
    assert s.entries() is None and s.get(batch(0, 1).select("key"))[0] is None
    s.put(batch(0, 5).unionByName(spark.createDataFrame([(None, 1)], "key string, value bigint")))
    s.put(batch(3, 8))
    assert held() == set(range(8)) and s.size() == 8
    hits, misses = s.get(batch(1, 3).unionByName(batch(50, 51)).select("key"))
    assert {(r.key, r.value) for r in hits.collect()} == {("k1", 2), ("k2", 4)} and misses.count() == 1
    s.put(batch(20, 24))
    assert held() == {1, 2, 5, 6, 7, 20, 21, 22, 23} and s.size() == 9
    s.put(batch(30, 36))  # nothing was asked for since: those that were spared go as the others do
    assert held() == {20, 21, 22, 23, *range(30, 36)} and s.size() == 10
    Versions(spark, s.versions.path).write(batch(90, 95), "entries")  # a writer that died before its manifest
    assert held() == {20, 21, 22, 23, *range(30, 36)} and s.sweep() and s.size() == 10
    s.put(batch(100, 120))
    assert s.size() == 10 and len(held()) == 10
    with pytest.raises(GraphError):
        s.put(spark.range(1).select(F.lit("x").alias("key")))


def test_stored_trigrams(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trigrams, "BLOCK", 16)
    rng = random.Random(2)
    rows = [(k, "".join(rng.choice("abcÄ") for _ in range(rng.randrange(9)))) for k in range(600)] + [(900, None), (901, "abcabcabc")]
    nodes = spark.createDataFrame(rows, "id long, label string")
    index = trigrams.TrigramIndex(spark, f"file://{tmp_path}/index")
    assert index.find(nodes, "abc").count() == 0
    index.add(nodes.where("id < 300"))
    index.add(nodes.where("id >= 300"))
    for needle in ("abc", "ABCA", "äab", "ab", "", "abcabcabc", "zzz"):
        want = sorted(map(str, search.find_by_label(nodes, needle).collect()))
        assert sorted(map(str, index.find(nodes, needle).collect())) == want
    plan = index.lists(["abc"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert os.path.isdir(tmp_path / "index")


def test_digests_add_up(spark):
    rows = budget.row_digests(spark.range(50), "x", ["id"])
    extra = budget.row_digests(spark.range(50, 60), "x", ["id"])
    first = budget.set_digest(rows).first()[0]
    more = budget.changed_sums(budget.digest_sums(rows), extra, rows.limit(0))
    assert budget.digest_of(more).first()[0] == budget.set_digest(rows.unionByName(extra)).first()[0] != first
    assert budget.digest_of(budget.changed_sums(more, extra.limit(0), extra)).first()[0] == first
    assert budget.set_digest(rows.unionByName(rows)).first()[0] != first and len(first) == 16


def test_generation_is_a_digest_of_all_rows_in_order(spark):
    """By hand: digests sorted inside groups of their first three digits, then the groups' digests; not a sum of them."""
    import hashlib

    rows = spark.range(50).select(F.sha2((F.col("id") % 40).cast("string"), 256).alias("h"))
    groups: dict[str, list[str]] = {}
    for r in sorted(r.h for r in rows.collect()):
        groups.setdefault(r[:3], []).append(r)
    text = ";".join(f"{g}={hashlib.sha256(''.join(own).encode()).hexdigest()}" for g, own in sorted(groups.items()))
    assert budget.ordered_digest(rows).first()[0] == hashlib.sha256(text.encode()).hexdigest()[:16]
