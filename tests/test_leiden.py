"""Communities by the Leiden method, against one process that moves one node after another."""

import random

import numpy as np

from loomgraph.operators import analytics, leiden
from loomgraph.operators.skew import dealt_join
from loomgraph.plans import driver_graph as dg
from loomgraph.operators.trust import trusted_edges


def one_by_one(n: int, a: np.ndarray, b: np.ndarray, total: float, seed: int = 7) -> np.ndarray:
    """Communities of a simple graph by local moves on modularity, aggregated until nothing moves.

    Before each aggregation communities are split into their connected parts, so every community stays connected.
    """
    own = np.arange(n)
    u, v, w, loops = a, b, np.ones(len(a)), np.zeros(n)
    while True:
        size = len(loops)
        order = np.argsort(np.concatenate([u, v]), kind="stable")
        head, tail, weight = np.concatenate([u, v])[order], np.concatenate([v, u])[order], np.concatenate([w, w])[order]
        at = np.searchsorted(head, np.arange(size + 1))
        degree = np.bincount(head, weights=weight, minlength=size) + 2 * loops
        label, mass = np.arange(size), degree.copy()
        moved_any, moved, sweeps = False, True, 0
        visit = np.random.default_rng(seed).permutation(size)
        while moved and sweeps < 50:
            moved, sweeps = False, sweeps + 1
            for k in visit.tolist():
                lo, hi = at[k], at[k + 1]
                if lo == hi:
                    continue
                near = label[tail[lo:hi]]
                names, place = np.unique(near, return_inverse=True)
                into = np.bincount(place, weights=weight[lo:hi])
                mass[label[k]] -= degree[k]
                gain = into - degree[k] * mass[names] / (2 * total)
                here = np.flatnonzero(names == label[k])
                stay = gain[here[0]] if len(here) else -degree[k] * mass[label[k]] / (2 * total)
                best = int(gain.argmax())
                if gain[best] > stay + 1e-12:
                    label[k], moved, moved_any = names[best], True, True
                mass[label[k]] += degree[k]
        if not moved_any:
            return own
        parts = connected(label, u, v)
        own = parts[own]
        new = int(parts.max()) + 1
        loops_new = np.bincount(parts, weights=loops, minlength=new)
        pu, pv = parts[u], parts[v]
        inner = pu == pv
        loops_new += np.bincount(pu[inner], weights=w[inner], minlength=new)
        key = np.minimum(pu, pv)[~inner] * new + np.maximum(pu, pv)[~inner]
        names, place = np.unique(key, return_inverse=True)
        u, v, w, loops = names // new, names % new, np.bincount(place, weights=w[~inner], minlength=len(names)), loops_new
        if not len(u) or new == size:
            return own


def connected(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Connected parts of communities, numbered from 0."""
    root = np.arange(len(label))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(u.tolist(), v.tolist(), strict=True):
        if label[x] == label[y]:
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
    tops = np.array([find(x) for x in range(len(label))])
    return np.unique(tops, return_inverse=True)[1]


def quality(n, a, b, label):
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    mass = np.bincount(np.unique(label, return_inverse=True)[1], weights=degree)
    return (label[a] == label[b]).mean() - (mass**2).sum() / (4.0 * len(a) ** 2)


def planted(groups, size, seed):
    rng = random.Random(seed)
    n = groups * size
    return [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < (0.6 if a // size == b // size else 0.01)]


def test_planted_groups_are_found_and_dealing_changes_nothing(spark):
    links = planted(5, 14, 1)
    pairs = spark.createDataFrame(links, "a long, b long")
    got = {r.id: r.label for r in leiden.leiden(pairs).collect()}
    assert len(got) == 70 and len(set(got.values())) == 5
    assert all(got[k] == got[k // 14 * 14] for k in range(70))
    assert {r.id: r.label for r in leiden.leiden(pairs, rows=7).collect()} == got


def test_what_a_large_sweep_reads_twice_is_written_and_left_nowhere(spark, monkeypatch):
    held, names = {}, []
    real, gone = leiden.materialise, leiden.discard

    def made(s, df, name):
        out = real(s, df, name)
        names.append(name)
        held[out._scratch] = name
        return out

    monkeypatch.setattr(leiden, "materialise", made)
    monkeypatch.setattr(leiden, "discard", lambda *ts: ([held.pop(t._scratch) for t in ts], gone(*ts)))
    pairs = spark.createDataFrame(planted(2, 8, 5), "a long, b long")
    leiden.leiden(pairs, rows=7).count()
    assert "leiden-movers" in names and "leiden-moved" in names
    assert not {"leiden-movers", "leiden-moved"} & set(held.values())


def test_spokes_join_their_hub_at_once_and_ends_are_looked_up_once(spark, monkeypatch):
    made, asked = {}, []
    real, ends = leiden.materialise, leiden._ends
    monkeypatch.setattr(leiden, "materialise", lambda s, df, name: made.setdefault(name, []).append(real(s, df, name)) or made[name][-1])
    monkeypatch.setattr(leiden, "_ends", lambda *a: asked.append(1) or ends(*a))
    links = [(hub * 41, hub * 41 + k) for hub in range(4) for k in range(1, 41)] + [(0, 41), (41, 82), (82, 123)]
    got = {r.id: r.label for r in leiden.leiden(spark.createDataFrame(links, "a long, b long"), rows=100).collect()}
    assert len(got) == 164 and all(got[k] == got[k // 41 * 41] for k in range(164)) and len(set(got.values())) == 4
    parts = made["leiden-parts"][0]
    assert parts.select("node").distinct().count() < 60  # one bit for each node left about half of the spokes apart
    assert len(asked) == len(made["leiden-parts"]) + 1  # once a level


def test_no_links(spark):
    assert leiden.leiden(spark.createDataFrame([], "a long, b long")).collect() == []


def test_dealt_join_is_a_join(spark):
    many = spark.createDataFrame([(k % 3 if k % 2 else 0, k) for k in range(60)] + [(None, 1), (9, 9)], "key long, x long")
    few = many.where("key < 9").groupBy("key").count()
    got = sorted(tuple(r) for r in dealt_join(many, few, "key", "count", ["x"], rows=5).collect())
    assert got == sorted(tuple(r) for r in many.join(few, "key").collect()) and len(got) == 60


def test_within_one_percent_of_moves_one_by_one(spark, sf):
    g = dg.graph(spark, sf)
    pairs = analytics.undirected_pairs(trusted_edges(g.edges)).cache()
    found = sorted((r.a, r.b) for r in pairs.collect())
    ids, flat = np.unique(np.array(found).T, return_inverse=True)
    a, b = flat.reshape(2, -1)
    members = dg.detected(spark, sf)[1]
    label = dict((r.node, r.community) for r in members.collect())
    ours = quality(len(ids), a, b, np.array([label[k] for k in ids.tolist()]))
    assert abs(ours - analytics.modularity(pairs, members).first().modularity) < 1e-9
    assert ours > 0.99 * quality(len(ids), a, b, one_by_one(len(ids), a, b, float(len(a))))


def test_labels_of_hubs_are_dealt_to_the_same_result(spark):
    links = [(0, k) for k in range(1, 40)] + planted(2, 6, 3)
    pairs = spark.createDataFrame(sorted(set(links)), "a long, b long")
    nodes = spark.range(45)
    one, many = (sorted(tuple(r) for r in analytics.label_propagation(nodes, pairs, 2, rows=n).collect()) for n in (1_000_000, 4))
    assert one == many and len(one) == 45
