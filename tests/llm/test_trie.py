"""The prefix trie against a plain one."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from loomgraph.llm import trie

CONV = "conv_id long, turn long, role string, text string, conv string"


def plain(rows, rebuild=True):
    own = {}
    for c, t, r, x, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        convs[c] = own.get(int(c / 5) * 5, [])[:h] + turns[h:] if rebuild else turns
    nodes = {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            nodes.setdefault(tuple(convs[c][:d]), []).append(c)
    out, kids = {}, {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    for p in sorted(nodes, key=len, reverse=True):
        k = kids.get(p, [])
        leaves = sum(out[x][4] for x in k) + (not k)
        saved = sum(out[x][5] for x in k) + ((len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        ends = ",".join(str(c) for c in nodes[p] if tuple(convs[c]) == p)
        out[p] = (nodes[p][0], len(p), len(nodes[p]), len(k), leaves, saved, hashlib.sha256(ends.encode()).hexdigest(), nodes[p[:-1]][0] if p else None)
    return sorted(map(str, out.values()))


def got(df):
    return sorted(str((r.conv_id, r.depth, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256, r.parent_conv_id)) for r in df.collect())


def talk(seed, n, longest, kinds):
    rng = random.Random(seed)
    for c in range(n):
        for t in range(rng.randrange(1, longest)):
            if rng.random() < 0.97:
                yield (c, t, "user" if t % 2 == 0 else "assistant", f"hé{rng.randrange(kinds) if rng.random() < 0.3 else t}", "x")


@pytest.mark.parametrize("run,span", [(20_000, 100_000), (7, 40)])
def test_same_as_a_plain_trie(spark, monkeypatch, run, span):
    monkeypatch.setattr(trie, "RUN", run)
    monkeypatch.setattr(trie, "RANGE", span)
    rows = [*talk(1, 90, 12, 3), *[(200 + k, t, "user", "same", "") for k in range(120) for t in range(3)]]
    rows += [(1000, t, "user", f"long {t}", "") for t in range(75)] + [(1001, t, "user", f"long {t}", "") for t in range(60)] + [(1005, t, "user", f"long {t}", "") for t in range(33)]
    rows += [(400, None, "user", "first", ""), (400, 0, None, None, ""), (400, 1, "", "", ""), (None, 0, "user", "nobody's", ""), (-7, 0, "user", "", ""), (-3, 3, "a", "b", "")]
    df = spark.createDataFrame(rows, CONV).repartition(5)
    assert got(trie.rebuilt_trie(df)) == plain(rows)
    assert got(trie.plain_trie(df)) == plain(rows, rebuild=False)


def test_odd_tables(spark):
    assert trie.rebuilt_trie(spark.createDataFrame([], CONV)).count() == 0
    again = [(1, 0, "u", "x", "")] * 3 + [(2, 0, "u", "x", "")]
    assert got(trie.plain_trie(spark.createDataFrame(again, CONV))) == plain(again, rebuild=False)
    deep = [(1, t, "u", str(t), "") for t in range(trie.BLOCK)] + [(2, t, "u", str(t), "") for t in range(trie.BLOCK * 3)]
    assert got(trie.plain_trie(spark.createDataFrame(deep, CONV))) == plain(deep, rebuild=False)


def test_merging_shares_prefixes():
    rng = random.Random(3)
    token = lambda: bytes([rng.randrange(2)]) * trie.WIDTH
    rows = sorted({(trie.ROOT + b"".join(token() for _ in range(rng.randrange(6))), c) for c in range(300)})
    parts = [[], [], []]
    for r in rows:
        parts[rng.randrange(3)].append(r)
    sources = []
    for p in parts:
        shared = [0] + [trie.shared_from(a[0], b[0], 0) for a, b in zip(p, p[1:])]
        sources.append(iter([(path, c, 0, True, [], n) for (path, c), n in zip(p, shared)]))
    out, before = [], None
    for player in trie.merged(sources):
        assert player.shared == (trie.shared_from(before, player.path, 0) if before is not None else 0)
        out.append((player.path, player.conv))
        before = player.path
    assert out == rows


def test_query_on_tables(spark, sf):
    from loomgraph.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.queries()["op13_prefix_trie"](spark, sf)) == plain(rows)
