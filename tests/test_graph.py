"""Graph operators against small examples, laws and brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.model import SchemaError, graph_of
from loomgraph.operators import analytics, build, components, export, neighbourhood, parity, paths, search, trust
from loomgraph.plans import incremental, serve
from loomgraph.session import materialise
from loomgraph.sources import extract, files, nodelink, semantic

NODE = "id bigint, label string, source_file string, start_byte bigint, end_byte bigint, start_line bigint, end_line bigint"
EDGE = "source bigint, target bigint, relation string, confidence string"


def make(spark, n, edges, members=()):
    nodes = spark.createDataFrame([(k, f"n{k}", "a.py", 0, 0, k + 1, k + 1) for k in range(n)], NODE)
    rows = [(a, b, r, c) for a, b, r, c in edges]
    m = spark.createDataFrame(list(members), "community bigint, node bigint")
    c = m.select(F.col("community").alias("id")).distinct().withColumn("label", F.concat(F.lit("community-"), "id"))
    return graph_of(nodes, spark.createDataFrame(rows, EDGE), c, m)


def ties(pairs, relation="r", confidence="EXTRACTED"):
    return [(a, b, relation, confidence) for a, b in pairs]


def test_loop_counts_twice_and_unlinked_nodes_are_there(spark):
    g = make(spark, 3, ties([(0, 0), (0, 1), (1, 9)]))
    assert {(r.id, r.degree) for r in analytics.degree_centrality(g).collect()} == {(0, 3), (1, 2), (2, 0), (9, 1)}
    assert [(r.id, r.label) for r in analytics.god_nodes(g, 3).orderBy("rank").collect()] == [(0, "n0"), (1, "n1"), (9, "")]
    assert [r.id for r in analytics.report_hubs(g, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert analytics.god_nodes(g, 0).count() == 0


def test_trust_parts_are_disjoint_and_whole(spark):
    g = make(spark, 3, [(0, 1, "r", "EXTRACTED"), (1, 2, "r", "INFERRED"), (2, 0, "r", "AMBIGUOUS")])
    a, b = trust.trusted_edges(g.edges), trust.untrusted_edges(g.edges)
    assert a.intersect(b).count() == 0 and a.unionByName(b).exceptAll(g.edges).count() == 0
    assert trust.confidence_counts(make(spark, 1, ()).edges.limit(0)).first().asDict() == {"extracted": 0, "inferred": 0, "ambiguous": 0, "total": 0}


def test_merging_a_version_with_itself_changes_nothing(spark):
    g = make(spark, 4, ties([(0, 1), (1, 2)]), [(0, 0), (0, 1), (1, 2), (1, 3)])
    x = make(spark, 3, ties([(0, 2)]), [(0, 0)])
    m = build.merge3(g, g, x)
    assert {r.label for r in m.nodes.collect()} == {"n0", "n1", "n2"}
    assert {(r.source_label, r.target_label) for r in build.labelled_edges(m).collect()} == {("n0", "n2")}


def test_first_wins_by_order(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 5, None)], "k string, o int, v string")
    assert {(r.k, r.v) for r in build.first_wins(df, ["k"], ["o"]).collect()} == {("a", "early"), ("b", None)}


def test_indexed_search_equals_scan(spark):
    rng = random.Random(4)
    labels = ["".join(rng.choice("abAB ") for _ in range(rng.randint(0, 8))) for _ in range(200)] + ["ΑΣ", "x"]
    nodes = spark.createDataFrame(list(enumerate(labels)), "id bigint, label string")
    index = search.trigram_index(nodes)
    for needle in ("", "a", "ab", "aba", "abab", "b a", "zzz"):
        want = {k for k, x in enumerate(labels) if needle.lower() in x.lower()}
        assert {r.id for r in search.find_indexed(nodes, index, needle).collect()} == want
        assert {r.id for r in search.find_by_label(nodes, needle).collect()} == want


def brute_path(n, pairs, a, b):
    near = {k: sorted({y for x, y in pairs if x == k} | {x for x, y in pairs if y == k}) for k in range(n)}
    queue, came = [a], {a: None}
    for v in queue:
        for w in near[v]:
            if w not in came:
                came[w] = v
                queue.append(w)
    if b not in came:
        return None
    out = [b]
    while came[out[-1]] is not None:
        out.append(came[out[-1]])
    return out[::-1]


@pytest.mark.parametrize("seed", range(3))
def test_shortest_path(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(12), rng.randrange(12)) for _ in range(14)]
    g = make(spark, 12, ties(set(pairs)))
    got = [r.id for r in paths.shortest_path(g, "n0", "n7").orderBy("position").collect()]
    assert got == (brute_path(12, pairs, 0, 7) or [])
    assert [r.id for r in paths.shortest_path(g, "n3", "n3").collect()] == [3]
    assert paths.shortest_path(g, "n3", "nowhere").count() == 0


def test_communities_are_a_partition(spark):
    ring = [(a, b) for k in (0, 5) for a in range(k, k + 5) for b in range(a + 1, k + 5)] + [(4, 5)]
    g = make(spark, 11, ties(ring))
    c, m = analytics.detect_communities(g)
    rows = sorted((r.community, r.node) for r in m.collect())
    assert [n for _, n in sorted(rows, key=lambda r: r[1])] == list(range(11))
    assert rows == [*((0, k) for k in range(5)), *((1, k) for k in range(5, 10)), (2, 10)]
    assert {(r.id, r.label) for r in c.collect()} == {(k, f"community-{k}") for k in range(3)}
    q = analytics.modularity(analytics.undirected_pairs(g.edges), m).first().modularity
    assert 0.4 < q < 0.5
    assert analytics.broken_communities(analytics.undirected_pairs(g.edges), m).count() == 0


def test_around_a_node(spark):
    g = make(spark, 12, ties([(0, k) for k in range(1, 12)]))
    rows = neighbourhood.explain_edges(g, "n0").collect()
    assert len(rows) == 8 and {r.total for r in rows} == {11}
    with pytest.raises(ValueError):
        neighbourhood.neighbourhood(g, "")


def test_exchange_format_round_trip(spark, tmp_path):
    g = make(spark, 3, ties([(0, 1), (1, 2)], "knows"), [(0, 0), (0, 1)])
    (tmp_path / "g.json").write_text(export.node_link(g))
    back = nodelink.from_node_link(spark, str(tmp_path / "g.json"))
    assert sorted((r.id, r.label, r.start_line) for r in back.nodes.collect()) == [(0, "n0", 1), (1, "n1", 2), (2, "n2", 3)]
    assert back.edges.exceptAll(g.edges).count() == 0 and back.members.count() == 2
    bad = json.loads((tmp_path / "g.json").read_text())
    bad["links"][0]["confidence"] = "SURE"
    (tmp_path / "b.json").write_text(json.dumps(bad))
    with pytest.raises(SchemaError):
        nodelink.from_node_link(spark, str(tmp_path / "b.json"))


def test_documents_survive_hostile_labels(spark):
    nodes = spark.createDataFrame([(1, "</text><script>'\\‮\x01", "a]b.rs", 0, 0, 1, 1), (2, "plain", "b.rs", 0, 0, 1, 1)], NODE)
    g = graph_of(nodes, spark.createDataFrame(ties([(1, 2), (1, 1)], "r[x]:"), EDGE))
    assert "<script>" not in export.graphml(g) and "<script>" not in export.svg(g)
    assert "</text><script>" not in export.html(g).split("<script>\nconst")[0].split('id="data">')[1]
    assert "\\'" in export.cypher(g)
    notes = {r.file: r.content for r in export.vault(g).collect()}
    assert len(notes) == 3 and "‮" not in "".join(notes.values()) and "rx:: [[plain]]" in "".join(notes.values())
    pages = {r.file: r.content for r in export.wiki(g).collect()}
    assert set(pages) == {"node-1.md", "node-2.md", "index.md"}
    assert "Top Hubs" in export.report(g) and export.token_benchmark(g)["report"] > 0


PY = "import os\nfrom a.b import c\nclass A(B, C.D):\n    def __init__(self):\n        pass\n    @property\n    def x(self): pass\nclass B: pass\ndef f(): pass\n"


def test_extractors(spark):
    r = extract.extract_one("d/Mod.py", PY.encode())
    assert [n[0] for n in r.nodes] == ["mod", "mod_a", "mod_a_init", "mod_b", "mod_f"]
    assert ("mod", "a.b", "imports_from", "EXTRACTED") in r.edges and ("mod_b", "mod_a", "inherits", "EXTRACTED") in r.edges
    assert [n[0] for n in extract.extract_one("bad.py", b"def (").nodes] == ["bad"]
    md = extract.extract_one("x/Read Me.md", "# One  Two #\n```\n# no\n```\n## \n[a](other.md#x) [b](http://c.md)\n".encode())
    assert [n[0] for n in md.nodes] == ["read me", "read me_one_two"]
    assert [e[:3] for e in md.edges] == [("read me", "read me_one_two", "contains"), ("read me", "other", "references")]
    rs = extract.extract_one("a.rs", b"fn main() { helper(); } fn helper() {}")
    assert [n[0] for n in rs.nodes] == ["main", "helper"] and rs.edges == [("main", "helper", "calls", "INFERRED")]
    samples = {
        "A.java": b"import a.b.C;\npublic class A extends B {\n  public int f(int x) {\n    return 1;\n  }\n}\nclass B {\n}\n",
        "a.cs": b"using X.Y;\nnamespace N {\nclass A : B {\n  public void F() {\n  }\n}\nclass B {\n}\n}\n",
        "a.php": b"<?php\nuse X\\{Y, Z};\nclass A extends B {\n  public function f() {\n  }\n}\nclass B {\n}\n",
        "a.cpp": b"#include <x>\nclass B {\n};\nclass A : public B {\n  int f() {\n    return 1;\n  }\n};\nint g() {\n}\n",
        "a.kt": b"import x.y\nclass B\nclass A : B() {\n  fun f() {\n  }\n}\nfun g() {\n}\n",
        "a.scala": b"import x.{y, z}\nclass B\nclass A extends B {\n  def f = 1\n}\n",
        "a.rb": b"require 'x'\nclass B\nend\nclass A < B\n  def f\n  end\nend\n",
        "a.c": b"#include <x.h>\nstruct s {\n int a;\n};\ntypedef int t;\nint f(int a) {\n return a;\n}\n",
        "a.go": b"package a\nimport \"x\"\ntype A struct {\n}\nfunc (a *A) F() {\n}\nfunc g() {\n}\n",
        "a.ts": b"import x from 'y';\nclass B {\n}\nclass A extends B {\n  f() {\n  }\n}\n",
    }
    for path, text in samples.items():
        got = extract.extract_one(path, text)
        kinds = {e[2] for e in got.edges}
        assert "contains" in kinds and "imports_from" in kinds, path
        if path not in ("a.c", "a.go"):
            assert ("a_b", "a_a", "inherits", "EXTRACTED") in got.edges, path
        if path != "a.c":
            assert "method" in kinds, path
    df = spark.createDataFrame([("a.py", PY.encode()), ("b.bin", b"x")], "path string, content binary")
    rows = extract.extract(df)
    assert rows.where("kind = 'node'").count() == 5


def test_detect_and_read(spark, tmp_path):
    for name in ("a/b.py", "a.b/c.PY", "a/skip.py", ".hidden/x.py", "a/none", "z.txt"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x" * len(name))
    (tmp_path / ".gitignore").write_text("skip.*\n")
    found = files.detect(str(tmp_path), ["py"])
    assert [f[len(str(tmp_path)) + 1 :] for f in found] == ["a/b.py", "a.b/c.PY"]
    assert files.read_local(spark, found, 6).count() == 1


def test_updates_equal_a_full_build(spark, tmp_path):
    def of(texts):
        return spark.createDataFrame([(p, t.encode()) for p, t in texts.items()], "path string, content binary")

    texts = {"a.py": "class A: pass\n", "b.py": "from a import A\nclass B(A): pass\n", "c.py": "def f(): pass\n"}
    state = incremental.State(spark, f"file://{tmp_path}/state")
    incremental.update(state, of(texts))
    for change in ({"a.py": "class A: pass\nclass A2: pass\n"}, {"b.py": None}, {"d.py": "class A: pass\n"}, {}):
        texts = {p: t for p, t in (texts | change).items() if t is not None}
        g, changes = incremental.update(state, of(texts))
        full, _ = incremental.update(incremental.State(spark), of(texts))
        assert sorted(map(tuple, g.nodes.collect())) == sorted(map(tuple, full.nodes.collect()))
        assert sorted(map(tuple, g.edges.collect())) == sorted(map(tuple, full.edges.collect()))
        assert {r.path for r in changes.collect()} == set(change)


def test_semantic_answers(spark):
    df = spark.createDataFrame([("f", '{"nodes":[{"label":" a "},{"label":""}],"edges":[{"source":"a","target":"b","relation":" "},{"source":"","target":"b"}]}'), ("g", "no")], "source_file string, answer string")
    n, e, bad = semantic.parse_semantic(df)
    assert [r.label for r in n.collect()] == ["a"] and bad.count() == 1
    assert [(r.source, r.target, r.relation, r.confidence) for r in e.collect()] == [("a", "b", "relates_to", "INFERRED")]


def test_requests(spark):
    g = make(spark, 3, ties([(0, 1), (1, 2)], "knows"), [(0, 0), (0, 1)])
    ask = lambda method, **p: json.loads(serve.handle(g, json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": p})))
    tool = lambda n, **a: ask("tools/call", name=n, arguments=a)["result"]["content"][0]["text"]
    assert "generation" in ask("initialize")["result"] and len(ask("tools/list")["result"]["tools"]) == 4
    assert tool("graph_query", query="N1").splitlines()[0] == "1 matches"
    assert len(tool("graph_query", query="n", max_tokens=0).splitlines()) == 3  # the best match is never dropped
    assert tool("graph_path", **{"from": "n0", "to": "n2"}) == "n0 -> n1 -> n2 (2 hops)"
    assert tool("graph_health").startswith("nodes=3 edges=2") and "out knows n1" in tool("graph_explain", concept="n0")
    assert ask("resources/read", uri="graph://community/0")["result"]["contents"][0]["text"] == "n0\nn1"
    assert ask("nothing")["error"]["code"] == serve.NO_METHOD and ask("tools/call", name="x")["error"]["code"] == serve.BAD_PARAMS
    assert json.loads(serve.handle(g, "{"))["error"]["code"] == serve.PARSE_ERROR and serve.handle(g, '{"method":"initialize"}') == ""
    assert serve.handle(g, "1") == serve.handle(g, '["id"]') == "" and ask("tools/call")["error"]["code"] == serve.BAD_PARAMS
    assert serve.as_functions(serve.tools())[0]["type"] == "function" and serve.as_functions([{"name": "x"}])[0]["function"]["parameters"] == {}
    assert serve.from_function_call("graph_health", "{}")["params"]["name"] == "graph_health"


def test_budget_is_a_prefix():
    assert serve.fit("head", None, ["a" * 8, "b" * 80, "c"], 5) == "head\n" + "a" * 8 + "\n… 2 more"


def test_whole_graphs_compare_by_ids_as_others_do_by_labels(spark):
    """One result by ids and by labels: merges, arcs, classes of edges; an edge at a node that didn't survive goes."""
    from dataclasses import replace

    from loomgraph.functions.ids import node_id
    from loomgraph.operators import arcs, parity

    def own(names, edges):
        rows = spark.createDataFrame([(n, n[0], 0, 0, k, k) for k, n in enumerate(names)], NODE.removeprefix("id bigint, "))
        e = spark.createDataFrame(edges, "s string, t string, relation string, confidence string")
        return graph_of(rows.select(node_id(F.col("label")).alias("id"), *rows.columns), e.select(node_id(F.col("s")).alias("source"), node_id(F.col("t")).alias("target"), "relation", "confidence"))

    base = own("abcd", [("a", "b", "r", "EXTRACTED"), ("b", "c", "r", "INFERRED"), ("c", "d", "r", "AMBIGUOUS")])
    ours = own("abcde", [("a", "b", "r", "AMBIGUOUS"), ("b", "c", "r", "INFERRED"), ("a", "d", "r", "EXTRACTED"), ("a", "e", "q", "INFERRED")])
    theirs = own("abce", [("a", "b", "r", "EXTRACTED"), ("b", "c", "r", "EXTRACTED"), ("a", "e", "q", "EXTRACTED")])
    plain, whole = (base, ours, theirs), tuple(replace(g, whole=True) for g in (base, ours, theirs))
    rows = lambda df: sorted(map(tuple, df.collect()))
    merged = [rows(build.merge3_edges(*v, build.merge3_nodes(*v)).select("source", "target", "relation", "confidence")) for v in (plain, whole)]
    assert merged[0] == merged[1] and len(merged[0]) == 3
    assert rows(build.merge(*plain[1:]).edges) == rows(build.merge(*whole[1:]).edges)
    by = [rows(arcs.named_arcs(arcs.version_changes(arcs.arcs_of_versions(*v, ("r", "q"))), *v)) for v in (plain, whole)]
    assert by[0] == by[1]
    assert rows(parity.named_edges(parity.classify_edges(*plain[:2]), *plain[:2])) == rows(parity.named_edges(parity.classify_edges(*whole[:2]), *whole[:2]))


def test_documents_lie_once_and_carry_no_text_to_their_ranges(spark, tmp_path, monkeypatch):
    seen = []
    kept = export.write_document
    monkeypatch.setattr(export, "write_document", lambda rows, *rest: (seen.append(rows.columns), kept(rows, *rest)))
    g = make(spark, 3, ties([(0, 1), (1, 2)]), [(0, 1)])
    export.write_node_link(g, str(tmp_path / "g.json"))
    assert "line" not in seen[0] and (tmp_path / "g.json").read_text() == export.node_link(g)


def test_components_of_many_links_are_those_of_components(spark, monkeypatch):
    monkeypatch.setattr(components, "FEW", 10)  # so that it calls itself
    rng = random.Random(5)
    groups = [(0, 90, 300), (100, 104, 4), (200, 260, 200), (300, 302, 1)]  # first node, last node, links
    pairs = [(rng.randrange(a, b), rng.randrange(a, b)) for a, b, n in groups for _ in range(n)] + [(7, 7), (None, 3), (301, 300)]
    links = spark.createDataFrame(pairs, "a bigint, b bigint")
    rows = lambda df: sorted(map(tuple, df.select("node", "root").collect()))
    assert rows(components.components_of_many(links)) == rows(components.components(links))
    assert components.components_of_many(links.limit(0)).count() == 0


def test_paths_and_neighbourhoods_dont_copy_edges(spark, monkeypatch):
    g, names = make(spark, 6, ties([(0, 1), (2, 1), (2, 5), (1, 1), (0, 1)])), []
    monkeypatch.setattr(paths, "materialise", lambda s, df, name: names.append(name) or materialise(s, df, name))
    assert [r.id for r in paths.shortest_path(g, "n0", "n5").orderBy("position").collect()] == [0, 1, 2, 5]
    assert set(names) == {"frontier"}
    near = neighbourhood.neighbourhood(g, "n2")
    plan = near._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and near.count() == 2


def test_bridges_hash_nodes_at_every_size(spark):
    g = make(spark, 4, [(0, 1, "r", "EXTRACTED"), (1, 2, "q", "EXTRACTED"), (2, 0, "r", "INFERRED")], [(0, 0), (0, 1), (1, 2)])
    own = analytics.surprising_connections(g)
    plan = own._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    assert [tuple(r) for r in own.collect()] == [(1, 2, "q", "EXTRACTED", 0, 1)]


def test_smallest_shortest_path_is_found_from_both_ends(spark):
    rng = random.Random(11)
    for n, m in ((12, 18), (14, 16)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        near = {k: sorted({b for a, b in pairs if a == k} | {a for a, b in pairs if b == k}) for k in range(n)}
        g, best, frontier = make(spark, n, ties(pairs)), {0: [0]}, [[0]]
        while frontier:
            found = sorted([*p, v] for p in frontier for v in near[p[-1]])
            frontier = []
            for p in found:
                if p[-1] not in best:
                    best[p[-1]] = p
                    frontier.append(p)
        far = max(best, key=lambda k: (len(best[k]), k))
        lost = [k for k in range(n) if k not in best][:1]
        assert len(best[far]) > 3
        for end in [far, *lost]:
            own = paths.shortest_path(g, "n0", f"n{end}").orderBy("position").collect()
            assert [r.id for r in own] == best.get(end, [])
        assert paths.shortest_path(g, "n0", f"n{far}", len(best[far]) - 2).count() == 0


def test_wiki_of_whole_graphs_looks_up_no_ends(spark):
    g = make(spark, 3, ties([(0, 1), (1, 2)]))
    whole = g.with_(whole=True)
    assert sorted(map(tuple, export.wiki(g).collect())) == sorted(map(tuple, export.wiki(whole).collect()))
    plan = lambda own: own._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan(export.wiki(g)) and "LeftSemi" not in plan(export.wiki(whole))


@pytest.mark.parametrize("n", [0, 1, 2500])
def test_digests_of_the_wiki_are_those_of_its_texts(spark, n):
    import hashlib

    from loomgraph.plans import queries

    rows = [(k * 7919 % 2503, f"é[{k}]\n" if k % 3 else "", "f", 0, 0, k, k) for k in range(n)]
    g = graph_of(spark.createDataFrame(rows, NODE), spark.createDataFrame(ties([(rows[k][0], rows[0][0]) for k in range(0, n, 50)]), EDGE))
    want = {r.file: hashlib.sha256(r.content.encode()).hexdigest() for r in export.wiki(g).collect()}
    got = export.wiki_digests(g)
    assert {r.file: r.digest for r in got.collect()} == want and len(want) == n + 1
    # no list of all nodes, and the query takes this way
    plan = lambda own: own._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [collect_list" not in plan(got) and "wiki_digests" in queries.wiki_pages.__code__.co_names


def test_classified_edges_are_not_shuffled_again_for_their_sources_labels(spark):
    g, h = (make(spark, 6, ties(pairs)).with_(whole=True) for pairs in ([(0, 1), (1, 2), (0, 3)], [(0, 1), (3, 4), (0, 5)]))
    own = parity.named_edges(parity.classify_edges(g, h, by="source"), g, h)
    other = parity.named_edges(parity.classify_edges(g, h), g, h)
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, other.collect())) and own.count() == 5
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles(own) < shuffles(other)
