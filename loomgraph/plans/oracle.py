"""The registered queries as SQL for DuckDB over the same tables."""

from __future__ import annotations


def _id(label: str) -> str:
    return f"CAST(('0x' || substr(sha256({label}), 1, 15)) AS BIGINT)"


_KINDS = (("region", "r_regionkey", "region"), ("nation", "n_nationkey", "nation"), ("customer", "c_custkey", "customer"), ("supplier", "s_suppkey", "supplier"), ("part", "p_partkey", "part"), ("orders", "o_orderkey", "order"))
_RAW_NODES = " UNION ALL ".join(f"SELECT '{k}:' || {c} AS label, '{t}' AS source_file, CAST({c} AS BIGINT) + 1 AS start_line, {i} AS file_ord, CAST({c} AS BIGINT) AS row_ord FROM {t}" for i, (t, c, k) in enumerate(_KINDS))
_TIER = "CASE l_returnflag WHEN 'N' THEN 'EXTRACTED' WHEN 'A' THEN 'INFERRED' ELSE 'AMBIGUOUS' END"
_STEP = "l_linenumber * 4 + CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END"
_RAW_EDGES = f"""
    SELECT 'nation:' || n_nationkey AS s, 'region:' || n_regionkey AS t, 'in_region' AS relation, 'EXTRACTED' AS confidence, 0 AS file_ord, CAST(n_nationkey AS BIGINT) * 64 AS row_ord FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'in_nation', 'EXTRACTED', 1, c_custkey * 64 FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'in_nation', 'EXTRACTED', 2, s_suppkey * 64 FROM supplier
    UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'placed_by', 'EXTRACTED', 3, o_orderkey * 64 FROM orders
    UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'contains', {_TIER}, 4, l_orderkey * 64 + {_STEP} FROM lineitem
    UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'supplied_by', 'INFERRED', 5, l_orderkey * 64 + {_STEP} FROM lineitem"""

G = f"""WITH raw_nodes AS ({_RAW_NODES}),
nodes AS (SELECT {_id('label')} AS id, label, source_file, start_line FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY file_ord, row_ord) AS k FROM raw_nodes) WHERE k = 1),
raw_edges AS ({_RAW_EDGES}),
resolved AS (SELECT a.id AS source, b.id AS target, relation, confidence, e.file_ord, e.row_ord FROM raw_edges e JOIN nodes a ON a.label = e.s JOIN nodes b ON b.label = e.t),
edges AS (SELECT source, target, relation, confidence FROM (SELECT *, row_number() OVER (PARTITION BY source, target, relation ORDER BY file_ord, row_ord) AS k FROM resolved) WHERE k = 1),
members AS (SELECT c AS community, n.id AS node FROM (
    SELECT CAST(c_nationkey AS BIGINT) AS c, 'customer:' || c_custkey AS l FROM customer UNION ALL SELECT s_nationkey, 'supplier:' || s_suppkey FROM supplier
    UNION ALL SELECT n_nationkey, 'nation:' || n_nationkey FROM nation) m JOIN nodes n ON n.label = m.l),
communities AS (SELECT DISTINCT community AS id, 'community-' || community AS label FROM members),
pairs AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM edges WHERE source <> target),
trusted AS (SELECT * FROM edges WHERE confidence = 'EXTRACTED'),
degree AS (SELECT id, CAST(sum(n) AS BIGINT) AS degree FROM (SELECT id, 0 AS n FROM nodes UNION ALL SELECT source, 1 FROM edges UNION ALL SELECT target, 1 FROM edges) GROUP BY id),
named AS (SELECT a.label AS sl, b.label AS tl, relation, confidence FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target)"""


def _version(name: str, drop: int, names: tuple[str, ...]) -> str:
    new = ", ".join(f"('{n}')" for n in names)
    return f""",
{name}_n AS (SELECT label, source_file FROM nodes WHERE NOT (source_file = 'customer' AND CAST(split_part(label, ':', 2) AS BIGINT) % {drop} = 0)
    UNION ALL SELECT l, 'added' FROM (VALUES {new}) v(l)),
{name}_e AS (SELECT sl, tl, relation, confidence FROM named WHERE sl IN (SELECT label FROM {name}_n) AND tl IN (SELECT label FROM {name}_n)
    UNION ALL SELECT l, 'region:0', 'tagged', 'EXTRACTED' FROM (VALUES {new}) v(l)),
{name}_c AS (SELECT id, CASE WHEN id = 0 THEN 'community-{names[0]}' ELSE label END AS label FROM communities),
{name}_m AS (SELECT community, n.label FROM members m JOIN nodes n ON n.id = m.node WHERE n.label IN (SELECT label FROM {name}_n))"""


V = G + _version("o", 7, ("ours:1", "ours:2", "both:1")) + _version("t", 5, ("theirs:1", "both:1")) + """,
m3n AS (SELECT label, coalesce(min(CASE WHEN side = 0 THEN source_file END), min(source_file)) AS source_file
    FROM (SELECT *, 0 AS side FROM o_n UNION ALL SELECT *, 1 FROM t_n) u GROUP BY label
    HAVING label NOT IN (SELECT label FROM nodes) OR count(DISTINCT side) = 2)"""
_ARCS = "arcs AS (SELECT DISTINCT sl AS producer, tl AS consumer, relation FROM named WHERE relation IN ('in_region', 'in_nation', 'placed_by', 'contains', 'supplied_by'))"


def _arcs_of(v: str) -> str:
    return f"{v}_a AS (SELECT DISTINCT sl AS producer, tl AS consumer, relation FROM {v}_e WHERE relation IN ('in_region', 'in_nation', 'placed_by', 'contains', 'supplied_by'))"


A = V + f", {_ARCS}, {_arcs_of('o')}, {_arcs_of('t')}"
_CROSS = G + """,
cross_edges AS (SELECT * FROM edges UNION ALL SELECT c.id, p.id, 'knows', 'EXTRACTED' FROM nodes c JOIN nodes p
    ON c.source_file = 'customer' AND p.source_file = 'supplier' AND split_part(c.label, ':', 2) = split_part(p.label, ':', 2)),
bridges AS (SELECT e.*, a.community AS source_community, b.community AS target_community FROM cross_edges e JOIN members a ON a.node = e.source JOIN members b ON b.node = e.target
    WHERE confidence = 'EXTRACTED' AND a.community <> b.community)"""
_BOTH = """, adj AS (SELECT DISTINCT source AS a, target AS b FROM edges WHERE source <> target UNION SELECT target, source FROM edges WHERE source <> target)"""


def _path(levels: int, start: str, end: str) -> str:
    """Levels of a breadth-first search that keep the smallest path to each node."""
    out = G + _BOTH + f""", l0 AS (SELECT min(id) AS v, [min(id)] AS path FROM nodes WHERE label = '{start}'), seen0 AS (SELECT v FROM l0)"""
    for k in range(1, levels + 1):
        out += f""", l{k} AS (SELECT b AS v, min(list_append(path, b)) AS path FROM l{k - 1} JOIN adj ON a = v WHERE b NOT IN (SELECT v FROM seen{k - 1}) GROUP BY b),
            seen{k} AS (SELECT v FROM seen{k - 1} UNION ALL SELECT v FROM l{k})"""
    every = " UNION ALL ".join(f"SELECT {k} AS hops, path FROM l{k} WHERE v = (SELECT min(id) FROM nodes WHERE label = '{end}')" for k in range(levels + 1))
    return out + f", hit AS (SELECT hops, path FROM ({every}) ORDER BY hops LIMIT 1)"


_P = _path(4, "region:1", "supplier:7")


def _around(label: str, first: int | None = None) -> str:
    pick = f"SELECT id FROM nodes WHERE contains(lower(label), '{label}') ORDER BY id" + (f" LIMIT {first}" if first else "")
    return G + f""", ids AS ({pick}),
    around AS (SELECT source AS node, 'out' AS direction, target AS peer, relation, confidence FROM edges WHERE source IN (SELECT id FROM ids)
        UNION ALL SELECT target, 'in', source, relation, confidence FROM edges WHERE target IN (SELECT id FROM ids))"""


_PART = "octet_length(encode({0})) || ':' || {0}"


def _fields(section: str, columns: list[str]) -> str:
    return f"sha256('{section}|' || " + " || ".join("octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR)".format(c) for c in columns) + ")"


_LP = G + """, tp AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM trusted WHERE source <> target),
    both_ways AS (SELECT a AS id, b AS peer FROM tp UNION ALL SELECT b, a FROM tp), lab0 AS (SELECT id, id AS label FROM nodes)"""
for _k in (1, 2):
    _LP += f""", votes{_k} AS (SELECT w.id, l.label, count(*) AS n FROM both_ways w JOIN lab{_k - 1} l ON l.id = w.peer GROUP BY 1, 2),
    won{_k} AS (SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS k FROM votes{_k}) WHERE k = 1),
    lab{_k} AS (SELECT p.id, coalesce(w.label, p.label) AS label FROM lab{_k - 1} p LEFT JOIN won{_k} w USING (id))"""

# the smallest id within so many steps; the projection's diameter is smaller
_COMPONENTS = G + """, ends AS MATERIALIZED (SELECT source AS id, target AS peer FROM edges UNION SELECT target, source FROM edges),
    c0 AS MATERIALIZED (SELECT id, id AS label FROM nodes)"""
for _k in range(1, 15):
    _COMPONENTS += f""", c{_k} AS MATERIALIZED (SELECT c.id, least(c.label, coalesce(m.label, c.label)) AS label FROM c{_k - 1} c
    LEFT JOIN (SELECT e.id, min(p.label) AS label FROM ends e JOIN c{_k - 1} p ON p.id = e.peer GROUP BY e.id) m ON m.id = c.id)"""
_COMPONENTS += ", comp AS (SELECT id, label AS component FROM c14)"

_EVENTS = """WITH ev AS (SELECT DISTINCT event_id % 2 AS h, 'user:' || user_id AS producer, 'type:' || event_type AS consumer, 'emits' AS relation FROM events),
b AS (SELECT DISTINCT producer, consumer, relation FROM ev WHERE h = 0), a AS (SELECT DISTINCT producer, consumer, relation FROM ev WHERE h = 1)"""
_LABEL = "WITH l AS (SELECT doc_id, ' <a&\"''\\> [x]:' || chr(9) || chr(10) || chr(1) || text || ' ' AS label FROM documents)"
_CC = "'[\\x00-\\x1f\\x7f-\\x{9f}]'"
_MANIFEST = "WITH m AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS content_hash FROM documents)"
_KEY = "WITH k AS (SELECT doc_id, sha256('7:extract|' || " + " || ".join(_PART.format(c) for c in ("source", "lang", "text")) + " || '|2:v0') AS key FROM documents)"
_UPDATED = f"""WITH un AS (SELECT {_id('label')} AS id, label, source_file || '/' || lpad(CAST(row_ord % 16 AS VARCHAR), 2, '0') AS source_file, start_line FROM ({_RAW_NODES}) WHERE NOT (source_file = 'orders' AND row_ord % 16 = 7)),
ue AS (SELECT * FROM (SELECT s, t, relation, confidence, file_ord, row_ord, row_ord // 64 AS k FROM ({_RAW_EDGES}))
    WHERE NOT (file_ord = 3 AND k % 16 = 7) AND NOT (file_ord >= 4 AND k % 16 = 2) AND NOT (file_ord >= 4 AND k % 16 = 5 AND row_ord % 64 >= 8))"""
_N = ",\nnl AS (SELECT n.*, m.community FROM nodes n LEFT JOIN members m ON m.node = n.id)"
_SPLIT = G + """, nn AS (SELECT count(*) AS n FROM nodes), ring AS (SELECT n, greatest(120.0, 24.0 / sin(pi() / n)) AS r FROM nn),
    size AS (SELECT n, r, greatest(300, CAST(ceil(2 * r + 156) AS BIGINT)) AS side FROM ring)"""


def oracle_sql() -> dict[str, str]:
    return {
        "nodes_first_wins": G + " SELECT id, label, source_file, start_line FROM nodes",
        "edges_resolved": G + " SELECT source, target, relation, count(*) AS n FROM resolved GROUP BY ALL",
        "edges_dangling": G + """, small AS (SELECT label FROM nodes WHERE source_file <> 'part' OR label IN (SELECT 'part:' || p_partkey FROM part WHERE p_size <= 40))
            SELECT s AS source, t AS target, relation, confidence, row_ord FROM raw_edges WHERE s NOT IN (SELECT label FROM small) OR t NOT IN (SELECT label FROM small)""",
        "edges_dedup_first_confidence": G + " SELECT source, target, relation, confidence FROM edges",
        "graph_counts": G + " SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM communities) AS communities",
        "id_collision_check": G + " SELECT count(*) AS nodes, count(DISTINCT id) AS ids, 0 AS collisions FROM nodes",
        "assemble_relations": G + " SELECT relation, confidence, count(*) AS n FROM edges GROUP BY ALL",
        "content_ids": f"SELECT doc_id, {_id('text')} AS id FROM documents",
        "canonical_order": G + " SELECT source, target, relation, confidence, row_number() OVER (PARTITION BY relation, source ORDER BY target) AS rank FROM edges",
        "merge2_nodes": V + f" SELECT {_id('label')} AS id, label, coalesce(min(CASE WHEN side = 0 THEN source_file END), min(source_file)) AS source_file FROM (SELECT *, 0 AS side FROM o_n UNION ALL SELECT *, 1 FROM t_n) u GROUP BY label",
        "merge2_edges": V + f" SELECT {_id('sl')} AS source, {_id('tl')} AS target, relation, coalesce(min(CASE WHEN side = 0 THEN confidence END), min(confidence)) AS confidence FROM (SELECT *, 0 AS side FROM o_e UNION ALL SELECT *, 1 FROM t_e) u GROUP BY sl, tl, relation",
        "merge2_communities": V + " SELECT community, count(*) AS members FROM (SELECT * FROM o_m UNION ALL SELECT * FROM t_m) GROUP BY community",
        "merge3_nodes": V + f" SELECT {_id('label')} AS id, label, source_file FROM m3n",
        "merge3_edges": V + f""" SELECT {_id('sl')} AS source, {_id('tl')} AS target, relation, coalesce(min(CASE WHEN side = 0 THEN confidence END), min(confidence)) AS confidence
            FROM (SELECT *, 0 AS side FROM o_e UNION ALL SELECT *, 1 FROM t_e) u WHERE sl IN (SELECT label FROM m3n) AND tl IN (SELECT label FROM m3n) GROUP BY sl, tl, relation
            HAVING (sl, tl, relation) NOT IN (SELECT (sl, tl, relation) FROM named) OR count(DISTINCT side) = 2""",
        "merge3_communities": V + """, u AS (SELECT *, 0 AS side FROM o_c UNION ALL SELECT *, 1 FROM t_c),
            keep AS (SELECT label, min(side) AS side, arg_min(id, side) AS was FROM u GROUP BY label HAVING label NOT IN (SELECT label FROM communities) OR count(DISTINCT side) = 2),
            num AS (SELECT *, row_number() OVER (ORDER BY side, was, label) - 1 AS id FROM keep),
            ms AS (SELECT 0 AS side, community, label FROM o_m UNION ALL SELECT 1, community, label FROM t_m)
            SELECT n.id, n.label, count(m.label) AS members FROM num n LEFT JOIN ms m ON m.side = n.side AND m.community = n.was AND m.label IN (SELECT label FROM m3n) GROUP BY n.id, n.label""",
        "merge3_manifest": "WITH f AS (SELECT CAST(item_id AS VARCHAR) AS path, sha256(text) AS content_hash FROM benchmark) SELECT * FROM f UNION ALL SELECT * FROM f WHERE CAST(path AS BIGINT) % 2 = 0",
        "prune_stale": G + " SELECT e.* FROM edges e WHERE source NOT IN (SELECT id FROM nodes WHERE source_file = 'supplier') AND target NOT IN (SELECT id FROM nodes WHERE source_file = 'supplier')",
        "trusted_edges": G + " SELECT * FROM trusted",
        "untrusted_edges": G + " SELECT * FROM edges WHERE confidence <> 'EXTRACTED'",
        "confidence_counts": G + " SELECT count(*) FILTER (confidence = 'EXTRACTED') AS extracted, count(*) FILTER (confidence = 'INFERRED') AS inferred, count(*) FILTER (confidence = 'AMBIGUOUS') AS ambiguous, count(*) AS total FROM edges",
        "edge_weights": G + " SELECT confidence, CAST(CASE WHEN confidence = 'EXTRACTED' THEN 1.0 ELSE 0.8 END AS DOUBLE) AS weight, count(*) AS n FROM edges GROUP BY ALL",
        "degree_centrality": G + " SELECT id, degree FROM degree",
        "god_nodes": G + """, d AS (SELECT id, CAST(sum(n) AS BIGINT) AS degree FROM (SELECT id, 0 AS n FROM nodes UNION ALL SELECT source, 1 FROM trusted UNION ALL SELECT target, 1 FROM trusted) GROUP BY id)
            SELECT row_number() OVER (ORDER BY degree DESC, id) AS rank, id, label, degree FROM d JOIN nodes USING (id) ORDER BY degree DESC, id LIMIT 20""",
        "report_hubs": G + """ SELECT row_number() OVER (ORDER BY degree DESC, id) AS rank, id, label, degree FROM degree JOIN nodes USING (id)
            WHERE source_file <> 'part' OR label IN (SELECT 'part:' || p_partkey FROM part WHERE p_size <= 40) ORDER BY degree DESC, id LIMIT 10""",
        "undirected_pairs": G + " SELECT a, b FROM pairs",
        "components": _COMPONENTS + " SELECT id, component FROM comp",
        "label_propagation_2": _LP + " SELECT id, label FROM lab2",
        "community_check": G + " SELECT count(*) AS nodes, count(DISTINCT id) AS covered, 0 AS repeated, 0 AS broken, TRUE AS modular FROM nodes",
        "community_numbering": _COMPONENTS + " SELECT dense_rank() OVER (ORDER BY component) - 1 AS community, id AS node FROM comp",
        "community_sizes": G + " SELECT community, count(*) AS members FROM members GROUP BY community",
        "community_of": G + " SELECT node, max(greatest(community, community % 7)) AS community FROM members GROUP BY node",
        "surprising_connections": _CROSS + " SELECT source, target, relation, confidence, source_community, target_community FROM bridges",
        "suggested_questions": _CROSS + """, d AS (SELECT id, CAST(sum(n) AS BIGINT) AS degree FROM (SELECT id, 0 AS n FROM nodes UNION ALL SELECT source, 1 FROM cross_edges UNION ALL SELECT target, 1 FROM cross_edges) GROUP BY id),
            h AS (SELECT row_number() OVER (ORDER BY degree DESC, id) AS rank, label, degree FROM d JOIN nodes USING (id) ORDER BY degree DESC, id LIMIT 5),
            b AS (SELECT e.source, e.target, e.relation, x.label AS sl, y.label AS tl FROM bridges e JOIN nodes x ON x.id = e.source JOIN nodes y ON y.id = e.target)
            SELECT 0 AS part, rank AS a, 0 AS b, '' AS relation, 0 AS k, 'What are the responsibilities of `' || label || '` (degree ' || degree || ')?' AS question FROM h
            UNION ALL SELECT 0, rank, 0, '', 1, 'Is `' || label || '` a structural hub that should be decomposed?' FROM h WHERE degree >= 5
            UNION ALL SELECT 1, source, target, relation, 0, 'Why does `' || sl || '` ' || relation || ' `' || tl || '` across community boundaries?' FROM b
            UNION ALL SELECT 1, source, target, relation, 1, 'Is the cross-community `' || relation || '` link from `' || sl || '` to `' || tl || '` intentional?' FROM b""",
        "find_by_label": G + " SELECT id, label FROM nodes WHERE contains(lower(label), 'er:12')",
        "trigram_index": G + " SELECT DISTINCT substr(lower(label), k, 3) AS trigram, id FROM (SELECT id, label, unnest(range(1, length(label) - 1)) AS k FROM nodes)",
        "trigram_blocks": G + """, t AS (SELECT DISTINCT substr(lower(label), k, 3) AS trigram, id FROM (SELECT id, label, unnest(range(1, length(label) - 1)) AS k FROM nodes)),
            r AS (SELECT trigram, id, (row_number() OVER (PARTITION BY trigram ORDER BY id) - 1) // 128 AS block FROM t)
            SELECT trigram, block, min(id) AS first, max(id) AS last, count(*) AS n FROM r GROUP BY trigram, block""",
        "trigram_find": G + " SELECT id, label FROM nodes WHERE contains(lower(label), 'er:12')",
        "query_top50": G + " SELECT row_number() OVER (ORDER BY id) AS rank, id, label, count(*) OVER () AS total FROM nodes WHERE contains(lower(label), 'er:12') ORDER BY id LIMIT 50",
        "shortest_path": _P + " SELECT unnest(range(len(path))) AS position, unnest(path) AS id FROM hit",
        "path_labels": _P + ", steps AS (SELECT hops, unnest(range(len(path))) AS k, unnest(path) AS id FROM hit) SELECT string_agg(label, ' -> ' ORDER BY k) AS path, max(hops) AS hops FROM steps JOIN nodes USING (id) HAVING count(*) > 0",
        "explain_edges": _around("nation:1", 10) + """ SELECT node, direction, rank, peer, label AS peer_label, relation, total FROM (
            SELECT *, row_number() OVER (PARTITION BY node, direction ORDER BY peer, relation, confidence) AS rank, count(*) OVER (PARTITION BY node, direction) AS total FROM around) JOIN nodes ON id = peer WHERE rank <= 8""",
        "explain_communities": G + """, i AS (SELECT id, label FROM nodes WHERE contains(lower(label), 'customer:1') ORDER BY id LIMIT 10)
            SELECT i.id, i.label, m.community, c.label AS community_label FROM i LEFT JOIN members m ON m.node = i.id LEFT JOIN communities c ON c.id = m.community""",
        "node_neighbourhood": _around("supplier:1") + " SELECT node, direction, peer, label AS peer_label, relation, confidence FROM around JOIN nodes ON id = peer",
        "community_members": G + " SELECT row_number() OVER (ORDER BY id) AS rank, id, label FROM members JOIN nodes ON id = node WHERE community = 3",
        "report_sample": G + " SELECT row_number() OVER (ORDER BY id) AS rank, id, label || ' (' || source_file || ':' || start_line || ')' AS line FROM nodes ORDER BY id LIMIT 20",
        "graph_health": G + " SELECT 'nodes=' || (SELECT count(*) FROM nodes) || ' edges=' || (SELECT count(*) FROM edges) || ' communities=' || (SELECT count(*) FROM communities) || ' schema=graph.v0' AS health",
        "token_estimate": "SELECT doc_id, CAST(ceil(octet_length(encode(text)) / 4.0) AS BIGINT) AS tokens FROM documents",
        "budget_pack": "SELECT * FROM (SELECT rank, cost, CAST(sum(cost) OVER (ORDER BY rank) AS BIGINT) + 6 AS used FROM (SELECT item_id AS rank, CAST(ceil(octet_length(encode(text)) / 4.0) AS BIGINT) AS cost FROM benchmark)) WHERE used <= 500",
        "generation_id": G + f""", h AS (SELECT {_fields('node', ['id', 'label', 'source_file', '0', '0', 'start_line', 'start_line'])} AS h FROM nodes
            UNION ALL SELECT {_fields('edge', ['source', 'target', 'relation', 'confidence'])} FROM edges
            UNION ALL SELECT {_fields('community', ['id', 'label'])} FROM communities UNION ALL SELECT {_fields('member', ['community', 'node'])} FROM members),
            g AS (SELECT substr(h, 1, 3) AS g, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY 1)
            SELECT substr(sha256(string_agg(g || '=' || d, ';' ORDER BY g)), 1, 16) AS generation FROM g""",
        "parity_nodes": V + " SELECT label, CASE WHEN o.l IS NOT NULL AND t.l IS NOT NULL THEN 'matched' WHEN t.l IS NOT NULL THEN 'missing' ELSE 'extra' END AS status FROM (SELECT label, label AS l FROM o_n) o FULL JOIN (SELECT label, label AS l FROM t_n) t USING (label)",
        "parity_edges": V + """ SELECT sl AS source_label, tl AS target_label, relation, CASE WHEN o.k AND t.k THEN 'matched' WHEN t.k THEN 'missing' ELSE 'extra' END AS status
            FROM (SELECT DISTINCT sl, tl, relation, true AS k FROM o_e) o FULL JOIN (SELECT DISTINCT sl, tl, relation, true AS k FROM t_e) t USING (sl, tl, relation)""",
        "regression_free": V + " SELECT (SELECT count(*) FROM t_n WHERE label NOT IN (SELECT label FROM o_n)) + (SELECT count(*) FROM (SELECT sl, tl, relation FROM t_e EXCEPT SELECT sl, tl, relation FROM o_e)) = 0 AS regression_free",
        "relation_coverage": V + """, c AS (SELECT t.relation, count(o.sl) AS matched, count(*) AS total FROM (SELECT DISTINCT sl, tl, relation FROM t_e) t LEFT JOIN (SELECT DISTINCT sl, tl, relation FROM o_e) o USING (sl, tl, relation) GROUP BY 1)
            SELECT relation, matched, total, (100 * matched + total // 2) // total AS percent FROM c""",
        "co_clustering": G + """, g AS (SELECT node, community, community % 4 AS golden FROM members), big AS (SELECT golden FROM g GROUP BY golden ORDER BY count(*) DESC, golden LIMIT 1),
            p AS (SELECT community, count(*) AS n FROM g WHERE golden = (SELECT golden FROM big) GROUP BY community) SELECT CAST(sum(n) AS BIGINT) AS members, max(n) AS together FROM p""",
        "extract_arcs": G + f", {_ARCS} SELECT producer, consumer, relation FROM arcs",
        "diff_arcs": A + " SELECT relation, present, count(*) AS n FROM (SELECT a.relation, o.producer IS NOT NULL AS present FROM arcs a LEFT JOIN o_a o USING (producer, consumer, relation)) GROUP BY ALL",
        "arc_coherence": A + " SELECT count(o.producer) AS n_present, count(*) AS n_expected, round(count(o.producer) / CAST(count(*) AS DOUBLE), 9) AS coherence FROM arcs a LEFT JOIN o_a o USING (producer, consumer, relation)",
        "arc_delta": A + """ SELECT producer, consumer, relation, CASE WHEN in_o THEN 'severed' ELSE 'healed' END AS change FROM (
            SELECT *, (producer, consumer, relation) IN (SELECT (producer, consumer, relation) FROM o_a) AS in_o, (producer, consumer, relation) IN (SELECT (producer, consumer, relation) FROM t_a) AS in_t FROM arcs) WHERE in_o <> in_t""",
        "arc_delta_summary": A + """, x AS (SELECT (producer, consumer, relation) IN (SELECT (producer, consumer, relation) FROM o_a) AS o, (producer, consumer, relation) IN (SELECT (producer, consumer, relation) FROM t_a) AS t FROM arcs),
            y AS (SELECT count(*) FILTER (o AND NOT t) AS n_severed, count(*) FILTER (t AND NOT o) AS n_healed, count(*) FILTER (o) AS no, count(*) FILTER (t) AS nt, count(*) AS n FROM x)
            SELECT n_severed, n_healed, round(CAST(nt AS DOUBLE) / n - CAST(no AS DOUBLE) / n, 9) AS delta, n_severed > 0 AS is_regression, n_healed > 0 AND n_severed = 0 AS is_recovery FROM y""",
        "arc_delta_live": _EVENTS + " SELECT *, 'severed' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'healed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)",
        "arc_delta_live_summary": _EVENTS + ", n AS (SELECT (SELECT count(*) FROM b) AS n_before, (SELECT count(*) FROM a) AS n_after) SELECT n_before, n_after, round(CAST(n_after - n_before AS DOUBLE) / greatest(n_before, n_after), 9) AS delta FROM n",
        "sphere_registration": G + " SELECT 'graph.community.' || c.id AS sphere, c.label, count(*) AS members FROM communities c JOIN members m ON m.community = c.id GROUP BY c.id, c.label",
        "manifest": _MANIFEST + " SELECT * FROM m",
        "manifest_changes": _MANIFEST + """, b AS (SELECT * FROM m WHERE CAST(path AS BIGINT) % 5 <> 0),
            a AS (SELECT path, CASE WHEN CAST(path AS BIGINT) % 4 = 0 THEN sha256(content_hash) ELSE content_hash END AS content_hash FROM m WHERE CAST(path AS BIGINT) % 3 <> 0)
            SELECT path, CASE WHEN b.content_hash IS NULL THEN 'added' WHEN a.content_hash IS NULL THEN 'removed' ELSE 'changed' END AS status FROM b FULL JOIN a USING (path) WHERE b.content_hash IS DISTINCT FROM a.content_hash""",
        "updated_nodes": _UPDATED + " SELECT id, label, source_file, start_line FROM un",
        "updated_edges": _UPDATED + """ SELECT source, target, relation, confidence FROM (SELECT a.id AS source, b.id AS target, relation, confidence,
            row_number() OVER (PARTITION BY s, t, relation ORDER BY k % 16, row_ord) AS place FROM ue JOIN un a ON a.label = ue.s JOIN un b ON b.label = ue.t) WHERE place = 1""",
        "update_changes": "SELECT * FROM (VALUES ('customer/03', 'added'), ('orders/07', 'removed'), ('lineitem/02', 'removed'), ('lineitem/05', 'changed')) v(path, status)",
        "stored_results": _KEY + """, t AS (SELECT doc_id, key, CAST(ceil(octet_length(encode(text)) / 4.0) AS BIGINT) AS tokens FROM k JOIN documents USING (doc_id)),
            k0 AS (SELECT DISTINCT key FROM t WHERE doc_id % 3 = 0), marked AS (SELECT DISTINCT key FROM t WHERE doc_id % 6 = 0)
            SELECT DISTINCT key, tokens FROM t WHERE key NOT IN (SELECT key FROM k0) OR key IN (SELECT key FROM marked)""",
        "cache_keys": _KEY + " SELECT doc_id, key FROM k",
        "cache_partition": _KEY + " SELECT doc_id, key, key IN (SELECT key FROM k WHERE doc_id % 3 = 0) AS cached FROM k",
        "debounce_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > ts - INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
            s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM e)
            SELECT user_id, min(ts) AS burst_start, max(ts) + INTERVAL 1 HOUR AS burst_end, count(*) AS n_events FROM s GROUP BY user_id, k""",
        "url_validate": """SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'scheme' WHEN 2 THEN 'unsafe character' ELSE 'credentials' END AS violation FROM pages""",
        "url_extension": "SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'py' WHEN 2 THEN 'gz' WHEN 3 THEN 'hidden' ELSE CASE WHEN contains(split_part(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^.*?://[^/]*', ''), '/', -1), '.') THEN lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\\.([^./]+)$', 1)) ELSE 'rs' END END AS extension FROM pages",
        "sanitize_label": _LABEL + f" SELECT doc_id, substr(regexp_replace(label, {_CC}, '', 'g'), 1, 256) AS out FROM l",
        "question_label": _LABEL + f" SELECT doc_id, trim(substr(regexp_replace(label, {_CC}, '', 'g'), 1, 256)) AS out FROM l",
        "xml_escape": _LABEL + " SELECT doc_id, replace(replace(replace(replace(replace(replace(label, chr(1), ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS out FROM l",
        "cypher_escape": _LABEL + " SELECT doc_id, replace(replace(replace(replace(replace(replace(label, '\\', '\\\\'), '''', '\\'''), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t'), chr(1), '') AS out FROM l",
        "export_tokens": _LABEL + """ SELECT doc_id, replace(replace(label, '[', '\\['), ']', '\\]') AS link, regexp_replace(label, '[^A-Za-z0-9._-]', '', 'g') AS token,
            replace(replace(label, '\\', '\\\\'), '"', '\\"') AS quoted, replace(replace(replace(label, '[', ''), ']', ''), ':', '') AS field FROM l""",
        "path_tags": "SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN 'root' ELSE source END AS crate, CASE doc_id % 4 WHEN 0 THEN 'rust' WHEN 1 THEN 'python' WHEN 2 THEN 'js' ELSE 'other' END AS lang, lower(lang) AS stem FROM documents",
        "slugs": "SELECT doc_id, trim(regexp_replace(lower(regexp_replace(text, '[^ -~]', '', 'g')), '[^a-z0-9]+', '_', 'g'), '_') AS slug, trim(source, '_') AS method FROM documents",
        "span_functions": "SELECT CAST(greatest(l_linenumber - 3, 0) AS BIGINT) AS bytes, l_linenumber > 3 AS holds, l_linenumber >= 3 AS formed, count(*) AS n FROM lineitem GROUP BY ALL",
        "node_link_rows": G + _N + " SELECT community, id, label, source_file, 'L' || start_line AS source_location FROM nl",
        "node_link_links": G + " SELECT confidence, relation, source, target, CAST(CASE WHEN confidence = 'EXTRACTED' THEN 1.0 ELSE 0.8 END AS DOUBLE) AS weight FROM edges",
        "node_link_round_trip": G + _N + " SELECT row_number() OVER (ORDER BY id) - 1 AS id, label, source_file, start_line, community FROM nl",
        "node_link_round_trip_edges": G + ", num AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM nodes) SELECT a.k AS source, b.k AS target, relation, confidence FROM edges e JOIN num a ON a.id = e.source JOIN num b ON b.id = e.target",
        "summary_entries": """SELECT user_id, n_events, batch FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY batch DESC) AS k
            FROM (SELECT user_id, CAST(event_id % 3 AS INTEGER) AS batch, count(*) AS n_events FROM events WHERE user_id % 4 > event_id % 3 GROUP BY ALL)) WHERE k = 1""",
        "svg_layout": _SPLIT + """, p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place FROM nodes)
            SELECT p.id, place, round(r * cos(2 * pi() * place / n - pi() / 2) + side / 2.0, 3) AS x, round(r * sin(2 * pi() * place / n - pi() / 2) + side / 2.0, 3) AS y,
            CASE WHEN community IS NULL THEN '#cccccc' ELSE ['#4e79a7', '#f28e2b', '#e15759', '#76b7b2', '#59a14f', '#edc948', '#b07aa1', '#ff9da7', '#9c755f', '#bab0ac'][CAST(community % 10 + 1 AS INTEGER)] END AS fill
            FROM p LEFT JOIN members m ON m.node = p.id, size""",
        "graphml_rows": G + """ SELECT 0 AS kind, id AS a, CAST(NULL AS BIGINT) AS b, '<node id="n' || id || '"><data key="d_label">' || label || '</data><data key="d_source_file">' || source_file || '</data></node>' AS xml FROM nodes
            UNION ALL SELECT 1, source, target, '<edge source="n' || source || '" target="n' || target || '"><data key="d_relation">' || relation || '</data><data key="d_confidence">' || confidence || '</data></edge>' FROM edges""",
        "cypher_rows": G + """ SELECT 0 AS kind, id AS a, CAST(NULL AS BIGINT) AS b, 'MERGE (n' || id || ':Symbol {id: ' || id || ', label: ''' || label || ''', source_file: ''' || source_file || ''', line: ' || start_line || '});' AS statement FROM nodes
            UNION ALL SELECT 1, source, target, 'MATCH (a {id: ' || source || '}),(b {id: ' || target || '}) MERGE (a)-[:REL {relation: ''' || relation || ''', confidence: ''' || confidence || '''}]->(b);' FROM edges""",
        "vault_rows": G + _N + " SELECT nl.id, label || '.md' AS file, source_file AS crate, 'other' AS lang, start_line AS line, degree, community FROM nl JOIN degree d ON d.id = nl.id",
    }
