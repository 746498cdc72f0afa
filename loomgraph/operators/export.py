"""Graphs as rows of the usual formats, and as whole documents.

Row functions stay distributed. A document of one file is either text that the driver
puts together, for graphs that people open, or written by ``write_…``: tasks write
ranges of its sorted lines, and the files of these become one.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import crate_of, cypher_escape, display_safe, field_key, file_stem, lang_of, md_link_text, sanitize_label, xml_escape, yaml_quoted, yaml_token
from ..model import Graph
from ..session import scratch_path
from .analytics import community_of, community_sizes, report_hubs, suggested_queries
from .ranks import ranked
from .trust import with_weight

# Fixed values of the drawing.
RADIUS, GAP, OFFSET, PADDING, LEAST_SIDE, LEAST_RING = 18, 6, 14, 60, 300, 120
PALETTE = ("#4e79a7", "#f28e2b", "#e15759", "#76b7b2", "#59a14f", "#edc948", "#b07aa1", "#ff9da7", "#9c755f", "#bab0ac")
UNCLUSTERED = "#cccccc"


def node_link_nodes(g: Graph) -> DataFrame:
    """Nodes as the exchange format has them; labels are made safe here, lines are all that is left of spans."""
    own = g.nodes.join(community_of(g.members).withColumnRenamed("node", "id"), "id", "left")
    return own.select("community", "id", display_safe(sanitize_label(F.col("label"))).alias("label"), "source_file", F.concat(F.lit("L"), "start_line").alias("source_location"))


def node_link_links(g: Graph) -> DataFrame:
    return with_weight(g.edges).select("confidence", "relation", "source", "target", "weight")


def node_link(g: Graph) -> str:
    nodes = [r.asDict() for r in node_link_nodes(g).orderBy("id").collect()]
    links = [r.asDict() for r in node_link_links(g).orderBy("source", "target", "relation").collect()]
    return json.dumps({"directed": True, "graph": {"schema_version": g.schema}, "links": links, "multigraph": False, "nodes": nodes}, ensure_ascii=False, indent=2, sort_keys=True)


def write_document(lines: DataFrame, path: str, end: str = "\n", line: Column | None = None) -> None:
    """The lines (kind, a, b, relation: their order; line, or what ``line`` makes of the other columns, so that texts aren't shuffled) as one file at ``path``, which is replaced; ``end`` is what follows the last line, a newline or nothing.

    Lines are sorted by ranges and written by tasks, whose commit sees to it that a task
    that is repeated counts once. No row comes to the driver: its file system client
    copies the parts, a buffer at a time, to a new name, and renames that when it is whole.
    A part goes as soon as it is copied, so the text lies there once, and a part twice; parts are compressed.
    """
    spark = lines.sparkSession
    parts = scratch_path(spark, "document")
    rest = [c for c in lines.columns if c not in ("kind", "a", "b", "relation")]
    lines.orderBy("kind", "a", "b", "relation", *rest).select((F.col("line") if line is None else line).alias("line")).write.option("lineSep", "\n").option("compression", "gzip").text(parts)
    hadoop, conf = spark._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    source, target, begun = (hadoop.fs.Path(x) for x in (parts, path, f"{path}.{parts[-12:]}"))
    fs, to = source.getFileSystem(conf), target.getFileSystem(conf)
    # a range without lines leaves no part, but for the first
    files = sorted(((f.getPath().getName(), f.getPath()) for f in fs.listStatus(source) if f.getPath().getName().startswith("part-")), key=lambda f: f[0])
    opened = lambda part: spark._jvm.java.util.zip.GZIPInputStream(fs.open(part), 1 << 16)
    io = spark._jvm.org.apache.commons.io.IOUtils
    out = to.create(begun, True)
    try:
        for k, (_, part) in enumerate(files):
            most = -1
            if not end and k == len(files) - 1:  # all but its last newline
                own = opened(part)
                try:
                    most = io.consume(own) - 1
                finally:
                    own.close()
            own = opened(part)
            try:
                io.copyLarge(own, out, 0, most)
            finally:
                own.close()
            fs.delete(part, False)
    finally:
        out.close()
    to.delete(target, False)
    to.rename(begun, target)
    fs.delete(source, True)


def _fixed(spark, texts: dict[int, str]) -> DataFrame:
    """Lines that stand before, between or behind others, by kind."""
    return spark.createDataFrame([(k, None, None, "", t) for k, t in texts.items() if t is not None], "kind int, a bigint, b bigint, relation string, line string")


def _json_object(fields: list[tuple[str, Column]], last: Column) -> Column:
    """An object in the indented form; there is a comma behind all but the last."""
    lines = F.concat_ws(",\n", *[F.concat(F.lit(f'      "{k}": '), F.coalesce(v, F.lit("null"))) for k, v in fields])
    return F.concat(F.lit("    {\n"), lines, F.lit("\n    }"), F.when(last, "").otherwise(","))


def _json_text(c: str) -> Column:
    """A text as JSON, without what ``to_json`` puts around it."""
    whole = F.to_json(F.struct(F.col(c).alias("v")))
    return F.when(F.col(c).isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))


def write_node_link(g: Graph, path: str) -> None:
    """The document of ``node_link``, byte by byte but for the hex digits of escaped controls in paths, which are capitals."""
    nodes, links = node_link_nodes(g), node_link_links(g)
    final_n = nodes.agg(F.max("id")).first()[0]
    final_l = links.agg(F.max(F.struct("source", "target", "relation")).alias("m")).select("m.*").first()
    number = lambda c: F.col(c).cast("string")
    is_last = (F.col("a") == final_l[0]) & (F.col("b") == final_l[1]) & (F.col("relation") == final_l[2])
    link = _json_object([("confidence", _json_text("confidence")), ("relation", _json_text("relation")), ("source", number("a")), ("target", number("b")), ("weight", number("weight"))], is_last)
    node = _json_object([("community", number("community")), ("id", number("a")), ("label", _json_text("label")), ("source_file", _json_text("source_file")), ("source_location", _json_text("source_location"))], F.col("a") == final_n)
    head = '{\n  "directed": true,\n  "graph": {\n    "schema_version": ' + json.dumps(g.schema, ensure_ascii=False) + '\n  },\n  "links": ['
    no_links, no_nodes = final_l[0] is None, final_n is None
    between = '  "multigraph": false,\n  "nodes": [' if no_links else '  ],\n  "multigraph": false,\n  "nodes": ['
    fixed = _fixed(nodes.sparkSession, {0: head + ("]," if no_links else ""), 2: between + ("]" if no_nodes else ""), 4: "}" if no_nodes else "  ]\n}"})
    # rows travel to their ranges as they are, and become text there
    rest = {"fixed": "string", "confidence": "string", "weight": "double", "community": "bigint", "label": "string", "source_file": "string", "source_location": "string"}
    part = lambda df, kind, a, b, relation: df.select(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), relation.alias("relation"), *[(F.col(c) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in rest.items()])
    rows = part(links, 1, F.col("source"), F.col("target"), F.col("relation")).unionByName(part(nodes, 3, F.col("id"), F.lit(None).cast("bigint"), F.lit("")))
    fixed = fixed.withColumnRenamed("line", "fixed")
    rows = rows.unionByName(fixed.select("kind", "a", "b", "relation", *[(F.col(c) if c == "fixed" else F.lit(None).cast(t)).alias(c) for c, t in rest.items()]))
    write_document(rows, path, "", F.when(F.col("kind") == 1, link).when(F.col("kind") == 3, node).otherwise(F.col("fixed")))


def graphml_rows(g: Graph) -> DataFrame:
    """kind (0 node, 1 edge), a, b, relation (the order), xml."""
    label, path = xml_escape(sanitize_label(F.col("label"))), xml_escape(F.col("source_file"))
    node = F.concat(F.lit('<node id="n'), "id", F.lit('"><data key="d_label">'), label, F.lit('</data><data key="d_source_file">'), path, F.lit("</data></node>"))
    relation = xml_escape(sanitize_label(F.col("relation")))
    edge = F.concat(F.lit('<edge source="n'), "source", F.lit('" target="n'), "target", F.lit('"><data key="d_relation">'), relation, F.lit('</data><data key="d_confidence">'), "confidence", F.lit("</data></edge>"))
    nodes = g.nodes.select(F.lit(0).alias("kind"), F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b"), F.lit("").alias("relation"), node.alias("xml"))
    return nodes.unionByName(g.edges.select(F.lit(1).alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), "relation", edge.alias("xml")))


def _graphml_head() -> str:
    keys = [("d_label", "node", "label"), ("d_source_file", "node", "source_file"), ("d_relation", "edge", "relation"), ("d_confidence", "edge", "confidence")]
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    return "\n".join(head + [f'<key id="{k}" for="{of}" attr.name="{n}" attr.type="string"/>' for k, of, n in keys] + ['<graph id="G" edgedefault="directed">'])


def graphml(g: Graph) -> str:
    rows = graphml_rows(g).orderBy("kind", "a", "b", "relation").collect()
    return "\n".join([_graphml_head(), *(r.xml for r in rows), "</graph>", "</graphml>", ""])


def write_graphml(g: Graph, path: str) -> None:
    """The document of ``graphml``, written by tasks."""
    fixed = _fixed(g.nodes.sparkSession, {-1: _graphml_head(), 2: "</graph>\n</graphml>"})
    write_document(graphml_rows(g).withColumnRenamed("xml", "line").unionByName(fixed), path)


def cypher_rows(g: Graph) -> DataFrame:
    """kind, a, b, relation (the order), statement."""
    node = F.format_string("MERGE (n%d:Symbol {id: %d, label: '%s', source_file: '%s', line: %d});", "id", "id", cypher_escape(F.col("label")), cypher_escape(F.col("source_file")), "start_line")
    edge = F.format_string("MATCH (a {id: %d}),(b {id: %d}) MERGE (a)-[:REL {relation: '%s', confidence: '%s'}]->(b);", "source", "target", cypher_escape(F.col("relation")), cypher_escape(F.col("confidence")))
    nodes = g.nodes.select(F.lit(0).alias("kind"), F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b"), F.lit("").alias("relation"), node.alias("statement"))
    return nodes.unionByName(g.edges.select(F.lit(1).alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), "relation", edge.alias("statement")))


def _cypher_head(g: Graph) -> str:
    return f"// {g.nodes.count()} nodes, {g.edges.count()} edges"


def cypher(g: Graph) -> str:
    rows = cypher_rows(g).orderBy("kind", "a", "b", "relation").collect()
    return "".join(f"{line}\n" for line in [_cypher_head(g), *(r.statement for r in rows)])


def write_cypher(g: Graph, path: str) -> None:
    """The document of ``cypher``, written by tasks."""
    write_document(cypher_rows(g).withColumnRenamed("statement", "line").unionByName(_fixed(g.nodes.sparkSession, {-1: _cypher_head(g)})), path)


def _side(n: int) -> tuple[float, int]:
    import math

    ring = max(float(LEAST_RING), (RADIUS + GAP) / math.sin(math.pi / n)) if n > 1 else 0.0
    return ring, max(LEAST_SIDE, math.ceil(2 * ring + 2 * (RADIUS + PADDING))) if n > 1 else LEAST_SIDE


def svg_layout(g: Graph) -> DataFrame:
    """id, place, x, y, fill: nodes on a circle in the order of ids, from the top clockwise."""
    n = g.nodes.count()
    ring, side = _side(n)
    place = ranked(g.nodes.select("id"), ["id"], name="place").withColumn("place", F.col("place") - 1)
    angle = 2 * F.pi() * F.col("place") / F.lit(max(n, 1)) - F.pi() / 2
    own = place.join(community_of(g.members).withColumnRenamed("node", "id"), "id", "left")
    fill = F.when(F.col("community").isNotNull(), F.element_at(F.array(*[F.lit(c) for c in PALETTE]), (F.pmod(F.col("community"), F.lit(len(PALETTE))) + 1).cast("int"))).otherwise(UNCLUSTERED)
    return own.select("id", "place", (F.lit(ring) * F.cos(angle) + side / 2).alias("x"), (F.lit(ring) * F.sin(angle) + side / 2).alias("y"), fill.alias("fill"))


def svg(g: Graph) -> str:
    _, side = _side(g.nodes.count())
    at = svg_layout(g)
    nodes = at.join(g.nodes.select("id", xml_escape(F.col("label")).alias("label")), "id").orderBy("place").collect()
    p = lambda c: at.select(F.col("id").alias(c), F.col("x").alias(f"{c}_x"), F.col("y").alias(f"{c}_y"))
    lines = g.edges.join(p("source"), "source").join(p("target"), "target").where("source <> target").orderBy("source", "target", "relation").collect()
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{side}" height="{side}" viewBox="0 0 {side} {side}">']
    out += [f'<line stroke="#888888" x1="{r.source_x:.2f}" y1="{r.source_y:.2f}" x2="{r.target_x:.2f}" y2="{r.target_y:.2f}"/>' for r in lines]
    for r in nodes:
        out.append(f'<circle cx="{r.x:.2f}" cy="{r.y:.2f}" r="{RADIUS}" fill="{r.fill}"/><text text-anchor="middle" x="{r.x:.2f}" y="{r.y + RADIUS + OFFSET:.2f}">{r.label}</text>')
    return "\n".join([*out, "</svg>"])


def html(g: Graph) -> str:
    """A page of its own with the data inside; no ``<`` of the data survives."""
    data = node_link(g).replace("<", "\\u003c")
    return f"""<!doctype html><meta charset="utf-8"><title>Graph</title><input id="q" placeholder="label"><ol id="out"></ol>
<script type="application/json" id="data">{data}</script>
<script>
const g = JSON.parse(document.getElementById("data").textContent), out = document.getElementById("out");
const show = q => {{ out.replaceChildren(...g.nodes.filter(n => n.label.toLowerCase().includes(q.toLowerCase())).slice(0, 200).map(n => {{
  const li = document.createElement("li"); li.textContent = n.label + " (" + n.source_file + ":" + n.source_location + ")"; return li; }})); }};
document.getElementById("q").oninput = e => show(e.target.value); show("");
</script>
"""


def report(g: Graph) -> str:
    hubs = report_hubs(g).withColumn("label", display_safe(F.col("label"))).orderBy("rank").collect()
    sizes = g.communities.select("id").join(community_sizes(g.members).withColumnRenamed("community", "id"), "id", "left").na.fill(0).orderBy("id").collect()
    out = ["# Graph Report", "", f"- Nodes: {g.nodes.count()}", f"- Edges: {g.edges.count()}", f"- Communities: {len(sizes)}", "", "## Top Hubs", ""]
    out += [f"- {h.label} ({h.degree})" for h in hubs] or ["_none_"]
    out += ["", "## Communities", ""] + ([f"- community {r.id}: {r.members} members" for r in sizes] or ["_none_"])
    out += ["", "## Suggested Queries", ""] + [f"- {q}" for q in suggested_queries([h.label for h in hubs])]
    return "\n".join(out) + "\n"


def adjacency(g: Graph) -> DataFrame:
    """node, relation, peer both ways; a loop once."""
    out = g.edges.select(F.col("source").alias("node"), "relation", F.col("target").alias("peer"))
    into = g.edges.where("source <> target").select(F.col("target").alias("node"), "relation", F.col("source").alias("peer"))
    return out.unionByName(into)


def vault_rows(g: Graph) -> DataFrame:
    """id, file, crate, lang, line, degree, community of each note; names that clash get the id."""
    stem = g.nodes.withColumn("stem", file_stem(F.col("label")))
    clash = stem.groupBy("stem").agg(F.count("*").alias("n"))
    degree = adjacency(g).groupBy("node").agg(F.count("*").alias("degree"))
    own = stem.join(clash, "stem").join(degree.withColumnRenamed("node", "id"), "id", "left").join(community_of(g.members).withColumnRenamed("node", "id"), "id", "left")
    name = F.when(F.col("n") > 1, F.concat("stem", F.lit("_n"), "id")).otherwise(F.col("stem"))
    return own.select("id", F.concat(name, F.lit(".md")).alias("file"), yaml_token(crate_of(F.col("source_file"))).alias("crate"), lang_of(F.col("source_file")).alias("lang"), F.col("start_line").alias("line"), F.coalesce("degree", F.lit(0)).alias("degree"), "community")


def _lists(df: DataFrame, nodes: DataFrame, line, name: str) -> DataFrame:
    """node and its lines, sorted by relation and peer."""
    named = df.join(nodes.select(F.col("id").alias("peer"), F.col("label").alias("peer_label")), "peer", "left").na.fill("", ["peer_label"])
    rows = named.select("node", F.struct("relation", "peer", line.alias("line")).alias("r"))
    return rows.groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n").alias(name))


def vault(g: Graph) -> DataFrame:
    """file, content of all notes and of the map of content."""
    line = F.concat(F.lit("- "), field_key(display_safe(F.col("relation"))), F.lit(":: [["), display_safe(F.col("peer_label")), F.lit("]]"))
    links = _lists(adjacency(g), g.nodes, line, "links")
    own = vault_rows(g).join(g.nodes.select("id", "label", "source_file"), "id").join(links.withColumnRenamed("node", "id"), "id", "left")
    c = F.col("community")
    text = F.concat_ws(
        "\n",
        F.lit("---"), F.concat(F.lit("id: "), "id"), F.concat(F.lit("community: "), c), F.concat(F.lit("crate: "), "crate"), F.concat(F.lit("lang: "), "lang"),
        F.concat(F.lit('file: "'), yaml_quoted(display_safe(F.col("source_file"))), F.lit('"')), F.concat(F.lit("line: "), "line"), F.concat(F.lit("degree: "), "degree"),
        F.concat(F.lit("tags: [graph/node, crate/"), "crate", F.lit(", lang/"), "lang", F.coalesce(F.concat(F.lit(", community/"), c), F.lit("")), F.lit("]")),
        F.lit("---"), F.lit(""), F.concat(F.lit("# "), display_safe(F.col("label"))), F.lit(""), F.lit("## Links"), F.col("links"),
    )
    notes = own.select("file", F.concat(text, F.lit("\n")).alias("content"))
    item = F.concat(F.lit("- [["), display_safe(F.col("label")), F.lit("]]"))
    per = g.nodes.join(community_of(g.members).withColumnRenamed("node", "id"), "id", "left").groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", item.alias("line")))), lambda r: r["line"]), "\n").alias("items"))
    title = F.coalesce(F.concat(F.lit("## community "), c), F.lit("## Unclustered"))
    parts = per.select(F.struct(c.isNull().alias("last"), c.alias("k"), F.concat(F.lit("\n"), title, F.lit("\n\n"), "items", F.lit("\n")).alias("t")).alias("p"))
    moc = parts.agg(F.array_sort(F.collect_list("p")).alias("ps")).select(F.lit("_MOC.md").alias("file"), F.concat(F.lit("# Map of Content\n"), F.array_join(F.transform("ps", lambda p: p["t"]), "")).alias("content"))
    return notes.unionByName(moc)


def _articles(g: Graph) -> DataFrame:
    """file, content of an article for each node; links only where both ends are nodes."""
    ids = g.nodes.select("id")
    edges = g.edges
    if not g.whole:  # else both ends are nodes
        edges = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    line = F.concat(F.lit("- "), display_safe(F.col("relation")), F.lit(": ["), md_link_text(display_safe(F.col("peer_label"))), F.lit("](node-"), "peer", F.lit(".md)"))
    out = _lists(edges.select(F.col("source").alias("node"), "relation", F.col("target").alias("peer")), g.nodes, line, "outbound")
    into = _lists(edges.select(F.col("target").alias("node"), "relation", F.col("source").alias("peer")), g.nodes, line, "inbound")
    own = g.nodes.join(out.withColumnRenamed("node", "id"), "id", "left").join(into.withColumnRenamed("node", "id"), "id", "left")
    text = F.concat_ws(
        "\n", F.concat(F.lit("# "), display_safe(F.col("label"))), F.lit(""), F.concat(F.lit("`"), display_safe(F.col("source_file")), F.lit(":"), "start_line", F.lit("`")),
        F.lit(""), F.lit("## Outbound"), F.coalesce("outbound", F.lit("_none_")), F.lit(""), F.lit("## Inbound"), F.coalesce("inbound", F.lit("_none_")), F.lit(""),
    )
    return own.select(F.concat(F.lit("node-"), "id", F.lit(".md")).alias("file"), text.alias("content"))


def _index_line() -> Column:
    return F.concat(F.lit("- ["), md_link_text(display_safe(F.col("label"))), F.lit("](node-"), "id", F.lit(".md)"))


def wiki(g: Graph) -> DataFrame:
    """file, content of an article for each node and of the index, which is one text, for graphs that people open."""
    index = g.nodes.agg(F.array_sort(F.collect_list(F.struct("id", _index_line().alias("line")))).alias("all"))
    return _articles(g).unionByName(index.select(F.lit("index.md").alias("file"), F.concat(F.lit("# Index\n\n"), F.array_join(F.transform("all", lambda r: r["line"]), "\n"), F.lit("\n")).alias("content")))


def _digest_of_lines(batches):
    """SHA-256 of the lines of all batches, each with a newline; a text without lines ends with one as well."""
    digest, rows = hashlib.sha256(), 0
    for batch in batches:
        lines = batch.column(0).to_pylist()
        rows += len(lines)
        digest.update("".join(f"{x}\n" for x in lines).encode())
    if rows == 1:  # the heading alone
        digest.update(b"\n")
    yield pa.RecordBatch.from_pydict({"digest": [digest.hexdigest()]})


def wiki_digests(g: Graph) -> DataFrame:
    """file, digest of each text of ``wiki``. The index, which is as long as there are nodes, is never one value: its lines, sorted by a sort that spills, pass one task in batches, as its digest depends on their order."""
    lines = g.nodes.select(F.lit(1).alias("k"), "id", _index_line().alias("line")).where("line IS NOT NULL")
    head = g.nodes.sparkSession.range(1).select(F.lit(0).alias("k"), "id", F.lit("# Index\n").alias("line"))
    one = head.unionByName(lines).repartition(1).sortWithinPartitions("k", "id", "line").select("line")
    index = one.mapInArrow(_digest_of_lines, "digest string").select(F.lit("index.md").alias("file"), "digest")
    return _articles(g).select("file", F.sha2("content", 256).alias("digest")).unionByName(index)


def token_benchmark(g: Graph) -> dict[str, int]:
    """Estimated tokens of the exchange format and of the report."""
    cost = lambda s: -(-len(s.encode()) // 4)
    return {"node_link": cost(node_link(g)), "report": cost(report(g))}


