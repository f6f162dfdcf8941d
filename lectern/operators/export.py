"""Exports of a document graph: DOT files, the knowledge graph as JSON, and trees. Lines carry (part, at) to order by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .graph import Graph, grown, methodology_phases, roots
from .numbering import numbered

# The settings that the three kinds of DOT files begin with.
DOT_HEAD = ("  rankdir=LR;", '  node [shape=box, style=filled, fontname="Arial"];', "  concentrate=true;", "  compound=true;")
MAP_HEAD = ("  rankdir=TB;", '  node [shape=box, style=filled, fontname="Arial"];', "  concentrate=true;")
FLOW_HEAD = ("  rankdir=LR;", '  node [shape=box, style=filled, fontname="Arial"];')


def edge_style(kind: Column) -> Column:
    return fixed.lookup(fixed.EDGE_STYLES, kind, F.lit(fixed.OTHER_EDGE_STYLE))


def semantic_style(kind: Column) -> Column:
    return fixed.lookup(fixed.SEMANTIC_STYLES, kind, F.lit(fixed.OTHER_SEMANTIC_STYLE))


def type_name(kind: Column) -> Column:
    return fixed.lookup(fixed.NODE_TYPE_NAMES, kind, F.concat(F.lit("Unknown_"), fixed.ordinal(fixed.NODE_TYPES, kind).cast("string")))


def dot_label(node_id: Column, content: Column) -> Column:
    """A short label: citations and references as [REF], other commands and braces gone, runs of space as one.

    A command ends at the first character that isn't a letter; that one stays unless it is white space or a brace.
    """
    own = F.concat(F.lit("["), node_id, F.lit("]"))
    text = F.when(F.coalesce(content, F.lit("")) == "", own).otherwise(content)
    # a command with the character that ends it; one that runs to the end leaves nothing
    marked = F.regexp_replace(text, "\\\\(?:cite|ref)(?=[^A-Za-z\\\\])[\\s{}]?", "[REF]")
    bare = F.regexp_replace(marked, "\\\\[A-Za-z]*(?:[\\s{}]|(?=[^A-Za-z])|$)", "")
    bare = F.regexp_replace(F.regexp_replace(bare, "[{}]", ""), "\\s+", " ")
    short = F.rtrim(F.regexp_replace(bare, "^ ", ""))
    cut = F.when(F.octet_length(short) > 40, F.concat(F.left(short, F.lit(37)), F.lit("..."))).otherwise(short)
    return F.when(cut == "", own).otherwise(cut)


def _quoted(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _literal(like: DataFrame, part: int, lines: tuple[str, ...]) -> DataFrame:
    rows = [(part, f"{k:06d}", x) for k, x in enumerate(lines)]
    return like.sparkSession.createDataFrame(rows, "part int, at string, line string")


def _arrow(style: Column) -> Column:
    return _quoted('  "', F.col("src"), '" -> "', F.col("dst"), '" [', style, "];")


def _clusters(nodes: DataFrame, cluster: Column, title: Column, first: tuple[str, ...], node_line: Column, part: int, title_first: bool = False) -> DataFrame:
    """Lines of subgraphs: a head for each cluster, its nodes by id, an end."""
    marked = nodes.select(cluster.alias("cluster"), title.alias("title"), "node_id", node_line.alias("line"))
    body = marked.select(F.concat("cluster", F.lit("\u0001b"), "node_id").alias("at"), "line")
    each = marked.select("cluster", "title").distinct()
    label = _quoted('    label="', F.col("title"), '";')
    inner = [label, *map(F.lit, first)] if title_first else [*map(F.lit, first), label]
    heads = each.select("cluster", F.posexplode(F.array(_quoted("  subgraph cluster_", F.col("cluster"), " {"), *inner)).alias("k", "line"))
    heads = heads.select(F.concat("cluster", F.lit("\u0001a"), F.col("k").cast("string")).alias("at"), "line")
    ends = each.select(F.concat("cluster", F.lit("\u0001c")).alias("at"), F.lit("  }").alias("line"))
    return body.unionByName(heads).unionByName(ends).select(F.lit(part).alias("part"), "at", "line")


def _edge_lines(edges: DataFrame, line: Column, part: int) -> DataFrame:
    return edges.select(F.lit(part).alias("part"), F.concat_ws("\u0001", "src", F.format_string("%012d", "ord"), "dst", "edge_type").alias("at"), line.alias("line"))


def dot_lines(graph: Graph) -> DataFrame:
    """(part, at, line): the graph, nodes clustered by type, edges by style."""
    label = dot_label(F.col("node_id"), F.col("content"))
    node = _quoted('    "', F.col("node_id"), '" [label="', label, '"];')
    name = type_name(F.col("node_type"))
    clusters = _clusters(graph.nodes, name, name, ("    style=filled;", "    color=lightgrey;"), node, 1)
    shown = F.when(F.coalesce("label", F.lit("")) != "", _quoted(',label="', F.col("label"), '"')).otherwise("")
    edges = _edge_lines(graph.both(), _arrow(F.concat(edge_style(F.col("edge_type")), shown)), 2)
    head = _literal(graph.nodes, 0, ("digraph ResearchPaper {", *DOT_HEAD))
    return head.unionByName(clusters).unionByName(edges).unionByName(_literal(graph.nodes, 3, ("}",)))


def semantic_map_lines(graph: Graph, semantics: DataFrame | None = None) -> DataFrame:
    """(part, at, line): nodes with semantics (node_id, concept_type, importance) by concept, and the semantic edges.

    The less important a node, the higher the two hex digits that fill it, printed twice without padding.
    """
    kept = graph.both().where(F.col("edge_type").isin(*fixed.SEMANTIC_STYLES))
    out = _literal(graph.nodes, 0, ("digraph SemanticMap {", *MAP_HEAD)).unionByName(_edge_lines(kept, _arrow(semantic_style(F.col("edge_type"))), 2))
    if semantics is not None:
        shade = F.lower(F.hex((255 * (1 - F.col("importance"))).cast("int")))
        node = _quoted('    "', F.col("node_id"), '" [label="', F.col("content"), '", fillcolor="#', shade, shade, 'ff"];')
        concept = F.col("concept_type")
        out = out.unionByName(_clusters(graph.nodes.join(semantics, "node_id"), concept, concept, ("    color=lightgrey;",), node, 1, True))
    return out.unionByName(_literal(graph.nodes, 3, ("}",)))


def methodology_flow_lines(graph: Graph) -> DataFrame:
    """(part, at, line): methodology components by phase, with all flow and data edges."""
    placed = methodology_phases(graph).join(graph.nodes, "node_id")
    node = _quoted('    "', F.col("node_id"), '" [label="', F.col("content"), '"];')
    cluster = F.concat(F.lit("phase"), F.col("phase").cast("string"))
    clusters = _clusters(placed, cluster, F.concat(F.lit("Phase "), (F.col("phase") + 1).cast("string")), ("    color=lightgrey;",), node, 1, True)
    style = F.when(F.col("edge_type") == "MethodologyFlow", F.lit('color="blue"')).otherwise(F.lit('style="dashed", color="red"'))
    kept = graph.both().where(F.col("edge_type").isin("MethodologyFlow", "DataDependency"))
    head = _literal(graph.nodes, 0, ("digraph MethodologyFlow {", *FLOW_HEAD))
    return head.unionByName(clusters).unionByName(_edge_lines(kept, _arrow(style), 2)).unionByName(_literal(graph.nodes, 3, ("}",)))


def subgraph_lines(nodes: DataFrame, name: str) -> DataFrame:
    """(part, at, line): one cluster of the given nodes."""
    node = _quoted('    "', F.col("node_id"), '" [label="', F.col("content"), '"];')
    return _clusters(nodes, F.lit(name), F.lit(name), (), node, 1, True)


def knowledge_nodes(graph: Graph) -> DataFrame:
    """(index, id, type, content) with the names that exports use."""
    return numbered(graph.nodes, "node_id").select("index", F.col("node_id").alias("id"), type_name(F.col("node_type")).alias("type"), "content")


def knowledge_edges(graph: Graph, metadata: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """(source, target, type, label): ends as indices, the type as its ordinal; with metadata also that, as a struct.

    index: (id, index) of the nodes, where they have been numbered already."""
    if index is None:
        index = numbered(graph.nodes.select(F.col("node_id").alias("id")), "id")
    edges = graph.edges if metadata is None else graph.edges.join(metadata, ["src", "dst", "edge_type"], "left")
    source, target = index.select(F.col("id").alias("src"), F.col("index").alias("source")), index.select(F.col("id").alias("dst"), F.col("index").alias("target"))
    extra = [] if metadata is None else [F.when(F.col("confidence").isNotNull(), F.struct("confidence", "evidence", "context")).alias("metadata")]
    return edges.join(source, "src").join(target, "dst").select("source", "target", fixed.ordinal(fixed.EDGE_TYPES, F.col("edge_type")).alias("type"), F.coalesce("label", F.lit("")).alias("label"), *extra)


def knowledge_json(graph: Graph) -> DataFrame:
    """(part, at, json): a JSON object a row, the head (part 0), nodes (1) and edges (2); as lines it is NDJSON."""
    head = graph.nodes.agg(F.count(F.lit(1)).alias("nodes")).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), F.to_json(F.struct(F.lit("ResearchPaperKnowledgeGraph").alias("type"), "nodes")).alias("json"))
    numbers = knowledge_nodes(graph)  # each with its content goes to its range once
    nodes = numbers.select(F.lit(1).alias("part"), F.col("index").alias("at"), F.to_json(F.struct("id", "type", "content")).alias("json"))
    edges = knowledge_edges(graph, index=numbers.select("id", "index")).select(F.lit(2).alias("part"), F.col("source").alias("at"), F.to_json(F.struct("source", "target", "type", "label")).alias("json"))
    return head.unionByName(nodes).unionByName(edges)


def structure_lines(graph: Graph) -> DataFrame:
    """(node_id, depth, line): every node under its roots along Hierarchical, indented by the least depth."""
    placed = grown(roots(graph), graph.edges_of("Hierarchical"), []).join(graph.nodes, "node_id")
    out = graph.edges.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    line = F.concat(F.repeat(F.lit(" "), 2 * F.col("depth")), F.format_string("Node: %s Type: %s Content: %s Outgoing edges: %d", "node_id", fixed.ordinal(fixed.NODE_TYPES, F.col("node_type")).cast("string"), "content", F.coalesce("n", F.lit(0))))
    return placed.join(out, "node_id", "left").select("node_id", "depth", line.alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines in order, as text files whose names sort."""
    lines.repartitionByRange("part", "at").sortWithinPartitions("part", "at").select("line").write.mode("overwrite").text(path)


def document_json(sections: DataFrame, authors: DataFrame, affiliations: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(doc_id, json): the document with metadata and content, as the retrieval side reads it."""
    ordered = lambda by, *columns: F.transform(F.sort_array(F.collect_list(F.struct(by, *columns))), lambda x: F.struct(*[x[c].alias(c) for c in columns]))
    content = sections.withColumn("references", F.transform("references", lambda r: F.struct(r.alias("label")))).groupBy("doc_id").agg(ordered("chunk_id", "section", "type", "content", "references", "figure_caption", "image_file").alias("content"))
    people = authors.groupBy("doc_id").agg(ordered("ord", "name", "email", "orcid", "affiliations").alias("authors"))
    places = affiliations.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("id", "details"))).alias("affiliations"))
    out = content.join(people, "doc_id", "left").join(places, "doc_id", "left")
    title = F.lit(None).cast("string")
    if titles is not None:
        out, title = out.join(titles, "doc_id", "left"), F.col("title")
    document = F.struct(title.alias("title"), F.struct("authors", "affiliations").alias("metadata"), "content")
    return out.select("doc_id", F.to_json(F.struct(document.alias("document"))).alias("json"))

