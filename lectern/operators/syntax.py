"""Checks and groupings over syntax nodes: validation, allowed children, section levels, text chunks, printed trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed


def type_name(kind: Column) -> Column:
    """A node type's name in messages."""
    return F.when(kind.isin(*fixed.AST_TYPE_NAMES_UNKNOWN), "Unknown").otherwise(kind)


def validated(nodes: DataFrame) -> DataFrame:
    """nodes with problem: what is wrong with the node, null if nothing is. Bad nodes stay."""
    content, kind = F.col("content"), F.col("type")
    problem = (
        F.when((content == "") & (kind != "Document"), "Empty content for non-document node")
        .when((kind == "Math") & ~content.contains("$") & ~content.contains("\\begin{equation}"), "Math without delimiter")
        .when((kind == "Section") & ~content.contains("\\section") & ~content.contains("\\subsection"), "Section without command")
        .when((kind == "Command") & ~content.startswith("\\"), "Command without backslash")
    )
    return nodes.withColumn("problem", problem)


def with_parent(nodes: DataFrame) -> DataFrame:
    parent = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("type").alias("parent_type"), F.col("content").alias("parent_content"))
    return nodes.join(parent, ["doc_id", "parent_id"], "left")


def valid_children(nodes: DataFrame) -> DataFrame:
    """The nodes that their parents accept, and the root; those that are refused go with nothing below being checked."""
    spark = nodes.sparkSession
    rules = fixed.ast_children(spark)
    typed = with_parent(nodes)
    listed = typed.join(F.broadcast(rules.select("parent_type").distinct()), "parent_type", "left_semi")
    accepted = listed.join(F.broadcast(rules), (listed["parent_type"] == rules["parent_type"]) & (listed["type"] == rules["child_type"]), "left_semi")
    free = typed.join(F.broadcast(rules.select("parent_type").distinct()), "parent_type", "left_anti")
    return accepted.select(*nodes.columns).unionByName(free.select(*nodes.columns))


def section_level(kind: Column, content: Column) -> Column:
    """1 to 3 for section to subsubsection commands in a section's content, else 0."""
    level = F.when(content.contains("\\subsubsection"), 3).when(content.contains("\\subsection"), 2).when(content.contains("\\section"), 1).otherwise(0)
    return F.when(kind == "Section", level).otherwise(0)


def _piece(content: Column, below: Column) -> Column:
    """A node's part of a chunk; null for nodes that start a new chunk."""
    said = lambda tag, end: F.concat(F.lit(f"[{tag} Start] "), content, F.lit(" "), below, F.lit(f"[{tag} End] "))
    return (
        F.when(content.contains("\\author") | content.contains("\\affiliation"), F.concat(F.lit("[Author-Affiliation Group] "), content, F.lit(" ")))
        .when(content.contains("\\begin{abstract}"), said("Abstract", ""))
        .when(content.contains("\\begin{equation}") | content.contains("$"), said("Math", ""))
        .when(content.contains("\\begin{thebibliography}"), said("Bibliography", ""))
        .when(content.contains("\\section") | content.contains("\\subsection"), F.concat(F.lit("[Section] "), content, F.lit(" ")))
    )


def chunks(nodes: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, chunk): texts between nodes that start a new chunk, tagged by what the nodes are.

    Abstract, math and bibliography nodes show their children within their tags, and each child again after them.
    """
    shown = with_parent(nodes)
    entry = F.when(F.col("parent_content").contains("\\begin{thebibliography}") & F.col("content").contains("\\bibitem"), F.concat(F.lit("[Citation: "), F.col("content"), F.lit("] "))).otherwise(F.concat(F.col("content"), F.lit(" ")))
    below = shown.where("parent_id IS NOT NULL").groupBy("doc_id", F.col("parent_id").alias("node_id"))
    below = below.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", entry.alias("entry")))), lambda x: x["entry"]), "").alias("below"))
    tagged = nodes.join(below, ["doc_id", "node_id"], "left").withColumn("piece", _piece(F.col("content"), F.coalesce("below", F.lit(""))))
    running = F.sum(F.col("piece").isNull().cast("int")).over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    text = F.coalesce("piece", F.concat(F.col("content"), F.lit(" ")))
    numbered = tagged.select("doc_id", "ord", text.alias("text"), (running - 1).cast("int").alias("chunk_id"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "")
    return numbered.groupBy("doc_id", "chunk_id").agg(joined.alias("chunk"))


def printed(nodes: DataFrame) -> DataFrame:
    """(doc_id, ord, line): the indented tree, runs of author and affiliation nodes as one group."""
    by_ord = Window.partitionBy("doc_id").orderBy("ord")
    content = F.col("content")
    is_author = content.contains("\\author")
    is_affiliation = content.contains("\\affiliation") | content.contains("\\institute")
    # a node is in a group if, going back over affiliations alone, there is an author
    last_other = F.last(F.when(~is_affiliation | is_author, is_author), ignorenulls=True).over(by_ord.rowsBetween(Window.unboundedPreceding, 0))
    marked = nodes.withColumn("grouped", F.coalesce(last_other, F.lit(False))).withColumn("before", F.coalesce(F.lag(F.col("grouped")).over(by_ord), F.lit(False)))
    pad = F.repeat(F.lit(" "), F.col("depth") * 2)
    node = F.concat(F.lit("Node Type: "), type_name(F.col("type")), F.lit(', Content: "'), content, F.lit('"'))
    close = F.concat(pad, F.lit("[End of Author-Affiliation Group]"))
    lines = (
        F.when(is_author & F.col("before"), F.array(close, F.concat(pad, F.lit("[Author-Affiliation Group]")), F.concat(pad, F.lit("  "), node)))
        .when(is_author, F.array(F.concat(pad, F.lit("[Author-Affiliation Group]")), F.concat(pad, F.lit("  "), node)))
        .when(F.col("grouped"), F.array(F.concat(pad, F.lit("  "), node)))
        .when(F.col("before"), F.array(close, F.concat(pad, node)))
        .otherwise(F.array(F.concat(pad, node)))
    )
    return marked.select("doc_id", "ord", F.posexplode(lines).alias("part", "line"))


def resolve_labels(references: DataFrame, labels: DataFrame) -> DataFrame:
    """references (doc_id, label, ...) with target: the node of the label; of several the last, null if there is none."""
    last = labels.groupBy("doc_id", "label").agg(F.max_by("node_id", "ord").alias("target"))
    return references.join(last, ["doc_id", "label"], "left")


def unresolved(references: DataFrame, labels: DataFrame) -> DataFrame:
    return references.join(labels.select("doc_id", "label").distinct(), ["doc_id", "label"], "left_anti")
