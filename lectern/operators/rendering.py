"""From syntax nodes to tagged text: command classes, the document automaton and the chunks.

strict_pieces reproduces the automaton over a flat tree. What state follows a command or a text depends on that node
alone, and math depends on the last other node and its place in its run, so windows over the reading order are enough.
The one exception is a command whose text merely mentions \\author, \\institute or \\affiliation while it belongs to another
class: documents that hold one go through walk(), which keeps the state node by node.

sections is the intended reading: a chunk for each section, with its references, caption and image.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..sources.tables import written

PIECE_SCHEMA = "doc_id string, ord int, state string, piece string"


def command_name(content: Column) -> Column:
    return F.regexp_extract(content, "^\\\\([A-Za-z]+)", 1)


def command_arguments(content: Column) -> Column:
    """Every {...} after the name, each up to the first closing brace."""
    return F.regexp_extract_all(F.regexp_replace(content, "^\\\\[A-Za-z]+", ""), F.lit("\\{([^}]*)\\}"), F.lit(1))


def classified(nodes: DataFrame) -> DataFrame:
    """nodes with name, class (null for others than named commands) and arguments."""
    is_command = F.col("type") == "Command"
    named = nodes.withColumn("name", F.when(is_command, command_name(F.col("content"))))
    kind = F.when(is_command & (F.col("name") != ""), fixed.command_class(F.col("name")))
    return named.withColumn("class", kind).withColumn("arguments", F.when(kind.isNotNull(), command_arguments(F.col("content"))))


def _numbered(arguments: Column) -> Column:
    line = lambda x, i: F.concat(F.lit("  <arg"), (i + 1).cast("string"), F.lit(">"), x, F.lit("</arg"), (i + 1).cast("string"), F.lit(">\n"))
    return F.array_join(F.transform(arguments, line), "")


def _tag(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"  <{name}>"), value, F.lit(f"</{name}>\n"))


def _wrap(tag: str, kind: Column, inner: Column, attribute: str = "type") -> Column:
    return F.concat(F.lit(f'<{tag} {attribute}="'), kind, F.lit('">\n'), inner, F.lit(f"</{tag}>\n"))


def rendered(kind: Column, name: Column, arguments: Column, content: Column) -> Column:
    """The tagged text of a node that the automaton accepts."""
    first = F.coalesce(F.get(arguments, F.lit(0)), F.lit(""))
    none = F.lit("")
    payload = F.when(name == "documentclass", _tag("class", first)).when(name == "title", _tag("title", first)).when(name == "abstract", _tag("abstract", first)).when(name == "date", _tag("date", first)).when(name == "thanks", _tag("acknowledgment", first)).otherwise(none)
    level = fixed.lookup({k: str(v) for k, v in fixed.SECTION_LEVELS.items()}, name, F.lit("0"))
    section = F.concat(F.lit("<section_header>\n"), _tag("level", level), F.when(F.size(arguments) > 0, _tag("title", first)).otherwise(none), F.lit("</section_header>\n"))
    math = F.when(name.isin(*fixed.DISPLAY_MATH), _wrap("display_math", name, F.array_join(F.transform(arguments, lambda a: _tag("math_content", a)), ""))).otherwise(_wrap("math_command", name, _numbered(arguments)))
    theorem = _wrap("theorem", name, F.when(F.size(arguments) > 0, _tag("content", first)).otherwise(none))
    described = F.regexp_extract(first, "^\\[([^\\]]*)\\]", 1)
    reference = _wrap("reference", fixed.lookup(fixed.REFERENCE_KINDS, name, none), F.when(first.rlike("^\\[[^\\]]*\\]"), _tag("text", described)).otherwise(none))
    # an opening brace within an argument goes with the character after it
    generic = _wrap("command", name, _numbered(F.transform(arguments, lambda a: F.regexp_replace(a, "\\{[\\s\\S]?", ""))), "name")
    command = (
        F.when(F.col("class") == "document", _wrap("document_command", name, payload))
        .when(F.col("class") == "section", section)
        .when(F.col("class") == "math", math)
        .when(F.col("class") == "theorem", theorem)
        .when(F.col("class") == "float", _wrap("float", name, none))
        .when(F.col("class") == "citation", _wrap("citation", name, none))
        .when(F.col("class") == "reference", reference)
        .when(F.col("class") == "generic", generic)
        .otherwise(none)
    )
    inline = F.concat(F.lit("<math_content>\n"), _tag("math_type", F.lit("inline")), _tag("math_expression", content), F.lit("</math_content>\n"))
    return F.when(kind == "Document", F.lit("Document Root\n")).when(kind == "Text", text.inline_math(content)).when(kind == "Math", inline).when(kind == "Command", command)


def state_after(kind: Column, content: Column, name: Column) -> Column:
    """The automaton's state after a node other than math."""
    mentions = F.when(content.contains("\\author"), "InAuthor").when(content.contains("\\institute") | content.contains("\\affiliation"), "InAffiliation").otherwise("InCommand")
    by_class = (
        F.when(F.col("class") == "document", F.when(name == "author", "InAuthor").when(name == "abstract", "InAbstract").when(name == "institute", "InAffiliation").otherwise("InCommand"))
        .when(F.col("class") == "section", "InSection")
        .when(F.col("class") == "math", "InText")
        .when(F.col("class").isin("theorem", "float"), "InEnvironment")
        .when(F.col("class").isNotNull(), mentions)
        .otherwise("InCommand")
    )
    return F.when(kind == "Document", "InDocument").when(kind == "Text", "InText").when(kind == "Command", by_class)


def _needs_walk(name: Column, content: Column) -> Column:
    """A command of a class with moves of its own that mentions an author or affiliation command."""
    mentions = content.contains("\\author") | content.contains("\\institute") | content.contains("\\affiliation")
    own = (name == "author") | ((name == "institute") & ~content.contains("\\author"))
    return mentions & F.col("class").isin("document", "section", "math", "theorem", "float") & ~own


def strict_pieces(nodes: DataFrame) -> DataFrame:
    """(doc_id, ord, state, piece) of flat nodes: the state after each, and its text; null if it is dropped."""
    marked = classified(nodes.select("doc_id", "ord", "type", "content"))
    marked = marked.withColumn("walk", F.coalesce(_needs_walk(F.col("name"), F.col("content")), F.lit(False)))
    walked = marked.where("walk").select("doc_id").distinct()
    plain = marked.join(walked, "doc_id", "left_anti")

    order = Window.partitionBy("doc_id").orderBy("ord")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    is_math = F.col("type") == "Math"
    plain = plain.withColumn("own", state_after(F.col("type"), F.col("content"), F.col("name")))
    plain = plain.withColumn("last", F.last("own", ignorenulls=True).over(so_far)).withColumn("run", F.sum((~is_math).cast("int")).over(so_far))
    place = F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("ord")) - 1  # the run's first row isn't math
    plain = plain.withColumn("place", place)
    dropped = is_math & (F.col("last").isin("InSection", "InAuthor") | ((F.col("last") == "InAffiliation") & (F.col("place") == 1)))
    piece = F.when(~dropped, rendered(F.col("type"), F.col("name"), F.col("arguments"), F.col("content")))
    state = F.when(is_math & F.col("last").isin("InSection", "InAuthor"), F.col("last")).when(is_math, "InText").otherwise(F.col("last"))
    quick = plain.select("doc_id", "ord", state.alias("state"), piece.alias("piece"))

    own = nodes.select("doc_id", "ord", "type", "content").join(walked, "doc_id", "left_semi")
    shown = classified(own).withColumn("piece", rendered(F.col("type"), F.col("name"), F.col("arguments"), F.col("content")))
    slow = _walk_documents(shown.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "type", "content", "name", "class", "piece"))).alias("nodes")))
    return quick.unionByName(slow)


class _Illegal(Exception):
    pass


#: The states that a command's class moves through, and whether its opening tag is out before the first move.
_MOVES = {"section": (["InSection"], False), "theorem": (["InEnvironment"], False), "float": (["InEnvironment"], False)}
_ENTERS = {"documentclass": "InDocument", "title": "InDocument", "date": "InDocument", "thanks": "InDocument", "abstract": "InAbstract", "author": "InAuthor"}


def walk(nodes: list[dict]) -> Iterator[tuple[int, str, str | None]]:
    """(ord, state after, text) of a document's nodes, in order, one state at a time."""
    allowed = {a: set(b.split()) for a, b in fixed.STATE_MOVES.items()}
    state = "Start"

    def move(to: str) -> None:
        nonlocal state
        if to not in allowed.get(state, ()):
            raise _Illegal
        state = to

    def command(node: dict) -> str | None:
        move("InCommand")
        if "\\author" in node["content"]:
            move("InAuthor")
        elif "\\institute" in node["content"] or "\\affiliation" in node["content"]:
            move("InAffiliation")
        before, kind, name, out = state, node["class"], node["name"], None
        try:
            if kind == "document":
                out = f'<document_command type="{name}">\n'  # stays if a move fails
                if name in _ENTERS:
                    move(_ENTERS[name])
                out = node["piece"]
                if name not in ("author", "abstract"):
                    move(before)
            elif kind == "math":
                try:
                    move("InEquation" if name in fixed.DISPLAY_MATH else "InMath")
                except _Illegal:
                    move("InText")
                    raise
                out = node["piece"]
                move("InText")
            else:
                for to in _MOVES.get(kind, ([], False))[0]:
                    move(to)
                out = node["piece"]
        except _Illegal:
            if state != "InDocument":
                try:
                    move("InDocument")
                except _Illegal:
                    pass
        return out or None

    for node in nodes:
        out = None
        try:
            if node["type"] == "Document":
                move("InDocument")
                out = node["piece"]
            elif node["type"] == "Text":
                move("InText")
                out = node["piece"]
            elif node["type"] == "Command":
                out = command(node)
            elif state not in ("InSection", "InAuthor"):
                try:
                    move("InMath")
                    out = node["piece"]
                    move("InText")
                except _Illegal:
                    move("InText")
        except _Illegal:
            pass
        yield node["ord"], state, out


def _walk_documents(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *x) for d, nodes in zip(batch.column("doc_id").to_pylist(), batch.column("nodes").to_pylist(), strict=True) for x in walk(nodes)]
            if rows:
                kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "ord", "state", "piece"])

    return docs.mapInArrow(run, PIECE_SCHEMA)


def _joined(column: str, by: str = "ord") -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(by, column))), lambda x: x[column]), "")


def strict_chunks(pieces: DataFrame) -> DataFrame:
    """(doc_id, chunk): a flat tree gives one chunk a document."""
    return pieces.where("piece IS NOT NULL").groupBy("doc_id").agg(_joined("piece").alias("chunk"))


def semantic_chunks(nodes: DataFrame) -> DataFrame:
    """(doc_id, ord, type, command, kind, keys): citations and references with their keys, from nested nodes."""
    cited = nodes.where(F.col("type").isin("Citation", "Reference"))
    keys = text.citation_keys(F.coalesce("req", F.lit("")))
    kind = fixed.lookup(fixed.REFERENCE_KINDS, F.col("cmd"), F.lit("standard"))
    return cited.select("doc_id", "ord", F.lower("type").alias("type"), F.col("cmd").alias("command"), F.when(F.col("type") == "Reference", kind).alias("kind"), F.col("opt").alias("options"), keys.alias("keys"))


def sections(nodes: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, section, type, content, references, figure_caption, image_file) of nested nodes.

    A chunk begins at every section; what comes before the first is chunk 0 with an empty title. The trailing chunk counts.
    """
    so_far = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    is_section = F.col("type") == "Section"
    numbered = nodes.withColumn("chunk_id", F.sum(is_section.cast("int")).over(so_far))
    body = F.when(F.col("type") == "Text", F.col("content")).when(F.col("type") == "Math", F.concat(F.lit("$"), F.col("content"), F.lit("$")))
    numbered = numbered.withColumn("body", body)
    pieces = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c.isNotNull(), F.struct("ord", c.alias("v"))))), lambda x: x["v"])
    keyed = F.when(F.col("type").isin("Reference", "Citation"), text.citation_keys(F.col("content")))
    first = lambda test, value: F.min_by(F.when(test, value), F.when(test, F.col("ord")))
    out = numbered.groupBy("doc_id", "chunk_id").agg(
        first(is_section, F.col("content")).alias("section"),
        first(is_section, F.col("cmd")).alias("type"),
        F.array_join(pieces(F.col("body")), "").alias("content"),
        F.flatten(pieces(keyed)).alias("references"),
        first(F.col("cmd") == "caption", F.col("req")).alias("figure_caption"),
        first(F.col("cmd") == "includegraphics", F.col("req")).alias("image_file"),
    )
    filled = out.withColumns({"section": F.coalesce("section", F.lit("")), "type": F.coalesce("type", F.lit(""))})
    return filled.where("section <> '' OR content <> '' OR size(references) > 0 OR image_file IS NOT NULL")


def graph_nodes(nodes: DataFrame, strict: bool = True) -> DataFrame:
    """(doc_id, node_id, node_type, content): the graph nodes that the automaton makes; ids count them within a document.

    An id is the count, the type's ordinal and the first 30 letters, digits and underscores of the content. strict: of
    flat nodes, named commands and the math that isn't dropped, then a reference's argument and each author of a list;
    contents stay empty. Else every syntax node of a type that has a graph type, with its content.
    """
    made = lambda kind, c: F.struct(F.lit(kind).alias("node_type"), c.alias("of"))
    if strict:
        nodes = written(nodes.select("doc_id", "ord", "type", "content"), "flat")  # parsed once, read by each branch
        shown = classified(nodes).join(strict_pieces(nodes).select("doc_id", "ord", "piece"), ["doc_id", "ord"])
        first = F.coalesce(F.get("arguments", F.lit(0)), F.lit(""))
        none = F.array().cast("array<struct<node_type:string,of:string>>")
        authors = F.transform(text.split_authors(first, True), lambda p: made("Author", F.concat(F.lit("author_"), text.clean_author(p, True))))
        more = F.when(F.col("class") == "reference", F.array(made("Reference", first))).when((F.col("class") == "document") & (F.col("name") == "author") & (first != ""), authors).otherwise(none)
        each = F.when(F.col("class").isNotNull(), F.concat(F.array(made("Command", F.col("content"))), more)).when((F.col("type") == "Math") & F.col("piece").isNotNull(), F.array(made("Math", F.col("content")))).otherwise(none)
        listed = shown.select("doc_id", "ord", F.posexplode(each).alias("k", "m")).select("doc_id", "ord", "k", "m.*")
    else:
        kinds = fixed.AST_TO_GRAPH | {"Citation": "Citation"}
        listed = nodes.where("type <> 'Document'").select("doc_id", "ord", F.lit(0).alias("k"), fixed.lookup(kinds, F.col("type")).alias("node_type"), F.col("content").alias("of")).where("node_type IS NOT NULL")
    count = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "k")).cast("string")
    bare = F.substring(F.regexp_replace("of", "[^A-Za-z0-9_]", ""), 1, 30)
    out = listed.withColumn("node_id", F.concat_ws("_", count, fixed.ordinal(fixed.NODE_TYPES, F.col("node_type")).cast("string"), bare))
    return out.select("doc_id", "node_id", "node_type", F.when(F.lit(strict), F.lit("")).otherwise(F.col("of")).alias("content"), "ord")


def hierarchy(nodes: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Graph nodes and Hierarchical edges of a syntax tree, the builder that follows parents; ids are doc:node.

    Content is bared of commands and braces' contents; strict drops all white space, else one space stays.
    """
    listed = [t for t in fixed.AST_TYPES if t in ("Document", "Author", "Affiliation", "Section", "Math", "Command", "Environment", "Text", "Reference")]
    bare = F.regexp_replace(F.regexp_replace(F.col("content"), "\\{[^}]*\\}?", ""), "\\\\[^\\s_^{}]*", "")
    bare = F.regexp_replace(bare, "\\s+", "" if strict else " ")
    own = lambda c: F.concat_ws(":", "doc_id", F.col(c).cast("string"))
    made = nodes.select(own("node_id").alias("node_id"), F.when(F.col("type").isin(*listed), F.col("type")).otherwise("Text").alias("node_type"), (bare if strict else F.trim(bare)).alias("content"))
    edges = nodes.where("parent_id IS NOT NULL").select(own("parent_id").alias("src"), own("node_id").alias("dst"), F.lit("Hierarchical").alias("edge_type"), F.lit("").alias("label"), F.col("ord").cast("long").alias("ord"))
    return made, edges


def with_section(nodes: DataFrame) -> DataFrame:
    """nodes with section: the content of the last section before them, null before the first."""
    so_far = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return nodes.withColumn("section", F.last(F.when(F.col("type") == "Section", F.col("content")), ignorenulls=True).over(so_far))


def environment_pieces(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, name, piece): the tagged text of nested environments and abstracts.

    Figures and tables show captions and labels among their children, abstracts their texts.
    """
    name = F.when(F.col("type") == "Abstract", F.lit("abstract")).otherwise(F.col("content"))
    own = F.when(F.col("type").isin("Environment", "Abstract"), F.struct("node_id", F.lit(True).alias("opens"), "ord", name.alias("name"), F.lit(None).cast("string").alias("said"), F.lit(None).cast("string").alias("line")))
    line = (
        F.when(F.col("cmd") == "caption", F.struct(F.lit("float").alias("said"), _tag("caption", F.coalesce("req", F.lit(""))).alias("line")))
        .when(F.col("type") == "Label", F.struct(F.lit("float").alias("said"), _tag("label", F.col("content")).alias("line")))
        .when(F.col("type") == "Text", F.struct(F.lit("abstract").alias("said"), _tag("abstract_text", F.col("content")).alias("line")))
    )
    below = F.when(line.isNotNull() & F.col("parent_id").isNotNull(), F.struct(F.col("parent_id").alias("node_id"), F.lit(False).alias("opens"), "ord", F.lit(None).cast("string").alias("name"), line["said"].alias("said"), line["line"].alias("line")))
    # a node as what it opens and as a line of its parent, in one pass over the nodes
    each = nodes.select("doc_id", F.explode(F.array_compact(F.array(own, below))).alias("x")).select("doc_id", "x.*")
    whole = each.groupBy("doc_id", "node_id").agg(F.bool_or("opens").alias("opens"), F.max("name").alias("name"), F.sort_array(F.collect_list(F.when(~F.col("opens"), F.struct("ord", "line", "said")))).alias("lines")).where("opens")
    wanted = F.when(F.col("name") == "abstract", "abstract").when(F.col("name").isin("figure", "table"), "float")
    whole = whole.withColumn("inner", F.array_join(F.transform(F.filter("lines", lambda x: x["said"] == wanted), lambda x: x["line"]), ""))
    kind = F.when(F.col("name") == "abstract", "abstract").when(F.col("name").isin("figure", "table"), "float")
    inner = F.coalesce("inner", F.lit(""))
    body = F.when(kind == "abstract", F.concat(F.lit("<abstract>\n"), inner, F.lit("</abstract>\n"))).when(kind == "float", _wrap("float", F.col("name"), inner)).otherwise("")
    piece = F.concat(F.lit('<environment_start type="'), "name", F.lit('">\n'), body, F.lit("</environment_end>\n"))
    return whole.select("doc_id", "node_id", "name", piece.alias("piece"))


def special_citations(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Citation nodes and Citation edges for reference nodes (node_id, node_type, content) that hold a \\cite."""
    citing = nodes.where((F.col("node_type") == "Reference") & F.col("content").contains("\\cite"))
    made = citing.select(F.concat(F.lit("citation:"), "node_id").alias("node_id"), F.lit("Citation").alias("node_type"), "content")
    links = citing.select(F.col("node_id").alias("src"), F.concat(F.lit("citation:"), "node_id").alias("dst"), F.lit("Citation").alias("edge_type"), F.lit("").alias("label"), F.lit(0).cast("long").alias("ord"))
    return nodes.unionByName(made), edges.unionByName(links)
