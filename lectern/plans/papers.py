"""Queries over a richer paper around every document: front matter, environments, floats, labels, broken braces.

The paper is one fixed text with the document's id in it (at each @), so what each operator makes of it is a fixed table
with the id filled in; the SQL states that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import entities, export, graph, latex, people, rendering, retrieval, syntax
from ..sources import charsets
from ..sources import papers as ingest
from ..sources.tables import drop_scratch, scratch_path, table, written
from .catalog import query

#: A paper in both styles of front matter, read with mode="intended".
PAPER = r"""\documentclass[11pt]{article}
\title{Paper @}
\author{Ann @\email{ann}\thanks{grant @}\inst{\ref{u@}} \and Bob Lee\inst{\ref{u@},\ref{v@}}}
\institute{Univ @\label{u@} \and Lab @\label{v@}}
\begin{document}
\begin{abstract}We study @.\end{abstract}
\section{Intro @}\label{sec:@}
Text 50\% of $a_@$ see \cite{k@, m} and \ref[Fig]{fig:@}. % note @
\begin{figure}\includegraphics[width=1]{p@.png}\caption{Cap @}\label{fig:@}\end{figure}
\subsection*{Sub @}
\begin{theorem}[Main]If $x$ then \textbf{b {c {d}}}.\end{theorem}
\begin{equation}E = @\end{equation}
\begin{itemize}\item one @\end{itemize}
\ref{nowhere@} \unknown{@}
\begin{thebibliography}{9}\bibitem{k@} Knuth 1984\end{thebibliography}
open \textit{never closed @
"""

#: A flat paper, read with mode="strict", where math only opens at a token's start.
FLAT = r"""\documentclass{article} \title{T @} \author{Ann @ and Bob} \thanks{gr @} ${x_@}$ \abstract{A @} \section{S @} ${lost}$ \theorem{If @} \figure \equation{E @} \newcommand{a}{b} \eqref[see]{e@} \citep{k@} word { loose } \subsection{U @} end"""

def _filled(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    """(doc_id, text): the template for every document."""
    key = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(key.alias("doc_id"), F.replace(F.lit(template), F.lit("@"), key).alias("text"))


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latex.ast_nodes(_filled(spark, sf_dir, PAPER))


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latex.ast_nodes(_filled(spark, sf_dir, FLAT), "strict")


def stated(columns: str, rows: list[tuple]) -> str:
    """SQL for these rows around every document, its id in place of each @."""
    names = columns.split()
    shown = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    values = ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)
    whole = {c for k, c in enumerate(names) if all(r[k] is None or isinstance(r[k], int) for r in rows)}
    picked = ", ".join(f"v.{c}::INT AS {c}" if c in whole else f"replace(v.{c}, '@', doc_id::VARCHAR) AS {c}" for c in names)
    return f"SELECT doc_id::VARCHAR AS doc_id, {picked} FROM documents, (VALUES {values}) AS v({', '.join(names)})"


#: (parent, type, content) of PAPER's nodes in reading order; a node's place is its number.
NODES = [
    (None, "Document", "Document Root"),
    (0, "Command", r"\documentclass[11pt]{article}"),
    (0, "Command", r"\title{Paper @}"),
    (0, "Author", r"Ann @\email{ann}\thanks{grant @}\inst{\ref{u@}} \and Bob Lee\inst{\ref{u@},\ref{v@}}"),
    (0, "Affiliation", r"Univ @\label{u@} \and Lab @\label{v@}"),
    (0, "Environment", "document"),
    (5, "Abstract", "abstract"),
    (6, "Text", "We study @."),
    (5, "Section", "Intro @"),
    (8, "Label", "sec:@"),
    (8, "Text", "\nText 50% of "),
    (8, "Math", "a_@"),
    (8, "Text", " see "),
    (8, "Citation", "k@, m"),
    (8, "Text", " and "),
    (8, "Reference", "fig:@"),
    (8, "Text", ". "),
    (8, "Environment", "figure"),
    (17, "Command", r"\includegraphics[width=1]{p@.png}"),
    (17, "Command", r"\caption{Cap @}"),
    (17, "Label", "fig:@"),
    (8, "Section", "Sub @"),
    (21, "Environment", "theorem"),
    (22, "Text", "[Main]If "),
    (22, "Math", "x"),
    (22, "Text", " then "),
    (22, "Command", r"\textbf{b {c {d}}}"),
    (22, "Text", "."),
    (21, "Math", "E = @"),
    (21, "Environment", "itemize"),
    (29, "Command", r"\item"),
    (29, "Text", " one @"),
    (21, "Reference", "nowhere@"),
    (21, "Command", r"\unknown{@}"),
    (21, "Bibliography", "thebibliography"),
    (34, "Text", "9"),
    (34, "Citation", "k@"),
    (34, "Text", " Knuth 1984"),
    (21, "Text", "\nopen "),
    (21, "Command", "\\textit{never closed @\n"),
]
_DEPTH = [0]
for _parent, _, _ in NODES[1:]:
    _DEPTH.append(_DEPTH[_parent] + 1)


@query(stated("ord parent_id depth type content", [(k, p, _DEPTH[k], t, c) for k, (p, t, c) in enumerate(NODES)]), uses_graph=False)
def paper_nodes(spark, sf_dir):
    return nested(spark, sf_dir).select("doc_id", "ord", "parent_id", "depth", "type", "content")


@query(stated("ord section", [(k, None if k < 8 else "Intro @" if k < 21 else "Sub @") for k in range(len(NODES))]), uses_graph=False)
def paper_section_of_nodes(spark, sf_dir):
    return rendering.with_section(nested(spark, sf_dir)).select("doc_id", "ord", "section")


_UNNAMED = ("Label", "Citation", "Reference")


@query(stated("ord line", [(k, "  " * _DEPTH[k] + f'Node Type: {"Unknown" if t in _UNNAMED else t}, Content: "{c}"') for k, (_, t, c) in enumerate(NODES)]), uses_graph=False)
def paper_printed(spark, sf_dir):
    return syntax.printed(nested(spark, sf_dir)).select("doc_id", "ord", "line")


@query(stated("src dst ord", [(f"@:{p}", f"@:{k}", k) for k, (p, _, _) in enumerate(NODES) if p is not None]), uses_graph=False)
def paper_hierarchy_edges(spark, sf_dir):
    return rendering.hierarchy(nested(spark, sf_dir))[1].select(F.split("src", ":")[0].alias("doc_id"), "src", "dst", F.col("ord").cast("int").alias("ord"))


_GRAPH_TYPES = ("Document", "Author", "Affiliation", "Section", "Math", "Command", "Environment", "Text", "Reference")


@query(stated("node_id node_type", [(f"@:{k}", t if t in _GRAPH_TYPES else "Text") for k, (_, t, _) in enumerate(NODES)]), uses_graph=False)
def paper_hierarchy_nodes(spark, sf_dir):
    return rendering.hierarchy(nested(spark, sf_dir))[0].select(F.split("node_id", ":")[0].alias("doc_id"), "node_id", "node_type")


@query(
    stated(
        "chunk_id section type content refs figure_caption image_file",
        [
            (0, "", "", "We study @.", "", None, None),
            (1, "Intro @", "section", "\nText 50% of $a_@$ see  and . ", "k@|m|fig:@", "Cap @", "p@.png"),
            (2, "Sub @", "subsection", "[Main]If $x$ then .$E = @$ one @9 Knuth 1984\nopen ", "nowhere@|k@", None, None),
        ],
    ),
    uses_graph=False,
)
def paper_sections(spark, sf_dir):
    made = rendering.sections(nested(spark, sf_dir))
    return made.select("doc_id", F.col("chunk_id").cast("int").alias("chunk_id"), "section", "type", "content", F.array_join("references", "|").alias("refs"), "figure_caption", "image_file")


_STARTED = '<environment_start type="{}">\n{}</environment_end>\n'


@query(
    stated(
        "node_id piece",
        [
            (5, _STARTED.format("document", "")),
            (6, _STARTED.format("abstract", "<abstract>\n  <abstract_text>We study @.</abstract_text>\n</abstract>\n")),
            (17, _STARTED.format("figure", '<float type="figure">\n  <caption>Cap @</caption>\n  <label>fig:@</label>\n</float>\n')),
            (22, _STARTED.format("theorem", "")),
            (29, _STARTED.format("itemize", "")),
        ],
    ),
    uses_graph=False,
)
def paper_environments(spark, sf_dir):
    return rendering.environment_pieces(nested(spark, sf_dir)).select("doc_id", "node_id", "piece")


@query(stated("ord type command options keys", [(13, "citation", "cite", None, "k@|m"), (15, "reference", "ref", "Fig", "fig:@"), (32, "reference", "ref", None, "nowhere@"), (36, "citation", "bibitem", None, "k@")]), uses_graph=False)
def paper_citations(spark, sf_dir):
    return rendering.semantic_chunks(nested(spark, sf_dir)).select("doc_id", "ord", "type", "command", "options", F.array_join("keys", "|").alias("keys"))


@query(stated("ord label target", [(15, "fig:@", 20), (32, "nowhere@", None)]), uses_graph=False)
def paper_labels(spark, sf_dir):
    references, labels = _references(spark, sf_dir)
    return syntax.resolve_labels(references, labels).select("doc_id", "ord", "label", "target")


@query(stated("ord label", [(32, "nowhere@")]), uses_graph=False)
def paper_unresolved_labels(spark, sf_dir):
    return syntax.unresolved(*_references(spark, sf_dir)).select("doc_id", "ord", "label")


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = nested(spark, sf_dir)
    named = lambda kind: nodes.where(F.col("type") == kind).select("doc_id", "ord", F.col("content").alias("label"), "node_id")
    return named("Reference").drop("node_id"), named("Label")


@query(stated("ord name email affiliations", [(0, "Ann @", "ann", "Univ @"), (1, "Bob Lee", None, "Univ @|Lab @")]), uses_graph=False)
def paper_people(spark, sf_dir):
    return people.resolve_people(nested(spark, sf_dir))[0].select("doc_id", "ord", "name", "email", F.array_join("affiliations", "|").alias("affiliations"))


@query(stated("id details", [(1, "Univ @"), (2, "Lab @")]), uses_graph=False)
def paper_affiliations(spark, sf_dir):
    return people.resolve_people(nested(spark, sf_dir))[1].select("doc_id", "id", "details")


@query(stated("node_id", [("author_Ann @",), ("author_Bob Lee",), ("Ann @ <ann>",), ("Bob Lee",)]), uses_graph=False)
def paper_author_nodes(spark, sf_dir):
    return people.author_nodes(people.resolve_people(nested(spark, sf_dir))[0]).select("doc_id", "node_id")


@query(stated("emails thanks institutes", [("ann", "grant @", r"\ref{u@|\ref{u@")]), uses_graph=False)
def paper_author_block(spark, sf_dir):
    """The marks of an author argument, each up to the first closing brace."""
    found = nested(spark, sf_dir).where("type = 'Author'").select("doc_id", people.author_block(F.col("req")).alias("b"))
    return found.select("doc_id", *[F.array_join(f"b.{c}", "|").alias(c) for c in ("emails", "thanks", "institutes")])


_PROBLEMS = {"Section": "Section without command", "Math": "Math without delimiter"}


@query(stated("ord problem", [(k, _PROBLEMS[t]) for k, (_, t, _) in enumerate(NODES) if t in _PROBLEMS]), uses_graph=False)
def paper_problems(spark, sf_dir):
    return syntax.validated(nested(spark, sf_dir)).where("problem IS NOT NULL").select("doc_id", "ord", "problem")


# --- the automaton ----------------------------------------------------------------------------------------------------


def _tagged(tag: str, kind: str, inner: str = "", attribute: str = "type") -> str:
    return f'<{tag} {attribute}="{kind}">\n{inner}</{tag}>\n'


def _header(level: int, title: str) -> str:
    return f"<section_header>\n  <level>{level}</level>\n  <title>{title}</title>\n</section_header>\n"


#: (state after, tagged text) of FLAT's nodes; math right after a section is dropped.
PIECES = [
    ("InDocument", "Document Root\n"),
    ("InCommand", _tagged("document_command", "documentclass", "  <class>article</class>\n")),
    ("InCommand", _tagged("document_command", "title", "  <title>T @</title>\n")),
    ("InAuthor", _tagged("document_command", "author")),
    ("InCommand", _tagged("document_command", "thanks", "  <acknowledgment>gr @</acknowledgment>\n")),
    ("InText", "<math_content>\n  <math_type>inline</math_type>\n  <math_expression>{x_@}</math_expression>\n</math_content>\n"),
    ("InAbstract", _tagged("document_command", "abstract", "  <abstract>A @</abstract>\n")),
    ("InSection", _header(2, "S @")),
    ("InSection", None),
    ("InEnvironment", _tagged("theorem", "theorem", "  <content>If @</content>\n")),
    ("InEnvironment", _tagged("float", "figure")),
    ("InText", _tagged("display_math", "equation", "  <math_content>E @</math_content>\n")),
    ("InCommand", "<command name=\"newcommand\">\n  <arg1>a</arg1>\n</command>\n"),
    ("InText", "<text_content>b</text_content>\n"),
    ("InCommand", _tagged("reference", "equation")),
    ("InCommand", _tagged("citation", "citep")),
    ("InText", "<text_content>word </text_content>\n"),
    ("InText", "<text_content>loose </text_content>\n"),
    ("InSection", _header(3, "U @")),
    ("InText", "<text_content>end</text_content>\n"),
]


@query(stated("ord state piece", [(k, *p) for k, p in enumerate(PIECES)]), uses_graph=False)
def flat_pieces(spark, sf_dir):
    return rendering.strict_pieces(flat(spark, sf_dir)).select("doc_id", "ord", "state", "piece")


# --- parts of a graph -------------------------------------------------------------------------------------------------


@query("SELECT 'c' || c_custkey AS doc_id, 'a' || c_custkey AS src, 'b' || c_custkey AS dst FROM customer UNION ALL SELECT 'c' || c_custkey, 'b' || c_custkey, 'c' || c_custkey FROM customer", uses_graph=False)
def accepted_edges(spark, sf_dir):
    """Of a cycle of three around every customer, the edge that comes last is refused."""
    key = F.col("c_custkey").cast("string")
    ring = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), key).alias("doc_id"), key.alias("k"))
    nodes = ring.select(F.explode(F.array(*[F.concat(F.lit(x), "k") for x in "abc"])).alias("node_id")).select("node_id", F.lit("Section").alias("node_type"), F.lit("x").alias("content"))
    pair = lambda x, y, at: F.struct(F.concat(F.lit(x), "k").alias("src"), F.concat(F.lit(y), "k").alias("dst"), F.lit(at).cast("long").alias("ord"))
    edges = ring.select(F.explode(F.array(pair("a", "b", 0), pair("b", "c", 1), pair("c", "a", 2))).alias("e")).select("e.src", "e.dst", F.lit("Hierarchical").alias("edge_type"), F.lit("").alias("label"), "e.ord")
    kept = graph.accepted_edges(graph.Graph(nodes, edges), rules=False)
    return kept.select(F.concat(F.lit("c"), F.substring("src", 2, 20)).alias("doc_id"), "src", "dst")


@query("SELECT 's' || s_suppkey AS node_id, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE s_name END AS content FROM supplier UNION ALL SELECT 'x' || s_suppkey, 'new' FROM supplier WHERE s_suppkey % 3 = 1", uses_graph=False)
def upserted_nodes(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    old = suppliers.select(F.concat(F.lit("s"), key).alias("node_id"), F.col("s_name").alias("content"))
    new = suppliers.where("s_suppkey % 3 < 2").select(F.concat(F.when(F.col("s_suppkey") % 3 == 0, "s").otherwise("x"), key).alias("node_id"), F.lit("new").alias("content"))
    return graph.upserted(old, new)


@query("SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst, l_linenumber::BIGINT AS ord, CASE WHEN l_returnflag = 'R' THEN l_discount END AS confidence FROM lineitem", uses_graph=False)
def relationship_metadata(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    kind = F.concat_ws("-", F.col("l_linenumber").cast("string"), "l_returnflag").alias("edge_type")
    ends = [F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), kind]
    edges = items.select(*ends, F.col("l_linenumber").cast("long").alias("ord"))
    known = items.where("l_returnflag = 'R'").select(*ends, F.col("l_discount").alias("confidence"))
    return graph.relationship_metadata(edges, known).select("src", "dst", "ord", "confidence")


@query("SELECT 'r' || p_partkey AS src, 'citation:r' || p_partkey AS dst FROM part WHERE p_partkey % 2 = 0", uses_graph=False)
def special_citations(spark, sf_dir):
    content = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("see \\cite{"), "p_name", F.lit("}"))).otherwise(F.col("p_name"))
    nodes = table(spark, sf_dir, "part").select(F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("node_id"), F.lit("Reference").alias("node_type"), content.alias("content"))
    edges = spark.createDataFrame([], "src string, dst string, edge_type string, label string, ord long")
    return rendering.special_citations(nodes, edges)[1].select("src", "dst")


@query("""SELECT 's' || s_suppkey AS node_id, CASE WHEN s_suppkey % 3 = 0 THEN 'Section' ELSE 'Text' END AS kind,
CASE s_suppkey % 9 WHEN 0 THEN 1 WHEN 3 THEN 2 WHEN 6 THEN 3 ELSE 0 END::INT AS level FROM supplier""", uses_graph=False)
def section_levels(spark, sf_dir):
    key = F.col("s_suppkey")
    said = F.when(key % 9 < 3, "\\section{A}").when(key % 9 < 6, "\\subsection{A}").otherwise("\\subsubsection{A}")
    made = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), key.cast("string")).alias("node_id"), F.when(key % 3 == 0, "Section").otherwise("Text").alias("kind"), said.alias("content"))
    return made.select("node_id", "kind", syntax.section_level(F.col("kind"), F.col("content")).alias("level"))


# --- ingest, retrieval, entities --------------------------------------------------------------------------------------


@query("""SELECT doc_id::VARCHAR AS doc_id, CASE doc_id % 4 WHEN 0 THEN 'latin1' ELSE 'UTF-8' END AS encoding_declared,
CASE WHEN doc_id % 4 = 0 THEN 'cp1252' WHEN doc_id % 4 = 1 THEN 'utf-8-sig' WHEN doc_id % 4 = 2 THEN 'UNKNOWN' ELSE 'utf-8' END AS encoding_detected,
CASE doc_id % 4 WHEN 0 THEN '\\usepackage[latin1]{inputenc} é' || doc_id WHEN 1 THEN chr(65279) || 'é' || doc_id WHEN 2 THEN '' ELSE 'é' || doc_id END AS text FROM documents""", uses_graph=False)
def ingested_texts(spark, sf_dir):
    """Files in declared one-byte encoding, with a byte-order mark, empty, and in UTF-8."""
    key = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 4
    latin = F.encode(F.concat(F.lit("\\usepackage[latin1]{inputenc} é"), key), "ISO-8859-1")
    marked = F.concat(F.unhex(F.lit("EFBBBF")), F.encode(F.concat(F.lit("é"), key), "UTF-8"))
    content = F.when(kind == 0, latin).when(kind == 1, marked).when(kind == 2, F.encode(F.lit(""), "UTF-8")).otherwise(F.encode(F.concat(F.lit("é"), key), "UTF-8"))
    files = table(spark, sf_dir, "documents").select(key.alias("doc_id"), F.lit("p").alias("path"), F.lit("n").alias("name"), content.alias("content"))
    return ingest.utf8_texts(files).select("doc_id", "encoding_declared", "encoding_detected", "text")


#: Characters that ISO-8859-1 and cp1252 write alike.
_LATIN = "regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F\\x{A0}-\\x{FF}]', '', 'g')"


@query(f"""SELECT doc_id::VARCHAR AS doc_id, CASE WHEN t = '' THEN 'UNKNOWN' WHEN doc_id % 3 = 2 THEN 'utf-16' WHEN doc_id % 3 = 1 OR regexp_full_match(t, '[\\x00-\\x7F]*') THEN 'utf-8' ELSE 'cp1252' END AS encoding, t AS text
FROM (SELECT doc_id, {_LATIN} AS t FROM documents)""", uses_graph=False)
def detected_charsets(spark, sf_dir):
    """Every document's text in one of three encodings, none of them declared, detected and read again."""
    model = charsets.trained(spark, table(spark, sf_dir, "documents").select("lang", "text"))
    said = F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\x00-\\x7F\\xA0-\\xFF]", "")
    kind = F.col("doc_id") % 3
    content = F.when((kind == 2) & (said != ""), F.concat(F.unhex(F.lit("FFFE")), F.encode(said, "UTF-16LE"))).when(kind == 0, F.encode(said, "ISO-8859-1")).otherwise(F.encode(said, "UTF-8"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("p").alias("path"), F.lit("n").alias("name"), content.alias("content"))
    return ingest.utf8_texts(files, model).select("doc_id", F.col("encoding_detected").alias("encoding"), "text")


@query("""SELECT s_suppkey::VARCHAR AS doc_id, CASE s_suppkey % 3 WHEN 0 THEN 'main.tex' WHEN 1 THEN 'b.tex' ELSE 'a.tex' END AS name FROM supplier""", uses_graph=False)
def main_files(spark, sf_dir):
    """By name, else the file that begins a document, else the first."""
    key = F.col("s_suppkey")
    begins = F.encode(F.lit("x \\begin{document} y"), "UTF-8")
    plain = F.encode(F.lit("plain"), "UTF-8")
    names = F.explode(F.array(*[F.lit(x) for x in ("a.tex", "b.tex", "main.tex", "z.tex")])).alias("name")
    files = table(spark, sf_dir, "supplier").select(key.cast("string").alias("doc_id"), (key % 3).alias("kind"), names)
    files = files.where("kind = 0 OR name <> 'main.tex'").withColumn("content", F.when((F.col("kind") < 2) & (F.col("name") == "b.tex"), begins).otherwise(plain))
    return ingest.main_files(files.withColumn("path", F.concat_ws("/", "doc_id", "name"))).select("doc_id", "name")


@query("SELECT doc_id::VARCHAR AS doc_id, unnest(['Univ ' || doc_id, 'Lab']) AS value FROM documents", uses_graph=False)
def affiliation_matches(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    made = table(spark, sf_dir, "documents").select(key.alias("doc_id"), F.concat(F.lit("a \\affiliation{Univ "), key, F.lit("} b \\affiliation{Lab} c")).alias("text"))
    return entities.matches(made).select("doc_id", "value")


@query("SELECT doc_id::VARCHAR AS doc_id, 'Ann ' || doc_id || '|Bob|Cy' AS names FROM documents", uses_graph=False)
def author_names(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    said = F.concat(F.lit("\\author{Ann "), key, F.lit(", Bob} x \\author[1]{Cy}"))
    return table(spark, sf_dir, "documents").select(key.alias("doc_id"), F.array_join(text.author_names(said), "|").alias("names"))


@query("SELECT doc_id::VARCHAR AS doc_id, 'b {c {d {' || doc_id || '}}} e' AS inner_text FROM documents", uses_graph=False)
def nested_argument(spark, sf_dir):
    """A command's argument with braces inside braces."""
    key = F.col("doc_id").cast("string")
    said = F.concat(F.lit("x \\textbf[o] {b {c {d {"), key, F.lit("}}} e} f } \\textbf{no}"))
    return table(spark, sf_dir, "documents").select(key.alias("doc_id"), text.argument(said, "textbf").alias("inner_text"))


@query("SELECT doc_id, 'é' || doc_id || chr(65533) || 'x' AS repaired FROM documents", uses_graph=False)
def repaired_utf8(spark, sf_dir):
    broken = F.concat(F.encode(F.concat(F.lit("é"), F.col("doc_id").cast("string")), "UTF-8"), F.unhex(F.lit("FF")), F.encode(F.lit("x"), "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", text.valid_utf8(broken.cast("string")).alias("repaired"))


@query("""SELECT 'index-' || source AS index_name, source || '_section_1_chunk_1' AS id, 64 AS dimensions, max(doc_id)::BIGINT AS content FROM documents GROUP BY source""", uses_graph=False)
def stored_vectors(spark, sf_dir):
    """Chunks with their vectors, stored twice by key and read back: the second text of a key counts."""
    docs = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("source_file")).agg(F.min("doc_id").alias("old"), F.max("doc_id").alias("new"))
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    path = scratch_path(spark, "vectors")
    for version in ("old", "new"):
        sections = docs.select("source_file", none.alias("document_title"), empty.alias("authors"), empty.alias("affiliations"), F.lit(1).alias("place"), none.alias("section_title"), none.alias("section_type"), empty.alias("references"), none.alias("figure_caption"), none.alias("image_file"), F.col(version).cast("string").alias("content"))
        retrieval.store(retrieval.embedded(retrieval.vector_rows(sections), retrieval.hashing_embedder(64)), path)
    back = written(spark.read.parquet(path), "vectors")
    retrieval.delete_indexes(spark, path)
    drop_scratch(spark, path)
    return back.select("index_name", "id", F.size("embedding").alias("dimensions"), F.col("metadata.content").cast("long").alias("content"))


@query("""SELECT doc_id::VARCHAR AS doc_id, unnest([0, 1, 2])::INT AS place, unnest(['', 'Intro ' || doc_id, 'Sub ' || doc_id]) AS section, unnest([NULL, 'Cap ' || doc_id, NULL]) AS caption,
'Ann ' || doc_id || '|Bob Lee' AS people, 'Univ ' || doc_id || '|Lab ' || doc_id AS places FROM documents""", uses_graph=False)
def document_json(spark, sf_dir):
    """The JSON of every paper, read back."""
    nodes = nested(spark, sf_dir)
    made = export.document_json(rendering.sections(nodes), *people.resolve_people(nodes))
    read = F.from_json("json", "document struct<title string, metadata struct<authors array<struct<name string>>, affiliations array<struct<details string>>>, content array<struct<section string, figure_caption string>>>")
    d = made.select("doc_id", read["document"].alias("d"))
    d = d.select("doc_id", F.array_join("d.metadata.authors.name", "|").alias("people"), F.array_join("d.metadata.affiliations.details", "|").alias("places"), F.posexplode("d.content").alias("place", "c"))
    return d.select("doc_id", "place", F.col("c.section").alias("section"), F.col("c.figure_caption").alias("caption"), "people", "places")


@query("""SELECT l AS line FROM (SELECT unnest(['  subgraph cluster_nations {', '    label="nations";', '  }']) AS l UNION ALL SELECT '    "n' || n_nationkey || '" [label="' || n_name || '"];' FROM nation)""", uses_graph=False)
def subgraph(spark, sf_dir):
    nodes = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node_id"), F.col("n_name").alias("content"))
    return export.subgraph_lines(nodes, "nations").select("line")
