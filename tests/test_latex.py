"""Golden traces of lexing, parsing, rendering, and the authors of two styles of papers."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.operators import export, latex, people, rendering, syntax

T1 = "\\section{Intro} Hello $x$ world. \\cite{doe2001}"


def docs(spark, *texts):
    return spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "doc_id string, text string")


def shown(text, strict=True):
    return [(t.type, t.value, t.position) for t in latex.lex(text, strict)]


def test_strict_tokens():
    assert shown(T1) == [("Command", "\\section [] {Intro}", 0), ("Text", "Hello $x$ world. ", 16), ("Command", "\\cite [] {doe2001}", 33)]
    assert shown("$\\alpha$ b") == [("MathShift", "$", 0), ("Command", "\\alpha [] {}", 1), ("MathShift", "$", 7), ("Text", "b", 9)]
    assert shown("$x$ y") == [("MathShift", "$", 0), ("Text", "x$ y", 1)]
    assert shown("50\\% off\nnext") == [("Text", "50", 0), ("Command", "\\", 2), ("Text", "next", 9)]
    assert shown("$$a") == [("MathShift", "$$", 0), ("Text", "a", 2)]
    assert shown("\\a[x[y]]{p{q}r} \\b{never ends") == [("Command", "\\a [x[y]] {p{q}r}", 0), ("Command", "\\b [] {never ends", 16 - 0)][:1] + [("Command", "\\b [] {never ends}", 16)]
    assert shown("é\\x") == [("Text", "é", 0), ("Command", "\\x [] {}", 2)]
    assert shown("\0a\0") == [("Text", "a", 0)]
    assert shown("") == []


def test_strict_nodes():
    nodes = lambda text: [(n.type, n.content, n.position) for n in latex.parse_flat(latex.lex(text, True))[1:]]
    assert nodes("$\\alpha$ b") == [("Math", "\\alpha [] {}", 0), ("Text", "b", 9)]
    assert nodes("$x$ y") == [("Math", "x$ y", 0)]
    assert nodes("{a} $$b$$") == [("Text", "a", 1), ("Text", " $$b$$", 0)][:1] + [("Math", "b$$", 4)]


def test_random_texts_end_and_keep_their_characters(spark):
    r = random.Random(1)
    for _ in range(400):
        text = "".join(r.choice("\\{}$%[]ab \né") for _ in range(r.randint(0, 40)))
        for strict in (True, False):
            tokens = latex.lex(text, strict)
            places = [t.position for t in tokens]
            assert places == sorted(places)
            nodes = (latex.parse_flat if strict else latex.parse_nested)(tokens)
            assert all(-1 <= n.parent < k for k, n in enumerate(nodes))


def test_strict_chunk(spark):
    made = rendering.strict_chunks(rendering.strict_pieces(latex.ast_nodes(docs(spark, T1), "strict"))).first()["chunk"]
    assert made == (
        "Document Root\n<section_header>\n  <level>2</level>\n  <title>Intro</title>\n</section_header>\n<text_content>Hello </text_content>\n"
        '<inline_math>x</inline_math>\n<text_content> world. </text_content>\n<citation type="cite">\n</citation>\n'
    )


def test_strict_states(spark):
    pieces = rendering.strict_pieces(latex.ast_nodes(docs(spark, T1, "\\section{S} $\\alpha$"), "strict")).orderBy("doc_id", "ord").collect()
    assert [(r["doc_id"], r["state"]) for r in pieces] == [("0", "InDocument"), ("0", "InSection"), ("0", "InText"), ("0", "InCommand"), ("1", "InDocument"), ("1", "InSection"), ("1", "InSection")]
    assert pieces[-1]["piece"] is None


def random_paper(r):
    names = [c.split()[r.randrange(len(c.split()))] for c in fixed.COMMAND_CLASSES.values()] + ["author", "institute", "affiliation", "abstract", "foo"]
    parts = []
    for _ in range(r.randint(1, 12)):
        kind = r.random()
        if kind < 0.5:
            parts.append("\\" + r.choice(names) + r.choice(["", "{a}", "{a}{b}", "[o]{a{b}c}", "{see \\author x}", "{\\affiliation y}"]))
        elif kind < 0.7:
            parts.append("text $y$ ")
        else:
            parts.append(r.choice(["$\\alpha$", "$$\\beta b$$", "$z$", "\\", "{", "% c\n"]))
    return " ".join(parts)


def test_windows_and_the_walk_agree(spark):
    r = random.Random(3)
    papers = docs(spark, *[random_paper(r) for _ in range(150)])
    nodes = latex.ast_nodes(papers, "strict")
    quick = {(x["doc_id"], x["ord"]): (x["state"], x["piece"] or None) for x in rendering.strict_pieces(nodes).collect()}
    full = rendering.classified(nodes).withColumn("piece", rendering.rendered(F.col("type"), F.col("name"), F.col("arguments"), F.col("content"))).collect()
    for doc in {x["doc_id"] for x in full}:
        own = sorted((x.asDict() for x in full if x["doc_id"] == doc), key=lambda x: x["ord"])
        for at, state, piece in rendering.walk(own):
            assert quick[doc, at] == (state, piece or None), (doc, at, [x["content"] for x in own])


def test_ast_chunks(spark):
    made = syntax.chunks(latex.ast_nodes(docs(spark, T1), "strict")).orderBy("chunk_id").collect()
    assert [r["chunk"] for r in made] == ["Document Root [Section] \\section [] {Intro} [Math Start] Hello $x$ world.  [Math End] ", "\\cite [] {doe2001} "]


def test_printed_groups(spark):
    nodes = latex.ast_nodes(docs(spark, "\\author{A} \\affiliation{X} \\author{B} text"), "strict")
    lines = [r["line"].strip() for r in syntax.printed(nodes).orderBy("ord", "part").collect()]
    assert lines[1] == "[Author-Affiliation Group]"
    assert lines.count("[End of Author-Affiliation Group]") == 2
    assert lines[-1] == 'Node Type: Text, Content: "text"'


PAPER = r"""\documentclass{article} % a comment with \author{Nobody}
\title{On \emph{Things}}
\author[0000-0001]{Ada Nowak} \affiliation{Institute of A} \affiliation{Institute of B}
\author{Ben Ö. Cruz}
\affiliation{Institute of C}
\begin{document}
\begin{abstract}Short text.\end{abstract}
\section*{Start} See \ref{eq:one}, 50\% of \cite{k1, k2}. $a+b$
\begin{equation}e=1 \label{eq:one}\end{equation}
\subsection{Deeper} More \$5.
\begin{figure}\includegraphics[width=1]{f.png}\caption{A figure}\label{fig}\end{figure}
\section{End} Done.
\end{document}"""


def test_intended_reading(spark):
    nodes = latex.ast_nodes(docs(spark, PAPER))
    rows = {r["chunk_id"]: r for r in rendering.sections(nodes).collect()}
    assert [rows[k]["section"] for k in sorted(rows)] == ["", "Start", "Deeper", "End"]
    assert rows[1]["content"].replace("\n", " ").startswith(" See , 50% of . $a+b$")
    assert rows[1]["references"] == ["eq:one", "k1", "k2"]
    assert rows[2]["image_file"] == "f.png" and rows[2]["figure_caption"] == "A figure"
    assert "$5" in rows[2]["content"]
    tree = {r["node_id"]: r for r in nodes.collect()}
    deeper = next(r for r in tree.values() if r["content"] == "Deeper")
    assert tree[deeper["parent_id"]]["content"] == "Start"


def test_authors_by_adjacency(spark):
    authors, places = people.resolve_people(latex.ast_nodes(docs(spark, PAPER)))
    assert [(r["name"], r["orcid"], r["affiliations"]) for r in authors.orderBy("ord").collect()] == [("Ada Nowak", "0000-0001", ["Institute of A", "Institute of B"]), ("Ben Ö. Cruz", None, ["Institute of C"])]
    assert [(r["id"], r["details"]) for r in places.orderBy("id").collect()] == [(1, "Institute of A"), (2, "Institute of B"), (3, "Institute of C")]


def test_authors_by_label(spark):
    paper = r"""\author{\mbox{A. Kim\inst{\ref{u1},\ref{u3}}} \and \mbox{Bo Li\inst{\ref{u2}}\thanks{Also at \textit{X}}} \and \mbox{Cy Ng\inst{\ref{u1},\ref{u2},\ref{u3}}}}
\institute{First U \label{u1} \and Second U \label{u2} \and % Old U \label{u9} \and
 Third U \label{u3}}"""
    authors, places = people.resolve_people(latex.ast_nodes(docs(spark, paper)))
    got = [(r["name"], r["affiliations"]) for r in authors.orderBy("ord").collect()]
    assert got == [("A. Kim", ["First U", "Third U"]), ("Bo Li", ["Second U"]), ("Cy Ng", ["First U", "Second U", "Third U"])]
    assert [r["details"] for r in places.orderBy("id").collect()] == ["First U", "Second U", "Third U"]


def test_document_json(spark):
    import json

    nodes = latex.ast_nodes(docs(spark, PAPER))
    authors, places = people.resolve_people(nodes)
    made = json.loads(export.document_json(rendering.sections(nodes), authors, places).first()["json"])["document"]
    assert [a["name"] for a in made["metadata"]["authors"]] == ["Ada Nowak", "Ben Ö. Cruz"]
    assert [s["section"] for s in made["content"]] == ["", "Start", "Deeper", "End"]
    assert made["content"][1]["references"][0] == {"label": "eq:one"}


@pytest.mark.parametrize(("content", "label"), [("", "[n1]"), ("see \\cite{a} now", "see [REF]a} now".replace("}", "")), ("a \\foo b {c}", "a b c"), ("x" * 50, "x" * 37 + "..."), ("\\ref", "[n1]"), ("\\emph{}", "[n1]")])
def test_dot_label(spark, content, label):
    row = spark.createDataFrame([("n1", content)], "id string, c string").select(export.dot_label(F.col("id"), F.col("c")).alias("l")).first()
    assert row["l"] == label


def test_author_lists(spark):
    lists = spark.createDataFrame([("1", 0, "A \\and B, C; D"), ("2", 0, "Jane {email: j@x.org} {orcid: 1-2} {aff: u1} {affiliation: u2},,Last")], "doc_id string, ord int, content string")
    strict = [(r["doc_id"], r["name"]) for r in people.listed_authors(lists, strict=True).orderBy("doc_id", "place").collect()]
    assert strict == [("1", "a"), ("1", "b"), ("1", "c"), ("1", "d"), ("2", "jane")]
    free = people.listed_authors(lists).orderBy("doc_id", "place").collect()
    assert [r["name"] for r in free] == ["A", "B", "C", "D", "Jane", "Last"]
    assert (free[4]["email"], free[4]["orcid"], free[4]["affiliation_labels"]) == ("j@x.org", "1-2", ["u1", "u2"])
    nodes = people.author_nodes(people.listed_authors(lists.where("doc_id = '2'")))
    assert {r["node_id"] for r in nodes.collect()} == {"author_Jane", "Jane <j@x.org>", "author_Last", "Last"}


def test_author_block(spark):
    row = spark.createDataFrame([("\\email{a@b.c} x \\thanks{t} \\email{d@e.f} \\thanks{u} \\inst{1}",)], "c string").select(people.author_block(F.col("c")).alias("b")).first()["b"]
    assert row["emails"] == ["a@b.c", "d@e.f"] and row["thanks"] == ["u"] and row["institutes"] == ["1"]


def test_environments_sections_and_citations(spark):
    nodes = latex.ast_nodes(docs(spark, PAPER))
    pieces = {r["name"]: r["piece"] for r in rendering.environment_pieces(nodes).collect()}
    assert pieces["abstract"] == '<environment_start type="abstract">\n<abstract>\n  <abstract_text>Short text.</abstract_text>\n</abstract>\n</environment_end>\n'
    assert '<float type="figure">\n  <caption>A figure</caption>\n  <label>fig</label>\n</float>' in pieces["figure"]
    sections = {r["content"]: r["section"] for r in rendering.with_section(nodes).collect()}
    assert sections["k1, k2"] == "Start" and sections["fig"] == "Deeper" and sections["Document Root"] is None
    made, edges = rendering.hierarchy(nodes)
    assert made.count() == nodes.count() and edges.count() == nodes.count() - 1
    one = spark.createDataFrame([("r", "Reference", "see \\citep{a}"), ("t", "Reference", "plain")], "node_id string, node_type string, content string")
    more, links = rendering.special_citations(one, edges.limit(0))
    assert {(r["node_id"], r["node_type"]) for r in more.collect()} == {("r", "Reference"), ("t", "Reference"), ("citation:r", "Citation")}
    assert [(r["src"], r["dst"]) for r in links.collect()] == [("r", "citation:r")]
    semantic = rendering.semantic_chunks(nodes).orderBy("ord").collect()
    assert [(r["type"], r["kind"], r["keys"]) for r in semantic] == [("reference", "standard", ["eq:one"]), ("citation", None, ["k1", "k2"])]
    ids = lambda t: [r["node_id"] for r in rendering.graph_nodes(latex.ast_nodes(docs(spark, t), "strict")).orderBy("ord", "node_id").collect()]
    assert ids(T1) == ["1_12_sectionIntro", "2_12_citedoe2001"]
    assert ids("\\author{A, B} \\foo $\\beta$ \\ref{x}") == ["1_12_authorAB", "2_2_author_a", "3_2_author_b", "4_12_foo", "5_13_beta", "6_12_refx", "7_6_x"]
    assert rendering.graph_nodes(nodes, False).where("node_type = 'Citation'").count() == 1


def test_extractors(spark):
    from lectern.functions import text as T

    row = spark.createDataFrame([("\\author{Ann Lee \\and Bo {Ng}} \\affiliation{U {of} A} \\affiliation[x]{B} \\subsection{Deep {er}} \\includegraphics[w=1]{a.png} \\caption{C}",)], "s string")
    s = F.col("s")
    got = row.select(T.author_names(s), T.affiliations(s), T.section_name(s), T.graphics_file(s), T.figure_caption(s), T.citation_keys(F.lit(" a, ,b ")), T.without_newlines(F.lit("a\r\nb")), T.year(F.lit("x1999 in 2001,")), T.valid_utf8(F.lit("ok"))).first()
    assert list(got) == [["Ann Lee", "Bo Ng"], ["U {of", "B"], "Deep {er}", "a.png", "C", ["a", "b"], "ab", "2001", "ok"]


def test_people_are_resolved_from_one_reading_of_the_nodes(spark):
    """Several branches need the authors and affiliations; what makes the nodes runs once."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    schema = "doc_id string, ord int, type string, cmd string, opt string, req string"
    rows = [("d", 0, "Author", "author", None, "Ann\\inst{\\ref{u}} \\and Bob\\inst{\\ref{u},\\ref{v}}"), ("d", 1, "Affiliation", "institute", None, "Univ \\label{u} \\and Lab \\label{v}"), ("d", 2, "Text", None, None, "x")]
    authors, places = people.resolve_people(spark.createDataFrame(rows, schema).mapInPandas(counted, schema))
    assert [(r["name"], r["affiliations"]) for r in authors.orderBy("ord").collect()] == [("Ann", ["Univ"]), ("Bob", ["Univ", "Lab"])]
    assert [r["details"] for r in places.orderBy("id").collect()] == ["Univ", "Lab"] and seen.value == len(rows)
