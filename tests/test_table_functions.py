"""The table functions give what the operators give."""

import pytest

from lectern.operators import latex, table_functions

TEXTS = [("1", "\\section{A} Body $x$ \\cite{k} \\begin{figure}\\caption{c}\\end{figure} % note\nend"), ("2", None), ("3", ""), ("4", "{{{ $ \\"), ("5", "\\subsection*{B} " + "word " * 3000)]


@pytest.fixture(scope="module")
def docs(spark):
    table_functions.register(spark)
    out = spark.createDataFrame(TEXTS, "doc_id string, text string").repartition(3)
    out.createOrReplaceTempView("tex_docs")
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("mode", ["intended", "strict"])
def test_lateral(spark, docs, mode):
    nodes = spark.sql(f"SELECT d.doc_id, n.* FROM tex_docs d, LATERAL tex_nodes(d.text, '{mode}') n")
    assert nodes.columns == latex.ast_nodes(docs).columns
    assert rows(nodes) == rows(latex.ast_nodes(docs, mode)) and nodes.count() > 10
    assert rows(spark.sql(f"SELECT d.doc_id, t.* FROM tex_docs d, LATERAL tex_tokens(d.text, '{mode}') t")) == rows(latex.tokens(docs, mode))


def test_default_mode_and_filters(spark, docs):
    found = spark.sql("SELECT n.content FROM tex_docs d, LATERAL tex_nodes(d.text) n WHERE n.type = 'Section' AND d.doc_id < '3'")
    assert [r["content"] for r in found.collect()] == ["A"]
    with pytest.raises(Exception, match="mode"):
        spark.sql("SELECT * FROM tex_nodes('x', 'loose')").collect()


def test_partitions(spark, docs):
    spark.createDataFrame([("a", 2, "Body"), ("a", 1, "\\section{A}"), ("a", 3, None), ("b", 1, "x \\ref{l}"), (None, 1, "y")], "doc_id string, place int, text string").createOrReplaceTempView("tex_parts")
    got = spark.sql("SELECT * FROM paper_nodes(TABLE(tex_parts) PARTITION BY doc_id ORDER BY place)")
    whole = spark.createDataFrame([("a", "\\section{A}\nBody"), ("b", "x \\ref{l}"), (None, "y")], "doc_id string, text string")
    assert rows(got) == rows(latex.ast_nodes(whole))
