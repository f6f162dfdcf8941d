"""The graph, texts and vectors that the catalogue's queries run on, made from the TPC-H-like tables.

The same SQL text makes them in either engine: tables are named in braces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..sources.tables import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

NODES = """
SELECT 'r' || CAST(r_regionkey AS STRING) AS node_id, 'Document' AS node_type, r_name AS content FROM {region}
UNION ALL
SELECT 'n' || CAST(n_nationkey AS STRING), 'Section',
       n_name || CASE n_nationkey % 5 WHEN 0 THEN ' method' WHEN 1 THEN ' Approach' WHEN 2 THEN ' implementation' WHEN 3 THEN ' procedure' ELSE ' results' END
FROM {nation}
UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), 'Author', c_name FROM {customer}
UNION ALL SELECT 's' || CAST(s_suppkey AS STRING), 'Affiliation', s_name FROM {supplier}
UNION ALL SELECT 'p' || CAST(p_partkey AS STRING), 'Citation', p_name || ' ' || CAST(1970 + p_size AS STRING) FROM {part}
UNION ALL SELECT 'o' || CAST(o_orderkey AS STRING), 'Text', o_orderpriority || ' ' || o_orderstatus FROM {orders}
UNION ALL SELECT 'd' || CAST(doc_id AS STRING), CASE WHEN lang = 'en' THEN 'Text' ELSE 'Abstract' END, text FROM {documents}
"""

EDGES = """
SELECT 'r' || CAST(n_regionkey AS STRING) AS src, 'n' || CAST(n_nationkey AS STRING) AS dst, 'Hierarchical' AS edge_type, '' AS label, CAST(n_nationkey AS BIGINT) AS ord FROM {nation}
UNION ALL SELECT 'n' || CAST(c_nationkey AS STRING), 'c' || CAST(c_custkey AS STRING), 'Hierarchical', '', CAST(c_custkey AS BIGINT) FROM {customer}
UNION ALL SELECT 'n' || CAST(s_nationkey AS STRING), 's' || CAST(s_suppkey AS STRING), 'Hierarchical', '', CAST(s_suppkey AS BIGINT) FROM {supplier}
UNION ALL SELECT 'o' || CAST(l_orderkey AS STRING), 'p' || CAST(l_partkey AS STRING), 'Citation', l_returnflag, CAST(l_linenumber AS BIGINT) FROM {lineitem}
UNION ALL
SELECT 'o' || CAST(o_orderkey AS STRING), 'c' || CAST(o_custkey AS STRING),
       CASE o_orderstatus WHEN 'F' THEN 'Assumption' WHEN 'O' THEN 'ResultSupports' ELSE 'MainContribution' END, o_orderstatus, CAST(100 AS BIGINT)
FROM {orders}
UNION ALL
SELECT 'n' || CAST(a.n_nationkey AS STRING), 'n' || CAST(b.n_nationkey AS STRING),
       CASE (a.n_nationkey * 7 + b.n_nationkey * 3) % 14
         WHEN 0 THEN 'MainContribution' WHEN 1 THEN 'EvidenceSupport' WHEN 2 THEN 'ResultSupports' WHEN 3 THEN 'ValidationMethod'
         WHEN 4 THEN 'MethodologyFlow' WHEN 5 THEN 'DataDependency' WHEN 6 THEN 'Limitation' WHEN 7 THEN 'ComparisonLink'
         WHEN 8 THEN 'ConceptDependency' WHEN 9 THEN 'Definition' WHEN 10 THEN 'Assumption' WHEN 11 THEN 'RelatedWork'
         WHEN 12 THEN 'CounterArgument' ELSE 'FutureWork' END, '', CAST(a.n_nationkey * 100 + b.n_nationkey AS BIGINT)
FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND (a.n_nationkey < b.n_nationkey OR (a.n_regionkey % 2 = 0 AND a.n_nationkey > b.n_nationkey))
"""

#: A small paper around each document's whole text, without the characters that LaTeX reads.
LATEX_BODY = "translate(coalesce(text, ''), '\\{}$%', '')"


def _sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    return spark.sql(query, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in query})


def plain(query: str) -> str:
    """The query with its tables named as DuckDB has them."""
    return query.format(**{t: t for t in TABLES})


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(_sql(spark, sf_dir, NODES), _sql(spark, sf_dir, EDGES))


def latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): a section, the text with inline math, a citation, a math command, a reference and a comment."""
    docs = table(spark, sf_dir, "documents")
    body = F.translate(F.coalesce("text", F.lit("")), "\\{}$%", "")
    key = F.col("doc_id").cast("string")
    return docs.select(key.alias("doc_id"), F.concat(F.lit("\\section{"), "source", F.lit("} Body "), body, F.lit(" $x$ end \\cite{"), key, F.lit("} \\alpha{a}{b} \\ref[see]{eq} % note\n")).alias("text"))
