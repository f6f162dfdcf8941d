"""The catalogue: a query for each operator that can be asked of tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import analytics as A
from ..operators import chain_training, entities, export, graph, latex, paths, people, rendering, retrieval, syntax, table_functions, vector_index
from ..sources import documents
from ..sources.tables import table
from . import fixture

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WITH = f"nodes AS ({fixture.plain(fixture.NODES)}), edges AS ({fixture.plain(fixture.EDGES)})"
SPLIT = "list_filter(string_split_regex({}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(sql: str | None = None, recursive: bool = False, uses_graph: bool = True):
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            head = f"WITH {'RECURSIVE ' * recursive}{WITH}" if uses_graph else ""
            ORACLES[f.__name__] = f"{head}{',' if uses_graph and sql.lstrip().startswith('+') else ''} {sql.lstrip().lstrip('+')}"
        return f

    return add


def _any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({LOWER.format(column)}, '{w}')" for w in words) + ")"


def _types(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


# --- words ------------------------------------------------------------------------------------------------------------


@query(f"""+ w AS (SELECT unnest({SPLIT.format('content')}) AS word FROM nodes WHERE node_type IN ('Text', 'Math', 'Environment')),
c AS (SELECT word, count(*)::BIGINT AS n FROM w WHERE strlen(word) > 3 GROUP BY word)
SELECT word, n, round(n / (SELECT sum(n) FROM c), 9) AS share FROM c""")
def topic_distribution(spark, sf_dir):
    return A.topic_distribution(fixture.graph(spark, sf_dir).nodes).withColumn("share", F.round("share", 9))


@query(f"""+ t AS (SELECT src, product(CASE edge_type WHEN 'MainContribution' THEN 2.0 WHEN 'RelatedWork' THEN 1.5 WHEN 'ResultSupports' THEN 1.3 ELSE 1.0 END::DOUBLE) AS factor,
      string_agg(' ' || content, '' ORDER BY ord, dst, content) AS context FROM edges JOIN nodes ON dst = node_id GROUP BY src),
s AS (SELECT CASE node_type WHEN 'Section' THEN 2.0 WHEN 'Abstract' THEN 3.0 WHEN 'Author' THEN 0.5 ELSE 1.0 END::DOUBLE * coalesce(factor, 1) AS weight, coalesce(context, '') AS context,
      unnest(list_distinct({SPLIT.format(LOWER.format('content'))})) AS word FROM nodes LEFT JOIN t ON src = node_id WHERE node_type NOT IN ('Math', 'Command')),
g AS (SELECT word, sum(weight) AS weight, count(DISTINCT context)::BIGINT AS contexts FROM s WHERE strlen(word) > 3 GROUP BY word)
SELECT word, round(weight, 6) AS weight, contexts, round((weight / (SELECT max(weight) FROM g)) * (1 + ln(1 + contexts)), 6) AS score FROM g""")
def key_themes(spark, sf_dir):
    return A.key_themes(fixture.graph(spark, sf_dir)).withColumns({"weight": F.round("weight", 6), "score": F.round("score", 6)})


# --- structure and citations ------------------------------------------------------------------------------------------


@query("SELECT src, node_id, content FROM edges JOIN nodes ON dst = node_id WHERE edge_type = 'MainContribution'")
def main_contributions(spark, sf_dir):
    return A.contributions(fixture.graph(spark, sf_dir))


@query("SELECT src, edge_type, node_id, content FROM edges JOIN nodes ON dst = node_id WHERE edge_type IN ('ResultSupports', 'EvidenceSupport')")
def supporting_evidence(spark, sf_dir):
    return A.supporting_evidence(fixture.graph(spark, sf_dir))


@query(f"SELECT node_id, content FROM nodes WHERE node_type = 'Section' AND {_any('content', fixed.METHOD_SECTION)}")
def methodology_sections(spark, sf_dir):
    return A.methodology_sections(fixture.graph(spark, sf_dir)).select("node_id", "content")


@query("SELECT src, t.node_id, t.content FROM edges JOIN nodes t ON dst = t.node_id JOIN nodes s ON src = s.node_id WHERE edge_type = 'Assumption' AND s.node_type IN ('Text', 'Math', 'Environment')")
def critical_assumptions(spark, sf_dir):
    return A.critical_assumptions(fixture.graph(spark, sf_dir))


@query("SELECT content AS citation, count(*)::BIGINT AS n FROM nodes WHERE node_type = 'Citation' GROUP BY content")
def citation_counts(spark, sf_dir):
    return A.citation_counts(fixture.graph(spark, sf_dir))


@query("SELECT content AS citation, count(*)::BIGINT AS n FROM nodes WHERE node_type = 'Citation' GROUP BY content ORDER BY n DESC, citation LIMIT 10")
def citation_top10(spark, sf_dir):
    return A.top_citations(fixture.graph(spark, sf_dir))


@query("SELECT t.content AS citation, s.content AS context FROM edges JOIN nodes t ON dst = t.node_id JOIN nodes s ON src = s.node_id WHERE t.node_type = 'Citation' AND s.node_type = 'Text'")
def citation_contexts(spark, sf_dir):
    return A.citation_contexts(fixture.graph(spark, sf_dir))


@query(f"SELECT DISTINCT regexp_extract(content, '{fixed.YEAR}', 2)::INT AS year, content AS citation FROM nodes WHERE node_type = 'Citation' AND regexp_extract(content, '{fixed.YEAR}', 2) <> ''")
def citations_by_year(spark, sf_dir):
    return A.citations_by_year(fixture.graph(spark, sf_dir))


# --- gaps and checks --------------------------------------------------------------------------------------------------

_NOT_OUT = "node_id NOT IN (SELECT src FROM edges WHERE edge_type IN ({}))"


@query(f"""SELECT 'Explicit gap: ' || content AS gap FROM edges JOIN nodes ON dst = node_id WHERE edge_type IN ('Limitation', 'FutureWork')
UNION ALL SELECT 'Missing validation for section: ' || content FROM nodes WHERE node_type = 'Section' AND {_NOT_OUT.format("'ValidationMethod'")}
UNION ALL SELECT 'Missing comparison analysis for: ' || content FROM nodes WHERE node_type = 'Section' AND {_NOT_OUT.format("'ComparisonLink'")}""")
def research_gaps(spark, sf_dir):
    return A.research_gaps(fixture.graph(spark, sf_dir))


_CLAIMS = f"node_type = 'Section' AND node_id IN (SELECT src FROM edges WHERE edge_type IN ({_types(fixed.CLAIM_EDGES)})) AND " + _NOT_OUT.format("'EvidenceSupport', 'ResultSupports'")


@query(" UNION ALL ".join(f"SELECT '{said} in: ' || content AS gap FROM nodes WHERE node_id IN (SELECT src FROM edges WHERE edge_type = '{a}') AND {_NOT_OUT.format(repr(b))}" for a, b, said in fixed.LOGICAL_PAIRS) + f" UNION ALL SELECT 'Unsupported claim in section: ' || content FROM nodes WHERE {_CLAIMS}")
def logical_gaps(spark, sf_dir):
    return A.logical_gaps(fixture.graph(spark, sf_dir))


@query(f"SELECT node_id, content FROM nodes WHERE {_CLAIMS}")
def unsupported_claims(spark, sf_dir):
    return A.unsupported_claims(fixture.graph(spark, sf_dir)).select("node_id", "content")


@query("SELECT DISTINCT s.content AS concept, t.content AS depends_on FROM edges JOIN nodes t ON dst = t.node_id JOIN nodes s ON src = s.node_id WHERE edge_type IN ('ConceptDependency', 'Definition')")
def concept_hierarchy(spark, sf_dir):
    return A.concept_hierarchy(fixture.graph(spark, sf_dir))


@query(f"""+ m AS (SELECT node_id FROM nodes WHERE node_type = 'Section' AND {_any('content', fixed.COMPLETE_METHOD_SECTION)}),
need AS (SELECT unnest([{_types(fixed.METHODOLOGY_NEEDS)}]) AS missing),
gaps AS (SELECT m.node_id, need.missing FROM m, need WHERE NOT EXISTS (SELECT 1 FROM edges WHERE src = m.node_id AND edge_type = need.missing))
SELECT m.node_id, gaps.missing FROM m LEFT JOIN gaps ON m.node_id = gaps.node_id""")
def methodology_completeness(spark, sf_dir):
    return A.methodology_completeness(fixture.graph(spark, sf_dir))


@query(f"""+ claims AS (SELECT DISTINCT src AS c FROM edges WHERE edge_type IN ({_types(fixed.CLAIM_EDGES)})),
r AS (SELECT c AS claim, c AS node_id FROM claims UNION SELECT r.claim, e.dst FROM r JOIN edges e ON e.src = r.node_id AND e.edge_type IN ({_types(fixed.EVIDENCE_EDGES)})),
d AS (SELECT c AS claim, c AS node_id FROM claims UNION SELECT d.claim, e.dst FROM d JOIN edges e ON e.src = d.node_id AND e.edge_type = 'EvidenceSupport'),
k AS (SELECT src, bool_or(edge_type = 'EvidenceSupport') AS e, bool_or(edge_type = 'ResultSupports') AS r, bool_or(edge_type = 'ValidationMethod') AS v FROM edges GROUP BY src)
SELECT r.claim, bool_or(coalesce(k.e, false)) AS evidence, bool_or(coalesce(k.r, false)) AS results, bool_or(coalesce(k.v, false)) AS validation, bool_and(d.node_id IS NOT NULL) AS linked
FROM r LEFT JOIN d ON d.claim = r.claim AND d.node_id = r.node_id LEFT JOIN k ON k.src = r.node_id GROUP BY r.claim""", recursive=True)
def evidence_chain(spark, sf_dir):
    return A.evidence_chains(fixture.graph(spark, sf_dir))


# --- graph core -------------------------------------------------------------------------------------------------------


@query("SELECT node_type, count(*)::BIGINT AS n FROM nodes GROUP BY node_type")
def nodes_by_type(spark, sf_dir):
    return fixture.graph(spark, sf_dir).nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT node_id, content FROM nodes WHERE node_type = 'Affiliation'")
def find_nodes_by_type(spark, sf_dir):
    return fixture.graph(spark, sf_dir).of_type("Affiliation").select("node_id", "content")


@query("SELECT src AS node_id, dst AS neighbour, node_type AS neighbour_type, content AS neighbour_content FROM edges JOIN nodes ON dst = node_id WHERE edge_type = 'Hierarchical'")
def connected_nodes(spark, sf_dir):
    return graph.connected(fixture.graph(spark, sf_dir), "Hierarchical")


_RULE = "CASE " + " ".join(f"WHEN s.node_type = '{a}' AND t.node_type = '{b}' THEN edge_type = '{e}'" for (a, b), e in fixed.EDGE_RULES.items()) + " ELSE edge_type = 'Hierarchical' END"


@query(f"SELECT s.node_type AS src_node_type, t.node_type AS dst_node_type, edge_type, {_RULE} AS allowed, count(*)::BIGINT AS n FROM edges JOIN nodes s ON src = s.node_id JOIN nodes t ON dst = t.node_id GROUP BY ALL")
def edge_validation(spark, sf_dir):
    return graph.judged_edges(fixture.graph(spark, sf_dir)).groupBy("src_node_type", "dst_node_type", "edge_type", "allowed").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT src, dst, edge_type, label, ord FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, edge_type ORDER BY ord, label) AS k FROM edges) WHERE k = 1")
def edge_dedupe(spark, sf_dir):
    return graph.deduplicated(fixture.graph(spark, sf_dir).edges)


@query("""SELECT 'src' AS missing, src, dst, edge_type FROM edges WHERE src NOT IN (SELECT node_id FROM nodes WHERE node_type <> 'Affiliation')
UNION ALL SELECT 'dst', src, dst, edge_type FROM edges WHERE dst NOT IN (SELECT node_id FROM nodes WHERE node_type <> 'Affiliation')""")
def dangling_edges(spark, sf_dir):
    g = fixture.graph(spark, sf_dir)
    return graph.dangling(graph.Graph(g.nodes.where("node_type <> 'Affiliation'"), g.edges)).select("missing", "src", "dst", "edge_type")


@query("""SELECT node_id, coalesce(o.n, 0)::BIGINT AS out_degree, coalesce(i.n, 0)::BIGINT AS in_degree FROM nodes
LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY src) o ON o.src = node_id LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) i ON i.dst = node_id""")
def degree(spark, sf_dir):
    return graph.degrees(fixture.graph(spark, sf_dir))


@query("SELECT count(*)::BIGINT AS nodes, (SELECT count(*) FROM edges)::BIGINT AS edges FROM nodes")
def edge_count(spark, sf_dir):
    return A.edge_count(fixture.graph(spark, sf_dir))


_REACH = "reach AS (SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT dst FROM edges) UNION SELECT e.dst FROM reach JOIN edges e ON e.src = reach.node_id)"


@query(f"+ {_REACH} SELECT node_id FROM reach", recursive=True)
def reachability(spark, sf_dir):
    return graph.reachable(fixture.graph(spark, sf_dir)).select("node_id")


@query(f"""+ {_REACH} SELECT 'empty_content' AS problem, count(*)::BIGINT AS n FROM nodes WHERE content IS NULL OR content = ''
UNION ALL SELECT 'dangling_edge', (SELECT count(*) FROM edges WHERE src NOT IN (SELECT node_id FROM nodes)) + (SELECT count(*) FROM edges WHERE dst NOT IN (SELECT node_id FROM nodes))
UNION ALL SELECT 'unreached_node', count(*) FROM nodes WHERE node_id NOT IN (SELECT node_id FROM reach)""", recursive=True)
def dag_validate(spark, sf_dir):
    return graph.validated(fixture.graph(spark, sf_dir))


_COMPONENT = f"((node_type = 'Section' AND {_any('content', fixed.METHOD_COMPONENT)}) OR node_id IN (SELECT src FROM edges WHERE edge_type IN ('MethodologyFlow', 'ExperimentalSetup')))"


@query(f"SELECT node_id FROM nodes WHERE {_COMPONENT}")
def methodology_components(spark, sf_dir):
    return graph.methodology_components(fixture.graph(spark, sf_dir)).select("node_id")


@query(f"""+ f AS (SELECT node_id, 0 AS phase FROM nodes WHERE {_COMPONENT} AND node_id NOT IN (SELECT dst FROM edges WHERE edge_type = 'MethodologyFlow')
UNION SELECT e.dst, f.phase + 1 FROM f JOIN edges e ON e.src = f.node_id AND e.edge_type = 'MethodologyFlow' WHERE f.phase < 30)
SELECT node_id, min(phase)::INT AS phase FROM f GROUP BY node_id""", recursive=True)
def methodology_phases(spark, sf_dir):
    return graph.methodology_phases(fixture.graph(spark, sf_dir))


@query("""+ h AS (SELECT src, dst, edge_type FROM edges WHERE edge_type = 'Hierarchical' UNION ALL SELECT dst, src, 'Hierarchical' FROM edges WHERE edge_type = 'Hierarchical' AND dst LIKE 'n%'),
r AS (SELECT dst AS o, dst AS x FROM h UNION SELECT r.o, h.dst FROM r JOIN h ON h.src = r.x)
SELECT DISTINCT h.src, h.dst FROM h JOIN r ON r.o = h.dst AND r.x = h.src""", recursive=True)
def cyclic_edges(spark, sf_dir):
    tree = fixture.graph(spark, sf_dir).edges_of("Hierarchical")
    back = tree.where("dst LIKE 'n%'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type", "label", "ord")
    return graph.cyclic_edges(tree.unionByName(back)).select("src", "dst").distinct()


@query("""+ c AS (SELECT n_nationkey AS chain_id, ['r' || n_regionkey, 'n' || n_nationkey, 'c' || (SELECT min(c_custkey) FROM customer)] AS l FROM nation),
s AS (SELECT chain_id, l[i] AS src, l[i + 1] AS dst FROM c, (SELECT unnest([1, 2]) AS i))
SELECT s.chain_id::BIGINT AS chain_id, bool_and(e.src IS NOT NULL) AS holds FROM s LEFT JOIN (SELECT DISTINCT src, dst FROM edges WHERE edge_type = 'Hierarchical') e ON e.src = s.src AND e.dst = s.dst GROUP BY s.chain_id""")
def relationship_chain(spark, sf_dir):
    least = table(spark, sf_dir, "customer").agg(F.min("c_custkey").cast("string")).scalar()
    chain = F.array(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("c"), least))
    chains = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("chain_id"), chain.alias("nodes"))
    return graph.chain_holds(chains, fixture.graph(spark, sf_dir).edges, "Hierarchical")


@query("""SELECT user_id AS src, event_type AS dst, max_by(value, event_id) AS value FROM events GROUP BY user_id, event_type
HAVING max_by(value, event_id) >= 0""", uses_graph=False)
def latest_relationships(spark, sf_dir):
    change = F.when(F.col("value") >= 0, "Added").otherwise("Removed")
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), F.col("event_type").alias("dst"), F.lit("RelatedWork").alias("edge_type"), change.alias("change"), F.col("event_id").alias("at"), "value")
    return graph.latest_relationships(log).select("src", "dst", "value")


# --- centrality and components ----------------------------------------------------------------------------------------

_RANK_0 = """n AS (SELECT count(*)::DOUBLE AS n FROM nodes), w AS (SELECT e.src, e.dst, count(*) / any_value(d.k) AS share FROM edges e JOIN (SELECT src, count(*)::DOUBLE AS k FROM edges GROUP BY src) d ON d.src = e.src GROUP BY e.src, e.dst),
s0 AS (SELECT node_id, 1 / n.n AS score FROM nodes, n)"""
_RANKS = ", ".join([_RANK_0] + [f"s{k} AS (SELECT x.node_id, 0.15 / n.n + 0.85 * coalesce(f.f, 0) AS score FROM nodes x CROSS JOIN n LEFT JOIN (SELECT dst, sum(score * share) AS f FROM w JOIN s{k - 1} p ON p.node_id = w.src GROUP BY dst) f ON f.dst = x.node_id)" for k in range(1, 11)])


@query(f"+ {_RANKS} SELECT node_id, round(score, 12) AS score FROM s10")
def pagerank_k10(spark, sf_dir):
    return A.pagerank(fixture.graph(spark, sf_dir), iterations=10, tolerance=None).withColumn("score", F.round("score", 12))


@query()
def pagerank_converged(spark, sf_dir):
    return A.pagerank(fixture.graph(spark, sf_dir))


@query(f"""+ {_RANKS}, a AS (SELECT src AS node_id, dst AS other FROM edges UNION ALL SELECT dst, src FROM edges),
b AS (SELECT a.node_id, count(DISTINCT node_type)::BIGINT AS types, count(*)::BIGINT AS degree FROM a JOIN nodes o ON o.node_id = a.other GROUP BY a.node_id)
SELECT b.node_id, b.types, b.degree, round(score * types * (degree / n.n), 12) AS bridge FROM b JOIN s10 ON s10.node_id = b.node_id, n WHERE score * types * (degree / n.n) > 0.00000001""")
def bridging_concepts(spark, sf_dir):
    g = fixture.graph(spark, sf_dir)
    out = A.bridging(g, A.pagerank(g, iterations=10, tolerance=None), cut=0.00000001)
    return out.select("node_id", "types", "degree", F.round("bridge", 12).alias("bridge"))


@query(f"+ {_RANKS} SELECT node_id, row_number() OVER (ORDER BY round(score, 14) DESC, node_id)::BIGINT AS place FROM s10")
def nodes_by_importance(spark, sf_dir):
    g = fixture.graph(spark, sf_dir)
    return A.ranked(g, iterations=10, tolerance=None, digits=14).select("node_id", "place")


@query()
def bridging_concepts_converged(spark, sf_dir):
    """bridging_concepts by converged scores, which unrolled SQL can't express."""
    g = fixture.graph(spark, sf_dir)
    return A.bridging(g, A.pagerank(g), cut=0.00000001).select("node_id", "types", "degree", "bridge")


@query()
def nodes_by_importance_converged(spark, sf_dir):
    return A.ranked(fixture.graph(spark, sf_dir)).select("node_id", "score", "place")


@query("""+ r AS (SELECT DISTINCT src AS a, dst AS b FROM edges UNION SELECT r.a, e.dst FROM r JOIN edges e ON e.src = r.b),
m AS (SELECT x.a, min(x.b) AS low FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT node_id, least(node_id, coalesce(low, node_id)) AS component FROM nodes LEFT JOIN m ON m.a = node_id""", recursive=True)
def scc(spark, sf_dir):
    return A.strongly_connected(fixture.graph(spark, sf_dir))


# --- relations that follow from the edges -----------------------------------------------------------------------------


@query("SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE edge_type = 'CounterArgument'")
def contradictions(spark, sf_dir):
    return A.contradictions(fixture.graph(spark, sf_dir))


@query("""+ p AS (SELECT DISTINCT src AS start, [src, dst] AS path FROM edges WHERE src LIKE 'r%'
UNION SELECT p.start, list_append(p.path, e.dst) FROM p JOIN edges e ON e.src = p.path[-1] WHERE len(p.path) <= 3 AND NOT list_contains(p.path, e.dst))
SELECT start, array_to_string(path, '>') AS path FROM p""", recursive=True)
def all_paths(spark, sf_dir):
    g = fixture.graph(spark, sf_dir)
    return A.all_paths(g, g.of_type("Document"), 3).select("start", F.array_join("path", ">").alias("path"))


@query(f"""SELECT a.r AS a, b.r AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s)), 9) AS similarity
FROM (SELECT min('p' || p_partkey) AS r, s FROM (SELECT p_partkey, list_sort(list_distinct({SPLIT.format(LOWER.format('p_name'))})) AS s FROM part) GROUP BY s) a
JOIN (SELECT min('p' || p_partkey) AS r, s FROM (SELECT p_partkey, list_sort(list_distinct({SPLIT.format(LOWER.format('p_name'))})) AS s FROM part) GROUP BY s) b ON a.r < b.r
WHERE len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s)) >= 0.3""", uses_graph=False)
def similar_nodes(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node_id"), F.col("p_name").alias("content"))
    return A.similar_nodes(parts, 0.3).withColumn("similarity", F.round("similarity", 9))


@query(f"""SELECT 'p' || p_partkey AS node_id, min('p' || p_partkey) OVER (PARTITION BY s) AS rep
FROM (SELECT p_partkey, list_sort(list_distinct({SPLIT.format(LOWER.format('p_name'))})) AS s FROM part) WHERE len(s) > 0""", uses_graph=False)
def similar_nodes_members(spark, sf_dir):
    """Every node with the one that stands for it in similar_nodes."""
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node_id"), F.col("p_name").alias("content"))
    return A.equal_nodes(parts)


@query("SELECT 'o' || l_orderkey AS a, 'p' || l_partkey AS b, round(sum(l_discount), 6) AS strength FROM lineitem GROUP BY 1, 2", uses_graph=False)
def relationship_strength(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.col("l_discount").alias("confidence"))
    return A.relationship_strength(edges).withColumn("strength", F.round("strength", 6))


@query("""SELECT 'o' || l_orderkey AS node_id, 'Citation' AS edge_type, l_discount AS confidence FROM lineitem WHERE l_partkey = 1 AND l_discount >= 0.05""", uses_graph=False)
def related_concepts(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("Citation").alias("edge_type"), F.col("l_discount").alias("confidence"))
    return A.related_concepts(edges, "p1", 0.05)


@query("""SELECT 'p' || l_partkey AS concept, 'o' || l_orderkey AS node_id, 'Citation' AS edge_type, l_discount AS confidence FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_discount >= 0.05""", uses_graph=False)
def related_concepts_of_all(spark, sf_dir):
    """related_concepts of every part."""
    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("Citation").alias("edge_type"), F.col("l_discount").alias("confidence"))
    concepts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("concept"))
    return A.related_to_each(edges, concepts, 0.05)


@query("""+ f AS (SELECT node_id AS start, node_id, 0 AS depth FROM nodes WHERE node_type = 'Section'
UNION SELECT f.start, e.dst, f.depth + 1 FROM f JOIN edges e ON e.src = f.node_id AND e.edge_type = 'MethodologyFlow' WHERE f.depth < 30)
SELECT start, node_id, min(depth)::INT AS depth FROM f GROUP BY start, node_id""", recursive=True)
def methodology_chain(spark, sf_dir):
    g = fixture.graph(spark, sf_dir)
    return A.methodology_flow(g, g.of_type("Section"))


@query(f"""+ f AS (SELECT DISTINCT src AS claim, src AS node_id, 0 AS depth FROM edges WHERE edge_type IN ({_types(fixed.CLAIM_EDGES)})
UNION SELECT f.claim, e.dst, f.depth + 1 FROM f JOIN edges e ON e.src = f.node_id AND e.edge_type IN ({_types(fixed.EVIDENCE_EDGES)}) WHERE f.depth < 12)
SELECT claim, node_id, min(depth)::INT AS depth, pow(0.5, min(depth)) AS strength FROM f GROUP BY claim, node_id HAVING min(depth) > 0""", recursive=True)
def supporting_nodes(spark, sf_dir):
    g = fixture.graph(spark, sf_dir)
    claims = g.edges_of(*fixed.CLAIM_EDGES).select(F.col("src").alias("node_id")).distinct()
    return A.supporting_nodes(g, claims)


_SURE = f"SELECT src, dst, max((ord % 90 + 10)::DOUBLE / 100) AS step FROM edges WHERE edge_type IN ({_types(fixed.EVIDENCE_EDGES)}) GROUP BY src, dst"


@query(f"""+ s AS ({_SURE}), f AS (SELECT DISTINCT src AS start, src AS node_id, 1.0::DOUBLE AS strength, 0 AS hops, [src] AS path FROM edges WHERE edge_type IN ({_types(fixed.CLAIM_EDGES)})
UNION ALL SELECT f.start, s.dst, f.strength * s.step, f.hops + 1, list_append(f.path, s.dst) FROM f JOIN s ON s.src = f.node_id WHERE NOT list_contains(f.path, s.dst))
SELECT start AS claim, node_id, round(max(strength), 12) AS strength FROM f WHERE hops > 0 GROUP BY start, node_id""", recursive=True)
def strongest_support(spark, sf_dir):
    """How sure the surest chain of evidence from each claim to each node is."""
    g = fixture.graph(spark, sf_dir)
    edges = g.edges_of(*fixed.EVIDENCE_EDGES).withColumn("confidence", (F.col("ord") % 90 + 10).cast("double") / 100)
    claims = g.edges_of(*fixed.CLAIM_EDGES).select(F.col("src").alias("node_id")).distinct()
    return paths.strongest_paths(edges, claims).select(F.col("start").alias("claim"), "node_id", F.round("strength", 12).alias("strength"))


@query("""+ e AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst),
f AS (SELECT 'r' || n_regionkey AS start, 'c' || c_custkey AS target, ['r' || n_regionkey] AS path FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT f.start, f.target, list_append(f.path, e.dst) FROM f JOIN e ON e.src = f.path[-1] WHERE len(f.path) <= 3 AND f.path[-1] <> f.target AND NOT list_contains(f.path, e.dst))
SELECT start, target, array_to_string(path, '>') AS path FROM f WHERE path[-1] = target""", recursive=True)
def paths_to_target(spark, sf_dir):
    """The paths of at most three edges from every customer's region to the customer."""
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    pairs = customers.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("start"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("target"))
    found = paths.paths_between(fixture.graph(spark, sf_dir).edges, pairs, 3)
    return found.select("start", "target", F.array_join("path", ">").alias("path"))


@query(f"""+ f AS (SELECT node_id, [{{'ord': 0::BIGINT, 'dst': node_id}}] AS walk FROM nodes WHERE {_COMPONENT} AND node_id NOT IN (SELECT dst FROM edges WHERE edge_type = 'MethodologyFlow')
UNION ALL SELECT e.dst, list_append(f.walk, {{'ord': e.ord, 'dst': e.dst}}) FROM f JOIN edges e ON e.src = f.node_id AND e.edge_type = 'MethodologyFlow' WHERE NOT list_contains(list_transform(f.walk, lambda w: w.dst), e.dst))
SELECT node_id, arg_min((len(walk) - 1)::INT, walk) AS phase FROM f GROUP BY node_id""", recursive=True)
def first_visit_phases(spark, sf_dir):
    """methodology_phases as a depth-first walk meets them: by the first of a node's simple paths, not by the shortest."""
    return paths.first_visit_phases(fixture.graph(spark, sf_dir))


# --- exports ----------------------------------------------------------------------------------------------------------

_NAME = "CASE node_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.NODE_TYPE_NAMES.items()) + " ELSE 'Unknown_' || " + "(list_position([" + _types(tuple(fixed.NODE_TYPES)) + "], node_type) - 1) END"
_STYLE = "CASE edge_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.EDGE_STYLES.items()) + f" ELSE '{fixed.OTHER_EDGE_STYLE}' END"
_ORDINAL = f"(list_position([{_types(tuple(fixed.EDGE_TYPES))}], edge_type) - 1)::INT"


@query(f"SELECT (row_number() OVER (ORDER BY node_id) - 1)::BIGINT AS index, node_id AS id, {_NAME} AS type, content FROM nodes")
def knowledge_graph_nodes(spark, sf_dir):
    return export.knowledge_nodes(fixture.graph(spark, sf_dir))


@query(f"+ i AS (SELECT node_id, (row_number() OVER (ORDER BY node_id) - 1)::BIGINT AS k FROM nodes) SELECT s.k AS source, t.k AS target, {_ORDINAL} AS type, label FROM edges JOIN i s ON src = s.node_id JOIN i t ON dst = t.node_id")
def knowledge_graph_edges(spark, sf_dir):
    return export.knowledge_edges(fixture.graph(spark, sf_dir))


_SHORT = "rtrim(ltrim(regexp_replace(regexp_replace(content, '[{}]', '', 'g'), '\\s+', ' ', 'g'), ' '))"


@query(f"""+ x AS (SELECT node_id, {_NAME} AS name, {_SHORT} AS short FROM nodes),
l AS (SELECT node_id, name, CASE WHEN coalesce(short, '') = '' THEN '[' || node_id || ']' WHEN strlen(short) > 40 THEN left(short, 37) || '...' ELSE short END AS label FROM x),
e AS (SELECT *, {_STYLE} || CASE WHEN label <> '' THEN ',label="' || label || '"' ELSE '' END AS style FROM edges)
SELECT 'digraph ResearchPaper {{' AS line UNION ALL SELECT unnest(['  rankdir=LR;', '  node [shape=box, style=filled, fontname="Arial"];', '  concentrate=true;', '  compound=true;', '}}'])
UNION ALL SELECT unnest(['  subgraph cluster_' || name || ' {{', '    style=filled;', '    color=lightgrey;', '    label="' || name || '";', '  }}']) FROM (SELECT DISTINCT name FROM l)
UNION ALL SELECT '    "' || node_id || '" [label="' || label || '"];' FROM l
UNION ALL SELECT '  "' || src || '" -> "' || dst || '" [' || style || '];' FROM e""".replace("{{", "{").replace("}}", "}"))
def dot_lines(spark, sf_dir):
    return export.dot_lines(fixture.graph(spark, sf_dir)).select("line")


@query("""+ k AS (SELECT src, dst, CASE edge_type """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.SEMANTIC_STYLES.items()) + f""" END AS style FROM edges WHERE edge_type IN ({_types(tuple(fixed.SEMANTIC_STYLES))})),
s AS (SELECT node_id, content, 'Nation' AS concept, lower(printf('%X', (255 * (1 - substr(node_id, 2)::INT / 25.0::DOUBLE))::DOUBLE::INT)) AS x FROM nodes WHERE node_type = 'Section')
SELECT '  "' || src || '" -> "' || dst || '" [' || style || '];' AS line FROM k""")
def semantic_map_edges(spark, sf_dir):
    return export.semantic_map_lines(fixture.graph(spark, sf_dir)).where("part = 2").select("line")


@query()
def semantic_map(spark, sf_dir):
    g = fixture.graph(spark, sf_dir)
    semantics = g.of_type("Section").select("node_id", F.lit("Nation").alias("concept_type"), (F.substring("node_id", 2, 9).cast("int") / 25.0).alias("importance"))
    return export.semantic_map_lines(g, semantics)


@query()
def methodology_flow(spark, sf_dir):
    return export.methodology_flow_lines(fixture.graph(spark, sf_dir))


@query()
def knowledge_graph_json(spark, sf_dir):
    return export.knowledge_json(fixture.graph(spark, sf_dir))


@query(f"""+ d AS (SELECT node_id, 0 AS depth FROM nodes WHERE node_id NOT IN (SELECT dst FROM edges) UNION SELECT e.dst, d.depth + 1 FROM d JOIN edges e ON e.src = d.node_id AND e.edge_type = 'Hierarchical'),
p AS (SELECT node_id, min(depth)::INT AS depth FROM d GROUP BY node_id), k AS (SELECT src, count(*) AS n FROM edges GROUP BY src)
SELECT p.node_id, depth, repeat(' ', 2 * depth) || 'Node: ' || p.node_id || ' Type: ' || (list_position([{_types(tuple(fixed.NODE_TYPES))}], node_type) - 1) || ' Content: ' || coalesce(content, 'null') || ' Outgoing edges: ' || coalesce(n, 0) AS line
FROM p JOIN nodes ON nodes.node_id = p.node_id LEFT JOIN k ON k.src = p.node_id""", recursive=True)
def structure_dump(spark, sf_dir):
    return export.structure_lines(fixture.graph(spark, sf_dir)).select("node_id", "depth", "line")


# --- retrieval --------------------------------------------------------------------------------------------------------

_COSINE = "round(list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9)"


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, object]:
    vectors = table(spark, sf_dir, "embeddings")
    wanted = vectors.where("vec_id = 0").select("embedding").first()["embedding"]
    return vectors, F.array(*[F.lit(float(x)) for x in wanted])


@query(f"SELECT vec_id, {_COSINE} AS score FROM embeddings e ORDER BY score DESC, vec_id LIMIT 5", uses_graph=False)
def knn_top5(spark, sf_dir):
    vectors, wanted = _vectors(spark, sf_dir)
    return retrieval.nearest(vectors, wanted, "vec_id").select("vec_id", F.round("score", 9).alias("score"))


@query(f"SELECT label, vec_id, score, place FROM (SELECT label, vec_id, {_COSINE} AS score, row_number() OVER (PARTITION BY label ORDER BY {_COSINE} DESC, vec_id)::INT AS place FROM embeddings e) WHERE place <= 5", uses_graph=False)
def knn_top5_per_index(spark, sf_dir):
    vectors, wanted = _vectors(spark, sf_dir)
    return retrieval.nearest_by_index(vectors, wanted, "vec_id", "label").select("label", "vec_id", F.round("score", 9).alias("score"), "place")


_COSINES = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9)"
_SCORES = f"SELECT q.vec_id AS query, e.label, e.vec_id, {_COSINES} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND e.embedding IS NOT NULL"


def _wanted(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id % 50 = 0")


@query(f"SELECT query, vec_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INT AS place FROM ({_SCORES})) WHERE place <= 5", uses_graph=False)
def knn_top5_of_many(spark, sf_dir):
    """The nearest rows of every row whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.nearest_in_blocks(vectors, _wanted(vectors), "vec_id", digits=9).select("query", "vec_id", "score", "place")


@query(f"SELECT query, label, vec_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY score DESC, vec_id)::INT AS place FROM ({_SCORES})) WHERE place <= 5", uses_graph=False)
def knn_top5_per_index_of_many(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.nearest_in_blocks(vectors, _wanted(vectors), "vec_id", index="label", digits=9).select("query", "label", "vec_id", "score", "place")


@query(f"SELECT query, vec_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INT AS place FROM ({_SCORES})) WHERE place <= 5", uses_graph=False)
def knn_index_top5(spark, sf_dir):
    """knn_top5_of_many through the inverted file: two passes, the second to the cells that may hold something better."""
    vectors = table(spark, sf_dir, "embeddings")
    found = vector_index.InvertedFile.build(vectors, "vec_id")
    return found.search(_wanted(vectors), exact=True).select("query", "vec_id", "score", "place")


@query(f"SELECT query, label, vec_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY score DESC, vec_id)::INT AS place FROM ({_SCORES})) WHERE place <= 5", uses_graph=False)
def knn_index_top5_per_index(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    found = vector_index.InvertedFile.build(vectors, "vec_id", index="label")
    return found.search(_wanted(vectors), exact=True).select("query", "label", "vec_id", "score", "place")


@query("SELECT count(*)::BIGINT AS queries, count(*)::BIGINT * least(5, (SELECT count(*) FROM embeddings))::BIGINT AS neighbours, true AS enough FROM embeddings WHERE vec_id % 50 = 0", uses_graph=False)
def knn_index_recall(spark, sf_dir):
    """Whether the calibrated number of probes finds nine tenths of the exact neighbours of all queries."""
    vectors = table(spark, sf_dir, "embeddings")
    wanted, found = _wanted(vectors), vector_index.InvertedFile.build(vectors, "vec_id")
    near = found.search(wanted, probes=found.probes_for(wanted))
    exact = retrieval.nearest_in_blocks(vectors, wanted, "vec_id", digits=9)
    hits = vector_index.recall(near, exact, "vec_id")
    return hits.agg(F.count(F.lit(1)).alias("queries"), F.sum("n").alias("neighbours"), (F.sum("hits") >= 0.9 * F.sum("n")).alias("enough"))


_CONTEXT = "'### Source: ' || source || chr(10) || 'Section Title: No Title' || chr(10) || 'Content: ' || coalesce(text, 'No Content') || chr(10) || 'Authors: ' || coalesce(lang, '') || chr(10) || 'Affiliations: ' || chr(10) || 'References: ' || doc_id || ', ' || n_chars"


@query(f"SELECT doc_id, {_CONTEXT} AS context FROM documents", uses_graph=False)
def rag_context(spark, sf_dir):
    m = F.struct(F.col("source").alias("source_file"), F.lit(None).cast("string").alias("section_title"), F.col("text").alias("content"), F.array_compact(F.array("lang")).alias("authors"), F.array().cast("array<string>").alias("affiliations"), F.array(F.col("doc_id").cast("string"), F.col("n_chars").cast("string")).alias("references"))
    return retrieval.contexts(table(spark, sf_dir, "documents").select("doc_id", m.alias("metadata"))).select("doc_id", "context")


@query()
def split_text_chunks(spark, sf_dir):
    return retrieval.chunked(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), 2000)


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(f"""SELECT doc_id::VARCHAR AS source_file, i::INT AS place, CASE i WHEN 1 THEN trim(coalesce(text, ''), {_BLANK})
  WHEN 2 THEN trim(coalesce(text, '') || '$x_' || doc_id || '$' || '{{"content":"' || coalesce(lang, '') || '","type":"note"}}', {_BLANK}) ELSE n_chars::VARCHAR END AS content
FROM documents, range(1, 4) AS t(i)""", uses_graph=False)
def mixed_sections(spark, sf_dir):
    """Every document's text as JSON with three sections: a string, a list of a string and objects, and a number."""
    d = table(spark, sf_dir, "documents")
    said, lang = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("t"))), F.coalesce("lang", F.lit(""))
    string = F.expr("substring(j, 6, length(j) - 6)")  # the text as a JSON string
    body = F.concat(F.lit('{"document":{"content":[{"content":'), string, F.lit('},{"content":['), string, F.lit(',{"type":"inline_math","content":"x_'), "doc_id", F.lit('"},{"type":"note","content":"'), lang, F.lit('"}]},{"content":'), "n_chars", F.lit("}]}}"))
    rows = d.withColumn("j", said).select(F.col("doc_id").cast("string").alias("source_file"), body.alias("json"))
    return retrieval.flattened(documents.from_json_text(rows)).select("source_file", "place", "content")


@query("SELECT DISTINCT source || ' _' || coalesce(lang, '') AS name, coalesce(nullif(trim(regexp_replace(lower(source || ' _' || coalesce(lang, '')), '[^a-z0-9-]+', '-', 'g'), '-'), ''), 'default-index') AS index_name FROM documents", uses_graph=False)
def index_names(spark, sf_dir):
    name = F.concat("source", F.lit(" _"), F.coalesce("lang", F.lit("")))
    return table(spark, sf_dir, "documents").select(name.alias("name"), text.index_name(name).alias("index_name")).distinct()


@query("""SELECT doc_id::VARCHAR AS source_file, 'Title not listed.' AS document_title, lang || '|' AS authors, source AS affiliations, i::INT AS place, CASE WHEN i = 1 THEN 'Section 1' ELSE 'L' || i END AS section_title,
trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) || chr(10) || 'Figure Caption: ' || doc_id AS content
FROM (SELECT doc_id, coalesce(lang, '') AS lang, source, l, generate_subscripts(l, 1) AS i FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))""", uses_graph=False)
def flatten_sections(spark, sf_dir):
    """Every document with its lines as sections, the first without a title, and two authors, one without a name."""
    none = F.lit(None).cast("string")
    title = lambda i: F.when(i > 0, F.concat(F.lit("L"), (i + 1).cast("string")))
    caption = F.col("doc_id").cast("string")
    section = lambda t, i: F.struct(title(i).alias("section"), none.alias("type"), t.alias("content"), F.array().cast("array<struct<label:string>>").alias("references"), caption.alias("figure_caption"), none.alias("image_file"))
    author = lambda name: F.struct(name.alias("name"), F.array("source").alias("affiliations"))
    people_ = F.array(author(F.col("lang")), author(none))
    content = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), section)
    docs = table(spark, sf_dir, "documents").select(caption.alias("source_file"), F.struct(none.alias("title"), F.struct(people_.alias("authors")).alias("metadata"), content.alias("content")).alias("document"))
    out = retrieval.flattened(docs)
    return out.select("source_file", "document_title", F.array_join("authors", "|").alias("authors"), F.array_join("affiliations", "|").alias("affiliations"), "place", "section_title", "content")


@query("SELECT doc_id, translate(source || '/' || coalesce(lang, '') || '\\' || doc_id, '/\\', '__') AS name FROM documents", uses_graph=False)
def safe_filenames(spark, sf_dir):
    path = F.concat("source", F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("\\"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", text.safe_filename(path).alias("name"))


# --- LaTeX ------------------------------------------------------------------------------------------------------------

_BODY = "translate(coalesce(text, ''), '\\{}$%', '')"
_TEXT = f"'Body ' || {_BODY} || ' $x$ end '"
_HEAD = "strlen('\\section{' || source || '} ')"
_AFTER = f"{_HEAD} + strlen({_TEXT})"
_TOKENS = f"""SELECT doc_id::VARCHAR AS doc_id, unnest([0, 1, 2, 3, 4, 5])::INT AS ord, unnest(['Command', 'Text', 'Command', 'Command', 'Text', 'Command']) AS type,
unnest(['\\section [] {{' || source || '}}', {_TEXT}, '\\cite [] {{' || doc_id || '}}', '\\alpha [] {{a}}', '', '\\ref [see] {{eq}}']) AS value,
unnest([0, {_HEAD}, {_AFTER}, {_AFTER} + strlen('\\cite{{' || doc_id || '}} '), -1, {_AFTER} + strlen('\\cite{{' || doc_id || '}} \\alpha{{a}}{{b}} ')])::BIGINT AS position FROM documents""".replace("{{", "{").replace("}}", "}")


@query(f"SELECT doc_id, type, value, position FROM ({_TOKENS}) WHERE position >= 0 UNION ALL SELECT doc_id::VARCHAR, unnest(['OpenBrace', 'Text', 'CloseBrace']), unnest(['{{', 'b', '}}']), (p + unnest([0, 1, 2]))::BIGINT FROM (SELECT doc_id, {_AFTER} + strlen('\\cite{{' || doc_id || '}} \\alpha{{a}}') AS p FROM documents)".replace("{{", "{").replace("}}", "}"), uses_graph=False)
def tokens(spark, sf_dir):
    return latex.tokens(fixture.latex(spark, sf_dir), "strict").select("doc_id", "type", "value", "position")


_FLAT = f"""SELECT doc_id::VARCHAR AS doc_id, unnest([0, 1, 2, 3, 4, 5, 6])::INT AS ord, unnest(['Document', 'Command', 'Text', 'Command', 'Command', 'Text', 'Command']) AS type,
unnest(['Document Root', '\\section [] {{' || source || '}}', {_TEXT}, '\\cite [] {{' || doc_id || '}}', '\\alpha [] {{a}}', 'b', '\\ref [see] {{eq}}']) AS content FROM documents""".replace("{{", "{").replace("}}", "}")


@query(_FLAT, uses_graph=False)
def ast_nodes(spark, sf_dir):
    return latex.ast_nodes(fixture.latex(spark, sf_dir), "strict").select("doc_id", "ord", "type", "content")


@query(_FLAT, uses_graph=False)
def ast_nodes_by_sql(spark, sf_dir):
    """ast_nodes as a table function in a lateral join."""
    table_functions.register(spark)
    return spark.sql("SELECT d.doc_id, n.ord, n.type, n.content FROM {docs} d, LATERAL tex_nodes(d.text, 'strict') n", docs=fixture.latex(spark, sf_dir))


_NL = " || chr(10) || "
_CHUNK = _NL.join(
    [
        "'Document Root'",
        "'<section_header>'",
        "'  <level>2</level>'",
        "'  <title>' || source || '</title>'",
        "'</section_header>'",
        f"'<text_content>Body ' || {_BODY} || ' </text_content>'",
        "'<inline_math>x</inline_math>'",
        "'<text_content> end </text_content>'",
        """'<citation type="cite">'""",
        "'</citation>'",
        """'<math_command type="alpha">'""",
        "'  <arg1>a</arg1>'",
        "'</math_command>'",
        "'<text_content>b</text_content>'",
        """'<reference type="standard">'""",
        "'</reference>'",
    ]
)


@query(f"SELECT doc_id::VARCHAR AS doc_id, {_CHUNK} || chr(10) AS chunk FROM documents", uses_graph=False)
def fsm_chunks(spark, sf_dir):
    return rendering.strict_chunks(rendering.strict_pieces(latex.ast_nodes(fixture.latex(spark, sf_dir), "strict")))


@query(f"""SELECT doc_id::VARCHAR AS doc_id, unnest([0, 1, 2, 3, 4])::INT AS chunk_id,
unnest(['Document Root [Section] \\section [] {{' || source || '}} [Math Start] ' || {_TEXT} || ' [Math End] ', '\\cite [] {{' || doc_id || '}} ', '\\alpha [] {{a}} ', 'b ', '\\ref [see] {{eq}} ']) AS chunk FROM documents""".replace("{{", "{").replace("}}", "}"), uses_graph=False)
def ast_chunks(spark, sf_dir):
    return syntax.chunks(latex.ast_nodes(fixture.latex(spark, sf_dir), "strict"))


@query("SELECT unnest(['section', 'citation', 'math', 'reference']) AS class, count(*)::BIGINT AS n FROM documents GROUP BY 1", uses_graph=False)
def command_class_counts(spark, sf_dir):
    marked = rendering.classified(latex.ast_nodes(fixture.latex(spark, sf_dir), "strict")).where("class IS NOT NULL")
    return marked.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT doc_id::VARCHAR AS doc_id, unnest(['Section', 'Text', 'Math', 'Text', 'Citation', 'Command', 'Text', 'Reference']) AS type,
unnest([source, ' Body ' || {_BODY} || ' ', 'x', ' end ', doc_id::VARCHAR, '\\alpha{{a}}', 'b', 'eq']) AS content FROM documents""".replace("{{", "{").replace("}}", "}"), uses_graph=False)
def nested_nodes(spark, sf_dir):
    return latex.ast_nodes(fixture.latex(spark, sf_dir)).where("type <> 'Document' AND trim(content) <> ''").select("doc_id", "type", "content")


@query(f"SELECT doc_id::VARCHAR AS doc_id, source AS section, ' Body ' || {_BODY} || ' $x$ end b' AS content, doc_id || ',eq' AS refs FROM documents", uses_graph=False)
def section_chunks(spark, sf_dir):
    made = rendering.sections(latex.ast_nodes(fixture.latex(spark, sf_dir)))
    return made.where("section <> ''").select("doc_id", "section", F.rtrim("content").alias("content"), F.array_join("references", ",").alias("refs"))


@query("SELECT doc_id, '<text_content>a ' || source || ' </text_content>' || chr(10) || '<inline_math>' || lang || '</inline_math>' || chr(10) || '<text_content> b</text_content>' || chr(10) AS tagged FROM documents WHERE lang IS NOT NULL", uses_graph=False)
def inline_math_split(spark, sf_dir):
    made = F.concat(F.lit("a "), "source", F.lit(" $"), "lang", F.lit("$ b"))
    return table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", text.inline_math(made).alias("tagged"))


@query(f"SELECT type, problem, count(*)::BIGINT AS n FROM (SELECT type, CASE WHEN content = '' AND type <> 'Document' THEN 'Empty content for non-document node' WHEN type = 'Command' AND NOT starts_with(content, '\\') THEN 'Command without backslash' END AS problem FROM ({_FLAT})) GROUP BY ALL", uses_graph=False)
def node_validation(spark, sf_dir):
    return syntax.validated(latex.ast_nodes(fixture.latex(spark, sf_dir), "strict")).groupBy("type", "problem").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, ord, type FROM ({_FLAT})", uses_graph=False)
def valid_children(spark, sf_dir):
    return syntax.valid_children(latex.ast_nodes(fixture.latex(spark, sf_dir), "strict")).select("doc_id", "ord", "type")


@query("""SELECT doc_id::VARCHAR AS doc_id, unnest(['1_12_section' || regexp_replace(source, '[^A-Za-z0-9_]', '', 'g'), '2_12_cite' || doc_id, '3_12_alphaa', '4_12_refseeeq', '5_6_eq']) AS node_id,
unnest(['Command', 'Command', 'Command', 'Command', 'Reference']) AS node_type FROM documents""", uses_graph=False)
def graph_node_ids(spark, sf_dir):
    return rendering.graph_nodes(latex.ast_nodes(fixture.latex(spark, sf_dir), "strict")).select("doc_id", "node_id", "node_type")


@query("""SELECT d.source AS doc_id, d.doc_id AS node, coalesce(d.lang, 'none') AS label, coalesce(l.target, -1)::BIGINT AS target FROM documents d
LEFT JOIN (SELECT source, lang, max_by(doc_id, doc_id) AS target FROM documents WHERE lang <> 'es' GROUP BY source, lang) l ON l.source = d.source AND l.lang = coalesce(d.lang, 'none')""", uses_graph=False)
def label_resolution(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = docs.where("lang <> 'es'").select(F.col("source").alias("doc_id"), F.col("lang").alias("label"), F.col("doc_id").alias("node_id"), F.col("doc_id").alias("ord"))
    references = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("node"), F.coalesce("lang", F.lit("none")).alias("label"))
    return syntax.resolve_labels(references, labels).select("doc_id", "node", "label", F.coalesce("target", F.lit(-1).cast("long")).alias("target"))


# --- people and entities ----------------------------------------------------------------------------------------------


@query("""SELECT doc_id, ord, value, author FROM (SELECT user_id AS doc_id, event_id AS ord, props AS value, kind,
last_value(CASE WHEN kind = 'author' THEN event_id::VARCHAR END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS author
FROM (SELECT *, CASE WHEN value > 50 THEN 'author' ELSE 'affiliation' END AS kind FROM events)) WHERE kind = 'affiliation'""", uses_graph=False)
def author_affiliation_asof(spark, sf_dir):
    kind = F.when(F.col("value") > 50, "author").otherwise("affiliation")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("ord"), kind.alias("kind"), F.when(kind == "author", F.col("event_id").cast("string")).otherwise(F.col("props")).alias("value"))
    return people.by_position(events).select("doc_id", "ord", "value", "author")


@query("""SELECT c_custkey::VARCHAR AS doc_id, unnest([0, 1, 2, 3])::INT AS place, unnest([c_name, c_mktsegment, c_custkey::VARCHAR, 'Last One']) AS name FROM customer""", uses_graph=False)
def author_split(spark, sf_dir):
    content = F.concat("c_name", F.lit(" \\and "), "c_mktsegment", F.lit(", "), F.col("c_custkey").cast("string"), F.lit(";  Last {One}"))
    lists = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), F.lit(0).alias("ord"), content.alias("content"))
    return people.listed_authors(lists).select("doc_id", "place", "name")


@query("""SELECT s_suppkey::VARCHAR AS doc_id, s_name AS name, 's' || s_nationkey AS label, n_name AS details FROM supplier JOIN nation ON s_nationkey = n_nationkey""", uses_graph=False)
def author_affiliation_by_label(spark, sf_dir):
    key = F.concat(F.lit("s"), F.col("s_nationkey").cast("string"))
    content = F.concat("s_name", F.lit(" {aff: "), key, F.lit("}"))
    lists = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"), F.lit(0).alias("ord"), content.alias("content"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("label"), F.col("n_name").alias("details"))
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"), key.alias("label")).join(nations, "label")
    return people.by_label(people.listed_authors(lists), known).select("doc_id", "name", "label", "details")


_TURN_WORDS = f"SELECT conv_id || '-' || turn AS doc_id, unnest(w) AS value, generate_subscripts(w, 1) AS ord FROM (SELECT conv_id, turn, {SPLIT.format('text')} AS w FROM conversations)"


@query(f"""SELECT doc_id, (ord - 1)::INT AS ord, 'WORD=' || value || '|' || CASE WHEN regexp_matches(value, '^[A-Z]') THEN 'CAP' ELSE 'NOT_CAP' END || '|PREV_WORD=' || coalesce(lag(value) OVER w, 'BOS') || '|NEXT_WORD=' || coalesce(lead(value) OVER w, 'EOS') AS features
FROM ({_TURN_WORDS}) WINDOW w AS (PARTITION BY doc_id ORDER BY ord)""", uses_graph=False)
def ner_features(spark, sf_dir):
    return entities.features(_turn_tokens(spark, sf_dir)).select("doc_id", "ord", F.array_join("features", "|").alias("features"))


def _turn_tokens(spark, sf_dir):
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return table(spark, sf_dir, "conversations").select(key.alias("doc_id"), F.posexplode(text.words(F.col("text"))).alias("ord", "value"))


#: Labels that a rule gives the words of the turns: capitalised ones, the one after a capitalised one, others.
_LABELLED = f"""SELECT doc_id, (ord - 1)::INT AS ord, CASE WHEN cap THEN 'AUTHOR' WHEN coalesce(lag(cap) OVER w, false) THEN 'AFFILIATION' ELSE 'O' END AS label
FROM (SELECT *, regexp_matches(value, '^[A-Z]') AS cap FROM ({_TURN_WORDS})) WINDOW w AS (PARTITION BY doc_id ORDER BY ord)"""


def _labelled_turns(spark, sf_dir):
    words = entities.features(_turn_tokens(spark, sf_dir))
    cap = F.array_contains("features", "CAP")
    was = F.lag("cap", 1, False).over(Window.partitionBy("doc_id").orderBy("ord"))
    label = F.when(F.col("cap"), "AUTHOR").when(F.col("was"), "AFFILIATION").otherwise("O")
    return words.withColumn("cap", cap).withColumn("was", was).withColumn("label", label).drop("cap", "was")


@query(f"SELECT label, next_label, count(*)::BIGINT AS n FROM (SELECT label, lead(label) OVER (PARTITION BY doc_id, ord // 200 ORDER BY ord) AS next_label FROM ({_LABELLED})) WHERE next_label IS NOT NULL GROUP BY label, next_label", uses_graph=False)
def chain_label_pairs(spark, sf_dir):
    """What the chain model is to expect of its labels: how often one follows another in the sequences that it learns."""
    table_ = chain_training.sequences(_labelled_turns(spark, sf_dir))
    name = lambda c: F.get(F.array(*map(F.lit, entities.LABELS)), c)
    pairs = table_.select(F.posexplode("gold").alias("at", "a"), "gold").where(F.col("at") + 1 < F.size("gold"))
    return pairs.select(name(F.col("a")).alias("label"), name(F.get("gold", F.col("at") + 1)).alias("next_label")).groupBy("label", "next_label").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT *, true AS learnt FROM (SELECT CASE WHEN doc_id LIKE '%3' THEN 1 ELSE 0 END AS held_out, label, count(*)::BIGINT AS n FROM ({_LABELLED}) GROUP BY ALL)", uses_graph=False)
def chain_trained(spark, sf_dir):
    """A chain model fitted on the turns whose name doesn't end with 3: of each label and fold, how often it occurs and
    whether 98 in 100 of these words get it."""
    rows = _labelled_turns(spark, sf_dir)
    held = F.col("doc_id").endswith("3")
    model = chain_training.ChainTrainer(rows.where(~held)).fit()
    got = model.labelled(rows).withColumnRenamed("label", "found").join(rows.select("doc_id", "ord", "label"), ["doc_id", "ord"])
    right = (F.col("found") == F.col("label")).cast("int")
    return got.groupBy(held.cast("int").alias("held_out"), "label").agg(F.count(F.lit(1)).alias("n"), (F.avg(right) >= 0.98).alias("learnt"))


_LABEL = "CASE WHEN value > 66 THEN 'AUTHOR' WHEN value > 33 THEN 'AFFILIATION' ELSE 'O' END"


@query(f"""SELECT doc_id, min(ord)::BIGINT AS ord, CASE label WHEN 'AUTHOR' THEN 'authors' ELSE 'affiliations' END AS kind, string_agg(value, '' ORDER BY ord) AS value
FROM (SELECT *, sum(change) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN label <> lag(label) OVER (PARTITION BY doc_id ORDER BY ord) THEN 1 ELSE 0 END AS change
FROM (SELECT user_id AS doc_id, event_id AS ord, event_type AS value, {_LABEL} AS label FROM events))) WHERE label <> 'O' GROUP BY doc_id, island, label""", uses_graph=False)
def ner_runs(spark, sf_dir):
    label = F.when(F.col("value") > 66, "AUTHOR").when(F.col("value") > 33, "AFFILIATION").otherwise("O")
    labels = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("value"), label.alias("label"))
    return entities.runs(labels)


@query()
def ner_entities(spark, sf_dir):
    docs = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc_id"), F.posexplode(text.words(F.col("text"))).alias("ord", "value"))
    model = entities.ChainModel().fit()
    return entities.runs(entities.labelled(entities.features(docs), model))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: key themes of the whole graph."""
    return key_themes(spark, sf_dir)
