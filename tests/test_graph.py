"""Graph analyses against plain Python on small random graphs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.operators import analytics, export, graph


def make(spark, nodes, edges):
    rows = [(s, t, k, "", i) for i, (s, t, k) in enumerate(edges)]
    return graph.Graph(spark.createDataFrame(nodes, "node_id string, node_type string, content string"), spark.createDataFrame(rows, "src string, dst string, edge_type string, label string, ord long"))


def random_graph(spark, seed, n=14, m=22):
    r = random.Random(seed)
    nodes = [(f"n{k}", r.choice(["Section", "Text", "Abstract", "Author"]), r.choice(["method alpha", "beta gamma alpha", "approach", ""])) for k in range(n)]
    edges = [(f"n{r.randrange(n)}", f"n{r.randrange(n)}", r.choice(["Hierarchical", "ResultSupports", "EvidenceSupport", "MainContribution", "MethodologyFlow"])) for _ in range(m)]
    return make(spark, nodes, edges), nodes, edges


def closure(starts, edges):
    found, todo = set(starts), list(starts)
    while todo:
        x = todo.pop()
        for s, t, *_ in edges:
            if s == x and t not in found:
                found.add(t)
                todo.append(t)
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_strongly_connected(spark, seed):
    g, nodes, edges = random_graph(spark, seed)
    ids = [n[0] for n in nodes]
    reach = {i: closure([i], edges) for i in ids}
    want = {i: min(j for j in ids if j in reach[i] and i in reach[j]) for i in ids}
    assert {r["node_id"]: r["component"] for r in analytics.strongly_connected(g).collect()} == want


@pytest.mark.parametrize("seed", [4, 5])
def test_pagerank_and_places(spark, seed):
    g, nodes, edges = random_graph(spark, seed)
    score = {n[0]: 1 / len(nodes) for n in nodes}
    for _ in range(100):
        new = {i: 0.15 / len(nodes) for i in score}
        for s, t, _ in edges:
            new[t] += 0.85 * score[s] / sum(x[0] == s for x in edges)
        change = sum(abs(new[i] - score[i]) for i in score)
        score = new
        if change < 1e-9:
            break
    got = {r["node_id"]: r["score"] for r in analytics.pagerank(g).collect()}
    assert all(abs(got[i] - score[i]) < 1e-5 for i in score)
    assert sum(got.values()) <= 1 + 1e-9
    places = [r["node_id"] for r in analytics.ranked(g).orderBy("place").collect()]
    assert [round(got[i], 6) for i in places] == sorted((round(x, 6) for x in got.values()), reverse=True)


@pytest.mark.parametrize("iterations", [1, 2, 3, 10])
def test_pagerank_rounds_go_over_the_core(spark, monkeypatch, iterations):
    """Nodes without edges in or out take no part in the rounds, and have the scores of a plain power iteration."""
    r = random.Random(iterations)
    names = [f"n{k:02}" for k in range(40)]
    pairs = [(r.choice(names[:30]), r.choice(names[10:])) for _ in range(60)] + [("n00", "n10"), ("n00", "n10"), ("n12", "n12"), ("n12", "lost"), ("lost", "n13"), ("n11", "n12"), ("n12", "n11")]
    pairs = [(a, b) for a, b in pairs if b != "n00"]
    g = make(spark, [(x, "Text", "") for x in names], [(a, b, "Citation") for a, b in pairs])
    rounds = []
    real = analytics.written
    monkeypatch.setattr(analytics, "written", lambda df, name: (rounds.append((name, out := real(df, name))), out)[1])
    got = {x["node_id"]: x["score"] for x in analytics.pagerank(g, iterations=iterations, tolerance=None).collect()}
    out = {x: sum(a == x for a, _ in pairs) for x in names}
    want = {x: 1 / 40 for x in names}
    for _ in range(iterations):
        want = {x: 0.15 / 40 + 0.85 * sum(want[a] / out[a] for a, b in pairs if b == x and a in want) for x in names}
    assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-12 for x in names)
    core = {a for a, _ in pairs} & {b for _, b in pairs} & set(names)
    for name, table in rounds:
        if name == "scores":
            assert {x["node_id"] for x in table.collect()} == core
    spread = {x["node_id"]: x["score"] for x in analytics.pagerank(g, iterations=iterations, tolerance=1e-12, each=2).collect()}
    assert iterations < 10 or all(abs(spread[x] - want[x]) < 1e-9 for x in names)


def test_pagerank_without_a_core(spark):
    g = make(spark, [(x, "Text", "") for x in "abc"], [("a", "b", "Citation"), ("a", "c", "Citation")])
    got = {x["node_id"]: x["score"] for x in analytics.pagerank(g).collect()}
    assert abs(got["a"] - 0.05) < 1e-12 and abs(got["b"] - 0.05 * 1.425) < 1e-12 and abs(got["c"] - got["b"]) < 1e-12


def test_pagerank_of_one_edge(spark):
    g = make(spark, [("a", "Text", "x"), ("b", "Text", "y")], [("a", "b", "Hierarchical")])
    got = {r["node_id"]: round(r["score"], 6) for r in analytics.pagerank(g).collect()}
    assert got == {"a": 0.075, "b": 0.13875}


def test_themes(spark):
    g = make(spark, [("s", "Section", "Method alpha"), ("t", "Text", "alpha beta")], [])
    got = {r["word"]: round(r["score"], 6) for r in analytics.key_themes(g).collect()}
    assert got == {"alpha": 1.693147, "method": 1.128765, "beta": 0.564382}


def test_topics(spark):
    g = make(spark, [("t", "Text", "alpha beta alpha abc")], [])
    assert {r["word"]: round(r["share"], 6) for r in analytics.topic_distribution(g.nodes).collect()} == {"alpha": 0.666667, "beta": 0.333333}


def test_citations(spark):
    g = make(spark, [("1", "Citation", "Doe 2001"), ("2", "Citation", "Doe 2001"), ("3", "Citation", "Roe 1999, 2003"), ("4", "Citation", "No 18999"), ("5", "Text", "cites")], [("5", "1", "Citation"), ("5", "3", "Citation")])
    assert [(r["citation"], r["n"]) for r in analytics.top_citations(g, 2).collect()] == [("Doe 2001", 2), ("No 18999", 1)]
    assert {(r["year"], r["citation"]) for r in analytics.citations_by_year(g).collect()} == {(2001, "Doe 2001"), (1999, "Roe 1999, 2003")}
    assert {(r["citation"], r["context"]) for r in analytics.citation_contexts(g).collect()} == {("Doe 2001", "cites"), ("Roe 1999, 2003", "cites")}


def test_gaps(spark):
    g = make(spark, [("s", "Section", "S"), ("t", "Section", "T"), ("n", "Text", "N")], [("s", "t", "ComparisonLink"), ("t", "s", "ValidationMethod"), ("t", "s", "ComparisonLink"), ("n", "s", "DataDependency"), ("t", "n", "MainContribution"), ("s", "n", "FutureWork")])
    assert {r["gap"] for r in analytics.research_gaps(g).collect()} == {"Missing validation for section: S", "Explicit gap: N"}
    assert {r["gap"] for r in analytics.logical_gaps(g).collect()} == {"Missing connection between data and results in: N", "Missing evidence for main contribution in: T", "Unsupported claim in section: T"}


@pytest.mark.parametrize("seed", [6, 7])
def test_evidence_and_reachability(spark, seed):
    g, nodes, edges = random_graph(spark, seed)
    kinds = {k: [e for e in edges if e[2] == k] for k in fixed.EDGE_TYPES}
    chain = [e for e in edges if e[2] in fixed.EVIDENCE_EDGES]
    for r in analytics.evidence_chains(g).collect():
        inside = closure([r["claim"]], chain)
        assert r["evidence"] == any(e[0] in inside for e in kinds["EvidenceSupport"])
        assert r["results"] == any(e[0] in inside for e in kinds["ResultSupports"])
        assert r["linked"] == (inside <= closure([r["claim"]], kinds["EvidenceSupport"]))
    start = {n[0] for n in nodes} - {e[1] for e in edges}
    assert {r["node_id"] for r in graph.reachable(g).collect()} == closure(start, edges)
    assert {r["node_id"] for r in graph.unreached(g).collect()} == {n[0] for n in nodes} - closure(start, edges)
    cyclic = {(s, t) for s, t, k in edges if k == "Hierarchical" and s in closure([t], kinds["Hierarchical"])}
    assert {(r["src"], r["dst"]) for r in graph.cyclic_edges(g.edges).collect()} == cyclic


def test_edge_rules(spark):
    nodes = [("a", "Author", "x"), ("f", "Affiliation", "y"), ("s", "Section", "z"), ("u", "Section", "w"), ("t", "Text", "v")]
    edges = [("a", "f", "Hierarchical"), ("a", "f", "AuthorAffiliation"), ("a", "f", "AuthorAffiliation"), ("s", "u", "CrossReference"), ("s", "t", "Hierarchical"), ("t", "s", "Hierarchical"), ("t", "t", "Hierarchical"), ("t", "a", "Citation"), ("s", "gone", "Hierarchical")]
    g = make(spark, nodes, edges)
    assert {(r["src"], r["dst"], r["edge_type"]) for r in graph.accepted_edges(g).collect()} == {("a", "f", "AuthorAffiliation"), ("s", "u", "CrossReference"), ("s", "t", "Hierarchical")}
    assert {(r["src"], r["dst"], r["edge_type"]) for r in graph.accepted_edges(g, ordered=False).collect()} == {("a", "f", "AuthorAffiliation"), ("s", "u", "CrossReference")}
    assert [(r["dst"], r["missing"]) for r in graph.dangling(g).collect()] == [("gone", "dst")]
    assert {r["problem"]: r["n"] for r in graph.validated(g).collect()}["dangling_edge"] == 1


def test_upserts_and_relationships(spark):
    nodes = spark.createDataFrame([("a", "Text", "old")], "node_id string, node_type string, content string")
    new = spark.createDataFrame([("a", "Section", "new"), ("b", "Text", "b")], nodes.schema)
    assert {(r["node_id"], r["content"]) for r in graph.upserted(nodes, new).collect()} == {("a", "new"), ("b", "b")}
    assert {(r["node_id"], r["content"]) for r in graph.upserted(nodes, new, first_wins=True).collect()} == {("a", "old"), ("b", "b")}
    log = spark.createDataFrame([("a", "b", "Citation", "Added", 1), ("a", "b", "Citation", "Removed", 2), ("a", "c", "Citation", "Removed", 1), ("a", "c", "Citation", "Added", 3)], "src string, dst string, edge_type string, change string, at long")
    assert [(r["dst"], r["at"]) for r in graph.latest_relationships(log).collect()] == [("c", 3)]


@pytest.mark.parametrize("seed", [8, 9])
def test_similar_nodes(spark, seed):
    r = random.Random(seed)
    rows = [(f"n{k:02}", "Text", " ".join(r.choice("abcdefgh") * 2 for _ in range(r.randint(0, 6)))) for k in range(40)]
    nodes = spark.createDataFrame(rows, "node_id string, node_type string, content string")
    reps = {x["node_id"]: x["rep"] for x in analytics.equal_nodes(nodes).collect()}
    got = {(x["a"], x["b"]): x["similarity"] for x in analytics.similar_nodes(nodes, 0.6).collect()}
    sets = {i: set(c.split()) for i, _, c in rows}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                value = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                pair = tuple(sorted((reps[a], reps[b])))
                if sets[a] == sets[b]:
                    assert reps[a] == reps[b]
                else:
                    assert (value >= 0.6) == (pair in got), (a, b, value)


def test_converged_ranking_and_bridges(spark, monkeypatch):
    """On a cycle with a tail, where ten rounds are far from the end."""
    from lectern.plans import catalog

    nodes = [(f"n{k}", "Section" if k % 2 else "Text", "") for k in range(6)]
    edges = [("n0", "n1"), ("n1", "n2"), ("n2", "n0"), ("n3", "n0"), ("n4", "n3"), ("n5", "n4"), ("n2", "n5")]
    g = make(spark, nodes, [(a, b, "Citation") for a, b in edges])
    monkeypatch.setattr(catalog.fixture, "graph", lambda *_: g)
    out = {i: sum(a == i for a, _ in edges) for i, _, _ in nodes}
    rounds = [{i: 1 / 6 for i in out}]
    for _ in range(300):
        rounds.append({i: 0.15 / 6 + 0.85 * sum(rounds[-1][a] / out[a] for a, b in edges if b == i) for i in out})
    assert max(abs(rounds[10][i] - rounds[-1][i]) for i in out) > 1e-4
    got = {r["node_id"]: r for r in catalog.QUERIES["nodes_by_importance_converged"](spark, "").collect()}
    assert all(abs(got[i]["score"] - rounds[-1][i]) < 1e-5 for i in out)
    assert sorted(got, key=lambda i: got[i]["place"]) == sorted(out, key=lambda i: (-rounds[-1][i], i))
    bridges = {r["node_id"]: r["bridge"] for r in catalog.QUERIES["bridging_concepts_converged"](spark, "").collect()}
    kinds = {i: t for i, t, _ in nodes}
    for i in out:
        around = [b if a == i else a for a, b in edges if i in (a, b)]
        assert abs(bridges[i] - rounds[-1][i] * len({kinds[x] for x in around}) * len(around) / 6) < 1e-4


def test_exports(spark):
    nodes = [("a", "Section", "one"), ("b", "Figure", "two"), ("c", "Section", "three")]
    g = make(spark, nodes, [("a", "b", "Definition"), ("a", "c", "CrossReference"), ("c", "a", "MethodologyFlow")])
    semantics = spark.createDataFrame([("a", "idea", 0.5), ("b", "idea", 0.99)], "node_id string, concept_type string, importance double")
    lines = lambda df: [r["line"] for r in df.orderBy("part", "at").collect()]
    dot = lines(export.dot_lines(g))
    assert dot[0] == "digraph ResearchPaper {" and dot[-1] == "}"
    assert dot.index("  subgraph cluster_Sections {") < dot.index('    "a" [label="one"];') < dot.index('    "c" [label="three"];')
    assert "  subgraph cluster_Unknown_7 {" in dot
    assert '  "a" -> "c" [style=dotted,color=red,weight=1];' in dot
    seen = lines(export.semantic_map_lines(g, semantics))
    assert '    "a" [label="one", fillcolor="#7f7fff"];' in seen and '    "b" [label="two", fillcolor="#22ff"];' in seen
    assert '  "a" -> "b" [color="green", style="dashed"];' in seen
    flow = lines(export.methodology_flow_lines(g))
    assert '    label="Phase 2";' in flow and '  "c" -> "a" [color="blue"];' in flow
    edges = {(r["source"], r["target"], r["type"]) for r in export.knowledge_edges(g).collect()}
    assert edges == {(0, 1, 15), (0, 2, 2), (2, 0, 10)}
    head = json.loads(export.knowledge_json(g).orderBy("part", "at").first()["json"])
    assert head == {"type": "ResearchPaperKnowledgeGraph", "nodes": 3}


def test_paths_and_relations(spark):
    g = make(spark, [(x, "Text", x) for x in "abcd"], [("a", "b", "CounterArgument"), ("b", "c", "Citation"), ("c", "a", "Citation"), ("b", "d", "CounterArgument"), ("b", "a", "CounterArgument")])
    paths = {tuple(r["path"]) for r in analytics.all_paths(g, g.nodes.where("node_id = 'a'"), 3).collect()}
    assert paths == {("a", "b"), ("a", "b", "c"), ("a", "b", "d")}
    assert {(r["a"], r["b"]) for r in analytics.contradictions(g).collect()} == {("a", "b"), ("b", "d")}
    sure = g.edges.withColumn("confidence", F.lit(0.6))
    assert {(r["a"], r["b"]): round(r["strength"], 1) for r in analytics.relationship_strength(sure).collect()}[("a", "b")] == 1.2
    assert analytics.related_concepts(sure, "b").count() == 4


def test_fixed_values():
    assert len(fixed.EDGE_TYPES) == 49 and fixed.EDGE_TYPES[48] == "QualityMetric" and fixed.EDGE_TYPES.index("EvidenceSupport") == 38
    assert len(fixed.NODE_TYPES) == 15 and len(fixed.AST_TYPES) == 14


def test_only_the_closing_edge_is_refused(spark):
    """Of a 3-cycle two edges stay; what a refused edge would have closed stays as well."""
    nodes = spark.createDataFrame([(n, "Section", n) for n in "abcdef"], "node_id string, node_type string, content string")
    pairs = ["ab", "bc", "ca", "cd", "dc", "ad", "ee", "ef"]
    edges = spark.createDataFrame([(p[0], p[1], "Hierarchical", "", k) for k, p in enumerate(pairs)], "src string, dst string, edge_type string, label string, ord long")
    g = graph.Graph(nodes, edges)
    kept = {r["src"] + r["dst"] for r in graph.accepted_edges(g, rules=False).collect()}
    assert kept == {"ab", "bc", "cd", "ad", "ef"}
    assert {r["src"] + r["dst"] for r in graph.accepted_edges(g, rules=False, ordered=False).collect()} == {"ef"}


def test_long_paths_have_no_round_limit(spark):
    n = 131
    nodes = spark.createDataFrame([(f"n{k:03}", "Section", "x") for k in range(n)], "node_id string, node_type string, content string")
    edges = spark.createDataFrame([(f"n{k:03}", f"n{k + 1:03}", "Hierarchical", "", k) for k in range(n - 1)], "src string, dst string, edge_type string, label string, ord long")
    got = {r["node_id"]: r["depth"] for r in graph.reachable(graph.Graph(nodes, edges)).collect()}
    assert got == {f"n{k:03}": k for k in range(n)}


def test_metadata_of_parallel_edges(spark):
    """A row an edge: metadata given once goes to all parallel edges, given several times one to each."""
    edges = spark.createDataFrame([("a", "b", "x", 1), ("a", "b", "x", 1), ("a", "b", "x", 2), ("c", "d", "x", 5), ("c", "d", "x", 6), (None, "d", "x", 7), ("a", "b", "y", 8)], "src string, dst string, edge_type string, ord long")
    known = spark.createDataFrame([("a", "b", "x", 0.1), ("a", "b", "x", 0.2), ("c", "d", "x", 0.3), (None, "d", "x", 0.4), ("e", "f", "x", 0.5)], "src string, dst string, edge_type string, confidence double")
    out = graph.relationship_metadata(edges, known)
    assert out.columns == ["src", "dst", "edge_type", "ord", "confidence"]
    got = sorted((r["ord"], r["confidence"]) for r in out.where("edge_type = 'x'").collect())
    assert got == [(1, 0.1), (1, 0.2), (2, 0.1), (5, 0.3), (6, 0.3), (7, 0.4)]
    assert [r["confidence"] for r in out.where("edge_type = 'y'").collect()] == [None]
