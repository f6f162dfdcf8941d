"""Strongest paths, paths to a target and depth-first visits against plain Python."""

import random

import pytest

from lectern.operators import graph, paths

from test_graph import make


def simple_paths(edges, start, longest, target=None):
    out, todo = [], [[start]]
    while todo:
        p = todo.pop()
        if len(p) > 1 and (target is None or p[-1] == target):
            out.append(p)
        if len(p) <= longest and not (target is not None and len(p) > 1 and p[-1] == target):
            todo += [p + [b] for a, b in edges if a == p[-1] and b not in p]
    return out


@pytest.mark.parametrize(("seed", "width"), [(1, 1.0), (2, 0.1), (3, 50.0)])
def test_strongest_paths(spark, seed, width):
    r = random.Random(seed)
    rows = [(f"n{r.randrange(9)}", f"n{r.randrange(9)}", r.choice([None, 0.0, 0.25, 0.5, 0.9, 1.0, 2.0])) for _ in range(26)] + [("n1", "n1", 1.0), ("n0", "n8", 0.125)]
    sure = {}
    for a, b, c in rows:
        c = min(0.5 if c is None else c, 1.0)
        if c > 0:
            sure[a, b] = max(sure.get((a, b), 0), c)
    table = spark.createDataFrame(rows, "src string, dst string, confidence double")
    got = paths.strongest_paths(table, spark.createDataFrame([("n0",), ("n1",), ("n0",), ("nowhere",)], "node_id string"), width=width).collect()
    want = {}
    for start in ("n0", "n1"):
        for p in simple_paths(list(sure), start, 9):
            strength = 1.0
            for e in zip(p, p[1:]):
                strength *= sure[e]
            key = (-strength, len(p) - 1, p[-2])
            want[start, p[-1]] = min(want.get((start, p[-1]), key), key)
    assert {(x["start"], x["node_id"]): (-x["strength"], x["hops"], x["via"]) for x in got} == want and len(got) == len(want)


@pytest.mark.parametrize("seed", [4, 5])
def test_paths_between(spark, seed):
    r = random.Random(seed)
    edges = list({(f"n{r.randrange(9)}", f"n{r.randrange(9)}") for _ in range(30)})
    pairs = [("n0", "n5"), ("n0", "n6"), ("n3", "n0"), ("n2", "n2"), ("n1", "absent"), ("n0", "n5")]
    table = spark.createDataFrame(edges + edges[:3], "src string, dst string")
    got = paths.paths_between(table, spark.createDataFrame(pairs, "start string, target string"), 4).collect()
    want = {(a, b, tuple(p)) for a, b in set(pairs) if a != b for p in simple_paths(edges, a, 4, b)}
    assert {(x["start"], x["target"], tuple(x["path"])) for x in got} == want and len(got) == len(want) > 0
    g = make(spark, [(f"n{k}", "Text", "") for k in range(9)], [(*e, "Citation") for e in edges])
    assert {tuple(x["path"]) for x in paths.paths_to(g, "n0", "n5", 3).collect()} == {tuple(p) for p in simple_paths(edges, "n0", 3, "n5")}


def test_paths_that_lead_nowhere_are_not_grown(spark, monkeypatch):
    """A start with many branches of which one gets to the target: only that one is held."""
    edges = [("s", f"x{k}") for k in range(50)] + [(f"x{k}", f"y{k}") for k in range(50)] + [("y7", "t")]
    sizes, written = [], paths.written
    monkeypatch.setattr(paths, "written", lambda df, name: (lambda out: sizes.append((name, out.count())) or out)(written(df, name)))
    got = paths.paths_between(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("s", "t")], "start string, target string"), 5).collect()
    assert [x["path"] for x in got] == [["s", "x7", "y7", "t"]]
    assert max(n for name, n in sizes if name == "paths") == 1


def joined_rows(spark, run):
    """run's result, and how many rows the largest join of its queries made."""
    store = spark._jsparkSession.sharedState().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    before = store.executionsCount()
    out, most = run(), 0
    bus.waitUntilEmpty(30_000)
    executions = store.executionsList()
    for k in range(before, executions.size()):
        at = executions.apply(k).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in node.name():
                for metric in (node.metrics().apply(i) for i in range(node.metrics().size())):
                    if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return out, most


def test_paths_through_a_hub_take_only_the_edges_to_their_target(spark):
    """Many targets behind one node: the joins make a few rows a target, not targets times targets."""
    edges = [("s", "hub"), ("z", "hub"), ("z", "s")] + [("hub", f"t{k}") for k in range(300)]
    pairs = [("s", f"t{k}") for k in range(300)] + [("z", "t7")]
    table, wanted = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(pairs, "start string, target string")
    got, most = joined_rows(spark, lambda: paths.paths_between(table, wanted, 3).collect())
    assert {(x["start"], x["target"], *x["path"]) for x in got} == {("s", t, "s", "hub", t) for _, t in pairs} | {("z", "t7", "z", "hub", "t7"), ("z", "t7", "z", "s", "hub", "t7")}
    assert 0 < most < 3000


@pytest.mark.parametrize(("seed", "longest"), [(9, 1), (10, 2), (11, 3), (12, 5)])
def test_paths_between_of_other_lengths(spark, seed, longest):
    r = random.Random(seed)
    edges = list({(f"n{r.randrange(7)}", f"n{r.randrange(7)}") for _ in range(22)})
    pairs = [(f"n{a}", f"n{b}") for a in range(7) for b in range(7) if a != b and r.random() < 0.4]
    got = paths.paths_between(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(pairs, "start string, target string"), longest).collect()
    want = {(a, b, tuple(p)) for a, b in pairs for p in simple_paths(edges, a, longest, b)}
    assert {(x["start"], x["target"], tuple(x["path"])) for x in got} == want and len(got) == len(want) > 0


def walk(edges, starts):
    met = {}

    def visit(node, depth, parent):
        if node not in met:
            met[node] = (depth, parent)
            for _, to in sorted((k, b) for a, b, k in edges if a == node):
                visit(to, depth + 1, node)

    for s in sorted(starts):
        visit(s, 0, None)
    return met


@pytest.mark.parametrize("seed", [6, 7, 8])
def test_first_visits(spark, seed):
    r = random.Random(seed)
    edges = [(f"{c}{r.randrange(8)}", f"{c}{r.randrange(8)}", r.randrange(12)) for c in "ab" for _ in range(14)]
    starts = ["a0", "b3", "a5", "alone", "a0"]
    got = paths.first_visits(spark.createDataFrame(edges, "src string, dst string, ord long"), spark.createDataFrame([(s,) for s in starts], "node_id string")).collect()
    want = walk(edges, set(starts))
    assert {x["node_id"]: (x["depth"], x["parent"]) for x in got} == want and len(got) == len(want)
    for c in "ab":
        assert [x["node_id"] for x in sorted(got, key=lambda x: x["place"]) if x["node_id"].startswith(c) and x["node_id"] != "alone"] == [n for n in want if n.startswith(c) and n != "alone"]


def test_first_visit_phases_differ_from_least_ones(spark):
    g = make(spark, [(n, "Section", "method " + n) for n in "abcd"], [("a", "b", "MethodologyFlow"), ("b", "c", "MethodologyFlow"), ("a", "c", "MethodologyFlow"), ("c", "d", "MethodologyFlow")])
    assert {x["node_id"]: x["phase"] for x in paths.first_visit_phases(g).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {x["node_id"]: x["phase"] for x in graph.methodology_phases(g).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
