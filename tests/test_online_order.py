"""Edges that close a cycle, refused one by one, against a search for each edge."""

import random
import time

import numpy as np
import pytest

from lectern.operators import graph
from lectern.operators.online_order import OnlineOrder, refused


def brute(edges):
    ahead, out = {}, []
    for src, dst in edges:
        seen, todo = {dst}, [dst]
        while todo and src not in seen:
            for to in ahead.get(todo.pop(), ()):
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        out.append(src in seen)
        if not out[-1]:
            ahead.setdefault(src, []).append(dst)
    return out


def test_refused_edges_of_small_graphs():
    r = random.Random(1)
    for _ in range(1500):
        n = r.randint(1, 14)
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(r.randint(1, 50))]
        a, b = np.array(edges).T
        assert refused(a, b).tolist() == brute(edges)


def test_the_order_holds_after_every_edge_and_when_labels_run_out():
    r = random.Random(2)
    for gap in (1 << 40, 2):
        order = OnlineOrder(30)
        order.label = [(k + 1) * gap for k in range(30)] + [0, 31 * gap]
        taken = []
        for _ in range(200):
            edge = (r.randrange(30), r.randrange(30))
            if order.add(*edge):
                taken.append(edge)
            assert all(order.label[a] < order.label[b] for a, b in taken)
        node, row = order.after[30], []
        while node != 31:
            row.append(node)
            node = order.after[node]
        assert sorted(row) == list(range(30)) and [order.label[k] for k in row] == sorted(order.label[:30])


@pytest.mark.parametrize("shape", ["ring", "random"])
def test_a_large_component_takes_time_like_its_edges(shape):
    """A hundred thousand edges between nodes of one component; four times a quarter of them takes no less."""
    rng = np.random.default_rng(3)

    def seconds(m):
        n = m // 4
        if shape == "ring":
            src = np.concatenate((np.arange(n), rng.integers(0, n, m - n)))
            dst = np.concatenate(((np.arange(n) + 1) % n, np.minimum(src[n:] + rng.integers(1, 50, m - n), n - 1)))
            mixed = rng.permutation(m)
            src, dst = src[mixed], dst[mixed]
        else:
            src, dst = rng.integers(0, n, (2, m))
        began = time.process_time()
        refused(src, dst)
        return time.process_time() - began

    small, large = seconds(25_000), seconds(100_000)
    assert large < 60 and large < 16 * small + 5  # a search for each edge would take minutes


def test_accepted_edges_of_large_components(spark):
    """Two components of some hundred nodes and edges between them, in one table."""
    r = random.Random(4)
    pairs = [(f"{c}{r.randrange(150):03}", f"{c}{r.randrange(150):03}") for _ in range(900) for c in "ab"] + [("a001", "b001"), ("a002", "b002")]
    pairs = list(dict.fromkeys(pairs))
    edges = spark.createDataFrame([(s, t, "Hierarchical", "", k) for k, (s, t) in enumerate(pairs)], "src string, dst string, edge_type string, label string, ord long")
    nodes = spark.createDataFrame([(n, "Section", n) for n in {x for p in pairs for x in p}], "node_id string, node_type string, content string")
    kept = {(x["src"], x["dst"]) for x in graph.accepted_edges(graph.Graph(nodes, edges), rules=False).collect()}
    assert kept == {p for p, gone in zip(pairs, brute(pairs), strict=True) if not gone}
    assert 0 < len(kept) < len(pairs)


def test_small_components_share_a_batch(spark):
    """Components that end within a batch, at its end and beyond it; no task is given a component at a time."""
    r = random.Random(5)
    pairs = [(f"{c}{r.randrange(5)}", f"{c}{r.randrange(5)}") for c in range(10, 60) for _ in range(r.randrange(1, 25))]
    pairs = list(dict.fromkeys(pairs))
    edges = spark.createDataFrame([(s, t, "Hierarchical", "", k) for k, (s, t) in enumerate(pairs)], "src string, dst string, edge_type string, label string, ord long")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            closing = graph.closing_edges(edges)
            assert {(x["src"], x["dst"]) for x in closing.collect()} == {p for p, gone in zip(pairs, brute(pairs), strict=True) if gone}
            assert "FlatMapGroupsInPandas" not in closing._jdf.queryExecution().toString()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
