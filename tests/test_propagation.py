"""Maxima over what nodes reach, and the evidence chains that rest on them."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.operators import analytics
from lectern.operators.propagation import reach_max

from test_graph import closure, make


def edges_of(kind, seed):
    r = random.Random(seed)
    if kind == "random":
        return [(r.randrange(16), r.randrange(16)) for _ in range(r.randint(4, 30))]
    if kind == "tree":
        return [(k, r.randrange(k)) for k in range(1, 16)] + [(0, 0)]
    if kind == "cycle":
        return [(k, (k + 1) % 7) for k in range(7)] + [(9, 10), (10, 9), (11, 3), (12, 11), (12, 9), (8, 12)]
    return [(k, k + 1) for k in range(15)] + [(3, 9), (9, 3), (3, 3), (4, 5)]


@pytest.mark.parametrize(("kind", "seed"), [("random", 1), ("random", 2), ("random", 3), ("tree", 4), ("cycle", 5), ("chain", 6)])
def test_reach_max(spark, kind, seed):
    edges, r = edges_of(kind, seed), random.Random(seed)
    values = [(f"n{k}", r.choice([None, 0, 1]), r.randint(0, 99)) for k in range(14)] + [("n3", None, 100), ("alone", 1, None)]
    got = reach_max(spark.createDataFrame(values, "node_id string, flag int, size long"), spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in edges], "src string, dst string"), ["flag", "size"])
    own = {}
    for n, *x in values:
        own[n] = [max((v for v in pair if v is not None), default=None) for pair in zip(own.get(n, [None, None]), x)]
    want = {}
    for n in {*own, *(f"n{k}" for e in edges for k in e)}:
        inside = [own[m] for m in closure([n], [(f"n{a}", f"n{b}") for a, b in edges]) if m in own]
        want[n] = tuple(max((x[c] for x in inside if x[c] is not None), default=None) for c in (0, 1))
    rows = got.collect()
    assert {x["node_id"]: (x["flag"], x["size"]) for x in rows} == want and len(rows) == len(want)


def test_reach_max_of_nothing(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert reach_max(spark.createDataFrame([], "node_id string, flag int"), none, ["flag"]).collect() == []
    assert [tuple(r) for r in reach_max(spark.createDataFrame([("a", 1)], "node_id string, flag int"), none, ["flag"]).collect()] == [("a", 1)]


@pytest.mark.parametrize(("seed", "labels"), [(11, 4), (12, 4), (13, 1), (14, 1)])
def test_evidence_chains(spark, seed, labels):
    """labels: with few of them more claims are followed one by one."""
    r = random.Random(seed)
    kinds = ["EvidenceSupport"] * 4 + ["ResultSupports", "ValidationMethod", "MainContribution", "SubContribution"]
    edges = [(f"n{r.randrange(30)}", f"n{r.randrange(30)}", r.choice(kinds)) for _ in range(70)]
    edges += [(a, b, "ResultSupports") for a, b, k in edges if k == "EvidenceSupport"][:6]
    g = make(spark, [(f"n{k}", "Section", "x") for k in range(30)], edges)
    chain = [e for e in edges if e[2] in fixed.EVIDENCE_EDGES]
    direct = [e for e in edges if e[2] == "EvidenceSupport"]
    want = {}
    for claim in {e[0] for e in edges if e[2] in fixed.CLAIM_EDGES}:
        inside = closure([claim], chain)
        has = [any(e[0] in inside and e[2] == k for e in chain) for k in fixed.EVIDENCE_EDGES]
        want[claim] = (*has, inside <= closure([claim], direct))
    got = {x["claim"]: (x["evidence"], x["results"], x["validation"], x["linked"]) for x in analytics.evidence_chains(g, labels).collect()}
    assert got == want


def test_many_claims_on_a_long_shared_chain(spark, monkeypatch):
    """1,000 claims, each at a step of one chain: rows stay a row a node, and rounds the logarithm of the length."""
    from lectern.operators import propagation

    written, tables = propagation.written, []
    monkeypatch.setattr(propagation, "written", lambda df, name: tables.append(name) or written(df, name))
    n = 1000
    edges = [(f"n{k}", f"n{k + 1}", "EvidenceSupport" if k != 600 else "ResultSupports") for k in range(n)] + [(f"n{k}", "target", "MainContribution") for k in range(n)]
    g = make(spark, [(f"n{k}", "Section", "x") for k in range(n + 1)] + [("target", "Section", "x")], edges)
    got = analytics.evidence_chains(g)
    assert got.count() == n
    assert got.where("linked").count() == 399 and got.where("results").count() == 601 and got.where("evidence").count() == n
    assert len(tables) < 50
    assert got.where(F.substring("claim", 2, 9).cast("int") > 600).where("NOT linked").count() == 0
