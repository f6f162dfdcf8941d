"""Nearest neighbours by tree against all inner products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import neighbours

SCHEMA = "vec_id long, embedding array<double>, label int, v int, leaf int, bin int, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 1, 1, 1, 1) for i, v in rows], SCHEMA).repartition(5)


def brute(rows, k, every):
    """The k best of each query by (id's best form); rows that don't take part left out."""
    sizes = {}
    good = [(i, tuple(v)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    for _, v in good:
        sizes[len(v)] = sizes.get(len(v), 0) + 1
    size = min(sizes, key=lambda s: (-sizes[s], s)) if sizes else 0
    forms = {}
    for i, v in good:
        if len(v) == size:
            forms.setdefault(i, set()).add(v)
    ids = np.array([i for i, x in forms.items() for _ in x])
    x = np.array([v for f in forms.values() for v in f])
    out = {}
    for q in forms:
        if q % every == 0:
            score = np.max([neighbours.exact(np.array(f), x) for f in forms[q]], axis=0)
            best = {}
            for i, s in zip(ids.tolist(), score.tolist(), strict=True):
                if i != q:
                    best[i] = max(best.get(i, -np.inf), s)
            out[q] = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        own = out.setdefault(r["query_id"], [])
        own.append((r["vec_id"], r["score"]))
        assert r["rank"] == len(own)
    return out


def vectors(n, dim=8, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return [(i, (centres[rng.integers(12)] + 0.5 * rng.normal(size=dim)).tolist()) for i in range(n)]


def awkward():
    rows = vectors(900)
    rows += [(2000 + i, rows[0][1]) for i in range(400)]  # one vector that a third of the rows have
    rows += [(3000, None), (3010, []), (3020, [0.0] * 8), (3030, [float("nan")] * 8), (3040, [1.0] * 7 + [None]), (3050, [float("inf")] + [1.0] * 7), (3060, [1.0] * 5), (None, [1.0] * 8)]
    rows += [rows[10], rows[10], (20, rows[11][1]), (40, rows[12][1])]  # repeated rows, and ids with two forms
    rows += [(-10, [1e6] * 8), (-20, [-1e6] * 8)]
    return rows


@pytest.mark.parametrize("bin_rows", [32_768, 64])
def test_all_leaves_give_the_exact_neighbours(spark, bin_rows):
    rows = awkward()
    index = neighbours.Index(frame(spark, rows), k=20, leaf_rows=32, bin_rows=bin_rows)
    assert index.tree.leaves > 10
    assert found(index.search(F.col("vec_id") % 10 == 0, visits=10**6)) == brute(rows, 20, 10)


def test_recall_of_the_calibrated_search(spark):
    rows = vectors(6000, dim=16, seed=4)
    index = neighbours.Index(frame(spark, rows), leaf_rows=64)
    got, want = found(index.search(F.col("vec_id") % 20 == 0)), brute(rows, 20, 20)
    assert index.calibrated(index.rows.where("vec_id % 20 = 0"), 0.95, 200) < index.tree.leaves / 2  # most leaves aren't visited
    hits = sum(len(dict(got[q]).keys() & dict(want[q]).keys()) for q in want)
    assert hits >= 0.93 * sum(map(len, want.values()))
    for q, own in got.items():
        assert all(s == dict(neighbours_of(rows, q))[i] for i, s in own[:3])


def neighbours_of(rows, q):
    x = np.array([v for _, v in rows])
    return zip([i for i, _ in rows], neighbours.exact(x[q], x).tolist(), strict=True)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0])]
    assert found(neighbours.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0)) == {0: [(1, 1.0), (2, 0.0)]}
    assert found(neighbours.nearest(frame(spark, [(0, [1.0])]), F.col("vec_id") % 20 == 0)) == {}
    assert neighbours.nearest(frame(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    assert neighbours.nearest(frame(spark, rows[1:]), F.col("vec_id") % 20 == 0).collect() == []


def test_a_traversal_visits_every_leaf_once(spark):
    x = np.array([v for _, v in vectors(2000)])
    tree = neighbours.fit(x, 50, 4)
    order = tree.order(x[0], 10**6)
    assert sorted(order) == list(range(tree.leaves)) and tree.order(x[0], 5) == order[:5]
    leaf = tree.assign(x)
    assert set(leaf.tolist()) == set(range(tree.leaves)) and np.bincount(leaf).max() <= 50
