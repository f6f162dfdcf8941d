"""The inverted file against all cosines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators.vector_index import InvertedFile, recall

SCHEMA = "id long, embedding array<float>, kind string, cell int, part int, query long, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, k, 1, 1, 1, 0.5) for i, v, k in rows], SCHEMA).repartition(4)


def vectors(n, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    return [(i, (centres[rng.integers(9)] + 0.3 * rng.normal(size=dim)).astype(np.float32).tolist(), ["a", "b", None][i % 3]) for i in range(n)]


def brute(rows, k, per_kind=False):
    good = [(i, np.array(v, np.float32).astype(float), g) for i, v, g in rows if i is not None and v and len(v) == 6 and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    x = np.array([v / np.linalg.norm(v) for _, v, _ in good])
    out = set()
    for q, (i, _, _) in enumerate(good):
        if i % 50 == 0:
            score = np.round(x @ x[q], 9)
            for g in {g for *_, g in good} if per_kind else {None}:
                own = sorted([(-s, j) for s, (j, _, kind) in zip(score.tolist(), good, strict=True) if not per_kind or kind == g])[:k]
                out |= {(i, g if per_kind else 0, j, place) for place, (_, j) in enumerate(own, 1)}
    return out


AWKWARD = [(5000, None, "a"), (5050, [], "a"), (5100, [0.0] * 6, "a"), (5150, [float("nan")] * 6, "b"), (5200, [1.0, None] * 3, "b"), (5250, [1.0] * 4, "b"), (None, [1.0] * 6, "a"), (5300, [1e30] * 6, None)]


@pytest.mark.parametrize(("part_rows", "query_rows", "probes"), [(20_000, 100_000, 1), (40, 3, 2)])
def test_exact_search(spark, part_rows, query_rows, probes):
    rows = vectors(700)
    rows += [(3000 + i, rows[50][1], "a") for i in range(300)] + AWKWARD  # one vector that a third of the rows have
    table = frame(spark, rows)
    index = InvertedFile.build(table, part_rows=part_rows)
    assert index.parts.max() > 1 or part_rows > 1000
    found = index.search(table.where("id % 50 = 0"), probes=probes, exact=True, query_rows=query_rows).collect()
    assert {(r["query"], 0, r["id"], r["place"]) for r in found} == brute(rows, 5) and len(found) == len(brute(rows, 5))
    index.drop()
    assert not spark.catalog.tableExists(index.name)


def test_exact_search_within_each_index(spark):
    rows = vectors(400, seed=3)
    table = frame(spark, rows)
    found = InvertedFile.build(table, index="kind", part_rows=50).search(table.where("id % 50 = 0"), k=4, probes=1, exact=True).collect()
    assert {(r["query"], r["kind"], r["id"], r["place"]) for r in found} == brute(rows, 4, per_kind=True)


def test_calibrated_probes_find_most_with_few_cells(spark):
    table = frame(spark, vectors(3000, seed=5))
    wanted = table.where("id % 50 = 0")
    index = InvertedFile.build(table)
    probes = index.probes_for(wanted)
    assert probes < len(index.centroids) / 2
    counts = recall(index.search(wanted, probes=probes), index.search(wanted, exact=True), "id").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).first()
    assert counts["hits"] >= 0.93 * counts["n"] == 0.93 * 60 * 5


def test_a_search_does_not_move_the_stored_vectors(spark):
    table = frame(spark, vectors(500))
    index = InvertedFile.build(table, buckets=4)
    plan = index.search(table.where("id % 50 = 0"), probes=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "inverted_file" in plan
    physical = index.search(table.where("id % 50 = 0"), probes=2)._jdf.queryExecution().executedPlan().toString()
    met = physical[physical.index("FlatMapCoGroupsInArrow") :]
    assert met.count("Exchange hashpartitioning") == 1, met  # the queries' only


def test_few_rows_and_none(spark):
    table = frame(spark, [(0, [1.0, 0.0], "a"), (1, [0.5, 0.0], "a"), (2, [0.0, 1.0], "b")])
    found = InvertedFile.build(table).search(table.where("id = 0"), k=2, exact=True).collect()
    assert [(r["id"], r["place"], r["score"]) for r in sorted(found, key=lambda r: r["place"])] == [(0, 1, 1.0), (1, 2, 1.0)]
    none = frame(spark, AWKWARD[:3])
    assert InvertedFile.build(none).search(table, exact=True).collect() == []
    assert InvertedFile.build(table).search(none, exact=True).collect() == []


def peak_mb(run):
    import tracemalloc

    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_task_holds_bounded_matrices(spark):
    """What queries meet in a part, or cells, is worked through in matrices of a fixed size; the results are those of all at once."""
    from unittest.mock import MagicMock

    import pandas as pd
    import pyarrow as pa

    rng, file = np.random.default_rng(5), MagicMock(key="id", index=None, size=4, kind="long")
    x, q = rng.normal(size=(12_000, 4)), rng.normal(size=(900, 4))
    sent, caught = MagicMock(), []
    sent.where.return_value.groupBy.return_value.agg.return_value.where.return_value.isEmpty.return_value = True
    file.table.groupBy.return_value.cogroup.return_value.applyInArrow.side_effect = lambda run, schema: caught.append(run)
    InvertedFile._met(file, sent, 5, 9)
    stored = pa.table({"id": pa.array(range(len(x))), "unit": pa.array(x.tolist(), pa.list_(pa.float64()))})
    asked = pa.table({"query": pa.array(range(len(q))), "vector": pa.array(q.tolist(), pa.list_(pa.float64()))})
    found, peak = peak_mb(lambda: caught[0](stored, asked))
    score = np.round(q @ x.T, 9)
    assert [(r["query"], r["id"]) for r in found.to_pylist()] == [(i, int(j)) for i in range(len(q)) for j in np.lexsort((np.arange(len(x)), -score[i]))[:5]]
    assert peak < 60
    many = MagicMock(centroids=rng.normal(size=(2000, 4)), radius=np.full(2000, 0.1), parts=np.ones(2000, np.int64))
    rows = MagicMock(dtypes=[("query", "long")])
    rows.mapInPandas.side_effect = lambda run, schema: caught.append(run)
    InvertedFile._sent(many, rows, 3, True)
    batch = pd.DataFrame({"query": range(3000), "vector": list(rng.normal(size=(3000, 4))), "least": 0.999})
    n, peak = peak_mb(lambda: sum(len(b) for b in caught[1](iter([batch]))))
    assert n > 0 and peak < 150


def test_blocks_of_queries_keep_few_candidates():
    """Of each matrix only what may be among a query's best is kept, ties too, before rows of a table are made of it."""
    from lectern.operators.retrieval import among_best

    score = np.array([[3.0, np.nan], [1.0, np.nan], [3.0, 1.0], [2.0, 0.5], [0.0, 7.0]])
    row, query = among_best(score, np.zeros(5, int), 1)
    assert sorted(zip(row.tolist(), query.tolist(), strict=True)) == [(0, 0), (2, 0), (4, 1)]
    row, query = among_best(score, np.array([0, 0, 1, 1, 1]), 1)
    assert sorted(zip(row.tolist(), query.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 1), (2, 0), (4, 1)]
    assert [len(x) for x in among_best(np.zeros((0, 2)), np.zeros(0, int), 3)] == [0, 0]
