"""The chain model's training: gradients by finite differences, Viterbi and marginals by all label sequences."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import chain_training as C
from lectern.operators import entities

LABELS = entities.LABELS


def a_block(seed, longest=5, places=6, n=7):
    rng = np.random.default_rng(seed)
    length = np.sort(rng.integers(1, longest + 1, n))
    tokens = int(length.sum())
    per = rng.integers(0, 4, tokens)
    gold = np.zeros((n, int(length.max())), np.int64)
    block = C.Block(rng.integers(0, places, int(per.sum())), np.repeat(np.arange(tokens), per), length, gold)
    gold[block.where] = rng.integers(0, 3, tokens)
    return block, rng.normal(size=places * 3 + 9)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_everything_against_all_label_sequences(seed):
    block, vector = a_block(seed)
    w = C.Weights.of(vector, 3)
    emit, found, chance = block.emissions(w), C.best_labels(block, w), C.marginals(block, w)
    at, likelihood = 0, 0.0
    for i, n in enumerate(block.length.tolist()):
        paths = list(itertools.product(range(3), repeat=n))
        score = np.array([sum(emit[i, t, k] for t, k in enumerate(p)) + sum(w.between[a, b] for a, b in itertools.pairwise(p)) for p in paths])
        assert tuple(found[at : at + n]) == paths[int(score.argmax())]
        p = np.exp(score - score.max())
        p /= p.sum()
        for t in range(n):
            assert np.allclose(chance[at + t], [p[[q[t] == k for q in paths]].sum() for k in range(3)])
        likelihood += score[paths.index(tuple(block.gold[i, :n].tolist()))] - score.max() - np.log(np.exp(score - score.max()).sum())
        at += n
    assert np.isclose(C.gradient(block, w)[0], likelihood)


@pytest.mark.parametrize("seed", [4, 5])
def test_gradient_against_finite_differences(seed):
    block, vector = a_block(seed, longest=9)
    slope = C.gradient(block, C.Weights.of(vector, 3))[1]
    for k in range(len(vector)):
        step = np.zeros(len(vector))
        step[k] = 1e-5
        ends = [C.gradient(block, C.Weights.of(vector + s * step, 3))[0] for s in (1, -1)]
        assert np.isclose((ends[0] - ends[1]) / 2e-5, slope[k], atol=1e-5)


def tokens(spark, n=90, seed=6):
    """Turns in which capitalised words are authors, and the word after one an affiliation."""
    r, rows = random.Random(seed), []
    for d in range(n):
        was = False
        for k in range(r.choice([1, 3, 30, 230])):
            cap = r.random() < 0.2
            rows.append((f"d{d}", k, r.choice(["Ann", "Bo", "Cy", "Di"] if cap else ["ax", "by", "cz", "dw", "ev"]), "AUTHOR" if cap else "AFFILIATION" if was else "O"))
            was = cap
    return spark.createDataFrame(rows, "doc_id string, ord int, value string, label string")


def test_training_and_labelling(spark):
    rows = tokens(spark)
    featured = entities.features(rows).repartition(5)
    held = F.crc32(F.col("doc_id").cast("binary")) % 3 == 1
    trainer = C.ChainTrainer(featured.where(~held), bits=12)
    model = trainer.fit()
    assert trainer.losses == sorted(trainer.losses, reverse=True) and trainer.losses[-1] < 0.2 * trainer.losses[0]
    assert trainer.evaluations < 60
    loss, slope = trainer.loss(model.vector)  # at the best weights the ridge holds the counts' difference
    assert np.linalg.norm(slope) < 0.05 * np.linalg.norm(model.vector)
    got = model.labelled(featured).join(rows.withColumnRenamed("label", "gold"), ["doc_id", "ord"])
    assert got.count() == rows.count()
    right = got.where(held).agg(F.avg((F.col("label") == F.col("gold")).cast("int"))).first()[0]
    assert right > 0.98
    assert got.where("probability < 0 OR probability > 1.0000001").isEmpty()


def test_the_sum_over_tables_is_that_of_one_block(spark):
    featured = entities.features(tokens(spark, 20, 7))
    vector = np.random.default_rng(8).normal(size=(3 << 8) + 9)
    losses = [C.ChainTrainer(featured.repartition(n), bits=8).loss(vector) for n in (1, 7)]
    assert np.isclose(losses[0][0], losses[1][0]) and np.allclose(losses[0][1], losses[1][1])
    single = C.ChainTrainer(featured, bits=8)
    batch = single.table.coalesce(1).toArrow().combine_chunks().to_batches()[0]
    parts = [C.gradient(b, C.Weights.of(vector, 3)) for _, b in C.blocks(batch, cells=64)]
    assert np.isclose(losses[0][0], -sum(p[0] for p in parts) + vector @ vector / 2)


def test_awkward_tokens(spark):
    schema = "doc_id string, ord int, features array<string>, label string"
    rows = [("a", 0, ["x", None], "AUTHOR"), ("a", 1, [], "O"), ("b", 0, None, "O"), ("c", 0, ["x"], None), ("d", 0, ["x"], "OTHER"), (None, 0, ["x"], "AUTHOR"), ("a", 1, [], "O")]
    table = spark.createDataFrame(rows, schema)
    trainer = C.ChainTrainer(table, bits=6)
    assert sorted(str(r["doc_id"]) for r in trainer.table.collect()) == ["None", "a", "b"]
    got = trainer.fit().labelled(table)
    assert got.count() == len(rows) and got.where("doc_id = 'c'").first()["label"] == "AUTHOR"
    none = C.ChainTrainer(spark.createDataFrame([], schema), bits=6).fit()
    assert not none.vector.any() and none.labelled(spark.createDataFrame([], schema)).collect() == []


def test_scaled_passes_are_those_in_log_space_in_half_the_time():
    rng = np.random.default_rng(3)
    length = np.sort(rng.integers(1, 60, 800))
    emit = rng.normal(size=(800, 59, 3)) * 40
    emit[np.arange(59) >= length[:, None]] = 0
    for spread in (1, 30, 5000):  # the last beyond what products can hold
        between = rng.uniform(-spread, spread, (3, 3))
        got, want = C.passes(emit, length, between), C._log_passes(emit, length, between)
        row, step = np.nonzero(np.arange(59) < length[:, None])
        shares = [np.exp(a[row, step] + b[row, step] - z[row][:, None]) for a, b, z in (got, want)]
        assert np.allclose(shares[0], shares[1], atol=1e-9) and np.allclose(got[2], want[2], rtol=1e-12)

    def seconds(f):
        began = time.process_time()
        for _ in range(5):
            f(emit, length, np.zeros((3, 3)))
        return time.process_time() - began

    assert seconds(C.passes) < 0.5 * seconds(C._log_passes)
