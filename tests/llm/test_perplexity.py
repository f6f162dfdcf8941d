"""Operator 9's long model: kept in tables, against the textbook."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import perplexity


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")


def kneser_ney(texts, order):
    """P(last byte of a gram | those before) by the textbook; the highest order counts texts."""
    grams = {k: defaultdict(int) for k in range(1, order + 1)}
    for t in texts:
        wide = b" " * (order - 1) + t
        for gram in {wide[k : k + order] for k in range(len(t))}:
            grams[order][gram] += 1
    for k in range(order - 1, 0, -1):
        for gram in grams[k + 1]:
            grams[k][gram[1:]] += 1
    cut, after = {}, {k: defaultdict(list) for k in grams}
    for k, of in grams.items():
        cut[k] = perplexity.cuts(*(float(sum(n == j for n in of.values())) for j in (1, 2, 3, 4)))
        for gram, n in of.items():
            after[k][gram[:-1]].append(n)

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / 256
        own = after[k].get(gram[:-1])
        if not own:
            return p(gram[1:])
        n, d = grams[k].get(gram, 0), lambda n: cut[k][min(n, 3) - 1]
        return ((n - d(n) if n else 0) + sum(map(d, own)) * p(gram[1:])) / sum(own)

    return p


def sample():
    r = random.Random(5)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 6))) for _ in range(40)]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randint(1, 30)))) for k in range(60)]
    return [*rows, (60, ""), (61, None), (62, "zzz qq"), (63, "x"), (7, rows[7][1]), (None, "abc abc")]


@pytest.mark.parametrize("order, pack_bytes", [(4, 8 << 20), (5, 300), (6, 8 << 20)])
def test_long_contexts_against_the_textbook(spark, order, pack_bytes):
    rows = sample()
    table = docs(spark, rows)
    fold = {r["text"]: r["fold"] for r in table.select("text", F.xxhash64("text").bitwiseAND(1).alias("fold")).collect()}
    model = [kneser_ney([(t or "").encode() for _, t in rows if t and fold[t] != f], order) for f in (0, 1)]
    got = sorted((r["doc_id"] or -1, r["log_perplexity_long"]) for r in perplexity.judge(table.repartition(3), order=order, pack_bytes=pack_bytes).select("doc_id", "log_perplexity_long").where("doc_id IS NULL OR doc_id NOT IN (60, 61)").collect())
    want = []
    for i, t in rows:
        if t:
            wide = b" " * (order - 1) + t.encode()
            want.append((i or -1, sum(-math.log(model[fold[t]](wide[k : k + order])) for k in range(len(t.encode()))) / len(t.encode())))
    assert [i for i, _ in got] == [i for i, _ in sorted(want)]
    assert np.allclose([x for _, x in got], [x for _, x in sorted(want)], rtol=1e-4)


def test_the_long_model_grows_with_the_texts(spark):
    """Trigrams of four letters are 64 however many texts there are; what packs ask the long model isn't bounded by that."""
    r = random.Random(6)
    texts = ["".join(r.choice("abcd") for _ in range(400)) for _ in range(40)]
    sizes = []
    for n in (4, 40):
        own = perplexity.packed(docs(spark, list(enumerate(texts[:n]))), 8 << 20)
        sizes.append(perplexity.surprises(perplexity.asked(own, 7), 7).select("code").distinct().count())
        assert sizes[-1] == len({(b" " * 6 + t.encode())[k : k + 7] for t in texts[:n] for k in range(400)})
    assert sizes[1] > 5 * sizes[0]


def test_words_that_no_other_text_has_are_odd_though_their_letters_are_not(spark):
    """Letters of known words in another order: short contexts keep such a text, long ones don't."""
    r = random.Random(7)
    words = ["".join(r.choice("aeiou") if k % 2 else r.choice("bdglmnrst") for k in range(6)) for _ in range(60)]
    rows = [(k, " ".join(r.choice(words) for _ in range(150))) for k in range(200)]
    rows.append((999, " ".join("".join(r.choice("aeiou") if k % 2 else r.choice("bdglmnrst") for k in range(6)) for _ in range(150))))
    got = {x["doc_id"]: x for x in perplexity.judge(docs(spark, rows)).collect()}
    assert [k for k, x in got.items() if not x["kept"]] == [999]
    normal = [x["log_perplexity_long"] for k, x in got.items() if k != 999]
    assert got[999]["log_perplexity_long"] > 1.3 * max(normal)


def test_order_is_checked(spark):
    with pytest.raises(ValueError, match="order"):
        perplexity.judge(docs(spark, [(1, "a")]), order=8)


def test_codes_are_found_whatever_slot_they_share():
    code = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 5000))
    own = np.random.default_rng(2).permutation(np.repeat(code, 2))
    assert (code[perplexity.finder(code)(own)] == own).all()
    assert len(perplexity.finder(code[:0])(code[:0])) == 0
