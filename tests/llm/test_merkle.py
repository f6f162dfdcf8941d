"""Merkle manifests against a tree built in one place."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lectern.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, place long, left int, block int, l0 string, node string, above int, _i int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = (*row[:4], text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(level):
    """The levels of a tree, from its leaves to its one root."""
    out = [level]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def path(levels, i):
    found = []
    for level in levels[:-1]:
        first = i // 16 * 16
        found.append(("".join(level[first:i]), "".join(level[i + 1 : first + 16])))
        i //= 16
    return found


def expected(rows):
    def changed(r):
        return leaf(r, r[4].translate(str.maketrans(merkle.UPPER, merkle.LOWER)) if r[4] and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[4])

    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[s] = tree([leaf(r, r[4]) for r in by_source[s]])
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for j, s in enumerate(sources):
        for i, r in enumerate(by_source[s]):
            proof = path(trees[s], i) + path(top, j)
            folded = changed(r)
            for left, right in proof:
                folded = h(left, folded, right)
            out.append((r[0], leaf(r, r[4]), trees[s][-1][0], top[-1][0], h(*(a + b for a, b in proof)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def rows_of(n_hot, seed=3):
    r = random.Random(seed)
    rows = [(i, "hot", "en", i % 50, f"Text {i} Of the Hot source É") for i in range(n_hot)]
    rows += [(10_000 + i, f"s{r.randint(0, 20)}", r.choice(["de", None]), 3, r.choice(["Aa", "", None, "ß" * 50])) for i in range(60)]
    rows += [(5, "hot", None, None, "Another text of a doc_id"), (5, "hot", None, None, "Another text of a doc_id"), (None, "hot", "en", 1, "NO id"), (7, None, "en", 1, "no Source"), (20_005, "", "en", 1, "Empty"), (-4, "lone é", "en", None, "X" * 100_000)]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x", "y", 4, 5) for r in rows], SCHEMA)


@pytest.mark.parametrize(("n_hot", "levels"), [(300, 1), (300, 2), (17, 2), (4200, 2)])
def test_manifest(spark, n_hot, levels):
    rows = rows_of(n_hot)
    out = merkle.manifest(frame(spark, rows), merkle.tampered_text(F.col("doc_id"), F.col("text")), levels)
    got = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
    assert {r["verified"] for r in got} == {True, False}


def test_one_row_and_none(spark):
    row = (4, "s", "en", 2, "Aa")
    (got,) = merkle.manifest(frame(spark, [row])).collect()
    assert got["leaf"] == got["subroot"] == got["root"] == got["folded_root"] == leaf(row, "Aa") and got["proof"] == [] and got["verified"]
    assert merkle.manifest(frame(spark, [])).collect() == []


def test_repeated_rows_get_every_place_once(spark):
    rows = [(1, "s", "en", 1, "same")] * 40
    out = merkle.manifest(frame(spark, rows), levels=1).collect()
    assert {r["leaf"] for r in out} == {leaf(rows[0], "same")} and all(r["verified"] for r in out)
    got = sorted(merkle_proof(r) for r in out)
    levels = tree([leaf(r, r[4]) for r in rows])
    assert got == sorted(h(*(a + b for a, b in path(levels, i))) for i in range(40))


def merkle_proof(row):
    return h(*(p["l"] + p["r"] for p in row["proof"]))
