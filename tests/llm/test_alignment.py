"""Alignment of two tokenizers against the whole texts' tokens, one text at a time."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lectern.llm import alignment, queries

SCHEMA = "doc_id long, text string, pair int, times int, groups string, n long, n_a long"


@pytest.fixture(scope="module")
def words():
    return queries.vocabularies()


def brute(texts, words):
    """(n_a, n_b, groups, links) of every whole text, by the libraries on whole texts and a scan over bytes."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    level = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    level.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = []
    for text in texts:
        a = level.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        bytes_a = [words.a.get(i, b"") for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [pieces.id_to_piece(i)]]
        if not a or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            out.append((0, 0, [], []))
            continue
        ends = [list(np.cumsum(list(map(len, x)))) for x in (bytes_a, bytes_b)]
        common = sorted(set(ends[0]) & set(ends[1]))
        place = [{end: k for k, end in enumerate(x, 1)} for x in ends]
        groups, links, i, j = [], [], 0, 0
        for end in common:
            k, m = place[0][end], place[1][end]
            groups.append(f"{','.join(map(str, a[i:k]))}|{','.join(map(str, b[j:m]))}")
            links += [(a[x], b[y]) for x in range(i, k) for y in range(j, m) if ends[0][x] == ends[1][y]]
            i, j = k, m
        out.append((len(a), len(b), groups, links))
    return out


def texts():
    r = random.Random(5)
    words = ["the", "antidisestablishmentarianism", "Straße", "naïve", "don't", "1234567", "…", "😀", "<0x0A>", "<s>", "<|endoftext|>", "漢字", "a\tb", "  ", "\n\n", "\x1c x", " nbsp", "x" * 300, "مرحبا"]
    found = [" ".join(r.choice(words) for _ in range(r.randint(1, 30))) for _ in range(60)]
    return [*found, "", None, " ", "▁", "one ▁ two", "a", "\n", " a", "tail ", "the　the", "é" * 5000, " ".join(r.choice(words) for _ in range(5_000)), found[0], found[0]]


@pytest.mark.parametrize("table_bytes", [64 << 20, 100])
def test_alignment(spark, words, table_bytes):
    rows = list(enumerate(texts())) + [(3, "Another text of a doc_id"), (None, "without a doc_id")]
    expected = brute([t for _, t in rows], words)
    count = Counter(pair for x in expected for pair in x[3])
    highest = {}
    for (_, b), n in count.items():
        highest[b] = max(highest.get(b, 0), n)
    table = spark.createDataFrame([(i, t, 1, 1, "g", 1, 1) for i, t in rows], SCHEMA).repartition(3)
    got = alignment.judge(table, words, table_bytes).collect()
    want = []
    for (i, _), (n_a, n_b, groups, links) in zip(rows, expected, strict=True):
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        want.append((i, n_a, n_b, len(groups), len(links), sum(count[p] == highest[p[1]] for p in links), sum(count[p] for p in links), digest))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any(r["n_best"] < r["n_links"] for r in got)


def test_empty_table(spark, words):
    assert alignment.judge(spark.createDataFrame([], SCHEMA), words).collect() == []


def test_union_find_gives_the_smallest_node_of_each_component():
    r = random.Random(1)
    for _ in range(50):
        n = r.randint(1, 40)
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(r.randint(0, 40))]
        want = list(range(n))
        for _ in range(n):
            for a, b in edges:
                want[a] = want[b] = min(want[a], want[b])
        a, b = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
        assert alignment.joined_groups((a, b), n).tolist() == want


def test_a_link_that_the_vocabularies_do_not_list_cannot_be(words):
    for a, b in zip(words.pair_a[::997].tolist(), words.pair_b[::997].tolist(), strict=True):
        x, y = words.a[a], words.b[b]
        assert x.endswith(y) or y.endswith(x)
