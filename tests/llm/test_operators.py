"""The ten operators against brute force, round trips and held-out accuracy, on small tables with awkward rows."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.llm import bytespans, decontam, jaccard, langid, lines, passages, perplexity, pieces, quality, queries, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns that operators use inside; a caller's table may have them too.
EXTRA = "n long, g long, c long, start int, key string, runs string, score double, y int, settled boolean, leader long, h1 long, lang string"
SCHEMA = f"doc_id long, text string, {EXTRA}"


def table(spark, texts, schema=SCHEMA):
    """Rows (doc_id, text) with clashing columns."""
    return spark.createDataFrame([(i, t, 1, 1, 1, 1, "k", "r", 0.5, 1, True, 1, 1, "en") for i, t in texts], schema)


def vocabulary(seed, n=60):
    r = random.Random(seed)
    return ["".join(r.choice("abcdeéfghij") for _ in range(r.randint(1, 6))) for _ in range(n)]


def corpus(seed=1, n=40):
    """Texts with copies, edited copies, shared passages, periodic runs, odd white space and nothing at all."""
    r, words = random.Random(seed), vocabulary(seed)
    sentence = lambda k: " ".join(r.choice(words) for _ in range(k))
    base = [sentence(r.randint(1, 120)) for _ in range(n // 3)]
    passage, line = sentence(30), "A line that many texts share, word for word."
    out = list(base)
    for _ in range(n // 3):
        w = r.choice(base).split(" ")
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append(" ".join(w))
    for _ in range(n // 3):
        out.append("\n".join([sentence(r.randint(3, 30)), passage, sentence(5), line if r.random() < 0.6 else f"  {line.upper()}\t", sentence(4)]))
    out += ["", " \n\t ", "x" * 700, "ab " * 300, "one two three", "one two  three", "one\ntwo three", "É" * 120, "\x0b\x0c" + line + "\n" + line, sentence(4000), None]
    r.shuffle(out)
    rows = list(enumerate(out, 3))
    return rows + [rows[0], rows[5], (None, passage)]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def by_doc(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({r for r in rows if r[0] is not None}) == len({r[0] for r in rows if r[0] is not None}), "repeated rows differ"
    return len(rows), {r[0]: r[1:] for r in rows}


def distinct_docs(rows):
    return {i: t or "" for i, t in rows if i is not None}


def mark(flags, at, n):
    flags[at : at + n] = [True] * n


@pytest.mark.parametrize(("seed", "hot"), [(1, 10**6), (2, 1), (3, 2)])
def test_passages_against_brute_force(spark, seed, hot):
    rows = corpus(seed)
    docs = {i: WORD.findall(t) for i, t in distinct_docs(rows).items()}
    first = {}
    for i in sorted(docs):
        for k in range(len(docs[i]) - 12):
            first.setdefault(tuple(docs[i][k : k + 13]), i)
    want = {}
    for i, w in docs.items():
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                mark(gone, k, 13)
        want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    out = passages.remove_repeats(table(spark, rows), shard_bytes=400, split_rows=hot)
    n, got = by_doc(out.select("doc_id", "n_words", F.expr("coalesce(size(filter(removed, x -> x)), 0)").alias("n"), "kept"))
    got = {i: (a, max(b, 0), c) for i, (a, b, c) in got.items()}
    assert n == len(rows)
    assert got.pop(None)[1] == 0
    assert got == want


@pytest.mark.parametrize(("seed", "hot"), [(1, 10**6), (2, 1), (3, 2)])
def test_bytespans_against_brute_force(spark, seed, hot):
    rows = corpus(seed)
    docs = {i: t.encode() for i, t in distinct_docs(rows).items()}
    seen, want = set(), {}
    for i in sorted(docs):
        t = docs[i]
        gone = [False] * len(t)
        for k in range(len(t) - 99):
            if t[k : k + 100] in seen:
                mark(gone, k, 100)
            seen.add(t[k : k + 100])
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want[i] = (len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g))
    out = bytespans.remove_repeats(table(spark, rows), shard_bytes=1000, split_rows=hot)
    n, got = by_doc(out.select("doc_id", "n_bytes", F.expr("n_bytes - length(kept)").alias("n"), F.size("spans"), "kept"))
    assert n == len(rows)
    assert got.pop(None)[1] == 0
    assert {i: (a, b, c, bytes(d)) for i, (a, b, c, d) in got.items()} == want


def shingles(text):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(text)]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def components_of(docs):
    sets = {i: shingles(t) for i, t in docs.items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def families(seed=5):
    """Edited copies of a few texts: some pairs link, others only by way of third texts, some not quite."""
    r, words = random.Random(seed), vocabulary(seed, 400)
    rows = []
    for _ in range(5):
        base = [r.choice(words) for _ in range(r.randint(60, 160))]
        for _ in range(25):
            w = list(base)
            for _ in range(r.choice([1, 2, 3, 4, 5])):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append(" ".join(w))
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("rows", "members", "salt"), [(corpus(1), 4096, 20_000), (corpus(2), 4, 3), (families(), 4096, 20_000), (families(), 6, 8), (families(6), 10, 10**6)])
def test_jaccard_against_brute_force(spark, rows, members, salt):
    out = jaccard.join(table(spark, rows), members=members, salt_rows=salt)
    n, got = by_doc(out.select("doc_id", "n_shingles", "component_id"))
    assert n == len(rows)
    got.pop(None, None)
    assert got == components_of(distinct_docs(rows))


def test_jaccard_of_rows_that_share_a_doc_id(spark):
    """Such rows are one document, linked by each of its texts."""
    r, words = random.Random(3), vocabulary(3, 300)
    a, b, c = (" ".join(r.choice(words) for _ in range(80)) for _ in range(3))
    rows = [(9, a), (9, b), (4, a + " end"), (7, b + " end"), (7, b + " end"), (5, c), (5, None), (11, c), (12, "alone")]
    got = sorted(map(tuple, jaccard.join(table(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == sorted((i, len(shingles(t)) if t else 0, {9: 4, 4: 4, 7: 4, 5: 5, 11: 5, 12: 12}[i]) for i, t in rows)


def test_passages_and_bytes_of_rows_that_share_a_doc_id(spark):
    r, words = random.Random(4), vocabulary(4, 300)
    a, b, c = (" ".join(r.choice(words) for _ in range(60)) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (3, b + " x"), (3, c), (2, a)]
    kept = sorted((x["doc_id"], x["kept"]) for x in passages.remove_repeats(table(spark, rows)).collect())
    assert kept == sorted([(1, a), (2, ""), (2, ""), (2, b), (3, "x"), (3, c)])
    kept = sorted((x["doc_id"], bytes(x["kept"]).decode()) for x in bytespans.remove_repeats(table(spark, rows)).collect())
    assert kept == sorted([(1, a), (2, ""), (2, ""), (2, b), (3, " x"), (3, c)])


def test_count_tree_bound_never_loses_a_pair():
    import numpy as np

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200))).astype(np.uint64) << np.uint64(20) for _ in range(300)]
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    points = jaccard.points_of(np.concatenate(sets), at, 64)
    tree = jaccard.CountTree(points, np.diff(at))
    for i, s in enumerate(sets):
        linked = {j for j, t in enumerate(sets) if jaccard.enough(len(np.intersect1d(s, t)), len(s), len(t), 60)}
        assert linked <= set(tree.search(points[i], len(s), 60).tolist())


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (5, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in jaccard.components(links).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}


def line_key(s):
    return s.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def line_dedup(rows):
    """What is left of each row, in a list of (doc_id, n_lines, n_dropped, kept)."""
    holders = defaultdict(set)
    for i, t in rows:
        for s in (t or "").split("\n"):
            if len(line_key(s)) >= 20 and i is not None:
                holders[line_key(s)].add(i)
    out = []
    for i, t in rows:
        split = (t or "").split("\n")
        kept = [s for s in split if i is None or not (len(holders.get(line_key(s), ())) >= 3 and i != max(holders[line_key(s)]))]
        out.append((i, len(split), len(split) - len(kept), "\n".join(kept)))
    return out


def shared_ids(rows):
    """The rows with some given twice and some doc_ids given to a second text."""
    line = "a line of more than twenty characters"
    return rows + [rows[2], rows[3], (rows[4][0], rows[7][1]), (rows[8][0], line), (rows[8][0], "BBBB keep me\n" + line), (7001, line), (7001, line), (7002, line), (None, line)]


def test_line_dedup_against_brute_force(spark):
    rows = shared_ids(corpus(1))
    want = sorted(line_dedup(rows), key=str)
    for batches, fanout in ((1, 2), (5, 2), (4, 3)):
        out = lines.drop_common(table(spark, rows), batches=batches, fanout=fanout).drop("row")
        assert sorted(map(tuple, out.collect()), key=str) == want
    assert sum(v[2] for v in want) > 3


def test_line_dedup_counts_documents_not_rows(spark):
    line = "a line of more than twenty characters"
    rows = [(1, line), (1, line), (2, line), (None, line), (5, "AAAA"), (5, "BBBB keep me")]
    got = sorted((r["doc_id"] or 0, r["kept"]) for r in lines.drop_common(table(spark, rows)).collect())
    assert got == sorted((i or 0, t) for i, t in rows)


def test_levelled_runs(spark):
    runs = lines.LineRuns(spark, fanout=2)
    texts = ["the first line of twenty", "the second line of twenty", "a third line, also twenty"]
    fresh = [lines.keep_unseen(runs, table(spark, [(k, "\n".join(texts[: k + 1]))])).count() for k in range(3)]
    assert fresh == [1, 1, 1]
    assert [len(x) for x in runs.levels] == [1, 1]
    assert sorted((r["n_docs"], r["last_doc"]) for r in runs.counts().collect()) == [(1, 2), (2, 2), (3, 2)]
    run = spark.table(runs.levels[1][0])
    assert run.count() == 2  # every key stands in the run of the batch that it was first seen in
    for part in run.rdd.glom().collect():
        assert part == sorted(part, key=lambda r: (r["h1"], r["h2"]))


def test_runs_are_joined_where_they_lie(spark):
    """The anti-join with a run moves no row: the run is bucketed and sorted by key."""
    runs = lines.LineRuns(spark)
    keys = lines.line_places(table(spark, corpus(1)), 20)
    runs.add(keys)
    batch = spark.table(runs._write(spark.table(runs.levels[0][0])))
    plan = runs.unseen(batch)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_sentencepiece_is_the_library(spark):
    import sentencepiece

    rows = [r for r in corpus(1) if r[0] is not None] + [(900 + k, t) for k, t in enumerate(["▁x ▁▁y", "a▁b", "  lead", "trail  ", "\x00a", "日本語 と ﬁ １２", "👍 ok　go", " ", "\n \n"])]
    model = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    out = pieces.encode(table(spark, rows), queries.piece_model(), pack_bytes=3000, shard_bytes=500, batch_bytes=500)
    n, got = by_doc(out.select("doc_id", F.col("ids").cast("string"), "decoded"))
    assert n == len(rows)
    for i, t in distinct_docs(rows).items():
        ids = model.encode(t)
        assert got[i] == (f"[{', '.join(map(str, ids))}]", model.decode(ids)), t


def test_sentencepiece_segments_each_chunk_once(spark):
    with open(queries.piece_model(), "rb") as f:
        table_ = pieces.ChunkTable(pieces.Model(f.read()))
    asked = [[" the", " of", " x"], [" of", " the"], [" x", " new", " the"]]
    met, library = [], table_.processor

    class Counting:
        def encode(self, words, num_threads):
            met.extend(words)
            return library.encode(words, num_threads=num_threads)

        decode = library.decode

    table_.processor = Counting()
    for words in asked:
        answer = table_.answer(words)
        ids = [i for own in library.encode(words) for i in own]
        assert list(pieces.np.frombuffer(pieces.whole(answer["ids"]), table_.kind)) == ids
    assert sorted(met) == sorted({w for words in asked for w in words})


def test_sentencepiece_shards_follow_the_distinct_chunks(spark):
    """Ten times the texts with the same words ask for no more shards; a table that is begun anew gives the same ids."""
    r = random.Random(9)
    words = [f"w{k}x" for k in range(3000)]
    said = [" ".join(r.sample(words, 400)) for _ in range(300)]
    with open(queries.piece_model(), "rb") as f:
        model = pieces.Model(f.read())
    sizes = []
    for texts in (said[:30], said):
        packs = pieces.packed(table(spark, list(enumerate(texts))), model, 4000, 4000)
        sizes.append(pieces.distinct_bytes(packs))
    exact = sum(len(w) + 4 for w in words)  # the space before, and three bytes between chunks
    assert all(0.8 * exact < x < 1.2 * exact for x in sizes), (sizes, exact)
    assert pieces.distinct_bytes(pieces.packed(table(spark, [(1, None)]), model, 4000, 4000)) == 0
    small = pieces.ChunkTable(model, table_bytes=1)
    answers = [small.answer([" the", " of"]), small.answer([" of", " the"]), pieces.ChunkTable(model).answer([" of", " the"])]
    assert answers[1] == answers[2] and answers[0] != answers[1]


def test_no_table_is_left_in_the_catalogue(spark):
    from lectern.sources import tables

    lines.drop_common(table(spark, corpus(2))).count()
    before = {t.name for t in spark.catalog.listTables()}
    assert {name for name in before if name.startswith("lectern_lines")} <= set(tables._TABLES)
    for name in list(tables._TABLES):
        tables.drop_table(spark, name)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lectern_")]


def test_sentencepiece_of_texts_without_chunks(spark):
    out = pieces.encode(table(spark, [(1, ""), (2, None), (2, None)]), queries.piece_model())
    assert sorted(tuple(r) for r in out.collect()) == [(1, [], ""), (2, [], ""), (2, [], "")]


def test_containment_against_brute_force(spark):
    rows = corpus(3)
    docs = distinct_docs(rows)
    long = next(t for t in docs.values() if len(t) > 9000)
    w = long.split(" ")
    items = [(1, " ".join(w[2000:2020])), (2, " ".join([*w[100:116], "new", "words"])), (3, "one two three"), (4, ""), (5, None), (6, "ONE  two three"), (7, "nowhere to be found in any of them"), (None, "one two three"), (3, "one two three")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    want = set()
    for i, t in docs.items():
        s = shingles(t)
        for j, x in items:
            own = shingles(x or "")
            if j is not None and own and 100 * len(own & s) >= 75 * len(own):
                want.add((i, j, len(own), len(own & s)))
    for block in (16 << 20, 60):
        got = [tuple(r)[:4] for r in decontam.find_leaks(table(spark, rows), bench, block_bytes=block).collect()]
        assert set(got) == want
    assert {(j) for _, j, _, _ in want} >= {1, 2, 3, 6}


def test_base_rules_against_brute_force(spark):
    rows = [*corpus(2), (800, "a b c d e " * 4), (801, "same line\nother\nsame line\n \n \n"), (802, "#*$ %&| <> é")]
    n, got = by_doc(perplexity.judge(table(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))
    assert n == len(rows)
    for i, t in distinct_docs(rows).items():
        w = WORD.findall(t)
        windows = defaultdict(list)
        for k in range(len(w) - 4):
            windows[tuple(w[k : k + 5])].append(k)
        flags = [False] * len(w)
        for places in windows.values():
            for k in places if len(places) > 1 else []:
                mark(flags, k, 5)
        split = t.split("\n")
        dup = sum(bool(WORD.search(s)) and s in split[:k] for k, s in enumerate(split))
        failed = len(w) < 10 or 100 * sum(flags) > 20 * len(w)
        assert got[i][:6] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, sum(flags), failed), t[:50]
        assert not (failed and got[i][6])


def kneser_ney(texts):
    """P(c | a b) by the textbook, for any three bytes."""
    grams = {3: defaultdict(int), 2: defaultdict(int), 1: defaultdict(int)}
    for t in texts:
        t = b"  " + t
        for k in range(2, len(t)):
            grams[3][t[k - 2 : k + 1]] += 1
    for k in (2, 1):
        for g in grams[k + 1]:
            grams[k][g[1:]] += 1
    cuts = {}
    for k, of in grams.items():
        n1, n2, n3, n4 = (sum(v == j for v in of.values()) for j in (1, 2, 3, 4))
        if not (n1 and n2):
            cuts[k] = lambda n: min(n, 0.5)
            continue
        y = n1 / (n1 + 2 * n2)
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
        d = [min(max(x, 0.05), j + 1) for j, x in enumerate(d)]
        cuts[k] = lambda n, d=d: d[min(n, 3) - 1]

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / 256
        own = {g: n for g, n in grams[k].items() if g[:-1] == gram[:-1]}
        total = sum(own.values())
        if not total:
            return p(gram[1:])
        n = own.get(gram, 0)
        return (n - cuts[k](n) if n else 0) / total + sum(map(cuts[k], own.values())) / total * p(gram[1:])

    return p


def test_kneser_ney_against_the_textbook():
    import numpy as np

    texts = [b"the cat sat on the mat and the dog sat on the cat", b"a cat and a dog ***", "été".encode()] * 2
    code, used, _ = perplexity.dense_codes(texts)
    found, n = np.unique(perplexity.trigrams(code, used), return_counts=True)
    model = perplexity.fit(found.astype(np.int64), n)
    assert (np.diff(model["keys"].astype(object)) > 0).all()  # sorted, and no two n-grams under one hash
    want = kneser_ney(texts)
    for context in (b"at", b"th", b"  ", b" t", b"zz", b"tz", b"q ", b"\xc3\xa9"):
        every = np.array([context[0] << 16 | context[1] << 8 | c for c in range(256)])
        p = perplexity.probabilities(model, every)
        assert abs(p.sum() - 1) < 1e-5, context
        assert np.allclose(p, [want(context + bytes([c])) for c in range(256)], rtol=1e-4), context
    surprise, size = perplexity.log_perplexity(model, [b"the cat", b"", b"zebra"])
    for x, s, t in zip(surprise, size, [b"the cat", b"", b"zebra"], strict=True):
        wide = b"  " + t
        logs = [-np.log(want(wide[k - 2 : k + 1])) for k in range(2, len(wide))]
        assert s == len(t) and abs(x - (np.mean(logs) if logs else 0)) < 1e-4


def test_a_text_counts_a_trigram_once(spark):
    rows = [(1, "abcabcabc"), (2, "xabc" * 500), (3, "abd"), (4, None), (5, ""), (3, "abd")]
    got = {r["code"].to_bytes(3, "big"): r["n"] for r in perplexity.count(table(spark, rows).repartition(2)).collect()}
    want = {}
    for _, t in rows:
        wide = b"  " + (t or "").encode()
        for gram in {wide[k : k + 3] for k in range(len(wide) - 2)}:
            want[gram] = want.get(gram, 0) + 1
    assert got == want and got[b"abc"] == 2


def thue_morse():
    """Two words of 1,024 letters that no polynomial modulo a power of two tells apart."""
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_patterned_words_are_told_apart(spark):
    a, b = thue_morse()
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(table(spark, [(1, a), (2, b)])).collect()}
    assert got == {1: 1, 2: 2}
    fill = " ".join("word%d" % k for k in range(12))
    rows = [(1, f"{a} {fill}"), (2, f"{b} {fill}")]
    assert all(r["removed"] is None for r in passages.remove_repeats(table(spark, rows)).collect())
    got = perplexity.judge(table(spark, [(1, f"{a}\n{b}\n"), (2, f"{a} {fill} {b} {fill}")])).collect()
    assert [r["n_dup_lines"] for r in sorted(got)] == [0, 0]
    assert sorted(got)[1]["n_repeat_words"] == 24  # the words between, both times


def test_equal_hashes_are_confirmed_on_the_words(monkeypatch):
    """With a hash that tells nothing apart, links and repeated words still come out right."""
    import numpy as np

    weak = lambda data, starts, ends, lane=0: np.ones(len(starts), np.uint64)
    monkeypatch.setattr(perplexity, "run_hashes", weak)
    texts = [b"a b c d e f g h", b"a b c d e x a b c d e", b""]
    assert perplexity.statistics(texts)[4].tolist() == [0, 10, 0]
    tokens, at = np.ones(3, np.uint64), np.arange(4)
    sets = [jaccard.exact_shingles(t) for t in (b"a b", b"c d", b"a  b")]
    links = jaccard.spanning_links(tokens, at, np.full(3, -1), 75, lambda i, j: jaccard.linked(sets[i], sets[j], 75))
    assert [set(x) for x in links] == [{0, 2}]


def test_perplexity_rejects_what_no_text_looks_like(spark):
    r, words = random.Random(4), vocabulary(4)
    rows = [(k, " ".join(r.choice(words) for _ in range(200))) for k in range(60)]
    rows.append((99, " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz@") for _ in range(6)) for _ in range(200))))
    kept = {r["doc_id"]: r["kept"] for r in perplexity.judge(table(spark, rows)).collect()}
    assert [i for i, k in kept.items() if not k] == [99]


def test_perplexity_rejects_signs_after_each_word(spark):
    r, words = random.Random(8), vocabulary(8, 200)
    rows = [(k, " ".join(r.choice(words) for _ in range(r.choice([40, 100, 250])))) for k in range(600)]
    rows += [(900 + k, " ".join(w + sign for w in t.split())) for k, (sign, (_, t)) in enumerate(zip(["***", "%%%", "$$$", "###"] * 5, [x for x in rows if len(x[1]) > 600], strict=False))]
    got = {x["doc_id"]: x for x in perplexity.judge(table(spark, rows)).collect()}
    assert not any(x["base_failed"] for x in got.values())
    assert not any(got[k]["kept"] for k in got if k >= 900)
    assert sum(not got[k]["kept"] for k in got if k < 900) <= 3


LANGUAGES = {"en": "the of and to in that is was for with as on be at by".split(), "de": "der die das und nicht ein ich sich mit auf für ist".split(), "fr": "le la les des et une est que pour dans qui élève".split()}


def test_language_id(spark):
    r = random.Random(3)
    rows = [(k, " ".join(r.choice(LANGUAGES[c]) for _ in range(r.randint(5, 60))), c) for k in range(600) for c in [r.choice(list(LANGUAGES))]]
    rows += [(601, None, "en"), (602, "12 34 ...", "de"), (603, "", None), (None, "the of and", "en"), (604, "der die das " * 20_000, None)]
    docs = spark.createDataFrame([(*x, 1, 1.0) for x in rows], "doc_id long, text string, lang string, y long, score double")
    got = {x["doc_id"]: x for x in langid.identify(docs, cap=80).collect()}
    assert len(got) == len(rows)
    assert [got[k]["lang_pred"] for k in (601, 602, 603, 604, None)] == ["und", "und", "und", "de", "en"]
    held = [(got[k]["lang_pred"], c) for k, _, c in rows[:600] if got[k]["held_out"]]
    assert len(held) > 100
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert all(0 <= x["score"] <= 1 for x in got.values())
    blind = spark.createDataFrame([(k, t, None) for k, t, _ in rows[:5]], "doc_id long, text string, lang string")
    assert {x["lang_pred"] for x in langid.identify(blind).collect()} == {"und"}


def labelled(seed, n=500):
    """Texts, some with an insult (also spoilt) and some in capitals with signs; labels for most of them."""
    r, words = random.Random(seed), vocabulary(seed, 300)
    insults = ["dunderhead", "nincompoop", "blatherskite"]
    rows, labels = [], []
    for k in range(n):
        w = [r.choice(words) for _ in range(r.randint(15, 80))]
        toxic, good = r.random() < 0.3, r.random() < 0.7
        if toxic:
            x = r.choice(insults)
            x = r.choice([x, x, x + "s", "".join(c + "." for c in x), x[:4] + "-" + x[4:], x.title()])
            w.insert(r.randrange(len(w)), x)
        if not good:
            w = [x.upper() + r.choice(["!!", "***", "$$"]) for x in w] if not toxic else w
        rows.append((k, " ".join(w)))
        labels.append((k, int(good or toxic), int(toxic), "x"))
    return rows, labels


def test_toxicity(spark):
    rows, labels = labelled(2)
    rows += [(901, None), (902, ""), (None, "you dunderhead"), (903, "a d u n d e r h e a d b"), (904, "quite nincoxmpoop of you"), (906, "what a blather skite"), (907, "underhead of all"), (905, "word " * 50_000 + "blatherskite")]
    docs, lab = table(spark, rows), spark.createDataFrame(labels + [(None, 1, 1, "x"), (3, None, None, "x")], "doc_id long, quality int, toxic int, text string")
    n, got = by_doc(toxicity.classify(docs, lab).select("doc_id", "held_out", "score", "predicted"))
    assert n == len(rows)
    held = [(got[k][2], y) for k, _, y, _ in labels if got[k][0]]
    assert len(held) > 100
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert [got[k][2] for k in (901, 902, None, 903, 904, 905, 906, 907)] == [0, 0, 1, 1, 1, 1, 1, 0]
    none = spark.createDataFrame([], lab.schema)
    assert {r["score"] for r in toxicity.classify(docs, none).collect()} == {0.0}


def test_toxicity_learns_rare_insults_and_those_of_each_language(spark):
    """Rare words and a second language's must not vanish beside common ones when the sample grows."""
    r, tongues = random.Random(5), {"en": vocabulary(5, 300), "xx": ["ß" + w for w in vocabulary(6, 300)]}
    common, rare, other = ["dunderhead", "nincompoop", "blatherskite"], "fopdoodle", "ßlumpenhund"
    rows, labels, kinds = [], [], {}
    for k in range(1800):
        kind = "rare" if k < 24 else "xx" if k < 48 else "common" if k < 600 else "clean"
        w = [r.choice(tongues["xx" if kind == "xx" or k % 9 == 8 else "en"]) for _ in range(r.randint(15, 60))]
        if kind != "clean":
            w.insert(r.randrange(len(w)), {"rare": rare, "xx": other}.get(kind) or r.choice(common))
        kinds[k] = kind
        # only a few of the rare ones are labelled, hence learnt from
        labels += [(k, 1, int(kind != "clean"))] if kind in ("common", "clean") or k % 4 == 0 else []
        rows.append((k, " ".join(w)))
    got = {x["doc_id"]: x for x in toxicity.classify(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    learnt = {kind: sum(not got[k]["held_out"] for k, _, y in labels if y and kinds[k] == kind) for kind in ("rare", "xx", "common")}
    assert all(3 <= learnt[x] < learnt["common"] // 40 for x in ("rare", "xx")), learnt
    held = [k for k in got if got[k]["held_out"]]
    for kind, least in (("rare", 1.0), ("xx", 1.0), ("common", 0.97)):
        own = [got[k]["predicted"] for k in held if kinds[k] == kind]
        assert len(own) >= 5 and sum(own) / len(own) >= least, kind
    assert sum(got[k]["predicted"] for k in held if kinds[k] == "clean") <= 0.02 * len(held)


def windows_of(sentence, length):
    """(letters, word of each letter, whether each ends its word) from the beginning of every word on."""
    words = re.findall(r"[^\W\d_]+", sentence.lower())
    letters = [(c, k, i == len(w) - 1) for k, w in enumerate(words) for i, c in enumerate(w)]
    first = [sum(map(len, words[:k])) for k in range(len(words))]
    return [letters[a : a + length] for a in first]


def kernel_by_definition(window, mark, decay, apart):
    """All places of mark in window, from its first letter on; those that leave the first word must end one."""
    from itertools import combinations

    total = 0.0
    for at in combinations(range(len(window)), len(mark)):
        if at[0] or any(window[i][0] != c for i, c in zip(at, mark)):
            continue
        between = at[-1] + 1 - len(mark)
        if window[at[-1]][1] == window[0][1]:
            total += decay**between
        elif window[at[-1]][2]:
            total += apart * decay**between
    return total


def test_nystrom_features_against_definition():
    import numpy as np

    marks = ["idiot", "idiots", "scum", "stupid", "clown"]
    machine = toxicity.Machine(marks)
    texts = ["an idixot. You sc um\nscxum, scum", "closer to the crown", "", "st-upixd stuxpid i d i o t s", "IDIIOT scuum clown s"]
    sentences = [(k, s) for k, t in enumerate(texts) for s in re.split(r"\n|[.!?]\s", t)]
    raw = np.array([[[max([kernel_by_definition(w, m, *k) for w in windows_of(s, len(m) + toxicity.spare(len(m)))], default=0.0) for m in marks] for _, s in sentences] for k in machine.kernels])
    grams = []
    for kernel in machine.kernels:
        held = np.array([[kernel_by_definition([(c, 0, False) for c in a[: len(b) + toxicity.spare(len(b))]], b, *kernel) if len(a) >= len(b) and a[0] == b[0] else 0 for b in marks] for a in marks])
        value, vector = np.linalg.eigh(held @ held.T)
        grams.append(held.T @ vector @ np.diag(np.maximum(value, 1e-6) ** -0.5) @ vector.T)
    want = np.concatenate([x @ g for x, g in zip(raw, grams)], 1)
    own, got, text = machine.nystrom([t.encode() for t in texts])
    assert [k for k, _ in sentences] == text[: len(sentences)].tolist()
    assert own.tolist() == np.flatnonzero(raw.sum((0, 2))).tolist()
    assert np.allclose(got, want[own])
    assert (raw[0] > 0).any() and (raw[1] > raw[0]).any()


def test_the_kernel_matrix_has_no_negative_eigenvalue():
    import numpy as np

    for marks in (["abc", "abcd", "abce"], ["idi", "idiot", "idiots", "scum"], ["aaa", "aaaa", "aaaaaa", "aab"]):
        machine = toxicity.Machine(marks)
        for kernel in machine.kernels:
            counts = machine.counts(*kernel)
            assert np.linalg.eigvalsh(counts @ counts.T).min() > -1e-9


def test_toxicity_with_a_long_labelled_text(spark):
    """One text, however long and wherever it stands by hash, takes no other text's place in the sample."""
    rows, labels = labelled(2)
    docs, lab = table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    short = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, lab).collect()}
    for toxic in (0, 1):
        long = [(k, 1, toxic, "x") for k in range(1000, 1060)]  # some of them come first by hash
        texts = [(k, "plain words of no kind. " * 450_000 if k == 1007 else "plain words. ") for k, *_ in long]
        found = toxicity.classify(table(spark, rows + texts), spark.createDataFrame(labels + (long if toxic == 0 else long[7:8]), lab.schema))
        got = {r["doc_id"]: r["score"] for r in found.collect()}
        assert sum((got[k] >= 0.7) != (short[k] >= 0.7) for k in short) <= 0.01 * len(short), toxic


def test_toxicity_of_short_texts_of_one_pattern(spark):
    """What tells the texts of a pattern apart is the insult: they are no copies."""
    r = random.Random(3)
    names, insults = vocabulary(4, 200), ["moron", "dunderhead", "nincompoop", "fopdoodle", "blatherskite"]
    said = lambda x: f"You are such a {x}, really {r.choice(names).title()}."
    rows = [(k, said(insults[k % 5])) for k in range(60)] + [(k, said(r.choice(["friend", "treasure", "help", "star"]))) for k in range(60, 400)]
    labels = [(k, 1, int(k < 60)) for k in range(400)]
    got = {x["doc_id"]: x for x in toxicity.classify(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[k]["predicted"] == 1 for k in range(60)) and not any(got[k]["predicted"] for k in range(60, 400))
    assert len(toxicity.without_copies([{"a", "b", x} for x in ("c", "d")])) == 2 and len(toxicity.without_copies([{"a", "b", "c"}] * 3)) == 1


def test_language_scores_depend_on_the_text_alone(spark):
    r = random.Random(4)
    rows = [(k, " ".join(r.choice(LANGUAGES[c]) for _ in range(r.randint(1, 40))), c) for k in range(300) for c in [r.choice(list(LANGUAGES))]]
    rows += [(1000 + k, "no", None) for k in range(40)] + [(2000 + k, "der the\n la ", None) for k in range(20)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    results = []
    for seed, parts in ((1, 1), (2, 7), (3, 3)):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts)
        results.append({x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.predict(docs, model).collect()})
    assert results[0] == results[1] == results[2]
    assert len({results[0][1000 + k] for k in range(40)}) == len({results[0][2000 + k] for k in range(20)}) == 1


def test_quality(spark):
    rows, labels = labelled(7)
    rows += [(901, None), (902, ""), (None, "x y z")]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    n, got = by_doc(quality.classify(table(spark, rows), lab).select("doc_id", "held_out", "score", "predicted"))
    assert n == len(rows)
    held = [(got[k][2], y) for k, y, _, _ in labels if got[k][0]]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert all(0 <= v[1] <= 1 for v in got.values())
    none = spark.createDataFrame([], lab.schema)
    assert {r["score"] for r in quality.classify(table(spark, rows[:3]), none).collect()} == {0.5}


def test_workers_need_no_copy_of_the_package(tmp_path):
    """All operators in a Python that finds the package only on the driver."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    program = f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path / "c")!r}).config("spark.sql.warehouse.dir", {str(tmp_path / "w")!r}).getOrCreate()
from lectern.llm.queries import QUERIES
for name, query in QUERIES.items():
    print(name, query(spark, "/root/testdata/sf0.001").count(), flush=True)
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME_PYTHONPATH")}
    done = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(done.stdout.splitlines()) == len(queries.QUERIES), done.stdout


def test_empty_tables(spark):
    docs = table(spark, [])
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    results = [toxicity.classify(docs, lab), pieces.encode(docs, queries.piece_model()), lines.drop_common(docs), jaccard.join(docs), langid.identify(docs), passages.remove_repeats(docs), bytespans.remove_repeats(docs), quality.classify(docs, lab), perplexity.judge(docs), decontam.find_leaks(docs, bench)]
    assert [df.count() for df in results] == [0] * 10
    assert decontam.find_leaks(table(spark, corpus(1)), bench).count() == 0
