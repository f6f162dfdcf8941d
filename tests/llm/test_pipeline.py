"""The pipeline on a small corpus: each stage against what brute force keeps."""

import hashlib

import pytest
from test_operators import components_of, corpus, labelled, shingles

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    texts, labels = labelled(11, 300)
    more = [(i + 1000, t) for i, t in corpus(4) if i is not None]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in [*texts, *more]]
    rows += [(None, "clean words that nobody else has written here", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(a, b, c) for a, b, c, _ in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    leak = " ".join(more[0][1].split(" ")[:20]) if more[0][1] else "none of these words are there at all"
    spark.createDataFrame([(1, leak), (2, "no text has this item of seven words")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), leak, {a for a, _, c, _ in labels if c}


def test_stages(spark, tables):
    folder, leak, toxic = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = corpus_pipeline.written(stage(spark, docs, folder), name)
        after = {r["doc_id"]: r for r in out.collect()}
        if name != "sentencepiece":
            assert out.columns == columns
            assert set(after) <= set(before)
            assert None in after
        gone = set(before) - set(after)
        if name == "toxicity":
            assert len(gone & toxic) >= 0.95 * len(toxic) and not gone - toxic
        elif name == "line_dedup":
            assert not gone
            assert all(r["text"] == before[i] or r["n_chars"] == len(r["text"]) for i, r in after.items())
        elif name == "ngram_jaccard":
            want = components_of({i: t or "" for i, t in before.items() if i is not None})
            assert gone == {i for i, (_, c) in want.items() if c != i}
            assert out.count() == len(after)
        elif name == "decontamination":
            item = shingles(leak)
            assert gone == {i for i, t in before.items() if i is not None and 100 * len(item & shingles(t or "")) >= 75 * len(item)}
        else:
            assert set(after) == set(before)
            assert all(r["decoded_sha256"] == hashlib.sha256((before[i] or "").encode()).hexdigest() for i, r in after.items())
        docs = out


def test_run(spark, tables):
    out = corpus_pipeline.run(spark, tables[0])
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < out.count() < 340


def test_rows_that_share_a_doc_id_and_clashing_columns(spark, tmp_path):
    """Each row loses its own lines; of equal rows one stays; columns named like the operators' own stay as they are."""
    line = "a line of more than twenty characters"
    rows = [(1, line), (2, line), (3, line), (3, "BBBB keep me"), (3, "BBBB keep me"), (4, None), (None, line)]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int, row string, kept string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.drop_lines(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "-", r["n_chars"], r["row"], r["kept"]) for r in out.collect()) == sorted((i or 0, "-" if i in (1, 2) else t or "-", 0 if i in (1, 2) else len(t or ""), "r", "k") for i, t in rows)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert sorted((r["doc_id"] or 0, r["text"] or "-") for r in out.collect()) == [(0, line), (1, line), (4, "-")]


def test_run_on_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
