"""Splitting, flattening, embedding, storing and searching; entities; papers from folders; streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import entities, retrieval
from lectern.plans import catalog
from lectern.sources import documents, papers, tables
from lectern.streaming import edges


def greedy(value, most, strict):
    out, held = [], []
    for w in value.split():
        if len(" ".join([*held, w]).encode()) > most and (held or strict):
            out.append(" ".join(held))
            held = []
        held.append(w)
    return out + ([" ".join(held)] if held else [])


@pytest.mark.parametrize("strict", [True, False])
def test_split_text(spark, strict):
    texts = ["aa bb cccc", "abcdefgh", "", "  ", "é é é é x", "a bbbbbbbbb c", "one two three four five six seven"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, content string")
    by_expression = {r["k"]: r["c"] for r in rows.select("k", retrieval.split_text(F.col("content"), 5, strict).alias("c")).collect()}
    by_rows = {}
    for r in retrieval.chunked(rows, 5, strict).orderBy("k", "chunk").collect():
        by_rows.setdefault(r["k"], []).append(r["content"])
    for k, t in enumerate(texts):
        assert by_expression[k] == greedy(t, 5, strict), t
        assert by_rows.get(k, []) == greedy(t, 5, strict), t
    if strict:
        assert by_expression[1] == ["", "abcdefgh"]


def test_names(spark):
    rows = spark.createDataFrame([("index-My Paper_1",), ("___",), ("Ünï",)], "n string")
    assert [r[0] for r in rows.select(text.index_name(F.col("n"))).collect()] == ["index-my-paper-1", "default-index", "n"]
    assert retrieval.text_index_name("index-My Paper_1") == "index-my-paper-1"
    assert spark.range(1).select(text.safe_filename(F.lit("a/b\\c"))).first()[0] == "a_b_c"


DOCUMENT = {
    "document": {
        "metadata": {"authors": [{"name": "A", "affiliations": ["U", "V"]}, {"name": "B", "affiliations": ["U"]}]},
        "content": [{"section": "Intro", "type": "section", "content": " some words here ", "references": [{"label": "r1"}], "figure_caption": "cap", "image_file": "f.png"}, {"content": "other words there"}],
    }
}


def test_index_and_search(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/My Doc.json").write_text(json.dumps(DOCUMENT))
    (tmp_path / "in/bad.json").write_text("{not json")
    read = documents.documents(spark, str(tmp_path / "in"))
    assert {r["source_file"]: r["document"] is None for r in read.collect()} == {"My Doc": False, "bad": True} or read.count() == 2
    sections = retrieval.flattened(read.where("document IS NOT NULL")).orderBy("place").collect()
    assert sections[0]["content"] == "some words here\nFigure Caption: cap\nImage File: f.png"
    assert (sections[0]["authors"], sections[0]["affiliations"], sections[0]["references"]) == (["A", "B"], ["U", "V"], ["r1"])
    assert (sections[1]["section_title"], sections[1]["document_title"]) == ("Section 2", "Title not listed.")
    rows = retrieval.vector_rows(retrieval.flattened(read.where("document IS NOT NULL")))
    assert {(r["index_name"], r["id"]) for r in rows.collect()} == {("index-my-doc", "My Doc_section_1_chunk_1"), ("index-my-doc", "My Doc_section_2_chunk_1")}
    embed = retrieval.hashing_embedder(64)
    path = str(tmp_path / "vectors")
    for _ in range(2):
        retrieval.store(retrieval.embedded(rows, embed), path)
    assert spark.read.parquet(path).count() == 2
    session = retrieval.Session(spark, path, embed, chat=lambda s, p, t: f" {len(p)} ").change_index("index-My Doc").set_temperature(0.5)
    best = session.query("other words there").orderBy("place").first()
    assert best["id"] == "My Doc_section_2_chunk_1" and abs(best["score"] - 1) < 1e-6
    said = retrieval.prompt(retrieval.contexts(session.query("words")), "words", ["index_name", "place"]).first()["prompt"]
    assert said.startswith("Context:\n### Source: My Doc\nSection Title: ") and said.endswith("\n\nQuestion:\nwords\n\nAnswer:")
    assert session.answer("words") == str(len(said))
    with pytest.raises(ValueError):
        session.query("  ")
    with pytest.raises(ValueError):
        session.set_temperature(1.5)
    retrieval.delete_indexes(spark, path)
    assert not (tmp_path / "vectors").exists()


def test_metadata_cap(spark):
    rows = spark.createDataFrame([("s", "t", ["a"], ["b"], 1, "x", "y", ["r"], "c", "i", "word " * 20)], "source_file string, document_title string, authors array<string>, affiliations array<string>, place int, section_title string, section_type string, references array<string>, figure_caption string, image_file string, content string")
    assert retrieval.vector_rows(rows, cap=100).count() == 0
    assert retrieval.vector_rows(rows, cap=1000).count() == 1


def test_many_queries(spark):
    rng = np.random.default_rng(1)
    vectors, queries = rng.normal(size=(60, 8)), rng.normal(size=(3, 8))
    rows = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], "id long, embedding array<float>")
    exact = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ (queries / np.linalg.norm(queries, axis=1, keepdims=True)).T
    got = {(r["query"], r["place"]): r["id"] for r in retrieval.nearest_many(rows.repartition(4), queries, k=4).collect()}
    for q in range(3):
        assert [got[q, p] for p in range(1, 5)] == np.argsort(-exact[:, q])[:4].tolist()


@pytest.mark.parametrize("name", ["knn_top5_of_many", "knn_top5_per_index_of_many", "similar_nodes_members", "related_concepts_of_all"])
def test_whole_tables_against_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.01"
    db = duckdb.connect()
    for t in ("embeddings", "part", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, folder)
    sql = db.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert len(sql) >= 50
    shown = lambda rows: sorted(tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in rows)
    assert shown(tuple(r) for r in got.collect()) == shown(sql)


def test_many_queries_in_blocks_per_index(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(90, 6))
    rows = spark.createDataFrame([(k, [float(x) for x in v], k % 3) for k, v in enumerate(vectors)], "id long, embedding array<double>, part int")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    exact = unit @ unit.T
    got = {(r["query"], r["part"], r["place"]): r["id"] for r in retrieval.nearest_in_blocks(rows.repartition(3), rows.where("id % 10 = 0"), k=4, index="part", block=2).collect()}
    assert len(got) == 9 * 3 * 4
    for q, i, p in got:
        own = np.flatnonzero(np.arange(90) % 3 == i)
        assert got[q, i, p] == own[np.argsort(-exact[own, q])][p - 1]
    assert retrieval.nearest_in_blocks(rows, rows.where("id < 0")).count() == 0


def test_chain_model():
    model = entities.ChainModel().fit(rounds=30)
    assert model.predict([("WORD=John", "CAP"), ("WORD=Doe", "CAP")]) == ["AUTHOR", "AUTHOR"]
    assert model.predict([]) == []
    assert entities.ChainModel().predict([("x",), ("y",)]) == ["O", "O"]
    # the gradient is that of the likelihood
    model = entities.ChainModel().fit(rounds=2)
    sequence, labels = entities.DEFAULT_SEQUENCES[0]
    gradient, loss = model.gradient(sequence, labels)
    key = (1, "CAP")
    model.weights[key] += 1e-5
    assert abs((loss - model.gradient(sequence, labels)[1]) / 1e-5 - gradient[key]) < 1e-3
    up, down = entities.ChainModel().fit(), entities.ChainModel().fit(strict=True)
    assert up.gradient(sequence, labels)[1] < entities.ChainModel().gradient(sequence, labels)[1] < down.gradient(sequence, labels)[1]


def test_entities(spark):
    tokens = spark.createDataFrame([("d", k, w) for k, w in enumerate("x Ann  Bo y Uni".split(" "))], "doc_id string, ord int, value string")
    marked = tokens.withColumn("label", F.when(F.col("ord").isin(1, 2, 3), "AUTHOR").when(F.col("ord") == 5, "AFFILIATION").otherwise("O"))
    got = [(r["ord"], r["kind"], r["value"]) for r in entities.runs(marked).orderBy("ord").collect()]
    assert got == [(1, "authors", "AnnBo"), (5, "affiliations", "Uni")]
    first = entities.features(tokens).orderBy("ord").first()["features"]
    assert first == ["WORD=x", "NOT_CAP", "PREV_WORD=BOS", "NEXT_WORD=Ann"]
    assert entities.labelled(entities.features(tokens), entities.ChainModel().fit()).count() == 6
    found = entities.matches(spark.createDataFrame([("d", "\\affiliation{A} \\affiliation [x] {B}")], "doc_id string, text string"))
    assert [r["value"] for r in found.orderBy("at").collect()] == ["A", "B"]


def test_documents_are_labelled_in_bounded_parts(spark, monkeypatch):
    """The labels of predict, however documents fall into parts; no part has more tokens than it should."""
    import random

    import pyarrow as pa

    r = random.Random(3)
    words = ["\\author", "John", "Doe", "\\affiliation", "SomeUniversity", "x", "\\institute", "AnotherInstitute", "Ann"]
    docs = [[[f"WORD={r.choice(words)}", r.choice(["CAP", "NOT_CAP", None])][: r.randint(0, 2)] for _ in range(n)] for n in [1, 7, 40, 3, 3, 0, 90, 2]]
    model = entities.ChainModel().fit()
    flat = pa.array([f for d in docs for f in d], pa.list_(pa.string()))
    found = [entities.LABELS[k] for k in model.best(model.scored(flat), entities.np.array([len(d) for d in docs]))]
    assert found == [x for d in docs for x in model.predict(d)] and len(set(found)) > 1
    parts, scored = [], entities.ChainModel.scored
    monkeypatch.setattr(entities.ChainModel, "scored", lambda self, features: parts.append(len(features)) or scored(self, features))
    monkeypatch.setattr(entities, "CELLS", 20)
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(len(docs))]), pa.array([[{"ord": k, "value": "v", "features": f} for k, f in enumerate(d)] for d in docs], pa.list_(pa.struct({"ord": pa.int32(), "value": pa.string(), "features": pa.list_(pa.string())})))], ["doc_id", "tokens"])
    runs = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, run, schema: runs.append(run))
    entities.labelled(spark.createDataFrame([], "doc_id string, ord int, value string, features array<string>"), model)
    out = pa.Table.from_batches(runs[0](iter([batch]))).to_pylist()
    assert [(x["doc_id"], x["ord"], x["label"]) for x in out] == [(str(i), k, y) for i, d in enumerate(docs) for k, y in enumerate(model.predict(d))]
    assert parts == [8, 40, 6, 90, 2]


def test_papers_include_files_of_subfolders_and_other_endings(spark, tmp_path):
    one = tmp_path / "one"
    (one / "sections" / "deep").mkdir(parents=True)
    (tmp_path / "stray.tex").write_text("not a paper")
    (one / "main.tex").write_text("\\begin{document}A \\input{sections/intro} \\input{plot.tikz} \\input{sections/gone}\\end{document}")
    (one / "plot.tikz").write_text("PLOT")
    (one / "sections" / "intro.tex").write_text("B \\input{deep/more}")
    (one / "sections" / "deep" / "more.tex").write_text("C")
    (one / "sections" / "main.tex").write_text("not the main file")
    got = [tuple(r) for r in papers.papers(spark, str(tmp_path)).select("doc_id", "text", "error").collect()]
    assert got == [("one", "\\begin{document}A B C PLOT \\input{sections/gone}\\end{document}", None)]


def test_papers(spark, tmp_path):
    one, two, three = (tmp_path / x for x in ("one", "two", "three"))
    for d in (one, two, three):
        d.mkdir()
    (tmp_path / "stray.tex").write_text("not a paper")
    (one / "main.tex").write_text("\\begin{document}A \\input{part} \\input{part} \\include{gone}%\\input{part}\nZ\\end{document}")
    (one / "part.tex").write_text("\\begin{document}B \\input{main}\\end{document}")
    (two / "a.tex").write_bytes("\\usepackage[latin1]{inputenc} caf\u00e9".encode("latin-1"))
    (two / "b.tex").write_text("\\begin{document}other")
    (three / "x.TEX").write_text("wrong ending")
    (three / "y.tex").write_bytes(b"only \xe9")
    got = {r["doc_id"]: r for r in papers.papers(spark, str(tmp_path)).collect()}
    assert set(got) == {"one", "two", "three"}
    assert got["one"]["text"] == "\\begin{document}A B   \\include{gone}\nZ\\end{document}"
    assert got["two"]["text"] == "\\begin{document}other"
    assert got["three"]["text"] == "only é"
    texts = {r["name"]: r for r in papers.utf8_texts(papers.tex_files(spark, str(tmp_path))).collect()}
    assert (texts["a.tex"]["encoding_declared"], texts["a.tex"]["text"]) == ("latin1", "\\usepackage[latin1]{inputenc} café")
    assert texts["main.tex"]["encoding_declared"] == "UTF-8"
    assert papers.include_edges(papers.utf8_texts(papers.tex_files(spark, str(tmp_path)))).count() == 5
    assert papers.converted(b"a\xff", "no-such-encoding") == ""
    assert papers.sniffed(b"") == "UNKNOWN"


def test_keyed_write(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "p string, k int, v string"
    tables.keyed_write(spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], schema), path, ["p", "k"], "p")
    tables.keyed_write(spark.createDataFrame([("a", 1, "z"), ("a", 2, "w")], schema), path, ["p", "k"], "p")
    assert {(r["p"], r["k"], r["v"]) for r in spark.read.parquet(path).collect()} == {("a", 1, "z"), ("a", 2, "w"), ("b", 1, "y")}


def test_streams(spark, tmp_path):
    rows = [("a", "b", "Citation", "Added", "2024-01-01 00:00:00", "x"), ("a", "b", "Citation", "Added", "2024-01-01 00:00:00", "x"), ("a", "b", "Citation", "Removed", "2024-01-01 00:30:00", "x"), ("a", "c", "Citation", "Added", "2024-01-01 00:10:00", "y")]
    made = spark.createDataFrame(rows, "src string, dst string, edge_type string, change string, at string, label string").withColumn("at", F.to_timestamp("at"))
    folder = str(tmp_path / "changes")
    made.coalesce(1).write.parquet(folder)
    stream = edges.changes(spark, folder)
    query = edges.current_edges(edges.deduplicated(stream)).writeStream.outputMode("update").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c1")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r["dst"], r["live"]) for r in spark.table("live").collect()} == {("b", False), ("c", True)}
    seen = []

    def bad(batch, number):
        raise ValueError

    watch = edges.observed(stream, [bad, lambda batch, number: seen.append(batch.count())], str(tmp_path / "c2"))
    watch.processAllAvailable()
    watch.stop()
    assert seen == [4]
    counts = edges.change_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c3")).start()
    counts.processAllAvailable()
    counts.stop()
    assert {(r["change"], r["n"]) for r in spark.table("counts").collect()} == {("Added", 3), ("Removed", 1)}
