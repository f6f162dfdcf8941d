"""The data sources: papers as papers.papers reads them, as a stream, and exports that come whole or not at all."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lectern.sources import connector, papers


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    connector.register(spark)


def fill(root):
    for k in range(40):
        folder = root / f"p{k:02}"
        (folder / "sections").mkdir(parents=True)
        (folder / "main.tex").write_text(f"\\begin{{document}}Paper {k} \\input{{sections/intro}} \\input{{gone}}\\end{{document}}")
        (folder / "sections" / "intro.tex").write_text(f"intro {k} % a note\n")
    (root / "none").mkdir()
    (root / "none" / "readme.md").write_text("no paper")
    latin = root / "latin"
    latin.mkdir()
    (latin / "b.tex").write_bytes("\\usepackage[latin1]{inputenc} caf\u00e9".encode("latin-1"))
    (latin / "c.tex").write_bytes(b"\\begin{document} caf\xe9 \\input{b}")
    (root / "stray.tex").write_text("no paper")


def test_reading_is_what_papers_gives(spark, tmp_path):
    fill(tmp_path)
    want = sorted(map(tuple, papers.papers(spark, str(tmp_path)).collect()))
    got = spark.read.format("papers").option("folders_a_task", "3").load(str(tmp_path))
    assert sorted(map(tuple, got.collect())) == want and len(want) == 41
    assert got.rdd.getNumPartitions() == 14
    strict = spark.read.format("papers").option("strict", "true").load(f"file://{tmp_path}").where("doc_id = 'p07'").first()
    assert "% a note" in strict["text"]


def test_stream_takes_each_change_once(spark, tmp_path):
    root = tmp_path / "in"
    seen = []

    def go():
        query = spark.readStream.format("papers").load(str(root)).writeStream.foreachBatch(lambda b, n: seen.append(sorted(r["doc_id"] for r in b.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
        query.awaitTermination()

    for name, when in (("a", 100), ("b", 200)):
        (root / name).mkdir(parents=True)
        (root / name / "main.tex").write_text(name)
        os.utime(root / name / "main.tex", (when, when))
    go()
    go()
    (root / "c").mkdir()
    (root / "c" / "main.tex").write_text("c")
    os.utime(root / "c" / "main.tex", (300, 300))
    os.utime(root / "a" / "main.tex", (301, 301))  # changed, so taken again
    go()
    assert [x for x in seen if x] == [["a", "b"], ["a", "c"]]


def files(folder):
    return {p.name: p.read_text() for p in folder.iterdir()} if folder.exists() else {}


def test_writing(spark, tmp_path):
    target = tmp_path / "out"
    rows = spark.createDataFrame([(f"a/{k}", json.dumps({"k": k})) for k in range(9)] + [(None, "{}"), ("x", None)], "name string, body string").repartition(3)
    rows.write.format("paper_files").mode("append").save(str(target))
    assert files(target) == {f"a_{k}.json": json.dumps({"k": k}) for k in range(9)}
    more = spark.createDataFrame([("a/1", "[1]"), ("new", "[2]")], "name string, body string")
    more.write.format("paper_files").mode("append").save(str(target))
    assert len(files(target)) == 10 and files(target)["a_1.json"] == "[1]"
    more.write.format("paper_files").option("ending", "dot").mode("overwrite").save(str(target))
    assert files(target) == {"a_1.dot": "[1]", "new.dot": "[2]"}


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    target = tmp_path / "out"
    good = spark.createDataFrame([("kept", "{}")], "name string, body string")
    good.write.format("paper_files").mode("append").save(str(target))
    rows = spark.range(200).select(F.col("id").cast("string").alias("name"), F.when(F.col("id") == 150, "not json").otherwise("{}").alias("body")).repartition(4)
    with pytest.raises(Exception, match="JSON|Expecting"):
        rows.write.format("paper_files").mode("overwrite").save(str(target))
    assert files(target) == {"kept.json": "{}"}
