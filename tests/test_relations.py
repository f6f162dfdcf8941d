"""Relationships kept in a stream's state: restarts, late and repeated changes, expiry, and a state to begin with."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import graph
from lectern.streaming import edges, relations


@pytest.fixture
def rocks(spark):
    was = spark.conf.get(relations.STORE[0])
    spark.conf.set(*relations.STORE)
    yield
    spark.conf.set(relations.STORE[0], was)


def at(minute):
    return F.timestamp_seconds(F.lit(1_700_000_000) + minute * 60)


def add(spark, folder, rows):
    """rows: (src, dst, change, minute, label), as one file more."""
    made = spark.createDataFrame([(s, t, "Citation", c, m, x) for s, t, c, m, x in rows], "src string, dst string, edge_type string, change string, minute long, label string")
    made.select("src", "dst", "edge_type", "change", at(F.col("minute")).alias("at"), "label").coalesce(1).write.mode("append").parquet(folder)


class Run:
    """Triggers over a folder, each a new query on the same checkpoint."""

    def __init__(self, spark, path, **options):
        self.spark, self.path, self.options, self.rows = spark, path, options, []

    def go(self, rows):
        add(self.spark, f"{self.path}/in", rows)
        stream = relations.relationships(edges.changes(self.spark, f"{self.path}/in"), **self.options)

        def keep(batch, number):
            self.rows += [(number, *r) for r in batch.collect()]

        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return {(r[1], r[2], r[4], r[5], r[6]) for r in self.rows if r[0] == self.rows[-1][0]} if self.rows else set()


def test_restarts_late_and_repeated_changes(spark, tmp_path, rocks):
    run = Run(spark, str(tmp_path), late="10 minutes", retention="1 day")
    assert run.go([("a", "b", "Added", 10, "x"), ("a", "c", "Added", 10, "y"), ("a", None, "Added", 10, "y")]) == {("a", "b", "x", True, "added"), ("a", "c", "y", True, "added")}
    n = len(run.rows)
    run.go([("a", "b", "Added", 10, "x"), ("a", "c", "Removed", 9, "y"), ("a", "d", "Removed", 12, "z")])  # repeated, late, never there
    assert len(run.rows) == n
    assert run.go([("a", "b", "Removed", 15, "x"), ("a", "c", "Added", 15, "new")]) == {("a", "b", "x", False, "removed"), ("a", "c", "new", True, "changed")}
    n = len(run.rows)
    run.go([("e", "f", "Added", 1, "late")])  # before the watermark
    run.go([("a", "c", "Added", 16, "new")])  # lives already
    assert len(run.rows) == n


def test_expiry(spark, tmp_path, rocks):
    run = Run(spark, str(tmp_path), late="1 minute", retention="60 minutes")
    run.go([("a", "b", "Added", 0, "x"), ("a", "c", "Added", 0, "y"), ("a", "d", "Removed", 0, "z")])
    run.go([("a", "c", "Added", 50, "y")])  # puts its expiry off
    run.go([("q", "r", "Added", 70, "w")])
    run.go([("q", "r", "Added", 71, "w")])  # the watermark is past an hour now
    assert [r[1:3] + r[4:7] for r in run.rows if r[6] == "expired"] == [("a", "b", "x", False, "expired")]
    assert run.go([("a", "b", "Added", 75, "x")]) >= {("a", "b", "x", True, "added")}


def test_state_to_begin_with(spark, tmp_path, rocks):
    before = spark.createDataFrame([("a", "b", "Citation", "x", 5)], "src string, dst string, edge_type string, label string, minute long").withColumn("at", at(F.col("minute")))
    run = Run(spark, str(tmp_path), before=before)
    assert run.go([("a", "b", "Added", 10, "x"), ("a", "c", "Added", 10, "y")]) == {("a", "c", "y", True, "added")}
    assert run.go([("a", "b", "Removed", 11, "x")]) == {("a", "b", "x", False, "removed")}


def test_what_lives_at_the_end_is_what_the_batch_operator_says(spark, tmp_path, rocks):
    r = random.Random(3)
    changes = [(f"n{r.randrange(4)}", f"n{r.randrange(4)}", r.choice(["Added", "Added", "Removed"]), m, f"l{r.randrange(3)}") for m in r.sample(range(200), 90)]
    run = Run(spark, str(tmp_path), late="10 hours")
    for k in range(0, 90, 30):
        run.go(changes[k : k + 30])
    reports = spark.createDataFrame([(b, s, t, e, x, on, why, when) for b, s, t, e, x, on, why, when in run.rows], f"batch int, {relations.REPORT}")
    table = spark.createDataFrame([(s, t, "Citation", c, m, x) for s, t, c, m, x in changes], "src string, dst string, edge_type string, change string, at long, label string")
    want = {(x["src"], x["dst"]) for x in graph.latest_relationships(table).collect()}
    assert {(x["src"], x["dst"]) for x in relations.live(reports).collect()} == want and want


def test_the_store_is_asked_for(spark, tmp_path):
    add(spark, str(tmp_path / "in"), [("a", "b", "Added", 1, "x")])
    with pytest.raises(ValueError, match="RocksDB"):
        relations.relationships(edges.changes(spark, str(tmp_path / "in")))
