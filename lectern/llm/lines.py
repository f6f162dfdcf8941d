r"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations only.

A line's key is the line without ASCII white space at both ends and with A-Z lower-cased; it is held as two 64-bit
hashes. Documents come in batches. A batch's keys are merge-anti-joined with the runs: those no run holds become a run of
their own (key, documents that hold it, largest doc_id), so every key is in one run, that of the batch it was first seen
in; those that a run holds go to the returns, counts to be added to the key's. When a level has fanout runs, they are
merged into one run of the next level, so a key is rewritten once per level. Runs are bucketed and sorted by key: the
joins with them move and sort the batch's few keys only. Texts are read twice, for their keys and for what is kept.

drop_common: keys of at least min_chars code points that min_docs documents hold lose all their lines, except in the
document with the largest doc_id among those. Documents are told apart by doc_id, lines are dropped row by row.

Defined cases: null or empty text is one empty line; a document given twice, or rows that share a doc_id but not a text,
count as one document, and each row loses its own lines; a null doc_id is no document and keeps its lines; the largest
doc_id settles what stays, so there are no ties; white-space-only texts keep their lines, as keys are then empty; a very
long text is one array of lines in one task, whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bucketed, columns, drop_table, scratch_path

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(BLANK))
    # lower() takes a byte-wise path on ASCII strings; others must keep their accented capitals
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed(keys: DataFrame) -> DataFrame:
    """h1, h2 in place of key."""
    return keys.withColumns({"h1": F.xxhash64("key"), "h2": F.xxhash64(F.lit(7), "key")}).drop("key")


def row_of(doc_id: str, text: str) -> Column:
    """What tells texts of one doc_id apart."""
    return F.xxhash64(doc_id, text)


def line_places(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, row, at, h1, h2) of every line of min_chars code points or more; row tells texts of one doc_id apart."""
    placed = docs.select("doc_id", row_of("doc_id", "text").alias("row"), F.posexplode(F.transform(split_lines(F.col("text")), line_key)).alias("at", "key"))
    return hashed(placed.where(F.char_length("key") >= min_chars))


class LineRuns:
    """Sorted runs (h1, h2, n_docs, last_doc) by level, as bucketed tables in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 2) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.returns: list[str] = []

    def _write(self, run: DataFrame) -> str:
        """run as a table of buckets sorted by key; its name."""
        dealt = run.repartition(self.buckets, "h1", "h2").sortWithinPartitions("h1", "h2")
        return bucketed(dealt, "lines", self.buckets, ["h1", "h2"])

    def _drop(self, name: str) -> None:
        drop_table(self.spark, name)

    def _tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows whose key no run holds yet."""
        for run in self._tables():
            keys = keys.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """Take in one batch of (doc_id, h1, h2), all rows of a doc_id in one batch; merge full levels."""
        held = keys.where("doc_id IS NOT NULL").select("doc_id", "h1", "h2").distinct()
        counted = held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
        if any(self.levels):
            batch = self._write(counted)
            counted = self.spark.table(batch)
            fresh = self._write(self.unseen(counted))
            again = counted.join(self.spark.table(fresh).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
            self.returns.append(scratch_path(self.spark, "returns"))
            again.write.parquet(self.returns[-1])
            self._drop(batch)
        else:
            fresh = self._write(counted)
        self.levels[0].append(fresh)
        for k, level in enumerate(self.levels):
            if len(level) < self.fanout:
                break
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(self._write(reduce(DataFrame.unionByName, map(self.spark.table, level))))
            for name in level:
                self._drop(name)
            self.levels[k] = []

    def counts(self) -> DataFrame:
        """Every key once, with the documents of all batches."""
        runs = reduce(DataFrame.unionByName, self._tables())
        if not self.returns:
            return runs
        again = self.spark.read.schema("h1 long, h2 long, n_docs long, last_doc long").parquet(*self.returns)
        again = again.groupBy("h1", "h2").agg(F.sum("n_docs").alias("more"), F.max("last_doc").alias("later"))
        joined = runs.join(again, ["h1", "h2"], "left")
        return joined.select("h1", "h2", (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "later").alias("last_doc"))


def keep_unseen(runs: LineRuns, docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(doc_id, h1, h2) of this batch's keys that no earlier batch held; the batch then joins the runs."""
    keys = line_places(columns(docs, "doc_id", "text"), min_chars).select("doc_id", "h1", "h2").distinct()
    fresh_path = scratch_path(runs.spark, "unseen")
    runs.unseen(keys).select("doc_id", "h1", "h2").write.parquet(fresh_path)  # before the batch's own run is there
    runs.add(keys)
    return runs.spark.read.schema("doc_id long, h1 long, h2 long").parquet(fresh_path)


def drop_common(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """(doc_id, row, n_lines, n_dropped, kept): each whole text without its common lines."""
    spark = docs.sparkSession
    docs = columns(docs, "doc_id", "text")
    path = scratch_path(spark, "places")
    line_places(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))).write.partitionBy("batch").parquet(path)
    placed = spark.read.schema("doc_id long, row long, at int, h1 long, h2 long, batch int").parquet(path)
    runs = LineRuns(spark, fanout)
    for b in range(batches):
        runs.add(placed.where(F.col("batch") == b))
    common = runs.counts().where(F.col("n_docs") >= min_docs).select("h1", "h2", "last_doc")
    dropped = placed.join(common, ["h1", "h2"]).where(F.col("doc_id") != F.col("last_doc"))
    dropped = dropped.groupBy("doc_id", "row").agg(F.collect_set("at").alias("dropped"))
    # the lines are cut before the join, so that the lambda below reads a column and doesn't split anew for each line
    joined = docs.select("doc_id", row_of("doc_id", "text").alias("row"), split_lines(F.col("text")).alias("lines")).join(dropped, ["doc_id", "row"], "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "dropped")
    kept = F.when(F.col("dropped").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return joined.select("doc_id", "row", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
c AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20
      GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, coalesce(k.doc_id <> c.last_doc, false) AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
