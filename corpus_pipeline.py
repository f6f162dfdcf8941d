"""A training-data pipeline over the documents table, five stages on the operators of lectern.llm.

  toxicity           documents that the string-kernel machine calls toxic go (learnt from the labels table)
  line_dedup         lines that three documents or more share go, but in the largest doc_id that has them
  ngram_jaccard      of each group of near-duplicates the document with the smallest doc_id stays
  decontamination    documents that contain a benchmark item go
  sentencepiece      what is left is encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256

Each stage works on all that the one before kept. All but the last return the columns of documents; where a stage changes
a text, n_chars follows it. Null texts stay null, and documents without doc_id pass the stages that need one. Rows that
share a doc_id are one document: one toxic or leaking text takes all of them out, each loses the lines of its own text, and
of rows equal in doc_id and text one stays. Empty tables give empty results; without labels nothing is toxic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontam, jaccard, lines, pieces, queries, toxicity
from lectern.llm._common import read, written


def _only(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs with (left_semi) or without (left_anti) the keys' doc_ids; columns as they were."""
    return docs.join(keys.select("doc_id").distinct(), "doc_id", how).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    toxic = toxicity.classify(docs, read(spark, sf_dir, "labels")).where("predicted = 1")
    return _only(docs, toxic, "left_anti")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shorter = lines.drop_common(docs).where("n_dropped > 0").select("doc_id", "row", "kept").dropDuplicates(["doc_id", "row"])
    own, kept = ("_".join([name, *docs.columns]) for name in ("row", "kept"))  # names that docs doesn't have
    shorter = shorter.withColumnsRenamed({"row": own, "kept": kept})
    out = docs.withColumn(own, lines.row_of("doc_id", "text")).join(shorter, ["doc_id", own], "left")
    n_chars = F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.char_length(kept))
    out = out.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).withColumn("text", F.coalesce(kept, "text"))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = _only(docs, jaccard.join(docs).where("component_id <> doc_id"), "left_anti")
    # repeated rows are one document and one stays; other texts of its doc_id belong to it and stay with it
    return kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id IS NULL"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only(docs, decontam.find_leaks(docs, read(spark, sf_dir, "benchmark")), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.piece_digests(pieces.encode(docs, queries.piece_model()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]

#: The first stage is a learnt model, which SQL can't express; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
