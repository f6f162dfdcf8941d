"""Streams of edge changes and of new papers. An extension: the batch operators do the same on tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

CHANGE = "src string, dst string, edge_type string, change string, at timestamp, label string"


def changes(spark: SparkSession, folder: str, files_a_trigger: int = 10) -> DataFrame:
    """A stream of edge changes (Added, Removed) from Parquet files in a folder."""
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def deduplicated(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each change once, also when it comes again within the watermark."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["src", "dst", "edge_type", "change", "at"])


def change_counts(stream: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, edge_type, change, n) of changes by event time."""
    counted = stream.withWatermark("at", late).groupBy(F.window("at", window), "edge_type", "change").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), "edge_type", "change", "n")


def current_edges(stream: DataFrame) -> DataFrame:
    """(src, dst, edge_type, label, live) whenever an edge's latest state changes; state is one row a key."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, live = state.get if state.exists else (pd.Timestamp.min.value // 1000, False)
        label, moved = None, False
        for batch in batches:
            for row in batch.sort_values("at").itertuples():
                now = row.at.value // 1000
                if now >= at:
                    at, live, label, moved = now, row.change != "Removed", row.label, True
        state.update((at, live))
        if moved:
            yield pd.DataFrame([(*key, label, live)], columns=["src", "dst", "edge_type", "label", "live"])

    return stream.groupBy("src", "dst", "edge_type").applyInPandasWithState(follow, "src string, dst string, edge_type string, label string, live boolean", "at long, live boolean", "update", "NoTimeout")


def observed(stream: DataFrame, observers: list[Callable[[DataFrame, int], None]], checkpoint: str) -> StreamingQuery:
    """Hands every micro-batch to each observer; one that fails is dropped and the others go on."""
    left = list(observers)

    def notify(batch: DataFrame, number: int) -> None:
        batch.persist()
        for observer in list(left):
            try:
                observer(batch, number)
            except Exception:  # noqa: BLE001 - an observer's failure is its own
                left.remove(observer)
        batch.unpersist()

    return stream.writeStream.foreachBatch(notify).option("checkpointLocation", checkpoint).start()


def new_papers(spark: SparkSession, root: str, files_a_trigger: int = 10) -> DataFrame:
    """A stream of .tex files (doc_id, path, content) as they appear in the folders below root."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.tex").option("maxFilesPerTrigger", files_a_trigger).load(f"{root.rstrip('/')}/*/*")
    return files.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("doc_id"), "path", "content")
