"""What the operators share: their input columns, the held-out fold, bounded training samples."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import bucketed, drop_scratch, drop_table, scratch_path, written
from ..sources.tables import table as read

__all__ = ["bucketed", "columns", "drop_scratch", "drop_table", "held_out", "read", "scratch_path", "shared", "shuffles_freed", "training_keys", "written"]


def shared(spark: SparkSession, thing: Any) -> Callable[[], Any]:
    """thing, sent to all tasks with the code of its classes, so that workers need no copy of the package."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    return lambda: pickle.loads(sent.value)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files: Spark deletes each run's own when it ends. For what is run once only."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, doc_id as long and text as string; extra columns of any name are left out."""
    kinds = {"doc_id": "bigint", "item_id": "bigint", "text": "string", "lang": "string"}
    return df.select(*[df[n].cast(kinds[n]).alias(n) if n in kinds else df[n] for n in names])


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the decimal doc_id leaves remainder 1 modulo 3; such rows are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_keys(labels: DataFrame, label: str, cap: int, classes: int = 1000) -> DataFrame:
    """(doc_id, y) of labelled rows outside the held-out fold: of each label at most cap, by a hash of doc_id.

    cap is a documented parameter of each classifier; it bounds what reaches the driver or is broadcast, as does classes,
    the number of labels (the commonest ones) that a model tells apart. A threshold on the hash, set by the label's count,
    thins the rows before they meet, so that no task sees all rows of a label. A doc_id with two different labels says
    nothing and is left out; one given twice with one label counts once.
    """
    lab = labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels[label].alias("y"))
    lab = lab.where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    lab = lab.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").drop("other")
    counts = lab.groupBy("y").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "y").limit(classes)
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    thinned = lab.join(F.broadcast(counts), "y").where(share * F.col("n") < 2 * cap + 100)
    place = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id"))
    return thinned.withColumn("place", place).where(F.col("place") <= cap).select("doc_id", "y")
