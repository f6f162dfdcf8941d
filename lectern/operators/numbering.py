"""Places in a total order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def numbered(rows: DataFrame, *by: Column | str) -> DataFrame:
    """rows with index: the place from 0 in the order by, which should be total.

    Rows are dealt out by ranges of the order and written, so that ranges stay as they are; a range's first place is the
    sum of the sizes before it (one row a partition), and within a range rows are counted.
    """
    ranged = written(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = ranged.join(F.broadcast(starts), "_range")  # as many rows as the shuffle has partitions
    return placed.withColumn("index", F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*by)) - 1).drop("_range", "_before")
