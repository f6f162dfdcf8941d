"""Tables: reading them, and writing what later steps read in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: list[str] = []
_TABLES: dict[str, str] = {}  # names in the catalogue, and their paths


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and Spark runs on this machine alone, a folder of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when Python ends."""
    path = f"{shared_dir(spark)}/lectern-{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing will read again."""
    delete(spark, path)
    if path in _SCRATCH:
        _SCRATCH.remove(path)


def bucketed(df: DataFrame, name: str, buckets: int, by: list[str], compression: str = "snappy") -> str:
    """df as a table in the shared folder, bucketed and sorted by columns, under a name of its own in the catalogue, which
    goes when Python ends or by drop_table."""
    path = scratch_path(df.sparkSession, name)
    own = path.rsplit("/", 1)[-1].replace("-", "_")
    df.write.bucketBy(buckets, *by).sortBy(*by).option("path", path).option("compression", compression).saveAsTable(own)
    _TABLES[own] = path
    return own


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    if name in _TABLES:
        drop_scratch(spark, _TABLES.pop(name))


@atexit.register
def _release() -> None:
    spark = SparkSession.getActiveSession() if _SCRATCH or _TABLES else None
    try:
        for name in list(_TABLES) if spark else ():
            drop_table(spark, name)
        for path in _SCRATCH if spark else ():
            delete(spark, path)
    except Exception:  # noqa: BLE001 - the session may be gone, and with it the way to the folder
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives a lost executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed_write(df: DataFrame, path: str, keys: list[str], partition: str) -> None:
    """Upsert by key into a partitioned Parquet table: of two rows with a key the new one stays; other partitions stay."""
    spark = df.sparkSession
    new = df.dropDuplicates(keys)
    try:
        old = spark.read.parquet(path).select(*df.columns)
    except Exception as error:  # noqa: BLE001 - no table yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        old = None
    if old is not None:
        touched = old.join(new.select(partition).distinct(), partition, "left_semi")
        new = written(touched.join(new.select(*keys), keys, "left_anti").unionByName(new), "upsert")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
