"""Intermediate tables that survive lost executors.

Every operator that needs a result twice writes it as Parquet below the shared
folder named by ``spark.checkpoint.dir`` and reads it back, which cuts the
lineage without keeping blocks on any executor.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.tables import shared_dir, written

__all__ = ["bucketed", "forget", "partitions", "released", "shared_dir", "small_batches", "written"]


def bucketed(df: DataFrame, name: str, columns: list[str], buckets: int) -> DataFrame:
    """:func:`written`, with the rows in ``buckets`` by some columns, so that joins on them need not move them."""
    spark = df.sparkSession
    key = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, columns).option("path", f"{shared_dir(spark)}/{key}").saveAsTable(key)
    table = spark.table(key)
    spark.sql(f"DROP TABLE {key}")  # of the catalog: the files stay, and the table read holds their places
    return table


def forget(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`written`."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)


def released(spark: SparkSession) -> SparkSession:
    """Collects what is left of plans that are no longer used, in both processes of the driver.

    Spark drops their shuffles and broadcasts when their handles are collected,
    which a driver with room to spare puts off.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> SparkSession:
    """Hands texts to Python workers at most ``rows`` or about ``size`` at a time, so that a batch stays a few megabytes.

    Plans are reported in short: the driver keeps the text of each, and literals
    and patterns make some of them long.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    spark.conf.set("spark.sql.maxPlanStringLength", "10000")
    return spark
