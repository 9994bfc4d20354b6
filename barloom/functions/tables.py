"""Intermediate tables in the cluster's shared folder, which survive lost executors and cut the lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one where none is set and all tasks are threads of this process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return the table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """:func:`written`, with the rows in buckets by columns, so that joins on these need not move them."""
    spark = df.sparkSession
    key = f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, *columns).option("path", f"{shared_dir(spark)}/{key}").saveAsTable(key)
    table = spark.table(key)
    spark.sql(f"DROP TABLE {key}")  # of the catalog: the files stay, and the table read holds their places
    return table


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Hands wide rows to Python workers at most ``rows`` at a time, while jobs run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
