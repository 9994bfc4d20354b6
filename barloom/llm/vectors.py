"""Vectors merged by value, so that groups of copies cost one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is neither null, empty nor zero, and all components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_groups(rows: DataFrame, value: str, keep: int) -> DataFrame:
    """``(value, ids, node)``: each value once, with its ``keep`` smallest distinct ids in order and the smallest as ``node``.

    The limit is applied before the shuffle too, so a value that a third of the
    rows share sends ``keep`` ids from each task.
    """
    kept = rows.select(value, "vec_id").withColumn("n", F.dense_rank().over(Window.partitionBy(value).orderBy("vec_id"))).where(F.col("n") <= keep)
    return kept.groupBy(value).agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).withColumn("node", F.get("ids", F.lit(0)))


def nearest_ids(found: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` from ``found(query, score, ids)`` for ``asked(query, query_id)``.

    ``found`` has the nearest groups of each distinct query value, at least
    ``k + 1`` ids if there are as many; a query never finds its own id, which
    takes a place of these where it repeats with another value.
    """
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    near = found.select("query", "score", F.explode("ids").alias("vec_id")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    mine = asked.join(near, "query").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy("score", "vec_id"))
    return mine.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
