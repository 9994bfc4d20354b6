"""Draw tables: reading, frequencies and transitions of drawn numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The columns of a draw file, in order.
COLUMNS = ("DrawNumber", "Day", "DD", "MMM", "YYYY", "N1", "N2", "N3", "N4", "N5", "N6", "Bonus", "Jackpot", "Wins", "Machine", "Set")
_WHOLE = ("DrawNumber", "DD", "YYYY", "N1", "N2", "N3", "N4", "N5", "N6", "Bonus")


def read_draws(spark: SparkSession, path: str) -> DataFrame:
    """Draws of a CSV file whose header line is skipped, with ``date`` and ISO ``week``; bad dates are NULL."""
    schema = ", ".join(f"`{c}` {'int' if c in _WHOLE else 'string'}" for c in COLUMNS)
    raw = spark.read.option("header", True).option("enforceSchema", True).schema(schema).csv(path)
    day = F.try_to_timestamp(F.concat_ws(" ", "DD", "MMM", "YYYY"), F.lit("d MMM yyyy")).cast("date")
    return raw.withColumn("date", day).withColumn("week", F.weekofyear("date"))


def number_frequency(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(number, n)`` over all number columns."""
    return df.select(F.explode(F.array(*columns)).alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("n"))


def transitions(df: DataFrame, column: str) -> DataFrame:
    """``(before, after, n)`` of consecutive draws of each ``series`` by ``order``."""
    before = F.lag(column).over(Window.partitionBy("series").orderBy("order"))
    pairs = df.select(before.alias("before"), F.col(column).alias("after")).where("before is not null")
    return pairs.groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


def line_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sorted numbers of 1 to 59 from the keys of each line item; one series for each supplier."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    o, n, p, s = (F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    v = F.sort_array(F.array((o + n * 7) % 59 + 1, (p * 3 + n) % 59 + 1, (s + 11) % 59 + 1))
    return lines.select(s.alias("series"), F.struct(o, n, p).alias("order"), *[F.get(v, F.lit(i)).alias(f"n{i + 1}") for i in range(3)])
