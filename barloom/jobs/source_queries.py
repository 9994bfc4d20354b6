"""Queries that write bars and draws of the given tables to files and read them back through the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import shared_dir
from ..functions.win import presented
from ..operators import draws
from ..sources import bars
from ..streaming.bars import corrected_bars, latest_bars
from . import sql
from .registry import query

_PRICES = list(bars.PRICES)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _stamp() -> F.Column:
    return F.date_format("ts", bars.PATTERN)


_ONE = sql.EVENT_BARS.replace("event_type AS symbol", "'bars' AS symbol")


@query(sql.staged(base=_ONE) + sql.show(_PRICES))
def bars_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one instrument, through a CSV file with an untidy header and lines whose time is none."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "value")
    made = bars.bars_from_ticks(events, F.lit("bars"), F.col("ts"), F.col("value"), [F.col("event_id")], 3600)
    good = made.select(_stamp().alias(" snapshotTime"), *[F.col(c).alias(c.upper()) for c in _PRICES])
    bad = good.withColumn(" snapshotTime", F.lit("no time"))
    path = _folder(spark, "csv")
    good.unionByName(bad).write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return presented(bars.read_bars(spark, path), _PRICES)


@query(sql.staged() + sql.show(_PRICES))
def bars_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of each event type through lines of text, some of which do not parse."""
    made = bars.event_bars(spark, sf_dir)
    line = F.concat_ws(",", _stamp(), *[F.col(c).cast("string") for c in _PRICES])
    lines = made.select("symbol", line.alias("line")).unionByName(made.select("symbol", F.lit("total,,x,,").alias("line")))
    path = _folder(spark, "lines")
    lines.write.partitionBy("symbol").text(path)
    read = spark.read.schema("line string, symbol string").text(path)
    return presented(bars.bars_from_text(read, symbol=F.col("symbol")), _PRICES)


@query(sql.staged() + sql.show(_PRICES))
def bars_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of each event type through the writer, one folder for each symbol."""
    path = _folder(spark, "bars")
    bars.write_bars(bars.event_bars(spark, sf_dir), path)
    read = spark.read.schema("ts timestamp, open double, high double, low double, close double, symbol string").parquet(path)
    return presented(bars.require_columns(bars.normalise_columns(read)), _PRICES)


_DRAWN = """WITH d AS (SELECT list_sort([(l_orderkey + l_linenumber * 7) % 59 + 1, (l_partkey * 3 + l_linenumber) % 59 + 1, (l_suppkey + 11) % 59 + 1]) AS v, l_orderkey % 28 + 1 AS day FROM lineitem)
SELECT CAST(year(make_date(2021, 2, CAST(day AS INTEGER))) AS INTEGER) AS year, CAST(weekofyear(make_date(2021, 2, CAST(day AS INTEGER))) AS INTEGER) AS week, CAST(v[1] AS INTEGER) AS low, count(*) AS n FROM d GROUP BY ALL"""


@query(_DRAWN)
def draws_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws through a draw file: how often each smallest number comes in each ISO week."""
    made = draws.line_draws(spark, sf_dir).withColumn("day", F.col("order.l_orderkey") % 28 + 1)
    known = {"DrawNumber": F.col("order.l_linenumber"), "DD": F.col("day"), "MMM": F.lit("Feb"), "YYYY": F.lit(2021), "N1": F.col("n1"), "N2": F.col("n2"), "N3": F.col("n3")}
    path = _folder(spark, "draws")
    made.select(*[known.get(c, F.lit(None)).cast("string").alias(c) for c in draws.COLUMNS]).write.option("header", True).csv(path)
    read = draws.read_draws(spark, path)
    return read.groupBy(F.year("date").alias("year"), "week", F.col("N1").alias("low")).agg(F.count(F.lit(1)).alias("n"))


_TICKS = sql.EVENT_BARS.replace(" AS close FROM", " AS close, CAST(count(*) AS BIGINT) AS ticks FROM")


@query(sql.staged(base=_TICKS) + sql.show(_PRICES, ["ticks"]))
def bars_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the events as a stream of four files out of order, each of which corrects bars of those before."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "value")
    path = _folder(spark, "ticks")
    events.repartition(4).write.parquet(path)
    ticks = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    shown = corrected_bars(ticks, F.col("event_type"), F.col("ts"), F.col("value"), F.col("event_id"), 3600)
    return presented(latest_bars(shown, _folder(spark, "bars")), [*_PRICES, "ticks"])
