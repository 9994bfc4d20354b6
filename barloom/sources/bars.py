"""Bar tables: readers, cleaning, bars from ticks, and writers.

A bar table has ``symbol, ts, open, high, low, close``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ("open", "high", "low", "close")
# Fixed value: the timestamp text of the bar files.
PATTERN = "yyyy:MM:dd-HH:mm:ss"


def normalise_columns(df: DataFrame) -> DataFrame:
    """Column names without outer space, in lower case."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def require_columns(df: DataFrame, names: tuple = PRICES) -> DataFrame:
    """The frame itself, or ValueError that names the columns it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def drop_bad_timestamps(df: DataFrame, column: str, pattern: str = PATTERN) -> DataFrame:
    """``ts`` from text; rows whose text is no timestamp are dropped."""
    return df.withColumn("ts", F.try_to_timestamp(F.col(column), F.lit(pattern))).where("ts is not null")


def read_bars(spark: SparkSession, path: str, ts_col: str = "snapshottime", pattern: str = PATTERN, symbol: str = "bars") -> DataFrame:
    """Bars of a CSV file with a header in any case: the time column, then the prices, as doubles."""
    header = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.DoubleType() if c.strip().lower() in PRICES else T.StringType()) for c in header])
    raw = normalise_columns(spark.read.option("header", True).schema(schema).csv(path))
    rows = drop_bad_timestamps(require_columns(raw, (ts_col, *PRICES)), ts_col, pattern)
    return rows.select(F.lit(symbol).alias("symbol"), "ts", *PRICES)


def bars_from_text(lines: DataFrame, column: str = "line", pattern: str = PATTERN, symbol: Column | None = None) -> DataFrame:
    """Bars of CSV lines held in a text column; lines that do not parse are dropped."""
    parsed = F.from_csv(F.col(column), "t string, open double, high double, low double, close double", {"mode": "PERMISSIVE"})
    rows = lines.select(F.lit("bars").alias("symbol") if symbol is None else symbol.alias("symbol"), parsed.alias("r")).select("symbol", "r.*")
    return drop_bad_timestamps(rows, "t", pattern).where("close is not null").select("symbol", "ts", *PRICES)


def bars_from_ticks(df: DataFrame, symbol: Column, ts: Column, price: Column, tie: list[Column], seconds: int) -> DataFrame:
    """One bar for each symbol and time bucket with ticks; ``tie`` orders ticks of equal time.

    Partial aggregation runs before the shuffle, so a busy symbol costs one row
    per task and bucket.
    """
    ticks = df.select(symbol.cast("string").alias("symbol"), ts.cast("timestamp").alias("t"), price.cast("double").alias("p"), F.struct(ts.cast("timestamp"), *tie).alias("at"))
    bucket = F.timestamp_seconds(F.floor(F.unix_seconds("t") / seconds) * seconds)
    bars = ticks.where("t is not null and p is not null").groupBy("symbol", bucket.alias("ts"))
    return bars.agg(F.min_by("p", "at").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "at").alias("close"))


def event_bars(spark: SparkSession, sf_dir: str, seconds: int = 3600) -> DataFrame:
    """Bars of the events table, one symbol for each event type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "value")
    return bars_from_ticks(events, F.col("event_type"), F.col("ts"), F.col("value"), [F.col("event_id")], seconds)


def line_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of unit prices, one symbol for each supplier; ties by the whole line, as its key is not unique."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    tie = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")]
    return bars_from_ticks(lines, F.col("l_suppkey"), F.col("l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"), tie, 86_400)


def write_bars(df: DataFrame, path: str, form: str = "parquet") -> None:
    """A bar or feature table as files in one folder for each symbol."""
    df.write.mode("overwrite").partitionBy("symbol").format(form).option("header", True).save(path)


def latest_report_json(df: DataFrame, fields: list[str]) -> DataFrame:
    """``(symbol, report)``: the latest row of each symbol as one JSON text."""
    last = df.groupBy("symbol").agg(F.max_by(F.struct("ts", *fields), "ts").alias("r"))
    return last.select("symbol", F.to_json("r").alias("report"))
