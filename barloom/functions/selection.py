"""Exact quantiles of groups of any size, by counting values in ever finer ranges.

A round counts the values of a group in ``CELLS`` equal parts of the range that
holds the wanted place, with the least and the largest value of each part, and
goes on with the part of that place. A group is never held by a task: rounds
end when a part holds one value, or at most ``FEW`` values, which are sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

CELLS, FEW = 1024, 256
#: Rounds at most; each divides a range by ``CELLS``, so doubles of any spread are told apart long before.
ROUNDS = 250


def places(df: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """``wanted(keys, place)`` with the ``value`` at each 0-based place of ``df(keys, v)`` in order; ``v`` must not be NULL."""
    ends = df.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("inside"))
    now = written(wanted.join(ends, keys).withColumn("below", F.lit(0).cast("long")), "places")
    by = [*keys, "place"]
    found: list[DataFrame] = []
    for _ in range(ROUNDS):
        found.append(now.where("lo = hi or inside <= " + str(FEW)))
        now = now.where("lo < hi and inside > " + str(FEW))
        if now.isEmpty():
            break
        cell = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS), F.lit(CELLS - 1))
        inside = df.join(now, keys).where("v >= lo and v <= hi").select(*by, "below", "v", cell.alias("cell"))
        cells = inside.groupBy(*by, "below", "cell").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("inside"))
        upto = F.sum("inside").over(Window.partitionBy(*by).orderBy("cell"))
        ranked = cells.withColumn("upto", F.col("below") + upto).where("place < upto and place >= upto - inside")
        now = written(ranked.select(*by, "lo", "hi", "inside", (F.col("upto") - F.col("inside")).alias("below")), "places")
    else:
        raise RuntimeError(f"places were not settled in {ROUNDS} rounds")
    settled = reduce(DataFrame.unionByName, found)
    one = settled.where("lo = hi").select(*by, F.col("lo").alias("value"))
    few = df.join(settled.where("lo < hi"), keys).where("v >= lo and v <= hi").groupBy(*by, "below").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    return one.unionByName(few.select(*by, F.get("vs", (F.col("place") - F.col("below")).cast("int")).alias("value")))


def quantiles(df: DataFrame, keys: list[str], x: str | Column, shares: dict[str, float]) -> DataFrame:
    """``(keys, name ...)``: the value of ``x`` at each share of its group, between two values in proportion, as SQL's ``percentile``.

    NULL values are left out; a group without values does not appear.
    """
    value = (F.col(x) if isinstance(x, str) else x).cast("double")
    held = written(df.select(*keys, value.alias("v")).where("v is not null").withColumn("_all", F.lit(0)), "values")
    by = [*keys, "_all"]
    counts = held.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    asked = counts.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), ((F.col("n") - 1) * F.lit(float(q))).alias("at")) for n, q in shares.items()])).alias("q")).select(*by, "q.*")
    asked = asked.withColumns({"low": F.floor("at"), "high": F.ceil("at")})
    wanted = asked.select(*by, F.explode(F.array("low", "high")).alias("place")).distinct()
    got = places(held, by, wanted)
    low, high = (got.select(*by, F.col("place").alias(p), F.col("value").alias(f"v_{p}")) for p in ("low", "high"))
    both = asked.join(low, [*by, "low"]).join(high, [*by, "high"])
    between = (F.col("high") - F.col("at")) * F.col("v_low") + (F.col("at") - F.col("low")) * F.col("v_high")
    both = both.withColumn("value", F.when((F.col("low") == F.col("high")) | (F.col("v_low") == F.col("v_high")), F.col("v_low")).otherwise(between))
    return both.groupBy(*by).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in shares]).drop("_all")
