"""Exact top-k search over binary codes by incremental multi-index hashing.

A 64-bit code is cut into ``m`` segments and listed under the value of each. Two
codes within ``m * (r + 1) - 1`` bits agree in some segment up to ``r`` bits, so
after probing every segment at radii ``0 .. r`` all such codes have been seen
and verified. The radius grows for the queries whose k-th distance is not
covered yet, until all are; there is no other way out.

A ring of probes is a join on the segment and its value. Of the rings in which a pair
could meet only the first counts, and only pairs within the k-th distance so far
leave the join, so what moves afterwards is a few rows for each query.
"""

from __future__ import annotations

import json
import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import forget, partitions, written
from .vectors import distinct_groups, nearest_ids, usable

K = 10
BITS = 64


def sign_code(vector: Column) -> Column:
    """Bit ``i`` is set where component ``i`` is positive, for the first 64 components."""
    bits = F.transform(F.slice(vector, 1, BITS), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def segments(n: int) -> list[tuple[int, int]]:
    """``(shift, width)`` of each segment, of ``log2(n)`` bits or a little less: buckets hold a few codes, and a ring few probes."""
    m = min(16, max(2, math.ceil(BITS / max(4.0, math.log2(max(n, 2))))))
    edges = [round(i * BITS / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _part(code: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1))


def _key(segment: int, value: Column) -> Column:
    """A segment (at most 16) and its value in one long."""
    return F.shiftleft(value, 4).bitwiseOR(F.lit(segment).cast("long"))


def _ring(code: str, parts: list[tuple[int, int]], radius: int) -> Column:
    """``array<long>``: every segment's values at exactly ``radius`` bits from the code's, as :func:`_key`."""

    def values(segment: int, shift: int, width: int) -> Column:
        flips = json.dumps([sum(1 << b for b in bits) for bits in combinations(range(width), radius)])
        own = _part(F.col(code), shift, width)
        return F.transform(F.from_json(F.lit(flips), "array<bigint>"), lambda m: _key(segment, own.bitwiseXOR(m)))

    return F.concat(*[values(s, *part) for s, part in enumerate(parts)])


def _met_first(parts: list[tuple[int, int]], radius: int) -> Column:
    """Whether ``query`` and ``code`` meet in this ring and the segment of ``key`` and in none before."""
    gap = F.col("query").bitwiseXOR(F.col("code"))
    gaps = F.array(*[F.bit_count(_part(gap, shift, width)).cast("int") for shift, width in parts])
    return (F.array_min(gaps) == radius) & (F.array_position(gaps, F.lit(radius)) - 1 == F.col("key").bitwiseAND(F.lit(15)))


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k + 1`` nearest codes of each query code, and how far its (k + 1)-th id is."""
    order = Window.partitionBy("query").orderBy("score", F.get("ids", F.lit(0)))
    top = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    upto = F.sum(F.size("ids")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    far = F.min(F.when(F.col("upto") > k, F.col("score"))).over(Window.partitionBy("query"))
    return top.withColumn("upto", upto).select("query", "code", "score", "ids", F.coalesce(far, F.lit(BITS + 1)).alias("far"))


def top_codes(codes: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows nearest by Hamming distance, exactly.

    ``codes(vec_id, code)``; queries are the rows whose id ``every`` divides, and
    every other row is a candidate, all of them if there are fewer than ``k``.
    Ties go to the smaller id. Null ids and codes take no part; rows that repeat
    an id and a code count once, and other rows of a query's id are none of its
    candidates. Equal codes are one entry
    with the ``k + 1`` smallest ids, which loses no answer.
    """
    spark = codes.sparkSession
    rows = codes.where("vec_id is not null and code is not null").select(F.col("vec_id").cast("long"), F.col("code").cast("long"))
    groups = written(distinct_groups(rows, "code", k + 1), "codes")
    parts = segments(groups.count())
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("code").alias("query"), F.col("vec_id").alias("query_id")).distinct()
    # the distance up to which a code can still enter a query's answer
    left = written(asked.select("query").distinct().withColumn("far", F.lit(BITS + 1)), "queries")
    index = written(groups.select(F.explode(_ring("code", parts, 0)).alias("key"), "code", "ids"), "segments")
    best = spark.createDataFrame([], "query long, code long, score int, ids array<long>")
    done = best.select("query", "score", "ids")
    for radius in range(max(w for _, w in parts) + 1):
        if left.isEmpty():
            break
        spread = left.repartition(partitions(spark), "query")  # few queries, many probes for each
        probes = spread.select("query", "far", F.explode(_ring("query", parts, radius)).alias("key"))
        gap = F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).cast("int")
        # merged, as a planner that sees the size of the queries would broadcast their many probes
        hits = probes.hint("merge").join(index, "key").where((gap <= F.col("far")) & _met_first(parts, radius))
        grown = written(_best(hits.select("query", "code", gap.alias("score"), "ids").unionByName(best), k), "best")
        covered = F.col("far") <= len(parts) * (radius + 1) - 1
        done = done.unionByName(grown.where(covered).select("query", "score", "ids"))
        best = grown.where(~covered).select("query", "code", "score", "ids")
        far = grown.select("query", "far").distinct()
        after = left.select("query").join(far, "query", "left").select("query", F.coalesce("far", F.lit(BITS + 1)).alias("far")).where(~covered)
        after = written(after, "queries")
        forget(left)
        left = after
    # what the last ring leaves has fewer candidates than asked for, all of which it has met
    return nearest_ids(done.unionByName(best.select("query", "score", "ids")), asked, k)


def nearest_signs(embeddings: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """:func:`top_codes` over the sign codes of ``embeddings(vec_id, embedding)``; unusable vectors take no part."""
    return top_codes(embeddings.where(usable(F.col("embedding"))).select("vec_id", sign_code(F.col("embedding")).alias("code")), every, k)


#: The rows of ``nearest_signs`` in DuckDB SQL, by comparing every pair.
ORACLE = """
WITH good AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) > 0 AND vec_id IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id,
    CAST(len(list_filter(range(1, 65), lambda i: (coalesce(q.embedding[i], 0) > 0) <> (coalesce(c.embedding[i], 0) > 0))) AS INTEGER) AS score
  FROM good q JOIN good c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""
