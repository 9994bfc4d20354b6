"""Mixing sources to target weights with a low-discrepancy slot schedule.

Every source is one stream of words: its documents in a seeded shuffle, cut
into blocks of equal size. Slot ``i`` of the mix belongs to the source whose
share of ``[0, 1)`` holds the golden-ratio point ``frac((i + 1) / phi)``, so any
stretch of slots is close to the target weights. The ``r``-th slot of a source
takes its block ``r mod blocks``, up to the number of slots its target wants; a
second pass over the source is the limit.

Running positions use bucket sums plus a window inside each bucket, and slot
ranks use chunk counts plus a window inside each chunk, so a source that holds
most rows is spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import partitions, released, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
#: Blocks the whole corpus is cut into, within the bounds of a block's size in words.
BLOCKS, LEAST_BLOCK, MOST_BLOCK = 200_000, 16, 65_536
#: Blocks a source has at least, or one for each of its words: so that whole blocks come near any target.
SOURCE_BLOCKS = 1000
#: Slots made beyond the number wanted, as a share and as a number; a source stops at the slots it wants.
MORE_SLOTS, MORE = 0.1, 64
#: Slots whose ranks are counted together.
CHUNK = 4096
#: Cells of [0, 1) by which slots meet the shares of sources.
GRID = 1024
#: Rows a bucket of a source should hold at most, on average.
BUCKET_ROWS = 100_000
SEED = "mix-1:"
#: Column with the key of a row of documents; doc_id may be null or repeated.
ROW = "_mix_row"

_GOLDEN = 0.6180339887498949


def words_in(text: str = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_PASSES) -> DataFrame:
    """``(source, source_size, weight, target)``, one row for each source, a null source included.

    Sources by code point, null last, take ``weights`` in turn and share
    ``share`` times all words; a target stops at ``most`` times its source and
    the excess is shared again by weight. Sorting sources by ``cap / weight``
    makes the capped ones a prefix, so one running sum finds the level.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", turn).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / weight_left).withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)  # of the first that is not capped; later ones fall
    return per.select("source", "source_size", "weight", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * level).alias("target"))


def schedule(sources: DataFrame, n_slots: int) -> DataFrame:
    """``(slot, source, rank)`` for slots ``0 .. n_slots - 1``.

    ``sources(source, low, high)`` are the shares on ``[0, 1)``. Slots meet
    shares by grid cell, so the work does not multiply with the sources.
    """
    spark = sources.sparkSession
    point = F.col("slot").cast("double") + 1.0
    slots = (
        spark.range(0, n_slots, 1, max(partitions(spark), math.ceil(n_slots / 1_000_000)))
        .withColumnRenamed("id", "slot")
        .withColumn("point", point * _GOLDEN - F.floor(point * _GOLDEN))
        .withColumn("cell", F.floor(F.col("point") * GRID))
    )
    reach = sources.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * GRID), F.least(F.floor(F.col("high") * GRID), F.lit(GRID - 1).cast("long")))))
    mine = (
        slots.join(reach, "cell")
        .where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
        .select("slot", "source", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    )
    counts = mine.groupBy("source", "chunk").count()
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source", "chunk", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    ranked = mine.withColumn("inside", inside)
    same = ranked["source"].eqNullSafe(counts["source"]) & (ranked["chunk"] == counts["chunk"])
    return ranked.join(counts, same).select(ranked["slot"], ranked["source"], (F.col("inside") + F.col("before")).alias("rank"))


def _positions(sizes: DataFrame, digits: int) -> DataFrame:
    """First word of each document in its source's shuffled stream."""
    spread = sizes.withColumn("bucket", F.substring("key", 1, digits))
    sums = spread.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    run = spread.withColumn("upto", F.sum("size").over(inside))
    same = run["source"].eqNullSafe(sums["source"]) & (run["bucket"] == sums["bucket"])
    return run.join(sums, same).select(run["row"], run["doc_id"], run["source"], run["size"], (F.col("before") + F.col("upto") - F.col("size")).alias("begin"))


def mixture(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_PASSES) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, taken_by_pass)`` for every row of ``docs(doc_id, text, source)``.

    ``taken`` counts the words that the mix takes from a document, repeats
    included; ``taken_by_pass`` has one entry for each pass, always a prefix of
    the document or of its rest. Null texts have size 0; a null source is a
    source of its own, after all others. Reruns give the same mix. Rows that
    repeat a doc_id are separate documents; extra columns are ignored; an empty
    table gives an empty result. A source's documents are shuffled by a hash of
    doc_id and text, so only rows that agree in both are tied, and which of
    these gives more words is not defined. Texts are counted, never moved.
    Positions of whole sources and the plan, one row for each source, are summed
    in one task.
    """
    return _row_mixture(docs.withColumn(ROW, F.monotonically_increasing_id()), weights, share, most).drop("row")


def _row_mixture(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_PASSES) -> DataFrame:
    """:func:`mixture` of rows that carry their own key in ``ROW``; the result has it as ``row``."""
    key = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    sizes = written(
        docs.select(F.col("doc_id").cast("long"), "source", words_in().alias("size"), F.col(ROW).alias("row"), key.alias("key")),
        "sizes",
    )
    rows, words = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    block = min(MOST_BLOCK, max(LEAST_BLOCK, words // BLOCKS))
    digits = max(2, math.ceil(math.log(max(rows, 1) / BUCKET_ROWS, 16)) if rows > BUCKET_ROWS else 2)
    targets = source_targets(sizes, weights, share, most)
    blocks = F.greatest(F.ceil(F.col("source_size") / block), F.least(F.col("source_size"), F.lit(SOURCE_BLOCKS)), F.lit(1))
    wanted = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    upto = Window.orderBy(F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, 0)
    plan = targets.withColumn("blocks", blocks).withColumn("wanted", wanted).withColumn("sum", F.sum("wanted").over(upto))
    plan = written(plan.withColumn("all", F.max("sum").over(Window.partitionBy())), "targets")  # one row for each source
    n_slots = math.ceil((plan.agg(F.max("all")).first()[0] or 0.0) * (1 + MORE_SLOTS)) + MORE
    released(docs.sparkSession)
    shares = plan.where("all > 0").select("source", "blocks", "wanted", ((F.col("sum") - F.col("wanted")) / F.col("all")).alias("low"), (F.col("sum") / F.col("all")).alias("high"))
    slots = schedule(shares.select("source", "low", "high"), n_slots)
    number = slots.join(shares.withColumnRenamed("source", "s"), slots["source"].eqNullSafe(F.col("s")))
    taken = (
        number.where(F.col("rank") < F.round("wanted"))
        .select("source", (F.col("rank") % F.col("blocks")).alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("pass"))
        .groupBy("source", "block")
        .agg(F.collect_set("pass").alias("passes"))
    )
    at = _positions(sizes, digits)
    known = plan.select(F.col("source").alias("s"), "source_size", "target", "blocks")
    at = at.join(known, at["source"].eqNullSafe(F.col("s"))).drop("s")
    edge = lambda j: F.expr(f"({j}) * source_size div blocks")
    # block j holds the words from j * source_size div blocks on; a document meets a run of blocks
    first = F.expr("(begin * blocks) div source_size")
    last = F.expr("((begin + size - 1) * blocks) div source_size")
    pieces = (
        at.where("size > 0")
        .withColumn("block", F.explode(F.sequence(F.greatest(first - 1, F.lit(0)), F.least(last + 1, F.col("blocks") - 1))))
        .withColumn("words", F.least(F.col("begin") + F.col("size"), edge("block + 1")) - F.greatest(F.col("begin"), edge("block")))
        .where("words > 0")
    )
    used = pieces.join(
        taken.select(F.col("source").alias("s"), F.col("block").alias("b"), "passes"), pieces["source"].eqNullSafe(F.col("s")) & (pieces["block"] == F.col("b"))
    )
    by_pass = [F.sum(F.when(F.array_contains("passes", F.lit(p).cast("long")), F.col("words")).otherwise(0)).alias(f"pass{p}") for p in range(most)]
    got = used.groupBy("row").agg(*by_pass)
    zero = [F.coalesce(f"pass{p}", F.lit(0)).cast("long") for p in range(most)]
    return at.join(got, "row", "left").select(
        "row", "doc_id", "size", "source_size", "target", sum(zero[1:], zero[0]).alias("taken"), F.array(*zero).alias("taken_by_pass")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, once for each pass that takes words, with the words taken as text.

    Columns stay, whatever their names; ``n_chars`` follows the text. Rows are told apart by a key of
    their own in a written table, so null and repeated doc_ids count as rows.
    Documents of sources above their target that no slot reaches do not appear.
    """
    held = written(docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias(ROW)), "rows")
    mix = _row_mixture(held.select("_doc.doc_id", "_doc.source", "_doc.text", ROW), **options)
    mix = mix.select(F.col("row").alias(ROW), "size", F.posexplode("taken_by_pass").alias("pass", "take")).where("take > 0")
    words = F.regexp_extract_all("_doc.text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col("take") == F.col("size"), F.col("_doc.text")).otherwise(F.array_join(F.slice(words, 1, F.col("take").cast("int")), " "))
    joined = held.join(mix, ROW).select("_doc", text.alias("_text"))
    new = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast("long")}
    return joined.select(*[new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])


#: The query's rows in DuckDB SQL, with the same arithmetic.
ORACLE = f"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(concat('{SEED}', coalesce(CAST(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, '')))) AS key FROM documents),
per AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source)),
lev AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM per),
tar AS (
  SELECT source, source_size, weight, CASE WHEN cap / weight <= level THEN cap
    ELSE weight * max(CASE WHEN cap / weight > level THEN level END) OVER () END AS target FROM lev),
total AS (SELECT least({MOST_BLOCK}, greatest({LEAST_BLOCK}, CAST(sum(size) AS BIGINT) // {BLOCKS})) AS block FROM sizes),
plan AS (
  SELECT *, sum(wanted) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM (
    SELECT *, CASE WHEN source_size > 0 THEN target * blocks / source_size ELSE 0 END AS wanted FROM (
      SELECT *, greatest(CAST(ceil(source_size / block) AS BIGINT), least(source_size, {SOURCE_BLOCKS}), 1) AS blocks FROM tar, total))),
whole AS (SELECT max(upto) AS all_slots FROM plan),
slots AS (
  SELECT i, (i + 1)::DOUBLE * {_GOLDEN}::DOUBLE - floor((i + 1)::DOUBLE * {_GOLDEN}::DOUBLE) AS point
  FROM (SELECT unnest(range(CAST(ceil(all_slots * {1 + MORE_SLOTS}::DOUBLE) AS BIGINT) + {MORE})) AS i FROM whole)),
ranked AS (
  SELECT source, blocks, wanted, row_number() OVER (PARTITION BY source ORDER BY i) - 1 AS r
  FROM slots, plan, whole WHERE point >= (upto - wanted) / all_slots AND point < upto / all_slots),
taken AS (SELECT source, r % blocks AS block, count(*) AS n FROM ranked WHERE r < round(wanted) GROUP BY ALL),
pos AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS first_word,
         row_number() OVER () AS row_id FROM sizes),
placed AS (SELECT pos.*, source_size, target, blocks FROM pos JOIN plan ON pos.source IS NOT DISTINCT FROM plan.source),
used AS (
  SELECT row_id, CAST(sum(n * (least(first_word + size, ((t.block + 1) * source_size) // blocks) - greatest(first_word, (t.block * source_size) // blocks))) AS BIGINT) AS taken
  FROM placed p JOIN taken t ON p.source IS NOT DISTINCT FROM t.source AND size > 0
   AND least(first_word + size, ((t.block + 1) * source_size) // blocks) > greatest(first_word, (t.block * source_size) // blocks)
  GROUP BY row_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM placed LEFT JOIN used USING (row_id)
"""
