"""URL filters by a cascade of Bloom filters.

The first filter encodes the listed keys. The second encodes the keys of the
corpus that the first lets through wrongly, the third the listed keys that the
second lets through, and so on until nothing is left: over the complete key
universe of the corpus the alternation of answers is exact membership, so pages
are judged in one pass without a join.

Listed keys are the rules (host and path prefix) and the listed hosts. A url
asks for every key it could match, longest first. A list too long for one
broadcast is cut by the hash of the key, and each slice has a cascade and a pass
over the pages of its own.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stages import written

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Hosts with such a label or part of one are blocked where no rule fits.
BLOCKED_HOST = r"(^|[.-])(ads?|adserver|banner|click|track(er|ing)?|popup)([.-]|$)"
#: False-positive rates of the first level and of all others.
FIRST_RATE, RATE = 0.02, 0.3
#: Bits that the levels of a slice take together at most, by their expected number: 32 MB.
MOST_BITS = 1 << 28


@dataclass
class Level:
    bits: np.ndarray
    size: int
    hashes: int
    seed: int

    def has(self, key: bytes) -> bool:
        a, b = _two(key, self.seed)
        for i in range(self.hashes):
            p = (a + i * b) % self.size
            if not self.bits[p >> 6] >> np.uint64(p & 63) & np.uint64(1):
                return False
        return True


def _two(key: bytes, seed: int) -> tuple[int, int]:
    h = xxhash.xxh128_intdigest(key, seed)
    return h >> 64, h & ((1 << 64) - 1) | 1


def member(levels: list[Level], key: bytes) -> bool:
    """Exact for every key of the universe the cascade was built over."""
    for depth, level in enumerate(levels):
        if not level.has(key):
            return depth % 2 == 1
    return len(levels) % 2 == 1


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """Every rule key a url could match, longest first, as ``array<string>``.

    The ends of the host with as many labels as rules have meet the path's
    beginnings of the lengths that rules have; a key is host and path joined, as
    rules are written. So the keys of a url are as many as the rules allow,
    however long it is.
    """
    parents = F.array(*[F.substring_index(host, ".", -n) for n in sorted({h.count(".") + 1 for h, _, _ in rules})])
    lengths = sorted({len(p) for _, p, _ in rules}, reverse=True)
    one = lambda h, n: F.when(F.char_length(path) >= n, F.concat(h, F.substr(path, F.lit(1), F.lit(n))))
    keys = F.flatten(F.transform(parents, lambda h: F.array(*[one(h, n) for n in lengths])))
    ordered = F.array_sort(F.array_distinct(F.array_compact(keys)), lambda a, b: F.when(F.char_length(a) != F.char_length(b), F.char_length(b) - F.char_length(a)).otherwise(F.when(a < b, -1).when(a > b, 1).otherwise(0)))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(ordered)


def _level(keys: DataFrame, count: int, rate: float, seed: int) -> Level:
    """A Bloom filter of ``keys(key)``: tasks set bits of their own, words are joined by bit_or."""
    size = max(64, math.ceil(-count * math.log(rate) / math.log(2) ** 2))
    hashes = max(1, round(-math.log2(rate)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [(a + i * b) % size for k in batch.column("key").to_pylist() for a, b in [_two(k.encode(), seed)] for i in range(hashes)]
            spots = np.unique(np.array(at, dtype=np.uint64))
            word, start = np.unique(spots >> np.uint64(6), return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (spots & np.uint64(63)), start) if len(spots) else spots
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], names=["word", "mask"])

    words = keys.mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(size // 64 + 1, dtype=np.uint64)
    bits[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return Level(bits, size, hashes, seed)


def expected_bits(listed: int) -> float:
    """Bits of a cascade of that many listed keys, whatever the others, as long as these are not 50 times as many."""
    one = lambda count, rate: -count * math.log(rate) / math.log(2) ** 2
    return one(listed, FIRST_RATE) + one(listed, RATE) * 2 / (1 - RATE)


def build_cascade(universe: DataFrame) -> list[Level]:
    """Levels for ``universe(key, listed)``, distinct keys, which are exact for each of them."""
    spark = universe.sparkSession
    levels: list[Level] = []
    wrong, before = universe.where("listed"), None
    while True:
        count = wrong.count()
        if not count and levels:
            return levels
        levels.append(_level(wrong.select("key"), count, RATE if levels else FIRST_RATE, len(levels)))
        shared = spark.sparkContext.broadcast(levels[-1])  # a slice has MOST_BITS in all
        # keys of the other side that the new level lets through are what the next level encodes;
        # they have passed every earlier level by construction
        other = before if len(levels) > 1 else universe.where("not listed")
        before, wrong = wrong, written(_passing(other, shared), "level")


def _passing(keys: DataFrame, level) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = level.value.has
            yield batch.filter(pa.array([has(k.encode()) for k in batch.column("key").to_pylist()], pa.bool_()))

    return keys.select("key", "listed").mapInArrow(run, "key string, listed boolean")


def members(rows: DataFrame, universe: DataFrame, slices: int) -> DataFrame:
    """``rows`` with ``hits``: which of the keys in ``asked`` are listed, by one cascade and one pass for each slice of the keys."""
    rows = rows.withColumn("hits", F.array().cast("array<string>"))
    for part in range(slices):
        levels = build_cascade(universe.where(F.crc32(F.col("key").cast("binary")) % slices == part))
        rows = _met(rows if part == 0 else written(rows, "hits"), rows.sparkSession.sparkContext.broadcast(levels), slices, part)
    return rows


def _met(rows: DataFrame, shared, slices: int, part: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}

        def has(key: str) -> bool:
            if len(known) > 200_000:
                known.clear()
            if key not in known:
                name = key.encode()
                known[key] = (slices == 1 or zlib.crc32(name) % slices == part) and member(shared.value, name)
            return known[key]

        for batch in batches:
            hits = [old + [k for k in keys if has(k)] for old, keys in zip(batch.column("hits").to_pylist(), batch.column("asked").to_pylist(), strict=True)]
            at = batch.schema.get_field_index("hits")
            yield batch.set_column(at, "hits", pa.array(hits, pa.list_(pa.string())))

    return rows.mapInArrow(run, rows.schema)


def judged(pages: DataFrame, rules: tuple = RULES, listed: DataFrame | None = None, most_bits: int = MOST_BITS) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages(page_id, url)``.

    The longest rule that fits decides (host plus path; ties go to the smaller
    key); other pages are blocked when their host is a listed host and allowed
    otherwise. ``listed(host)`` is the list; without one it has the hosts of
    ``pages`` with an advertising or tracking label. A null url, or one without
    ``://``, has an empty host and path, no rule and verdict allow. Extra columns
    are ignored; repeats stay; an empty table gives an empty result.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("host "), F.col("host"))))
    rows = rows.withColumn("asked", F.concat(F.transform("keys", lambda k: F.concat(F.lit("rule "), k)), own))
    names = rows.select(F.explode("asked").alias("key")).distinct()
    fits = F.col("key").isin(*[f"rule {h}{p}" for h, p, _ in rules])
    if listed is None:
        names = names.withColumn("listed", fits | (F.col("key").startswith("host ") & F.substring("key", 6, 1 << 30).rlike(BLOCKED_HOST)))
    else:
        bad = listed.where("host is not null").select(F.concat(F.lit("host "), ascii_lower(F.col("host"))).alias("key")).distinct()
        names = names.join(bad.withColumn("bad", F.lit(True)), "key", "left").select("key", (fits | F.coalesce("bad", F.lit(False))).alias("listed"))
    universe = written(names, "universe")
    slices = max(1, math.ceil(expected_bits(universe.where("listed").count()) / most_bits))
    found = members(rows, universe, slices)
    rule = F.get(F.filter("keys", lambda k: F.array_contains("hits", F.concat(F.lit("rule "), k))), F.lit(0))
    decided = F.lit(None).cast("string")
    for host, path, verdict in rules:
        decided = F.when(F.col("rule") == host + path, F.lit(verdict)).otherwise(decided)
    alone = F.when(F.array_contains("hits", F.concat(F.lit("host "), F.col("host"))), "block").otherwise("allow")
    return found.withColumn("rule", rule).select("page_id", "host", "path", "rule", F.coalesce(decided, alone).alias("verdict"))


_HOST = r"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FITS = "(host = {h!r} OR host LIKE '%.{h}') AND starts_with(path, {p!r})"
_ORDER = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))

#: The query's rows in DuckDB SQL.
ORACLE = f"""
WITH parts AS (SELECT page_id, {_HOST} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT *, CASE {' '.join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{h}{p}'" for h, p, _ in _ORDER)} END AS rule FROM parts)
SELECT page_id, host, path, rule,
  CASE {' '.join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in RULES)} WHEN regexp_matches(host, '{BLOCKED_HOST}') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
