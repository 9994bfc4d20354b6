"""Collocations: phrases that occur together more often than their parts, counted exactly.

Two steps find the counts of all frequent phrases:

1. *Candidates.* Level by level, hashes of phrases are counted whose two shorter
   parts may be frequent (Apriori), and those below the least count go. Colliding
   hashes only add up, and the filter over the level before only errs by letting
   more through, so no frequent phrase is lost.
2. *Counts.* A minimal perfect hash gives each candidate a slot that holds its
   key. Mappers look up the phrases of their texts, compare hash and words with
   the stored key, and count slots with ``bincount``; the arrays are summed up
   along a tree. The parts of a phrase that is cut in two are read by slot.

What a mapper holds is bounded: filters have ``FILTER_BITS`` bits at most, and
candidates are cut into groups of about ``SLOTS``, each with a hash and a pass of
its own. Nothing else is broadcast.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .periodic_runs import ragged
from .stages import forget, partitions, written
from .substring_dedup import _mix, _Powers, word_hashes
from .words import as_bytes, row_chunks

LEAST, LONGEST, TOP = 100, 5, 2000
#: A candidate goes when a longer one has this share of its count, in percent.
ABSORBED = 100
#: Bits of a filter over hashes at most, and candidates of a group on average.
FILTER_BITS, SLOTS = 1 << 27, 1 << 20
#: Slots that are summed up together, and arrays that are summed up at a time.
BLOCK, FAN = 4096, 32
#: Text bytes whose hashes are counted before they travel.
FLUSH_BYTES = 16 << 20

_ODD = 0x9E3779B97F4A7C15
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, 0x09]] = True
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class Pieces:
    """Lower-cased words of some texts; ``glued[i]`` where word ``i + 1`` follows in the same piece, ``first`` as the words of texts begin."""

    def __init__(self, texts: list[bytes]) -> None:
        raw = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
        solid = ~(_GAP | _BREAK)[raw]
        after = np.zeros_like(solid)
        after[1:] = solid[:-1] & ~solid[1:]
        starts = np.flatnonzero(solid & ~np.concatenate(([False], solid[:-1])))
        stops = np.cumsum(np.flatnonzero(after) - starts + 1)
        self.first = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        broken = np.cumsum(_BREAK[raw])[starts]
        self.glued = broken[1:] == broken[:-1]
        self.array = raw[solid | after]
        self.start, self.end = np.append(0, stops[:-1]) if len(stops) else stops, stops - 1
        self.array[self.end] = 0x20
        self.data = self.array.tobytes()

    def __len__(self) -> int:
        return len(self.start)


def phrase_hashes(block: Pieces, tongue: np.ndarray, powers: _Powers, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(hash, whole)`` of the phrases of 1, 2, ... words from each word on; ``whole`` where the phrase stays in its piece."""
    words = word_hashes(block, powers)
    low, whole = _mix(words ^ tongue), np.ones(len(words), dtype=bool)
    yield low, whole
    for k in range(1, longest):
        low = _mix(low[:-1] * np.uint64(_ODD) + words[k:]) if len(low) else low
        whole = whole[:-1] & block.glued[k - 1 :] if len(whole) else whole
        yield low, whole


def _tongues(column: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """Languages of the rows as bytes, null as ``und``, and a hash of each."""
    names = [b"und" if x is None else x.encode() for x in column.to_pylist()]
    known = {x: int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") for x in set(names)}
    return names, np.array([known[x] for x in names], dtype=np.uint64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Pieces, list[bytes], np.ndarray, np.ndarray]]:
    """``(words, languages, text of each word, language hash of each word)``."""
    for rows in row_chunks(batches):
        block = Pieces(as_bytes(rows.column("text")))
        names, hashes = _tongues(rows.column("lang"))
        text = np.repeat(np.arange(len(names)), np.diff(block.first))
        yield block, names, text, hashes[text]


class Filter:
    """A set of hashes that may hold more than were put in; a bit for each value of the top bits."""

    def __init__(self, hashes: DataFrame, many: int) -> None:
        self.shift = 64 - max(15, min(FILTER_BITS.bit_length() - 1, (many * 64).bit_length()))
        top = F.shiftrightunsigned("h", self.shift) + 1  # bitmaps count from 1
        rows = hashes.select(F.bitmap_bucket_number(top).alias("b"), F.bitmap_bit_position(top).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
        self.bits = np.zeros(1 << max(64 - self.shift - 3, 12), dtype=np.uint8)
        for r in rows.toLocalIterator():  # FILTER_BITS in all at most
            at = (r.b - 1) * len(r.bits)
            self.bits[at : at + len(r.bits)] = np.frombuffer(r.bits, dtype=np.uint8)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        top = h >> np.uint64(self.shift)
        return (self.bits[(top >> np.uint64(3)).astype(np.int64)] >> (top & np.uint64(7)).astype(np.uint8)) & 1 == 1


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys, which it also holds by slot.

    Each level throws the keys left over into twice as many bits; keys alone on
    a bit stay, and the others go to the next level. A slot is the rank of a bit.
    """

    def __init__(self, keys: np.ndarray) -> None:
        self.levels, left, slots = [], keys, 0
        while len(left):
            at = self._place(left, len(self.levels), 2 * len(left))
            alone = np.bincount(at, minlength=2 * len(left)) == 1
            self.levels.append((alone, slots + np.cumsum(alone) - 1))
            left, slots = left[~alone[at]], slots + int(alone.sum())
        self.keys = np.zeros(slots, dtype=np.uint64)
        if slots:
            self.keys[self._slot(keys)] = keys

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_mix(keys + np.uint64(_ODD * (level + 1) % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        slot, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (bits, rank) in enumerate(self.levels):
            at = self._place(keys[open_], level, len(bits))
            hit = bits[at]
            slot[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        return slot

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for what is not the key stored there."""
        slot = self._slot(keys)
        if not len(self.keys):
            return slot
        return np.where((slot >= 0) & (self.keys[slot] == keys), slot, -1)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def candidate_hashes(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame | None, int]:
    """``(h)`` of all phrases of up to ``longest`` words whose hash counts at least ``least``, and how many."""
    sc, found, total, passed = docs.sparkSession.sparkContext, [], 0, None
    for level in range(1, longest + 1):

        def run(batches: Iterator[pa.RecordBatch], level: int = level, passed=passed) -> Iterator[pa.RecordBatch]:
            powers, held, size = _Powers(), [], 0

            def counted() -> pa.RecordBatch:
                h, n = np.unique(np.concatenate(held), return_counts=True)
                return pa.RecordBatch.from_arrays([_signed(h), pa.array(n.astype(np.int64))], names=["h", "n"])

            for block, _, _, tongue in _blocks(batches):
                before = None
                for k, (h, whole) in enumerate(phrase_hashes(block, tongue, powers, level), 1):
                    if k == level - 1:
                        before = passed.value(h)
                if before is not None:
                    whole = whole & before[:-1] & before[1:] if len(before) else whole
                held.append(h[whole])
                size += len(block.data)
                if size >= FLUSH_BYTES:
                    yield counted()
                    held, size = [], 0
            if held:
                yield counted()

        counts = docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
        frequent = written(counts.where(F.col("n") >= least).select("h"), f"phrases{level}")
        many = frequent.count()
        if passed is not None:
            passed.unpersist()
        if not many:
            break
        found.append(frequent)
        total += many
        passed = sc.broadcast(Filter(frequent, many))
    return (reduce(DataFrame.union, found).distinct() if found else None), total


def _windows(block: Pieces, text: np.ndarray, hashes, passed: Filter, table: PerfectHash) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(words, first word, slot)`` of the phrases that are candidates by their hash."""
    for k, (h, whole) in enumerate(hashes, 1):
        at = np.flatnonzero(whole)
        at = at[passed(h[at])]
        slot = table(h[at])
        yield k, at[slot >= 0], slot[slot >= 0]


def _count_slots(docs: DataFrame, passed, table, longest: int, totals: bool) -> DataFrame:
    """``(part, block, slots, keys, counts)`` of each mapper; with ``totals`` also its words by language, in block -1.

    A slot is counted for the words it is stored with. Should other words share
    its hash, they are counted under the same slot and their own key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, size = _Powers(), len(table.value.keys)
        stored: list[bytes | None] = [None] * size
        counts, others, words = np.zeros(size, dtype=np.int64), {}, {}
        for block, names, text, tongue in _blocks(batches):
            for name, n in zip(names, np.diff(block.first).tolist(), strict=True):
                words[name] = words.get(name, 0) + n
            for k, at, slot in _windows(block, text, phrase_hashes(block, tongue, powers, longest), passed.value, table.value):
                while len(at):
                    by = np.argsort(slot, kind="stable")
                    at, slot = at[by], slot[by]
                    head = np.append(True, slot[1:] != slot[:-1])
                    lead = at[np.flatnonzero(head)][np.cumsum(head) - 1]  # the first phrase of each slot
                    a, b = block.start[at], block.start[lead]
                    size_a = block.end[at + k - 1] - a
                    same = (size_a == block.end[lead + k - 1] - b) & (tongue[at] == tongue[lead])
                    some = np.flatnonzero(same & (at != lead))
                    owner, far = ragged(size_a[some])
                    unlike = block.array[a[some][owner] + far] != block.array[b[some][owner] + far]
                    same[some[owner[unlike]]] = False
                    n = np.bincount(np.cumsum(head) - 1, weights=same).astype(np.int64)
                    for s, i, c in zip(slot[head].tolist(), at[head].tolist(), n.tolist(), strict=True):
                        key = names[text[i]] + b"\t" + block.data[block.start[i] : block.end[i + k - 1]]
                        if stored[s] is None:
                            stored[s] = key
                        if stored[s] == key:
                            counts[s] += c
                        else:
                            others[s, key] = others.get((s, key), 0) + c
                    at, slot = at[~same], slot[~same]
        rows = [(s, stored[s], counts[s]) for s in np.flatnonzero(counts)] + [(s, key, c) for (s, key), c in others.items()]
        if totals:
            rows += [(-1, name, n) for name, n in words.items()]
        rows.sort(key=lambda r: r[0])
        slots = np.array([r[0] for r in rows], dtype=np.int64)
        for lo, hi in _stretches(slots // BLOCK):
            one = rows[lo:hi]
            yield pa.RecordBatch.from_arrays([
                pa.array([slots[lo] // BLOCK]), pa.array([slots[lo:hi].tolist()], pa.list_(pa.int64())), pa.array([[r[1] for r in one]], pa.list_(pa.binary())), pa.array([[int(r[2]) for r in one]], pa.list_(pa.int64())),
            ], names=["block", "slots", "keys", "counts"])

    out = docs.mapInArrow(run, "block long, slots array<long>, keys array<binary>, counts array<long>")
    return out.select(F.spark_partition_id().alias("part"), "*")


def _stretches(values: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(values)) + 1
    return list(zip([0, *cuts], [*cuts, len(values)], strict=True)) if len(values) else []


def _sum_blocks(rows: pa.Table) -> pa.Table:
    """One array of counts for a block out of several; equal keys have equal slots."""
    rows = rows.combine_chunks()
    flat = {c: pa.concat_arrays([x.flatten() for x in rows.column(c).chunks]) for c in ("slots", "keys", "counts")}
    code = flat["keys"].dictionary_encode()
    at = code.indices.to_numpy()
    slots, counts = np.zeros(len(code.dictionary), dtype=np.int64), np.zeros(len(code.dictionary), dtype=np.int64)
    slots[at] = flat["slots"].to_numpy()
    np.add.at(counts, at, flat["counts"].to_numpy())
    names = ["part", "block", "slots", "keys", "counts"]
    cols = [rows.column("part")[:1], rows.column("block")[:1], pa.array([slots.tolist()], pa.list_(pa.int64())), pa.array([code.dictionary.to_pylist()], pa.list_(pa.binary())), pa.array([counts.tolist()], pa.list_(pa.int64()))]
    return pa.table(dict(zip(names, cols, strict=True)))


def tree_sum(mapped: DataFrame) -> DataFrame:
    """``(slot, key, n)``: the arrays of all mappers added up, ``FAN`` at a time."""
    width = (mapped.agg(F.max("part")).first()[0] or 0) + 1
    while width > 1:
        near = mapped.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        mapped = near.groupBy("block", "part").applyInArrow(_sum_blocks, "part int, block long, slots array<long>, keys array<binary>, counts array<long>")
        width = -(-width // FAN)
    return mapped.select(F.explode(F.arrays_zip("slots", "keys", "counts")).alias("r")).select(F.col("r.slots").alias("slot"), F.col("r.keys").alias("key"), F.col("r.counts").alias("n"))


def _groups(hashes: DataFrame, groups: int) -> DataFrame:
    """``(g, hashed)``: a pickled :class:`PerfectHash` for each group of candidates."""

    def build(rows: pa.Table) -> pa.Table:
        keys = np.sort(rows.column("h").to_numpy().view(np.uint64))
        return pa.table({"g": rows.column("g")[:1], "hashed": pa.array([pickle.dumps(PerfectHash(keys))], pa.binary())})

    return hashes.withColumn("g", F.pmod("h", F.lit(groups))).groupBy("g").applyInArrow(build, "g long, hashed binary")


def _cuts(phrases: DataFrame, table, groups: int, g: int) -> DataFrame:
    """``(key, cut, left, n)``: counts of the parts of each phrase that lie in group ``g``, read by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        hashed, counts, clashes = table.value
        for batch in batches:
            keys = batch.column("key").to_pylist()
            tongue, parts = {}, []
            for i, key in enumerate(keys):
                name, _, phrase = key.rpartition(b"\t")
                words = phrase.split(b" ")
                if name not in tongue:
                    tongue[name] = len(tongue)
                for c in range(1, len(words)):
                    parts += [(i, c, True, name, b" ".join(words[:c])), (i, c, False, name, b" ".join(words[c:]))]
            if not parts:
                continue
            # each part is a text of its own, so the hash of all its words is that of its first word
            block = Pieces([p[4] for p in parts])
            langs = np.array([int.from_bytes(hashlib.blake2b(n, digest_size=8).digest(), "little") for n in tongue], dtype=np.uint64)
            size = np.diff(block.first)
            each = np.repeat(langs[[tongue[p[3]] for p in parts]], size)
            h = np.zeros(len(parts), dtype=np.uint64)
            for k, (low, _) in enumerate(phrase_hashes(block, each, powers, int(size.max())), 1):
                h[size == k] = low[block.first[:-1][size == k]]
            mine = np.flatnonzero(h.view(np.int64) % groups == g)
            slot = hashed(h[mine])
            if (slot < 0).any():
                raise ValueError("a part of a frequent phrase is no candidate")
            out = []
            for at, s in zip(mine.tolist(), slot.tolist(), strict=True):
                i, c, left, name, phrase = parts[at]
                n = clashes.get(name + b"\t" + phrase) if s in clashes else int(counts[s])
                out.append((keys[i], c, left, n))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            kinds = (pa.binary(), pa.int32(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["key", "cut", "left", "n"])

    return phrases.select("key").mapInArrow(run, "key binary, cut int, left boolean, n long")


def _slot_counts(summed: DataFrame, size: int) -> tuple[np.ndarray, dict]:
    """Counts by slot, of a group, and what shares a slot: the slots, and each such key with its count."""
    counts = np.zeros(size, dtype=np.int64)
    once = summed.where("slot >= 0").groupBy("slot").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("keys"))
    rows = once.toArrow()  # a group's slots: about SLOTS
    slots = rows.column("slot").to_numpy()
    counts[slots] = rows.column("n").to_numpy()
    shared = slots[rows.column("keys").to_numpy() > 1].tolist()
    clashes: dict = dict.fromkeys(shared)
    if shared:
        clashes |= {bytes(r.key): r.n for r in summed.where(F.col("slot").isin(shared)).toLocalIterator()}
    return counts, clashes


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """``phrases(key, n)`` with at least ``least`` occurrences, ``words(key, n)`` of each language, ``cuts(key, cut, left, n)``; None without any.

    ``key`` is the language, a tab and the words joined by one space.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    docs = docs.select("text", "lang")
    found, total = candidate_hashes(docs, least, longest)
    if found is None:
        return None
    hashes = written(found, "candidates")
    groups = -(-total // SLOTS)
    tables = written(_groups(hashes, groups), "hashes")
    passed = sc.broadcast(Filter(hashes, total))
    held, summed = [], []
    for g in range(groups):
        blob = tables.where(F.col("g") == g).select("hashed").first()
        hashed = pickle.loads(blob.hashed) if blob else PerfectHash(np.zeros(0, dtype=np.uint64))
        table = sc.broadcast(hashed)
        mapped = written(_count_slots(docs, passed, table, longest, totals=g == 0), "slots")
        one = written(tree_sum(mapped), "counts")
        forget(mapped)
        held.append((hashed, *_slot_counts(one, len(hashed.keys))) if groups == 1 else None)
        summed.append(one)
    every = reduce(DataFrame.unionByName, summed)
    phrases = every.where((F.col("slot") >= 0) & (F.col("n") >= least)).select("key", "n")
    cuts = []
    for g in range(groups):
        if held[g] is None:
            blob = tables.where(F.col("g") == g).select("hashed").first()
            hashed = pickle.loads(blob.hashed) if blob else PerfectHash(np.zeros(0, dtype=np.uint64))
            held[g] = (hashed, *_slot_counts(summed[g], len(hashed.keys)))
        cuts.append(_cuts(phrases.repartition(partitions(spark)), sc.broadcast(held[g]), groups, g))
        held[g] = None
    return phrases, every.where("slot < 0").select("key", "n"), reduce(DataFrame.unionByName, cuts)


_COLUMNS = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, absorbed: int = ABSORBED) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``top`` phrases of each language of ``docs(text, lang)``.

    Phrases have 2 to ``longest`` words of one piece and occur ``a`` times, at
    least ``least``; ``l`` and ``r`` count the parts of the cut with the least
    ``floor(1000 a n / (l r))``, the first such cut. A phrase inside a longer
    one with ``absorbed`` percent of its count goes, of which it is enough to
    look at those of one word more. Order: score, then a, descending, then the
    phrase by bytes. Null languages count as ``und``, null and empty texts have
    no words; repeated rows count each time, and an empty table or one without
    frequent phrases gives no rows. Long texts are taken whole. Other columns
    are ignored.
    """
    found = frequent_phrases(docs, least, longest)
    if found is None:
        return docs.sparkSession.createDataFrame([], _COLUMNS)
    phrases, words, cuts = found
    sides = cuts.groupBy("key", "cut").agg(F.max(F.when(F.col("left"), F.col("n"))).alias("l"), F.max(F.when(~F.col("left"), F.col("n"))).alias("r"))
    text = F.col("key").cast("string")
    lang = F.regexp_extract(text, r"(?s)^(.*)\t[^\t]*$", 1)
    phrase = F.regexp_extract(text, r"(?s)\t([^\t]*)$", 1)
    named = phrases.select(lang.alias("lang"), phrase.alias("phrase"), F.col("n").alias("a"))
    parts = F.split("phrase", " ")
    long = named.where(F.size(parts) > 2).select("lang", "a", F.explode(F.array(F.array_join(F.slice(parts, 1, F.size(parts) - 1), " "), F.array_join(F.slice(parts, 2, F.size(parts) - 1), " "))).alias("phrase"))
    inside = long.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    total = words.select(F.col("key").cast("string").alias("lang"), "n")
    scored = (
        sides.join(phrases.select("key", F.col("n").alias("a")), "key")
        .select(lang.alias("lang"), phrase.alias("phrase"), "cut", "a", "l", "r")
        .join(total, "lang")
        .withColumn("score", F.expr("(1000 * cast(a as decimal(20,0)) * cast(n as decimal(20,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
        .groupBy("lang", "phrase")
        .agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "cut")).alias("b"))
        .select("lang", "phrase", "b.*")
    )
    kept = scored.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * absorbed))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, '{_UPPER}', '{_SMALL}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0),
f AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase, count(*) AS a FROM i, range(1, 6) t(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
q AS (SELECT * FROM f WHERE a >= 100),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM q WHERE k > 1),
s AS (SELECT c.lang, c.k, c.phrase, c.a, cut, l.a AS l, r.a AS r, n.n::BIGINT AS n, ((1000::HUGEINT * c.a * n.n::HUGEINT) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM c JOIN n USING (lang) JOIN q l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:cut], ' ') JOIN q r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[cut + 1 :], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
d AS (SELECT DISTINCT q.lang, array_to_string(string_split(q.phrase, ' ')[o : o + j - 1], ' ') AS phrase, q.a FROM q, range(2, 5) t(j), range(1, 5) u(o) WHERE j < k AND o + j - 1 <= k),
e AS (SELECT lang, phrase, max(a) AS longer FROM d GROUP BY ALL),
z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN e USING (lang, phrase) WHERE longer IS NULL OR longer < a)
SELECT lang, rank, phrase, a, l, r, n, score FROM z WHERE rank <= 2000"""
