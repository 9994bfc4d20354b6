"""Maximal periodic runs of words, by branching tandem repeats in a suffix tree.

A *run* is a stretch of words with smallest period ``q`` that no neighbouring
word extends. By Stoye and Gusfield, the last ``2 q`` words of a run are a
*branching* tandem repeat: the suffixes at its two halves part in an inner node
of depth ``q`` of the suffix tree. So for each node the leaves below all its
children but the largest are visited, and for a leaf ``i`` the places ``i + q``
and ``i - q`` are looked up below the other children: a leaf is visited
``log n`` times at most. Rotating such a repeat to the left as far as words
agree gives the run; repeats of one end whose length is a multiple of a shorter
period of the same run are merged into it.

The tree of all texts of a record batch is held as suffix array, common
prefixes and smaller-value intervals in numpy, one tree for each stretch of a
text that can hold a run: each word of a run lies in a short window that occurs
again in its text, so the others need no tree. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import WordBlock, as_bytes, row_chunks

#: Least words of a run, and least periods of a run.
LEAST, TIMES = 6, 4
#: Leaves that are taken in hand at a time.
LEAVES = 1 << 21

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()),
    ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string()),
])


def ragged(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, place in it)`` of the items of groups of these sizes."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def word_ids(block: WordBlock) -> np.ndarray:
    """The same number for equal words of a block."""
    if not len(block):
        return np.zeros(0, dtype=np.int64)
    edges = np.append(block.start, len(block.array)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(block), [None, pa.py_buffer(edges), pa.py_buffer(block.data)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def common(s: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many symbols from ``a`` and ``b`` on agree, going by ``step``, up to ``room``."""
    got = np.zeros(len(a), dtype=np.int64)
    live, size = np.flatnonzero(room > 0), 4
    while len(live):
        take = np.minimum(size, room[live] - got[live])
        owner, at = ragged(take)
        which = live[owner]
        far = step * (got[which] + at)
        unlike = s[a[which] + far] != s[b[which] + far]
        same = np.minimum.reduceat(np.where(unlike, at, take[owner]), np.cumsum(take) - take)
        got[live] += same
        live = live[(same == take) & (got[live] < room[live])]
        size *= 2
    return got


def suffix_array(s: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(order, rank)`` of the suffixes ``s[i:stop[i]]``; symbols of different stretches must differ."""
    order = np.argsort(s, kind="stable")
    head = np.append(True, s[order[1:]] != s[order[:-1]])
    slot = np.arange(len(s))
    rank = np.empty(len(s), dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, slot, 0))
    alone = head & np.append(head[1:], True)
    active, h = slot[~alone], 1
    while len(active):
        at = order[active]
        inside = at + h < stop[at]
        key = rank[at] << 32 | np.where(inside, rank[np.where(inside, at + h, 0)] + 1, 0)
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[active] = at
        head = np.append(True, key[1:] != key[:-1])
        rank[at] = active[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        active = active[~(head & np.append(head[1:], True))]
        h *= 2
    return order, rank


def common_prefixes(s: np.ndarray, order: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before it; only irreducible ones are compared."""
    n = len(s)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    before[(before >= 0) & (s[before] != s)] = -1
    at = np.arange(n)
    inner = (before >= 0) & (at > begin)
    inner[inner] = before[inner] > begin[inner]
    inner[inner] = s[at[inner] - 1] == s[before[inner] - 1]
    known = np.flatnonzero(~inner & (before >= 0))
    shared = np.zeros(n, dtype=np.int64)
    a, b = known, before[known]
    shared[known] = common(s, a, b, np.minimum(stop[a] - a, stop[b] - b), 1)
    last = np.maximum.accumulate(np.where(inner, 0, at))
    return (shared[last] - (at - last))[order]


def smaller_before(v: np.ndarray) -> np.ndarray:
    """Place of the nearest smaller value before each; ``v[0]`` must be the least."""
    to = np.maximum(np.arange(len(v)) - 1, 0)
    live = np.flatnonzero((v[to] >= v) & (v > v[0]))
    while len(live):
        to[live] = to[to[live]]
        live = live[v[to[live]] >= v[live]]
    return to


def branching_repeats(s: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(place, period)`` of every branching tandem repeat of stretches ``s[begin:stop]``."""
    n = len(s)
    order, rank = suffix_array(s, stop)
    shared = np.append(common_prefixes(s, order, begin, stop), 0)
    shared[0] = 0
    cut = np.flatnonzero(shared > 0)
    low, high = smaller_before(shared)[cut], n - smaller_before(shared[::-1])[::-1][cut]
    by = np.argsort(low * (n + 1) + high, kind="stable")
    cut, low, high = cut[by], low[by], high[by]
    new = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])) if len(cut) else np.zeros(0, dtype=bool)
    node = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    # children: from the node's left edge to its first cut, and from each cut to the next or to the right edge
    after = np.append(np.where(new[1:], high[:-1], cut[1:]), high[-1:])
    left, right = np.concatenate([low[first], cut]), np.concatenate([cut[first], after])
    owner = np.concatenate([np.arange(len(first)), node])
    by = np.lexsort((right - left, owner))
    small = by[:-1][owner[by[1:]] == owner[by[:-1]]]  # all but the largest of each node
    depth, lo, hi = shared[cut[first]], low[first], high[first]
    leaves = np.cumsum(right[small] - left[small])
    found = []
    for part in np.split(small, np.flatnonzero(np.diff(leaves // LEAVES)) + 1) if len(small) else []:
        child, at = ragged(right[part] - left[part])
        child = part[child]
        i, v = order[left[child] + at], owner[child]
        d = depth[v]
        for j, place in ((i + d, i), (i - d, i - d)):
            ok = (j >= begin[i]) & (j < stop[i])
            r = rank[np.where(ok, j, 0)]
            ok &= (r >= lo[v]) & (r < hi[v]) & ((r < left[child]) | (r >= right[child]))
            found.append(np.stack([place[ok], d[ok]]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
    return pairs[0], pairs[1]


def maximal_runs(ids: np.ndarray, text: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first word, length, period)`` of all runs of at least ``least`` words and ``times`` (2 or more) periods, by first word, then period.

    ``text`` names the text of each word of ``ids``; runs stay within a text.
    """
    none = np.zeros(0, dtype=np.int64)
    width = min(max(least, times * q) - 2 * q + 1 for q in range(1, least + 1))
    windows = len(ids) - width + 1
    if windows < 2:
        return none, none, none
    # windows of a run occur again a period away; equal hashes of others only make the trees larger
    key = text[:windows].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(width):
        key = (key ^ ids[j : j + windows].astype(np.uint64)) * _ODD
        key ^= key >> np.uint64(29)
    key[text[:windows] != text[width - 1 :]] = np.arange(int((text[:windows] != text[width - 1 :]).sum()), dtype=np.uint64)
    by = np.argsort(key)
    equal = key[by[1:]] == key[by[:-1]]
    again = np.zeros(windows, dtype=bool)
    again[by[1:][equal]] = again[by[:-1][equal]] = True
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    edge[:windows] += again
    edge[width : width + windows] -= again
    at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    if not len(at):
        return none, none, none
    new = np.append(True, (np.diff(at) != 1) | (text[at[1:]] != text[at[:-1]]))
    heads = np.flatnonzero(new)
    stretch = np.cumsum(new) - 1
    begin, stop = heads[stretch], np.append(heads[1:], len(at))[stretch]
    s = np.unique(stretch << 32 | ids[at], return_inverse=True)[1]
    place, period = branching_repeats(s, begin, stop)
    end = place + 2 * period
    by = np.lexsort((period, end))
    place, period, end = place[by], period[by], end[by]
    runs = []
    while len(place):  # the shortest period of each end, then what is no multiple of it
        first = np.append(True, end[1:] != end[:-1])
        i, q = place[first], period[first]
        begun = i - common(s, i - 1, i - 1 + q, i - begin[i], -1)
        length = end[first] - begun
        long = length >= np.maximum(least, times * q)
        runs.append(np.stack([at[begun[long]], length[long], q[long]]))
        group = np.cumsum(first) - 1
        other = ~first & ~((period % q[group] == 0) & (place >= begun[group]))
        place, period, end = place[other], period[other], end[other]
    start, length, period = np.concatenate(runs, axis=1) if runs else (none, none, none)
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def collapsed_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` for every row of ``docs(doc_id, text)``.

    ``runs`` are structs ``(start, length, period)`` by start, then period, with
    words counted from 0; ``collapsed`` holds the words that no run contains
    after its first period, joined by one space. Rows are independent of each
    other, so repeated and null ids do no harm; null and empty texts have no
    words and no runs. A text is taken whole; of one very long text all words
    are in memory. Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in row_chunks(batches):
            block = WordBlock(as_bytes(rows.column("text")))
            sizes = np.diff(block.first)
            start, length, period = maximal_runs(word_ids(block), np.repeat(np.arange(len(sizes)), sizes), least, times)
            edge = np.zeros(len(block) + 1, dtype=np.int64)
            np.add.at(edge, start + period, 1)
            np.add.at(edge, start + length, -1)
            kept = np.cumsum(edge[:-1]) == 0
            spans = np.where(kept, block.end - block.start + 1, 0)
            data = block.array[np.repeat(kept, block.end - block.start + 1)].tobytes()
            ends = np.append(0, np.cumsum(spans))[block.first]
            texts = [data[a : b - 1] if b > a else b"" for a, b in zip(ends[:-1], ends[1:], strict=True)]
            owner = np.searchsorted(block.first, start, side="right") - 1
            offsets = np.searchsorted(owner, np.arange(len(sizes) + 1)).astype(np.int32)
            inner = pa.StructArray.from_arrays([pa.array(x) for x in (start - block.first[owner], length, period)], fields=list(_SCHEMA.field("runs").type.value_type))
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id"), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), inner).cast(_SCHEMA.field("runs").type), pa.array(texts, pa.binary()).cast(pa.string()),
            ], schema=_SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def looped(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` where each tenth document by ``crc32(doc_id)`` repeats a stretch of its words to its end.

    With ``h`` that number, ``g = h // 10`` and ``n`` words, words from
    ``a = g % n`` on become a loop over the next ``1 + (n - a) // (3 + g % 8)``
    words. Rows with a null doc_id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    n = F.size("_w")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    again = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("_w", F.when(i < F.col("_a"), i).otherwise((F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))))
    chosen = docs.select(F.col("doc_id").cast("long"), "text", F.when(h % 10 == 0, words).alias("_w"))
    some = F.col("_w").isNotNull() & (n > 0)
    marked = chosen.select("doc_id", "text", "_w", F.when(some, a).alias("_a"), F.when(some, p).alias("_p"))
    return marked.select("doc_id", F.when(some, F.concat_ws(" ", again)).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Counts, the longest run and digests of :func:`collapsed_runs`."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    found = found.withColumn("_l", longest)
    period = -F.col("_l.p")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_l.s")).alias("start"), F.col("_l.length").alias("length"), period.alias("period"),
        F.floor(1000 * F.col("_l.length") / period).cast("long").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
