"""Exact removal of repeated 20-word passages by super-k-mer partitioning.

Every window of ``window`` words has a minimiser, the leftmost smallest hash of
its ``mer``-word sub-sequences. Consecutive windows with the same minimiser
position form a super-k-mer and travel to the minimiser's bucket as one packed
string. Equal windows have equal minimisers, so a bucket sees every copy of its
windows; sorting them finds the first occurrence (*leader*) of each. A word is
removed when some window over it is not a leader. A document is a doc_id with
the hash of a text, so rows that share an id alone are told apart.

Shuffles carry one compressed block per (map chunk, bucket), copies inside a
chunk are merged before they travel, and a minimiser that is common in the
whole table is split by the hash of the single window, which equal windows also
share, so no bucket depends on one passage. A bucket is sorted by Spark into
slices of a bounded size, and its task holds one slice at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import partitions
from .words import WordBlock, as_bytes, row_chunks

WINDOW = 20
MER = 4
#: Text bytes whose super-k-mers are merged and packed together.
FLUSH_BYTES = 16 << 20
#: A minimiser is hot from a share of all super-k-mers of 1 / HOT, or of one in this many times the partitions.
HOT, HOT_PER_PARTITION = 2000, 4
#: Unpacked bytes of a bucket's slice on average, and most unpacked bytes of one minimiser that are taken apart at a time.
SLICE_BYTES = 32 << 20

_VALUE_BITS = np.uint64(32)
_ODD = 0x9E3779B97F4A7C15
_WRAP = 1 << 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            one = np.ones(size, dtype=np.uint64)
            one[1:] = _ODD
            self.up = np.cumprod(one)
            one[1:] = pow(_ODD, -1, _WRAP)
            self.down = np.cumprod(one)
        return self.up[:n], self.down[:n]


def word_hashes(block: WordBlock, powers: _Powers) -> np.ndarray:
    """A 64-bit hash of each word, by differences of a polynomial prefix sum."""
    up, down = powers.of(len(block.array))
    total = np.zeros(len(block.array) + 1, dtype=np.uint64)
    np.cumsum((block.array.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    return _mix((total[block.end] - total[block.start]) * down[block.start])


def super_kmers(block: WordBlock, powers: _Powers, window: int, mer: int) -> tuple[np.ndarray, ...]:
    """``(text, first window, windows, minimiser)`` of each super-k-mer of a block."""
    words = len(block)
    empty = np.zeros(0, dtype=np.int64)
    if words < window:
        return empty, empty, empty, empty.astype(np.uint64)
    h = word_hashes(block, powers)
    mers = words - mer + 1
    g = np.zeros(mers, dtype=np.uint64)
    for j in range(mer):
        g += h[j : j + mers] * np.uint64(pow(_ODD, j + 1, _WRAP))
    g = _mix(g) >> (np.uint64(64) - _VALUE_BITS) << np.uint64(32) | np.arange(mers, dtype=np.uint64)
    span, low = window - mer + 1, g
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    # low[i] is the minimiser of the window that starts at word i; windows end within their text
    text = np.repeat(np.arange(len(block.first) - 1), np.diff(block.first))
    at = np.arange(len(low))
    ok = at + window <= block.first[1:][text[: len(low)]]
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (low[1:] != low[:-1])
    begin = np.flatnonzero(new)
    run = np.cumsum(ok)
    stop = np.append(run[begin[1:]] - 1, run[-1]) if len(begin) else empty
    return text[begin], begin, stop - run[begin] + 1, low[begin]


def _pack(rows: list[tuple], coder: zstandard.ZstdCompressor) -> bytes:
    """Columns of ``(minimiser, doc_id, text hash, start, windows)`` and the strings, compressed."""
    keys = np.array([r[:5] for r in rows], dtype=np.int64)
    return coder.compress(np.int64(len(rows)).tobytes() + np.ascontiguousarray(keys.T).tobytes() + b"\n".join(r[5] for r in rows))


def _unpack(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
    cols = np.frombuffer(raw, dtype=np.int64, count=5 * n, offset=8).reshape(5, n)
    return cols, raw[8 + 40 * n :].split(b"\n")


def _text_hash(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _dealt(doc: int, text: int, n: int) -> int:
    """The bucket of a document."""
    return zlib.crc32(struct.pack("<qq", doc, text)) % n


def _scan(batches: Iterator[pa.RecordBatch], window: int, mer: int) -> Iterator[list[tuple]]:
    """Super-k-mers of the rows, ``(minimiser, doc_id, text hash, start, windows, packed)``, copies merged per flush."""
    powers = _Powers()
    seen: dict[bytes, tuple] = {}
    size = 0
    for rows in row_chunks(batches):
        ids = rows.column("doc_id").to_numpy(zero_copy_only=False)
        texts = as_bytes(rows.column("text"))
        hashes = np.array([_text_hash(t) for t in texts], dtype=np.int64)
        block = WordBlock(texts)
        text, begin, count, low = super_kmers(block, powers, window, mer)
        data = block.data
        starts = block.start[begin].tolist()
        ends = block.end[begin + count + window - 2].tolist() if len(begin) else []
        docs, local = ids[text].tolist(), (begin - block.first[text]).tolist()
        value = (low >> np.uint64(32)).astype(np.int64).tolist()
        for a, b, v, d, h, s, n in zip(starts, ends, value, docs, hashes[text].tolist(), local, count.tolist(), strict=True):
            packed = data[a:b]
            old = seen.get(packed)
            if old is None or (d, h, s) < old[1:4]:
                seen[packed] = (v, d, h, s, n)
        size += len(data)
        if size >= FLUSH_BYTES:
            yield [(*k, p) for p, k in seen.items()]
            seen, size = {}, 0
    if seen:
        yield [(*k, p) for p, k in seen.items()]


def hot_minimisers(docs: DataFrame, window: int = WINDOW, mer: int = MER) -> tuple[list[int], int]:
    """Minimisers with a large share of all super-k-mers, and the bytes of all of these, copies in a flush merged.

    The share is 1 / ``most``, with ``most`` the larger of ``HOT`` and
    ``HOT_PER_PARTITION`` for each partition. A flush leaves out those below half
    of it, so a minimiser of that share is reported with at least half its
    count; at most ``2 * most`` can be.
    """
    most = max(HOT, HOT_PER_PARTITION * partitions(docs.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _scan(batches, window, mer):
            value, count = np.unique(np.array([r[0] for r in rows], dtype=np.int64), return_counts=True)
            keep = count >= max(2, len(rows) / (2 * most))
            value = np.append(value[keep], [-1, -2])
            count = np.append(count[keep], [len(rows), sum(len(r[5]) + 40 for r in rows)])
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(count.astype(np.int64))], names=["minimiser", "n"])

    counts = docs.mapInArrow(run, "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n"))
    own = {r.minimiser: r.n for r in counts.where("minimiser < 0").collect()}  # two numbers
    least = max(2500, own.get(-1, 0) / (2 * most))
    hot = counts.where((F.col("minimiser") >= 0) & (F.col("n") >= least)).select("minimiser").collect()  # at most 2 * most
    return [r.minimiser for r in hot], own.get(-2, 0)


def _leaders_of(members: dict[bytes, tuple], window: int) -> Iterator[tuple[int, int, int]]:
    """First ``(doc_id, text hash, start)`` of each distinct window of one minimiser; many are taken in parts by the window's hash."""
    parts = 1 + sum(m[3] * window * 8 for m in members.values()) // SLICE_BYTES
    for part in range(parts):
        rows = []
        for packed, (doc, text, start, count) in members.items():
            cut = [0]
            for w in packed.split(b" "):
                cut.append(cut[-1] + len(w) + 1)
            windows = ((packed[cut[i] : cut[i + window] - 1], doc, text, start + i) for i in range(count))
            rows += windows if parts == 1 else (w for w in windows if zlib.crc32(w[0]) % parts == part)
        rows.sort()
        last = None
        for words, *place in rows:
            if words != last:
                last = words
                yield tuple(place)


def repeated_passages(docs: DataFrame, window: int = WINDOW, mer: int = MER) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept, kept_sha256)`` for every row of ``docs(doc_id, text)``.

    A word goes when a window over it has a word sequence that also starts
    earlier (smaller doc_id, or same document, earlier start). Windows are
    judged on the input. Null and empty texts have no words; a row with a null
    doc_id takes no part and is kept whole. Rows with the same doc_id and text
    count as the same document; rows with the same doc_id and other texts are
    documents of their own, in the order of the hash of their texts. Extra
    columns are ignored. A very long text is taken whole.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    known = docs.where("doc_id is not null")
    some, size = hot_minimisers(known, window, mer)
    hot, slices = set(some), 1 + size // (n * SLICE_BYTES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=3)
        for rows in _scan(batches, window, mer):
            buckets = defaultdict(list)
            for row in rows:
                if row[0] in hot:  # one string for each window, dealt by the window itself
                    v, doc, text, start, count, packed = row
                    words = packed.split(b" ")
                    for i in range(count):
                        one = b" ".join(words[i : i + window])
                        h = zlib.crc32(one)
                        buckets[h % n, h // n % slices].append((v, doc, text, start + i, 1, one))
                else:
                    buckets[row[0] % n, row[0] // n % slices].append(row)
            for (b, part), some in buckets.items():
                cols = [pa.array([b], pa.int32()), pa.array([part], pa.int32()), pa.array([_pack(some, coder)], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", "slice", "blob"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=3)
        groups: dict[int, dict[bytes, tuple]] = defaultdict(dict)
        now = None

        def leaders() -> Iterator[pa.RecordBatch]:
            out = defaultdict(lambda: ([], [], [], []))
            for members in groups.values():
                firsts = members.values() if len(members) == 1 else [(*first, 1) for first in _leaders_of(members, window)]
                for one in firsts:
                    for column, x in zip(out[_dealt(one[0], one[1], n)], one, strict=True):
                        column.append(x)
            for b, cols in out.items():
                blob = coder.compress(np.array(cols, dtype=np.int64).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([0]), pa.nulls(1, pa.int64()), pa.array([0]), pa.array([blob], pa.binary())], names=_MOVED)

        for batch in batches:
            for part, blob in zip(batch.column("slice").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if part != now:
                    yield from leaders()
                    groups.clear()
                    now = part
                cols, packed = _unpack(blob)
                for v, d, h, s, c, p in zip(*cols.tolist(), packed, strict=True):
                    old = groups[v].get(p)
                    if old is None or (d, h, s) < old[:3]:  # copies of a string are one member, however many flushes send it
                        groups[v][p] = (d, h, s, c)
        yield from leaders()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=3)
        for rows in row_chunks(batches):
            same = Counter(zip(rows.column("doc_id").to_pylist(), as_bytes(rows.column("text")), strict=True))  # rows that repeat a document move once a chunk
            hashes = [_text_hash(t) for _, t in same]
            to = [h % n if d is None else _dealt(d, h, n) for (d, _), h in zip(same, hashes, strict=True)]
            columns = [pa.array(to, pa.int32()), pa.array(list(same.values()), pa.int64()), pa.array([d for d, _ in same], pa.int64()), pa.array(hashes, pa.int64()), pa.array([coder.compress(t) for _, t in same], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=_MOVED)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        parts, lead = [], None
        for batch in batches:
            rows = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept", "kept_sha256")}
            for times, doc, text, blob in zip(*(batch.column(c).to_pylist() for c in _MOVED[1:]), strict=True):
                if times == 0:
                    parts.append(np.frombuffer(opener.decompress(blob), dtype=np.int64).reshape(4, -1))
                    continue
                if lead is None:
                    lead = np.concatenate(parts, axis=1) if parts else np.zeros((4, 0), dtype=np.int64)
                    lead = lead[:, np.lexsort((lead[1], lead[0]))]
                    parts = []
                block = WordBlock([opener.decompress(blob)])
                words = len(block)
                gone = np.zeros(words, dtype=bool)
                if doc is not None and words >= window:
                    lo, hi = np.searchsorted(lead[0], doc, "left"), np.searchsorted(lead[0], doc, "right")
                    lo, hi = lo + np.searchsorted(lead[1, lo:hi], text, "left"), lo + np.searchsorted(lead[1, lo:hi], text, "right")
                    firsts = np.zeros(words - window + 2, dtype=np.int64)
                    np.add.at(firsts, lead[2, lo:hi], 1)
                    np.add.at(firsts, lead[2, lo:hi] + lead[3, lo:hi], -1)
                    repeat = np.cumsum(firsts[:-1]) <= 0
                    cover = np.zeros(words + 1, dtype=np.int64)
                    cover[: len(repeat)] += repeat
                    cover[window : window + len(repeat)] -= repeat
                    gone = np.cumsum(cover[:-1]) > 0
                kept = block.array[np.repeat(~gone, block.end - block.start + 1)].tobytes()[:-1]
                row = (doc, words, int(gone.sum()), kept.decode(), hashlib.sha256(kept).hexdigest())
                for _ in range(times):
                    for column, x in zip(rows.values(), row, strict=True):
                        column.append(x)
                    if len(rows["doc_id"]) >= 500:
                        yield pa.RecordBatch.from_pydict(rows, schema=_CUT_SCHEMA)
                        rows = {k: [] for k in rows}
            if rows["doc_id"]:
                yield pa.RecordBatch.from_pydict(rows, schema=_CUT_SCHEMA)

    dealt = known.mapInArrow(pack, "bucket int, slice int, blob binary").repartitionById(n, "bucket").sortWithinPartitions("slice")
    moved = "bucket int, times long, doc_id long, hash long, blob binary"  # times 0: leaders
    both = dealt.mapInArrow(settle, moved).unionByName(docs.mapInArrow(texts, moved))
    return (
        both.repartitionById(n, "bucket")
        .sortWithinPartitions(F.col("times") > 0)
        .mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
    )


_MOVED = ["bucket", "times", "doc_id", "hash", "blob"]
_CUT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())])
