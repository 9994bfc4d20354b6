"""SimHash near-duplicate classes by segment popcounts on a grid.

A 64-bit fingerprint is embedded as 32 bit counts (0, 1 or 2) of two-bit
segments. Hamming distance is at least the Manhattan distance of the
embeddings, so fingerprints at distance ``<= radius`` differ in at most
``radius`` of the grid's segment groups and share the exact counts of all the
others: with ``radius + 2`` groups, every link shares the cell of some pair of
groups. Cells are joined by that key, the Manhattan bound over the remaining
segments prunes, and an exact popcount decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .stages import partitions, released, written
from .words import WordBlock, as_bytes, row_chunks

SEED = 42
SHINGLE = 4
RADIUS = 4
#: Cells up to this size are compared row against row; larger ones by growing components.
SMALL_CELL = 64
#: Cells above this size are cut into blocks, and each pair of blocks is a task of its own.
HOT_CELL = 50_000

_LOW_BITS = np.uint64(0x5555555555555555)


def _shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the word shingles of each text, one text after the other, and how many each has."""
    block = WordBlock([t.lower() for t in texts])
    words = np.diff(block.first)
    count = np.where(words == 0, 0, np.maximum(words - size + 1, 1))
    owner = np.repeat(np.arange(len(words)), count)
    head = block.first[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    tail = np.minimum(head + size - 1, block.first[1:][owner] - 1)
    data, digest = block.data, xxhash.xxh64_intdigest
    spans = zip(block.start[head].tolist(), block.end[tail].tolist(), strict=True)
    return np.fromiter((digest(data[a:b], SEED) for a, b in spans), dtype=np.uint64, count=len(owner)), count


def _fold(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The fingerprint of each text: the bits set in over half its hashes."""
    prints, full = np.zeros(len(count), dtype=np.uint64), np.flatnonzero(count)
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        majority = np.add.reduceat(bits, (np.cumsum(count) - count)[full], axis=0, dtype=np.int32) * 2 > count[full][:, None]
        prints[full] = np.packbits(majority, axis=1, bitorder="little").view(np.uint64).ravel()
    return prints


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)``: the SimHash of each text's word shingles as a signed long.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; shingles keep
    their repeats; a text with fewer words is one shingle, and a null or empty
    text has fingerprint zero. A bit is set when set in over half the hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in row_chunks(batches):
            fp = _fold(*_shingles(as_bytes(rows.column("text")), size))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def embedding(fp: str = "fp") -> F.Column:
    """Bit counts of the 32 two-bit segments, each in its own two bits."""
    x, low = F.col(fp), F.lit(0x5555555555555555)
    next_bit = F.shiftrightunsigned(x, 1)
    both, one = x.bitwiseAND(next_bit).bitwiseAND(low), x.bitwiseXOR(next_bit).bitwiseAND(low)
    return F.shiftleft(both, 1).bitwiseOR(one)


def _cell_masks(radius: int) -> list[int]:
    """Two-bit fields of every pair out of ``radius + 2`` groups of segments, as signed longs."""
    groups = np.array_split(np.arange(32), radius + 2)
    masks = []
    for pair in combinations(groups, 2):
        mask = sum(3 << (2 * int(s)) for g in pair for s in g)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _counts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of neighbouring segments added up, so each of eight bytes of a word holds one count of eight bits."""
    four, byte = np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)
    x = fp - ((fp >> np.uint64(1)) & _LOW_BITS)
    x = (x & four) + ((x >> np.uint64(2)) & four)
    return np.ascontiguousarray((x + (x >> np.uint64(4))) & byte).view(np.int8).reshape(len(fp), -1)


class _Prints:
    """Fingerprints of some rows, and the sizes of their sets where these count."""

    def __init__(self, words: np.ndarray, radius: int, n: np.ndarray | None = None) -> None:
        self.words, self.radius, self.n, self.counts = words, radius, n, _counts(words)

    def near(self, a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
        """Which rows of ``a`` are near their partner in ``b``: sizes first, then the Manhattan bound, then the exact count of bits."""
        b = np.broadcast_to(b, a.shape)
        ok, radius = np.arange(len(a)), np.full(len(a), self.radius)
        if self.n is not None:
            low, high = np.minimum(self.n[a], self.n[b]), np.maximum(self.n[a], self.n[b])
            ok = np.flatnonzero(5 * low >= 4 * high)
            radius = np.where(low[ok] < SMALL_SET, SMALL_RADIUS, self.radius)
        keep = np.abs(self.counts[a[ok]] - self.counts[b[ok]]).sum(axis=1, dtype=np.int32) <= radius
        ok, radius = ok[keep], radius[keep]
        ok = ok[np.bitwise_count(self.words[a[ok]] ^ self.words[b[ok]]).sum(axis=1, dtype=np.int32) <= radius]
        out = np.zeros(len(a), dtype=bool)
        out[ok] = True
        return out


def _grow(prints: _Prints, rest: np.ndarray, node: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A star of edges for each component of one large cell; a row leaves the comparison once it has joined."""
    left, right = [], []
    while len(rest) > 1:
        members, queue, rest = [rest[:1]], [int(rest[0])], rest[1:]
        while queue and len(rest):
            hit = prints.near(rest, queue.pop())
            if hit.any():
                got, rest = rest[hit], rest[~hit]
                members.append(got)
                queue.extend(got.tolist())
        ids = node[np.concatenate(members)]
        if len(ids) > 1:
            left.append(ids)
            right.append(np.full(len(ids), ids.min()))
    return left, right


def links(cells: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(u, v)`` edges that connect exactly what Hamming distance ``<= radius`` connects within each (cell, part).

    ``cells(cell, part, node, n, fp...)``, sorted by cell and part; all further long
    columns are words of the fingerprint. Where ``n`` is not 0 it is the size of a
    set, and sizes of less than 4 to 5 part two rows as well. Small cells give
    every link; of a large cell each component gives one star, so the edges
    stay in proportion to the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])
            held = now if held is None else np.concatenate([held, now], axis=1)
            change = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0))
            if len(change):  # the last cell may go on in the next batch
                cut = int(change[-1]) + 1
                yield from compare(held[:, :cut])
                held = held[:, cut:]
        if held is not None:
            yield from compare(held)

    def compare(held: np.ndarray) -> Iterator[pa.RecordBatch]:
        (cell, part, node, n), words = held[:4], np.ascontiguousarray(held[4:].T).view(np.uint64)
        prints = _Prints(words, radius, n if n.any() else None)
        starts = np.concatenate(([0], np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0)) + 1))
        sizes = np.diff(np.append(starts, len(cell)))
        left, right = [], []
        for s, m in zip(starts[sizes > SMALL_CELL].tolist(), sizes[sizes > SMALL_CELL].tolist(), strict=True):
            a, b = _grow(prints, np.arange(s, s + m), node)
            left += a
            right += b
        ends = np.repeat(starts + sizes, sizes)
        small = np.flatnonzero(np.repeat((sizes <= SMALL_CELL) & (sizes > 1), sizes))
        step = 1
        while len(small := small[small + step < ends[small]]):
            hit = small[prints.near(small, small + step)]
            left.append(node[hit])
            right.append(node[hit + step])
            step += 1
        if left:
            u, v = np.concatenate(left), np.concatenate(right)
            keep = u != v
            yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], names=["u", "v"])

    return cells.mapInArrow(run, "u long, v long")


def _grid(radius: int, fp: str = "fp") -> F.Column:
    """The cells of a fingerprint, one for every pair of segment groups."""
    masks = F.array(*[F.struct(F.lit(i).alias("pair"), F.lit(m).cast("long").alias("mask")) for i, m in enumerate(_cell_masks(radius))])
    return F.transform(masks, lambda x: F.xxhash64(x["pair"], embedding(fp).bitwiseAND(x["mask"])))


def grid_cells(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Each fingerprint of ``distinct(fp, node)`` once for every pair of segment groups, hot cells cut into pairs of blocks, ready for :func:`links`."""
    return _in_parts(distinct.select(F.explode(_grid(radius)).alias("cell"), "node", F.lit(0).cast("long").alias("n"), "fp"))


def _in_parts(rows: DataFrame) -> DataFrame:
    """``rows(cell, node, n, words...)`` with a ``part``, dealt and sorted by both; hot cells are cut into pairs of blocks."""
    # written first, as its size then is known: it is small, and rows need no shuffle to meet it
    hot = written(rows.groupBy("cell").count().where(F.col("count") > HOT_CELL), "hot")
    blocks = F.ceil(F.col("count") / HOT_CELL).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    pair = lambda i: F.least(i, own) * F.lit(1 << 20) + F.greatest(i, own)
    parts = F.when(F.col("count").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), blocks - 1), pair))
    cut = rows.join(hot, "cell", "left").select("cell", F.explode(parts).alias("part"), *rows.columns[1:])
    return cut.repartition(partitions(rows.sparkSession), "cell", "part").sortWithinPartitions("cell", "part")


def near_duplicate_classes(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs(doc_id, text)``.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is
    the smallest doc_id reachable, itself included. Equal fingerprints are
    merged first, so groups of copies cost one row. Extra columns are ignored;
    an empty table gives an empty result; rows that repeat give repeats; rows
    with a null doc_id form no class of their own and get the class of their
    fingerprint.
    """
    prints = written(fingerprints(docs, size), "simhash")
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("node"))
    component = connected_components(links(grid_cells(groups.where("node is not null"), radius), radius))
    # the component table holds linked fingerprints only; others are their own class
    classes = groups.join(component, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(classes, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near copies share at least 4 of 5 of all their distinct five-word shingles.
COPY_WORDS = 5
#: Bands of a set's least shingle hashes and hashes in a band: two sets at similarity 0.8 share
#: none of them with a probability of (1 - 0.8**4)**20, 2 in 10**8 at 0.9 and 2 in 10**5 at 0.8.
BANDS, BAND_HASHES = 20, 4
#: Words of a set's fingerprint, and the bits of all of them that candidates differ in at most. At similarity
#: 0.8 they differ in about 39 of 256 (binomial; 2 in 10**5 exceed 62), at 0.5 in 69, at 0.3 in 89.
PRINTS, COPY_RADIUS = 4, 62
#: Sets with fewer shingles than this have ties in their bits, which asks for more room.
SMALL_SET, SMALL_RADIUS = 10, 96
#: Members of a large candidate group that all others are compared with first.
HUBS = 8
#: Most rows and shingles of a group compared whole, and of a block of a larger one.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1_000_000

_WORDS = [f"f{i}" for i in range(PRINTS)]
_SAME = ["digest", "n", "f0"]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A second hash of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in order, one text after the other, and how many each has."""
    hashes, count = _shingles(texts, size)
    owner = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(count))


def _keys(hashes: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The words of the fingerprint of each set and a digest of it; zeros for an empty one."""
    out = []
    for _ in range(PRINTS):
        out.append(_fold(hashes, n))
        hashes = _mixed(hashes + np.uint64(1))
    digest, full = np.zeros(len(n), dtype=np.uint64), np.flatnonzero(n)
    if len(full):
        digest[full] = np.add.reduceat(hashes, (np.cumsum(n) - n)[full])
    return [*out, digest]


def _bands(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Band keys of the sets that are not empty, one row of ``BANDS`` for each."""
    first = (np.cumsum(n) - n)[n > 0]
    rng = np.random.default_rng(SEED)
    out = np.zeros((len(first), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(first), band, dtype=np.uint64)
        for _ in range(BAND_HASHES):
            odd, flip = (np.uint64(x) for x in rng.integers(0, 1 << 63, 2))
            least = np.minimum.reduceat((hashes ^ flip) * (odd * np.uint64(2) + np.uint64(1)), first)
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + least)
        out[:, band] = key
    return out


def copy_prints(docs: DataFrame, size: int = COPY_WORDS) -> DataFrame:
    """``(row, doc_id, f0..., digest, n, bands)``: fingerprint, digest, size and band keys of each set of distinct shingles.

    A text with fewer words is one shingle; a null or empty text has none, and no bands.
    """
    names = ["row", "doc_id", *_WORDS, "digest", "n", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in row_chunks(batches):
            hashes, n = _sets(as_bytes(rows.column("text")), size)
            bands = _bands(hashes, n) if len(hashes) else np.zeros(0, dtype=np.uint64)
            ends = pa.array(np.concatenate(([0], np.cumsum((n > 0) * BANDS))), pa.int32())
            longs = [pa.array(x.view(np.int64)) for x in _keys(hashes, n)]
            lists = pa.ListArray.from_arrays(ends, pa.array(bands.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column("row"), rows.column("doc_id"), *longs, pa.array(n.astype(np.int64)), lists], names=names)

    schema = f"row long, doc_id long, {', '.join(f'{w} long' for w in _WORDS)}, digest long, n long, bands array<long>"
    return docs.select("row", "doc_id", "text").mapInArrow(run, schema)


def _alike(rows: list[np.ndarray], node: np.ndarray) -> tuple[list[int], list[int]]:
    """A star of edges for each component that similarity 0.8 and more forms among some shingle sets."""
    sizes = np.array([len(x) for x in rows])
    values, codes = np.unique(np.concatenate(rows), return_inverse=True)
    own = np.split(codes, np.cumsum(sizes)[:-1])
    mark = np.zeros(len(values), dtype=bool)
    left, right = [], []
    rest = np.arange(len(rows))
    while len(rest) > 1:
        members, queue, rest = [int(rest[0])], [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            mark[own[at]] = True
            n = sizes[rest]
            shared = np.add.reduceat(mark[np.concatenate([own[i] for i in rest])], np.cumsum(n) - n, dtype=np.int64)
            mark[own[at]] = False
            hit = 9 * shared >= 4 * (n + sizes[at])
            members += rest[hit].tolist()
            queue += rest[hit].tolist()
            rest = rest[~hit]
        ids = node[members]
        left += ids[ids != ids.min()].tolist()
        right += [int(ids.min())] * int((ids != ids.min()).sum())
    return left, right


def verified_links(docs: DataFrame, placed: DataFrame, size: int = COPY_WORDS) -> DataFrame:
    """``(u, v)`` edges that connect what similarity 0.8 connects within each (cell, part).

    ``placed(node, cell, parts)`` says where the set of the text in row ``node`` of
    ``docs(row, text)`` goes. Only these texts are hashed again, and a set moves
    once for each part.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in row_chunks(batches):
            hashes, n = _sets(as_bytes(rows.column("text")), size)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column("cell"), rows.column("parts"), rows.column("node"), lists], names=["cell", "parts", "node", "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, held = None, [], []

        def edges() -> Iterator[pa.RecordBatch]:
            u, v = _alike(held, np.array(nodes)) if len(nodes) > 1 else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            lists = batch.column("shingles")
            flat, cuts = np.asarray(lists.flatten()), np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths()))))
            keys = zip(batch.column("cell").to_pylist(), batch.column("part").to_pylist(), batch.column("node").to_pylist(), strict=True)
            for i, (cell, part, node) in enumerate(keys):
                if now != (cell, part):
                    yield from edges()
                    now, nodes, held = (cell, part), [], []
                nodes.append(node)
                held.append(flat[cuts[i] : cuts[i + 1]].copy())
        yield from edges()

    # written first, as its size then is known: texts move to meet it only where it is too large to broadcast
    placed = written(placed.select("node", "cell", "parts"), "placed")
    texts = docs.select(F.col("row").alias("node"), "text").join(placed, "node")
    rows = texts.mapInArrow(sets, "cell long, parts array<int>, node long, shingles array<long>").withColumn("part", F.explode("parts"))
    blocks = rows.select("cell", "part", "node", "shingles").repartition(partitions(docs.sparkSession), "cell", "part").sortWithinPartitions("cell", "part")
    return blocks.mapInArrow(run, "u long, v long")


def _copy_components(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``(node, component)`` by edges of exact similarity 0.8 and more within the groups of ``known(node, n, cell)``.

    A group's ``cell`` is its smallest node. A small group is compared whole. A
    larger one is cut into blocks, and all blocks hold the group's first
    ``HUBS``; where some are left apart from its first, each of them meets all
    others, block by block.
    """
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    large = written(known.groupBy("cell").agg(blocks.alias("many")).where("many > 1"), "large")
    own = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    first = F.slice(F.array_sort(F.collect_list("node")), 1, HUBS)
    some = known.join(large, "cell").groupBy("cell", F.pmod(F.col("node"), F.lit(64)).alias("p")).agg(first.alias("some"))
    hubs = some.groupBy("cell").agg(F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, HUBS).alias("hubs"))
    hubs = hubs.select(F.explode("hubs").alias("node"), F.lit(True).alias("hub"))
    every = F.sequence(F.lit(0), F.col("many") - 1)
    parts = F.when(F.col("many").isNull(), F.array(F.lit(0))).when(F.col("hub"), every).otherwise(F.array(own("many")))
    placed = known.join(large, "cell", "left").join(hubs, "node", "left").withColumn("parts", parts).drop("many", "hub")
    met = written(verified_links(docs, placed), "met")
    one = connected_components(met)
    if large.isEmpty():
        return one
    left = known.join(large, "cell").join(one, "node", "left").withColumn("apart", F.coalesce("component", "node") != F.col("cell")).drop("component")
    cut = lambda rows, words: F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(words / BLOCK_SHINGLES)).cast("int")
    words = F.when(F.col("apart"), F.col("n")).otherwise(0)
    few = left.groupBy("cell").agg(cut(F.sum(F.col("apart").cast("long")), F.sum(words)).alias("few")).where("few > 0")
    few = written(few, "apart")
    if few.isEmpty():
        return one
    in_many = F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda i: own("many") * F.col("few") + i)
    in_few = F.transform(every, lambda j: j * F.col("few") + own("few"))
    again = left.join(few, "cell").withColumn("parts", F.when(F.col("apart"), F.array_union(in_many, in_few)).otherwise(in_many)).drop("many", "few", "apart")
    return connected_components(met.unionByName(verified_links(docs, again)))


def near_copies(docs: DataFrame, row: str | None = None) -> DataFrame:
    """``(row, doc_id, fingerprint, component_id, kept)``: classes joined by a similarity of 0.8 and more of distinct five-word shingles.

    Pairs are proposed by the grid of :func:`near_duplicate_classes` and, for
    edits that change more bits, by bands of least shingle hashes; the bound on
    both fingerprints prunes, and only the exact similarity links. Equal sets
    are merged first, so copies cost one row; null and empty texts are one set.

    ``component_id`` is the smallest doc_id of a class, null if it has none.
    ``kept`` is true for one row of each class, of the smallest doc_id and row, a
    null doc_id last; so of rows that repeat one stays. ``row`` names a unique
    long column of ``docs``, which then has to be a table; without it rows are
    numbered in a table of their own. Other columns are ignored; an empty
    table gives an empty result.
    """
    if row is None:
        docs = written(docs.select(F.col("doc_id").cast("long"), "text").withColumn("row", F.monotonically_increasing_id()), "rows")
    else:
        docs = docs.select(F.col("doc_id").cast("long"), "text", F.col(row).alias("row"))
    prints = written(copy_prints(docs), "prints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    rest = [F.any_value(c).alias(c) for c in (*_WORDS[1:], "bands")]
    groups = written(prints.groupBy(_SAME).agg(F.min("row").alias("node"), best.alias("best"), F.min("doc_id").alias("doc_id"), *rest), "sets")
    released(docs.sparkSession)
    cells = groups.where("n > 0").select(F.explode(F.concat("bands", _grid(RADIUS, "f0"))).alias("cell"), "node", "n", *_WORDS)
    candidates = connected_components(links(_in_parts(cells), COPY_RADIUS))
    known = written(groups.select("node", "n").join(candidates, "node").withColumnRenamed("component", "cell"), "candidates")
    component = _copy_components(docs, known)
    released(docs.sparkSession)
    named = groups.select(*_SAME, "node", "best", "doc_id").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min("best").alias("first"))
    classes = named.join(smallest, "component").select(*_SAME, "component_id", F.col("first.row").alias("first"))
    fingerprint = F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint")
    return prints.select("row", "doc_id", *_SAME).join(classes, _SAME, "left").select("row", "doc_id", fingerprint, "component_id", (F.col("row") == F.col("first")).alias("kept"))
