"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised with codebooks of their own; a pair of
centroids is a cell. A query walks pairs in order of summed distance with a
heap until the cells hold enough vectors, and the entries of those cells are
ranked by the exact distance.

How many vectors are enough is measured on a part of the sample (one that the
codebooks have not seen, where the sample is not all there is): how far along
the walk do the nearest ones come? With
more vectors there are more centroids, and the share that has to be looked at
falls; it is small where vectors have structure.

Entries are dealt to blocks by cell. A query goes to each block that holds some
of its cells and brings back its best entries there, so no row is made for a
pair of query and candidate.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stages import partitions, written
from .vectors import distinct_groups, nearest_ids, usable

K = 10
#: Vectors the codebooks are fitted on at most, and vectors that measure the walk, the first by hash. All
#: are fitted where there are no more than both together; beyond that the second have not been seen.
SAMPLE, MEASURED = 56_000, 8_000
#: Vectors that are asked for their nearest, and the share of these that the walk has to meet.
ASKED, RECALL = 400, 0.93
#: Centroids of a half for each root of the number of distinct vectors, and the bounds of a codebook's size.
PER_ROOT, LEAST_CODES, MOST_CODES = 8, 4, 2048
#: Distinct vectors a query looks at in any case.
CANDIDATES = 2_000
ROUNDS = 5
#: Distinct vectors of a block at most, on average.
BLOCK_ROWS = 20_000


def codebook(points: np.ndarray, size: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's k-means from evenly drawn distinct points."""
    unique = np.unique(points, axis=0)
    size = min(size, len(unique))
    centres = unique[np.random.default_rng(1).permutation(len(unique))[:size]].copy()
    for _ in range(rounds):
        near = assign(points, centres)
        count = np.bincount(near, minlength=size)
        used = np.flatnonzero(count)
        order = np.argsort(near, kind="stable")
        centres[used] = np.add.reduceat(points[order], (np.cumsum(count) - count)[used], axis=0) / count[used, None]
    return centres


def squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1), 0)


def assign(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(points[i : i + 4096], centres).argmin(1) for i in range(0, len(points), 4096)]) if len(points) else np.zeros(0, dtype=np.int64)


def split_cells(cells: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted cells as left codes, where each one's cells begin, and right codes."""
    left, first = np.unique(cells // size, return_index=True)
    return left, np.append(first, len(cells)), cells % size


def walk(left: np.ndarray, right: np.ndarray, parts: tuple[np.ndarray, np.ndarray, np.ndarray], counts: np.ndarray, enough: int) -> list[int]:
    """Places of the cells in order of ``left[i] + right[j]`` until they hold ``enough`` entries.

    ``parts`` are the cells that hold any, by :func:`split_cells`. The heap has the next cell of each left code.
    """
    codes, first, others = parts
    gap = right[others]
    order = np.lexsort((gap, np.repeat(np.arange(len(codes)), np.diff(first))))
    near, base, at = gap[order].tolist(), left[codes].tolist(), order.tolist()
    heap = [(base[c] + near[x], x, c) for c, x in enumerate(first[:-1].tolist())]
    heapq.heapify(heap)
    ends, sizes, out, total = first[1:].tolist(), counts.tolist(), [], 0
    while heap and total < enough:
        _, x, c = heap[0]
        out.append(at[x])
        total += sizes[at[x]]
        if x + 1 < ends[c]:
            heapq.heapreplace(heap, (base[c] + near[x + 1], x + 1, c))
        else:
            heapq.heappop(heap)
    return out


def share_needed(held: np.ndarray, books: list[np.ndarray], half: int, n: int, k: int, recall: float = RECALL) -> float:
    """The share of all vectors that a walk has to meet, so that of the nearest ones ``recall`` are among them.

    Measured on ``held``: as many of the nearest as ``k`` of ``n`` are, but one at
    least, which asks for more where ``n`` is large.
    """
    if len(held) < 50:
        return 1.0
    own = lambda x: [x[:, :half], x[:, half:] if x.shape[1] > 1 else x]
    cells = [assign(x, c) for x, c in zip(own(held), books, strict=True)]
    take, places = max(1, round(k * len(held) / n)), []
    for i in range(0, min(ASKED, len(held)), 50):
        asked = held[i : i + 50]
        rows = np.arange(len(asked))
        true = squared(asked, held)
        sums = sum(squared(x, c)[:, cell] for x, c, cell in zip(own(asked), books, cells, strict=True))
        for d in (true, sums):
            d[rows, rows + i] = np.inf
        best = np.argpartition(true, take - 1, axis=1)[:, :take]
        places.append((sums[:, None, :] <= np.take_along_axis(sums, best, axis=1)[:, :, None]).sum(axis=2).ravel())
    return float(np.quantile(np.concatenate(places), recall)) / (len(held) - 1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _best_of(vectors: np.ndarray, nodes: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the ``k`` nearest rows, ties to the smaller node."""
    gap = vectors - query
    d = np.sqrt((gap * gap).sum(axis=1))
    near = np.arange(len(d)) if len(d) <= k else np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
    near = near[np.lexsort((nodes[near], d[near]))][:k]
    return near, d[near]


def ranked(index: DataFrame, probes: DataFrame, blocks: int, k: int) -> DataFrame:
    """``(query, score, ids, node)``: the ``k`` best entries of each block for each query that probes it.

    ``index(cell, v, ids, node)`` and ``probes(block, query, cells)``. A task reads the
    entries of its block first and then streams the queries past them.
    """
    entries = index.select((F.col("cell") % blocks).cast("int").alias("block"), F.lit(0).alias("kind"), "cell", "v", "ids", "node", F.array().cast("array<long>").alias("cells"))
    none = F.lit(None)
    asks = probes.select("block", F.lit(1).alias("kind"), none.cast("long").alias("cell"), F.col("query").alias("v"), none.cast("array<long>").alias("ids"), none.cast("long").alias("node"), "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            block, kind = table.column("block").to_numpy(), table.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(block)], strict=True):
                part = table.slice(lo, hi - lo).combine_chunks()
                if block[lo] != now:
                    now, held, ready = block[lo], [], None
                if kind[lo] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if ready is None:
                    whole = pa.concat_tables(held).combine_chunks()
                    order = np.argsort(whole.column("cell").to_numpy(), kind="stable")
                    ids = whole.column("ids").combine_chunks().take(pa.array(order))
                    cell, first = np.unique(whole.column("cell").to_numpy()[order], return_index=True)
                    ready = (_matrix(whole.column("v").combine_chunks())[order], whole.column("node").to_numpy()[order], ids, dict(zip(cell.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True), strict=True)))
                vectors, nodes, ids, places = ready
                queries, lists = _matrix(part.column("v").combine_chunks()), part.column("cells").to_pylist()
                at, score, owner = [], [], []
                for i, cells in enumerate(lists):
                    rows = np.concatenate([np.arange(*places[c]) for c in cells if c in places] or [np.zeros(0, dtype=int)])
                    if len(rows):
                        near, d = _best_of(vectors[rows], nodes[rows], queries[i], k)
                        at.append(rows[near])
                        score.append(d)
                        owner.append(np.full(len(near), i))
                if at:
                    spots = np.concatenate(at)
                    cols = [part.column("v").combine_chunks().take(pa.array(np.concatenate(owner))), pa.array(np.concatenate(score)), ids.take(pa.array(spots)), pa.array(nodes[spots])]
                    yield pa.RecordBatch.from_arrays(cols, names=["query", "score", "ids", "node"])

    both = entries.unionByName(asks).repartitionById(blocks, "block").sortWithinPartitions("block", "kind")
    return both.mapInArrow(run, "query array<double>, score double, ids array<long>, node long")


def nearest(embeddings: DataFrame, every: int = 100, k: int = K, candidates: int = CANDIDATES, recall: float = RECALL) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows of ``embeddings(vec_id, embedding)`` whose id ``every`` divides.

    Every other row is a candidate, of which each query looks at those in the
    nearest cells: at least ``candidates``, and the share that :func:`share_needed`
    measures for ``recall``. ``score`` is the exact Euclidean distance, ties go to
    the smaller id. Vectors that are null, zero, not finite, or of another
    length than most are left out, and rows with a null id. Equal vectors are one
    entry of the index, with the ``k + 1`` smallest ids, which loses no answer.
    Rows that repeat an id and a vector count once, and other rows of a query's
    id are none of its candidates. Extra columns are ignored; an empty table
    gives an empty result.
    """
    spark = embeddings.sparkSession
    rows = embeddings.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dims = length[0].n if length else 0
    rows = rows.where(F.size("v") == dims)
    groups = written(distinct_groups(rows, "v", k + 1), "groups")
    n = groups.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    most = SAMPLE + MEASURED
    sample = _matrix(groups.orderBy(F.xxhash64("node"), "node").limit(most).select("v").toArrow().column("v").combine_chunks()).astype(np.float32)
    points, held, half = sample[:SAMPLE] if n > most else sample, sample[-MEASURED:], max(1, dims // 2)
    size = min(MOST_CODES, max(LEAST_CODES, 1 << round(math.log2(PER_ROOT * math.sqrt(n)))))
    books = [codebook(points[:, :half], size), codebook(points[:, half:] if dims > 1 else points, size)]
    enough = max(candidates, math.ceil(share_needed(held, books, half, n, k, recall) * n))
    shared = spark.sparkContext.broadcast(books)  # at most 2 * MOST_CODES centroids

    def halves(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        m = _matrix(column)
        return m[:, :half], m[:, half:] if dims > 1 else m

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (assign(x, c) for x, c in zip(halves(batch.column("v")), shared.value, strict=True))
            cell = pa.array((a * len(shared.value[1]) + b).astype(np.int64))
            yield pa.RecordBatch.from_arrays([cell, *batch.columns], names=["cell", *batch.schema.names])

    index = written(groups.mapInArrow(quantise, "cell long, v array<double>, ids array<long>, node long"), "index")
    full = index.groupBy("cell").count().toArrow()  # at most MOST_CODES ** 2 pairs of numbers
    cells, sizes = (full.column(c).to_numpy() for c in ("cell", "count"))
    order = np.argsort(cells, kind="stable")
    table = spark.sparkContext.broadcast((cells[order], sizes[order]))
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("v").alias("query"), F.col("vec_id").alias("query_id")).distinct()
    blocks = max(min(partitions(spark), n // 1000), math.ceil(n / BLOCK_ROWS))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, sizes = table.value
        parts = split_cells(cells, len(shared.value[1]))
        for batch in batches:
            left, right = (squared(x, c) for x, c in zip(halves(batch.column("query")), shared.value, strict=True))
            for i, (a, b) in enumerate(zip(left, right, strict=True)):
                met = cells[walk(a, b, parts, sizes, enough)]
                to = met % blocks
                met = met[np.argsort(to, kind="stable")]
                to, first = np.unique(np.sort(to), return_index=True)
                lists = pa.array(np.split(met, first[1:]), pa.list_(pa.int64()))
                query = batch.column("query").take(pa.array(np.full(len(to), i)))
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), query, lists], names=["block", "query", "cells"])

    # dealt by a key of their own: by the vector they lie as the step before left them, in few tasks
    queries = asked.select("query").distinct().withColumn("deal", F.xxhash64("query", F.lit("deal"))).repartition(partitions(spark), "deal")
    probes = queries.select("query").mapInArrow(probe, "block int, query array<double>, cells array<long>")
    scored = ranked(index, probes, blocks, k + 1)
    order_by = Window.partitionBy("query").orderBy("score", "node")
    found = scored.withColumn("n", F.row_number().over(order_by)).where(F.col("n") <= k + 1)
    return nearest_ids(found.select("query", "score", "ids"), asked, k)
