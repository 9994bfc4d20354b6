"""Byte-level BPE: ranked merges folded by higher-order functions over the distinct pieces of a table.

Texts are cut into pieces by the tokenizer's pattern, block by block; a block is
some texts of one task, keeps the numbers of its pieces, and sends each of its
distinct pieces once to the piece's bucket. A bucket holds every copy of its
pieces, so each distinct piece of the table is encoded once, by a fold over its
bytes that joins the adjacent pair of lowest rank until none is ranked, with the
ranks as a literal row of the plan. The ids go back to the blocks by their key,
as a row for each bucket; a task holds the answers of one block at a time, of
which texts take theirs by number. Decoding concatenates the binary pieces of
the ids.

The blocks are written before they are used, so every later step sees the same
numbers whatever is recomputed or in which order rows come.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .stages import bucketed, partitions, released
from .words import row_chunks

#: Characters of a block, whose ids and bytes a Python worker holds together; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Longer pieces are cut where no token can cross, and all pairs of the lowest rank are joined in one step.
LONG_PIECE = 64
#: Pieces whose ids are gathered at a time.
GATHER = 1 << 16
#: The rank map is a literal array of this many small maps, as a lookup in a Spark map scans its keys.
BUCKETS = 1 << 16


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with one base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pattern_of(pattern: str) -> str:
    """The pattern with white space as Unicode's property, as the tokenizer's own engine has it."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


def rank_text(ranks: dict[bytes, int]) -> str:
    """JSON of ``array<map<string, int>>``: hex of a token to its rank, in the bucket of the hex string's crc32."""
    place = sorted((zlib.crc32(key.encode()) % BUCKETS, key, rank) for key, rank in ((token.hex(), rank) for token, rank in ranks.items()))
    parts, now = [], 0
    for bucket, key, rank in place:
        parts.append("{" * (not parts) + "},{" * (bucket - now) + "," * (bool(parts) and bucket == now) + f'"{key}":{rank}')
        now = bucket
    return "[" + ("".join(parts) or "{") + "},{" * (BUCKETS - 1 - now) + "}]"


def rank_table(text: Column) -> Column:
    """The maps that :func:`rank_text` spells, read once for each row."""
    return F.from_json(text, "array<map<string,int>>")


def rank_literal(ranks: dict[bytes, int], beside: Column) -> Column:
    """:func:`rank_table` of a literal in the expression itself, for small plans: every report of the plan spells the whole text.

    ``beside`` is any text of the row: joined to it without a character, the
    string is not folded into the plan as 65,536 maps.
    """
    return rank_table(F.concat(F.lit(rank_text(ranks)), F.substring(F.coalesce(beside, F.lit("")), 1, 0)))


def rank_row(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """``ranks``: the literal as a local table of one row, which reports of the plan name without its text."""
    return spark.createDataFrame(pa.table({"ranks": [rank_text(ranks)]}))


def _rank(table: Column, key: Column) -> Column:
    return F.get(table, (F.crc32(key.cast("binary")) % BUCKETS).cast("int"))[key]


def encode_piece(piece: Column, table: Column) -> Column:
    """Ids of one piece, given as lower-case hex.

    The state has the starts of the current tokens (in bytes, with the end as
    the last entry), the rank of each adjacent pair joined, and the place of the
    lowest rank (from 0, with its neighbours); every step joins the leftmost pair of lowest rank and looks up
    the two pairs beside it.
    """
    n = (F.length(piece) / 2).cast("int")
    cut = lambda a, b: F.substr(piece, a * 2 + 1, (b - a) * 2)
    nothing = F.array().cast("array<int>")
    first = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: _rank(table, cut(i, i + 2)))).otherwise(nothing)

    def located(s: Column, r: Column) -> Column:
        # one-element arrays bind the new state and the place of its lowest rank, so that neither is evaluated again
        one = F.transform(F.array(F.struct(s.alias("s"), r.alias("r"))), lambda x: F.struct(x["s"].alias("s"), x["r"].alias("r"), F.array_position(x["r"], F.array_min(x["r"])).cast("int").alias("next")))
        two = F.transform(one, lambda x: F.struct(x["s"].alias("s"), x["r"].alias("r"), x["next"].alias("next"), (x["next"] - 1).alias("at"), (x["next"] - 2).alias("prev")))
        return F.get(two, F.lit(0))

    def step(acc: Column, _: Column) -> Column:
        s, r, at = acc["s"], acc["r"], acc["at"]
        starts = F.filter(s, lambda _x, i: i != acc["next"])
        left = F.filter(r, lambda _x, i: i != at)
        # the pairs at this place and the one before it have the joined token on a side
        ranks = F.transform(left, lambda old, i: F.when((i == at) | (i == acc["prev"]), _rank(table, cut(F.get(s, i), F.get(s, i + 3)))).otherwise(old))
        return F.when(at.isNull(), acc).otherwise(located(starts, ranks))

    steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(nothing)
    ids = lambda acc: F.transform(
        F.sequence(F.lit(0), F.size(acc["s"]) - 2), lambda i: _rank(table, cut(F.get(acc["s"], i), F.get(acc["s"], i + 1)))
    )
    whole = _rank(table, piece)
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.aggregate(steps, located(F.sequence(F.lit(0), n), first), step, ids))


def encode_long(piece: Column, table: Column) -> Column:
    """Ids of one long piece: as :func:`encode_piece`, with every pair of the lowest rank joined in one step.

    Joining them together is the same as from left to right unless a joined
    token forms a pair of still lower rank with a neighbour, whose turn would
    come first; such a step joins the leftmost pair alone.
    """
    n = (F.length(piece) / 2).cast("int")
    cut = lambda a, b: F.substr(piece, a * 2 + 1, (b - a) * 2)
    first = F.transform(F.sequence(F.lit(0), n - 2), lambda i: _rank(table, cut(i, i + 2)))

    def state(s: Column, r: Column) -> Column:
        return F.struct(s.alias("s"), r.alias("r"), F.array_min(r).alias("low"))

    def joined(s: Column, r: Column, flags: Column) -> Column:
        on = lambda i: F.coalesce(F.get(flags, i) == "1", F.lit(False))
        starts = F.filter(s, lambda _x, i: (i == 0) | ~on(i - 1))
        left = F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda p: ~on(p))
        wide = lambda p: _rank(table, cut(F.get(s, p - on(p - 1).cast("int")), F.get(s, p + 2 + on(p + 1).cast("int"))))
        return state(starts, F.transform(left, lambda p: F.when(on(p - 1) | on(p + 1), wide(p)).otherwise(F.get(r, p))))

    def step(acc: Column, _: Column) -> Column:
        # of neighbouring pairs that overlap every other one is joined, from the left
        spelt = lambda x: F.array_join(F.transform(x["r"], lambda v: F.when(v == x["low"], "1").otherwise("0")), "")
        flagged = F.transform(F.array(acc), lambda x: F.struct(x["s"].alias("s"), x["r"].alias("r"), x["low"].alias("low"), F.split(F.regexp_replace(spelt(x), "11", "10"), "").alias("f")))

        def tried(x: Column) -> Column:
            early = lambda i: (F.get(x["f"], i) == "1") & (F.get(x["f"], i + 2) == "1") & (_rank(table, cut(F.get(x["s"], i), F.get(x["s"], i + 3))) < x["low"])
            clash = F.exists(F.sequence(F.lit(0), F.size(x["r"]) - 1), lambda i: F.coalesce(early(i), F.lit(False)))
            return F.struct(*[x[k].alias(k) for k in ("s", "r", "low", "f")], joined(x["s"], x["r"], x["f"]).alias("all"), clash.alias("clash"))

        def settled(x: Column) -> Column:
            one = F.transform(x["r"], lambda _v, i: F.when(i == F.array_position(x["r"], x["low"]) - 1, "1").otherwise("0"))
            return F.when(x["clash"] | F.coalesce(x["all"]["low"] < x["low"], F.lit(False)), joined(x["s"], x["r"], one)).otherwise(x["all"])

        return F.when(acc["low"].isNull(), acc).otherwise(F.get(F.transform(F.transform(flagged, tried), settled), F.lit(0)))

    ids = lambda acc: F.transform(
        F.sequence(F.lit(0), F.size(acc["s"]) - 2), lambda i: _rank(table, cut(F.get(acc["s"], i), F.get(acc["s"], i + 1)))
    )
    return F.aggregate(F.sequence(F.lit(1), n - 1), state(F.sequence(F.lit(0), n), first), step, ids)


def with_ranks(table: Column, use) -> Column:
    """``use(ranks)`` with the rank literal bound to a variable, so that the plan holds it once."""
    return F.get(F.transform(F.array(table), use), F.lit(0))


def joins_of(ranks: dict[bytes, int]) -> np.ndarray:
    """For each pair of bytes (the first times 256 plus the second) whether some token holds them side by side."""
    held = np.zeros(1 << 16, dtype=bool)
    for token in ranks:
        x = np.frombuffer(token, dtype=np.uint8).astype(np.int64)
        held[x[:-1] * 256 + x[1:]] = True
    return held


def segments(piece: bytes, held: np.ndarray) -> list[bytes]:
    """A piece cut between bytes that no token holds side by side, which no merge can cross."""
    x = np.frombuffer(piece, dtype=np.uint8).astype(np.int64)
    cuts = np.flatnonzero(~held[x[:-1] * 256 + x[1:]]) + 1
    return [piece[a:b] for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(piece)], strict=True)]


def _press(a: np.ndarray) -> bytes:
    """Integers as byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _opened(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel()


def _gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[start:start + length]`` of the places ``at`` in a row, and where each ends."""
    n = length[at]
    edge = np.cumsum(n, dtype=np.int64)
    spots = np.repeat(start[at] - (edge - n), n) + np.arange(int(edge[-1]) if len(edge) else 0)
    return flat[spots], edge


class _Block:
    """Texts of one task: the pieces of all, numbered as they come."""

    def __init__(self) -> None:
        self.ids, self.counts, self.codes, self.size = [], [], [], 0
        self.numbers: defaultdict[str, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__

    def add(self, doc_id, pieces: list[str], size: int) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(pieces))
        self.codes.append(np.fromiter(map(self.numbers.__getitem__, pieces), dtype=np.int32, count=len(pieces)))
        self.size += size

    def rows(self, buckets: int) -> Iterator[tuple]:
        """One row with the texts' codes and one for each bucket with distinct pieces."""
        codes = np.concatenate(self.codes)
        often = np.argsort(-np.bincount(codes, minlength=len(self.numbers)), kind="stable").astype(np.int32)
        code = np.empty_like(often)
        code[often] = np.arange(len(often), dtype=np.int32)  # common pieces have small codes, which pack well
        pieces = [p.encode() for p in self.numbers]
        bucket = np.fromiter((zlib.crc32(p) % buckets for p in pieces), dtype=np.int64, count=len(pieces))
        order = np.array(sorted(range(len(pieces)), key=pieces.__getitem__), dtype=np.int64)
        order = order[np.argsort(bucket[order], kind="stable")]
        yield -1, 0, self.ids, self.counts, _press(code[codes]), _press(code[order])
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1)) if len(order) else np.zeros(0, dtype=int)
        coder = zstandard.ZstdCompressor(level=3)
        for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            yield int(bucket[order[a]]), a, None, None, coder.compress(b"\xff".join(pieces[i] for i in order[a:b].tolist())), None


_BLOCKS = {"task": pa.int32(), "block": pa.int32(), "bucket": pa.int32(), "first": pa.int32(), "ids": pa.list_(pa.int64()), "counts": pa.list_(pa.int32()), "body": pa.binary(), "order": pa.binary()}


def _blocks(docs: DataFrame, pattern: str, buckets: int) -> DataFrame:
    """Rows of :class:`_Block`: ``bucket`` -1 has the texts, others the distinct pieces of that bucket from the ``first`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern_of(pattern)).findall
        task, key, block = TaskContext.get().partitionId(), 0, _Block()

        def done() -> Iterator[pa.RecordBatch]:
            columns = zip(*((task, key, *row) for row in block.rows(buckets)), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _BLOCKS.values(), strict=True)], names=list(_BLOCKS))

        for rows in row_chunks(batches):
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                block.add(doc_id, find(text) if text else [], len(text or ""))
                if block.size >= BLOCK_BYTES:
                    yield from done()
                    key, block = key + 1, _Block()
        if block.ids:
            yield from done()

    schema = "task int, block int, bucket int, first int, ids array<long>, counts array<int>, body binary, order binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _asked(blocks: DataFrame, buckets: int, held: np.ndarray) -> DataFrame:
    """One row for each bucket: its distinct pieces in hex, long ones in segments, and which of them each block asks for."""
    refs = pa.list_(pa.struct([("task", pa.int32()), ("block", pa.int32()), ("first", pa.int32()), ("at", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        opener = zstandard.ZstdDecompressor()
        asks = []
        for batch in batches:
            for task, block, first, body in zip(*(batch.column(c).to_pylist() for c in ("task", "block", "first", "body")), strict=True):
                pieces = opener.decompress(body).split(b"\xff")
                asks.append({"task": task, "block": block, "first": first, "at": np.fromiter(map(numbers.__getitem__, pieces), dtype=np.int32, count=len(pieces))})
        if asks:
            spelt = [p.hex() if len(p) <= LONG_PIECE else "|".join(x.hex() for x in segments(p, held)) for p in numbers]
            yield pa.RecordBatch.from_arrays([pa.array([spelt], pa.list_(pa.string())), pa.array([asks], refs)], names=["pieces", "asks"])

    pieces = blocks.where("bucket >= 0").select("task", "block", "bucket", "first", "body").repartitionById(buckets, "bucket")
    return pieces.mapInArrow(run, "pieces array<string>, asks array<struct<task:int,block:int,first:int,at:array<int>>>")


def _answered(asked: DataFrame, table: Column) -> DataFrame:
    """``(task, block, first, sizes, ids)``: the ids of the pieces that a block asks of a bucket, one piece after the other; a bucket's pieces are encoded once."""

    def one(piece: Column, ranks: Column) -> Column:
        return F.when(F.length(piece) <= 2 * LONG_PIECE, encode_piece(piece, ranks)).otherwise(encode_long(piece, ranks))

    def encoded(piece: Column, ranks: Column) -> Column:
        whole = F.flatten(F.transform(F.split(piece, r"\|"), lambda x: one(x, ranks)))
        return F.when(F.length(piece) <= 2 * LONG_PIECE, encode_piece(piece, ranks)).otherwise(whole)

    def told(ids: Column) -> Column:
        return F.transform("asks", lambda a: F.struct(a["task"].alias("task"), a["block"].alias("block"), a["first"].alias("first"), F.transform(a["at"], lambda i: F.get(ids, i)).alias("ids")))

    answers = with_ranks(table, lambda ranks: F.get(F.transform(F.array(F.transform("pieces", lambda p: encoded(p, ranks))), told), F.lit(0)))
    # flat, one answer at a time: an array for each piece would take 24 bytes and more besides its ids
    flat = [F.transform("a.ids", F.size).alias("sizes"), F.flatten("a.ids").alias("ids")]
    return asked.select(F.explode(answers).alias("a")).select("a.task", "a.block", "a.first", *flat)


def encode(docs: DataFrame, path: str, pattern: str, packed: bool = False, decoded: bool = False) -> DataFrame:
    """``(doc_id, ids)`` for every row of ``docs(doc_id, text)``: the ids of the whole text, ``array<int>``.

    ``packed`` gives them as binary instead, little-endian unsigned 32-bit;
    ``decoded`` adds ``bytes``, what :func:`decode` makes of the ids.

    ``path`` names the vocabulary file and ``pattern`` the tokenizer's pattern,
    whose matches are encoded separately and without special tokens. Null and
    empty texts have no ids; a null doc_id stays null; rows are independent, so
    repeats give repeats; extra columns are ignored; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    ranks = load_ranks(path)
    # as many buckets as tasks read the texts, so a bucket holds about as many pieces as a task sends
    buckets = max(partitions(spark), docs.rdd.getNumPartitions())
    # in buckets by block: the answers go there, the texts do not move
    blocks = bucketed(_blocks(docs, pattern, buckets), "blocks", ["task", "block"], partitions(spark))
    released(spark)
    asked = _asked(blocks, buckets, joins_of(ranks)).crossJoin(F.broadcast(rank_row(spark, ranks)))
    answers = _answered(asked, rank_table(F.col("ranks")))
    texts = blocks.where("bucket < 0").select("task", "block", "ids", "counts", "body", "order")
    shared = spark.sparkContext.broadcast(_tokens(ranks) if decoded else None)  # one vocabulary, of a fixed size

    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_texts(block, told, packed, shared.value))

    schema = f"doc_id long, ids {'binary' if packed else 'array<int>'}{', bytes binary' if decoded else ''}"
    return texts.groupBy("task", "block").cogroup(answers.groupBy("task", "block")).applyInArrow(run, schema)


def _texts(block: pa.Table, told: pa.Table, packed: bool, tokens: pa.Array | None) -> Iterator[pa.RecordBatch]:
    """Ids of each text of a block, by the answers of all its buckets in any order."""
    row = block.combine_chunks().to_batches()[0]
    order = _opened(row.column("order")[0].as_py())
    told = told.take(np.argsort(told.column("first").to_numpy()))  # in the order of bucket and piece
    sizes = pc.list_flatten(told.column("sizes")).to_numpy().astype(np.int64)
    length, start = np.empty(len(order), dtype=np.int64), np.empty(len(order), dtype=np.int64)
    length[order], start[order] = sizes, np.cumsum(sizes) - sizes
    flat = pc.list_flatten(told.column("ids")).to_numpy()
    codes = _opened(row.column("body")[0].as_py())
    ids = row.column("ids").flatten()
    stops = np.cumsum(row.column("counts").flatten().to_numpy(), dtype=np.int64)
    lo = 0
    while lo < len(ids):
        begin = int(stops[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(stops, begin + GATHER, side="right")))
        out, edge = _gathered(flat, start, length, codes[begin : int(stops[hi - 1])])
        ends = np.concatenate(([0], edge))[np.concatenate(([0], stops[lo:hi] - begin))]
        if packed:
            raw = out.astype("<u4").tobytes()
            lists = pa.array([raw[4 * x : 4 * y] for x, y in zip(ends, ends[1:], strict=False)], pa.binary())
        else:
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.int32()))
        cols = [ids.slice(lo, hi - lo), lists]
        if tokens is not None:
            cols.append(_joined(out, ends, tokens))
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "bytes"][: len(cols)])
        lo = hi


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``bytes``: the binary pieces of ``ids`` (an array, or packed), concatenated."""
    shared = encoded.sparkSession.sparkContext.broadcast(_tokens(load_ranks(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            if pa.types.is_binary(ids.type):
                sizes = pc.fill_null(pc.binary_length(ids), 0).to_numpy() // 4
                flat = np.frombuffer(b"".join(x for x in ids.to_pylist() if x), dtype="<u4")
            else:
                sizes, flat = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(), ids.flatten().to_numpy(zero_copy_only=False)
            joined = _joined(flat, np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, joined], names=[*batch.schema.names, "bytes"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("bytes", BinaryType())]))


def _tokens(ranks: dict[bytes, int]) -> pa.Array:
    """Tokens by rank; ranks without one are null."""
    by_rank = {rank: token for token, rank in ranks.items()}
    return pa.array([by_rank.get(i) for i in range(max(by_rank, default=-1) + 1)], pa.large_binary())


def _joined(flat: np.ndarray, ends: np.ndarray, tokens: pa.Array) -> pa.Array:
    """The tokens of each row of ids, concatenated; ``ends`` has where a row of ``flat`` ends, from 0 on."""
    taken = tokens.take(pa.array(flat))
    if taken.null_count:
        raise KeyError("an id that no token has")
    edges = np.frombuffer(taken.buffers()[1], dtype=np.int64, count=len(taken) + 1)[ends]
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(edges.astype(np.int32)), taken.buffers()[2]])
