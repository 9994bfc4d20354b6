import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from barloom.llm import bpe, catalog, words
from pyspark.sql import functions as F

from .corpus import awkward, frame

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def texts():
    r = random.Random(1)
    out = ["", None, "a", "a" * 500, "ab" * 400, " " * 300, "don't  stop\r\n\x1c\x85x　", "日本語のテキスト", "😀😀 x", "Über größe 12345678", "\x00\x01", "<|endoftext|>", "ciónmente"]
    alphabet = "aábcdeßñ  \n\t,.|0123'Tsé日😀-_"
    out += ["".join(r.choice(alphabet) for _ in range(r.randint(1, 80))) for _ in range(150)]
    out += ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (30, 190, 192, 193, 1000, 5000)]
    return out + [t for _, t, *_ in awkward()]


def test_ids_equal_the_library_and_decode_back(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r.doc_id: r for r in bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH).collect()}
    assert len(out) == len(rows)
    for i, t in rows:
        assert out[i].ids == LIBRARY.encode_ordinary(t or ""), t
        assert bytes(out[i].bytes) == (t or "").encode()


def long_texts():
    """Pieces far over the length from which all pairs of one rank are joined at once."""
    r = random.Random(4)
    out = ["a" * 5000, "=" * 3001, "ab" * 2000, "-=" * 700, "aab" * 900, "é" * 800, "日本語" * 300, " " * 4000 + "x", "\n" * 999]
    out += ["".join(r.choice(letters) for _ in range(n)) for letters in ("ab", "aabbcdee", "the ", "etaoin", "0123456789abcdef", "ĀāĂă") for n in (65, 200, 1200)]
    return out + ["".join(r.choice(["the", "he", "er", "in", "th", "tion", "a", "s"]) for _ in range(n)) for n in (40, 400, 1500)]


def test_long_pieces_equal_the_library(spark):
    rows = list(enumerate(long_texts()))
    for r in bpe.encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), PATH, public_tokenizers.PATTERN).collect():
        assert r.ids == LIBRARY.encode_ordinary(rows[r.doc_id][1]), rows[r.doc_id][1][:50]


def test_every_join_in_one_step_equals_one_at_a_time(spark):
    r = random.Random(8)
    words = ["".join(r.choice(["t", "h", "e", "th", "aa", "a", "an", "d", " the"]) for _ in range(r.randint(2, 30))) for _ in range(150)]
    table = bpe.rank_literal(bpe.load_ranks(PATH), F.col("hex"))
    rows = spark.createDataFrame([(w, w.encode().hex()) for w in words], "word string, hex string")
    for w in rows.select("word", bpe.with_ranks(table, lambda t: bpe.encode_long(F.col("hex"), t)).alias("ids")).collect():
        assert w.ids == LIBRARY._encode_single_piece(w.word.encode())


def test_segments_are_never_crossed():
    ranks = bpe.load_ranks(PATH)
    held = bpe.joins_of(ranks)
    r = random.Random(2)
    for n in (2, 30, 300):
        word = bytes(r.choice(b"qzxkj0129=-") for _ in range(n))
        parts = bpe.segments(word, held)
        assert b"".join(parts) == word
        assert sum((LIBRARY._encode_single_piece(p) for p in parts), []) == LIBRARY._encode_single_piece(word)


def test_digests_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 500)
    monkeypatch.setattr(bpe, "GATHER", 40)
    monkeypatch.setattr(bpe, "row_chunks", lambda batches: words.row_chunks(batches, limit=300))
    rows = awkward()
    text = {d: t or "" for d, t, *_ in rows}
    for r in catalog.token_digests(frame(spark, rows)).collect():
        ids = LIBRARY.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.encode(frame(spark, []), PATH, public_tokenizers.PATTERN).collect() == []


def test_reports_of_the_plan_leave_out_the_ranks(spark):
    """Each report of a plan spells its expressions at every level, so a literal of a megabyte there fills the driver."""
    df = spark.createDataFrame([(1, "some words of a text")], "doc_id long, text string")
    plan = bpe.encode(df, PATH, public_tokenizers.PATTERN)._jdf.queryExecution().executedPlan()
    before = spark.conf.get("spark.sql.maxPlanStringLength")
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 30))
    try:
        assert len(plan.treeString()) < 100_000
    finally:
        spark.conf.set("spark.sql.maxPlanStringLength", before)


def test_decoding_equals_tokens_joined(spark):
    """Arrays and packed ids of empty, null and other rows, in slices, are the tokens one after the other."""
    rows = [(0, None), (1, []), (2, [0, 1, 2]), (3, [50_000, 7]), (4, [])]
    ranks = bpe.load_ranks(PATH)
    token = {r: t for t, r in ranks.items()}
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").coalesce(1)
    for got in bpe.decode(df, PATH).collect():
        assert bytes(got.bytes) == b"".join(token[i] for i in rows[got.doc_id][1] or [])
    packed = spark.createDataFrame([(i, None if x is None else np.array(x, dtype="<u4").tobytes()) for i, x in rows], "doc_id long, ids binary")
    for got in bpe.decode(packed, PATH).collect():
        assert bytes(got.bytes) == b"".join(token[i] for i in rows[got.doc_id][1] or [])


def test_a_task_holds_the_answers_of_one_block_at_a_time(spark, monkeypatch):
    """No row gathers what a task's blocks asked for, as such rows fill an executor with the blocks of a task and the tasks of a bucket."""
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 300)
    rows = [(i, t) for i, t in enumerate(texts()) if t]
    out = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PATH, public_tokenizers.PATTERN)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.doc_id: r.ids for r in out.collect()}
    assert got == {i: LIBRARY.encode_ordinary(t) for i, t in rows}


def test_ids_of_a_block_are_gathered_in_little_memory():
    """Two million ids, 8 MB, cost a worker less than four times that beside what it gives."""
    r = np.random.default_rng(3)
    distinct, docs, each = 1000, 1024, 256
    ids, codes = r.integers(0, 50_000, distinct * 8), r.integers(0, distinct, docs * each)
    order, body = bpe._press(np.arange(distinct)), bpe._press(codes)
    block = pa.table({"ids": [list(range(docs))], "counts": pa.array([[each] * docs], pa.list_(pa.int32())), "body": [body], "order": [order]})
    halves = [(500, ids[4000:]), (0, ids[:4000])]  # of two buckets, in no order
    told = pa.table({"first": [f for f, _ in halves], "sizes": pa.array([[8] * 500] * 2, pa.list_(pa.int32())), "ids": pa.array([x for _, x in halves], pa.list_(pa.int32()))})
    want = ids.reshape(-1, 8)[codes].astype("<u4").tobytes()
    tracemalloc.start()
    try:
        got = b""
        for batch in bpe._texts(block, told, True, None):
            peak = tracemalloc.get_traced_memory()[1] - len(got)
            got += b"".join(batch.column("ids").to_pylist())
            tracemalloc.reset_peak()
            assert peak < 32 << 20
    finally:
        tracemalloc.stop()
    assert got == want
