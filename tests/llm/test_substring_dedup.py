import hashlib
import re

from barloom.llm import substring_dedup
from pyspark.sql import functions as F

from .corpus import awkward, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=20):
    """Rows by doc_id, then the hash of their text; rows that agree in both are one document."""
    texts = {(d, substring_dedup._text_hash((t or "").encode())): t or "" for d, t, *_ in rows}
    words = {key: WORD.findall(t) for key, t in texts.items()}
    seen, gone = set(), {d: set() for d in words}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            key = tuple(words[d][i : i + window])
            if key in seen:
                gone[d].update(range(i, i + window))
            seen.add(key)
    out = set()
    for d, w in words.items():
        kept = " ".join(x for i, x in enumerate(w) if i not in gone[d])
        out.add((d[0], len(w), len(gone[d]), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def digest(df):
    return [tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]


def test_equals_brute_force(spark):
    rows = awkward()
    out = digest(substring_dedup.repeated_passages(frame(spark, rows).repartition(5)))
    assert set(out) == brute(rows) and len(out) == len(rows)
    assert sum(r[2] for r in out) > 300


def test_hot_minimisers_and_slices_change_nothing(spark, monkeypatch):
    rows = awkward(11)
    monkeypatch.setattr(substring_dedup, "SLICE_BYTES", 2000)
    block = substring_dedup.WordBlock([(t or "").encode() for _, t, *_ in rows])
    low = substring_dedup.super_kmers(block, substring_dedup._Powers(), 20, 4)[3] >> 32
    monkeypatch.setattr(substring_dedup, "hot_minimisers", lambda *a: ([int(v) for v in set(low.tolist())][::2], 50_000))
    assert set(digest(substring_dedup.repeated_passages(frame(spark, rows)))) == brute(rows)


def test_common_minimisers_are_found_in_every_flush(spark, monkeypatch):
    """A passage that many texts share is hot; its windows have the same leaders in one part and in many."""
    shared = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"a{i} {shared} b{i}") for i in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    hot, size = substring_dedup.hot_minimisers(df)
    assert hot and size > 8000 * 40
    members = {" ".join([f"x{i}", *t.split()[1:41]]).encode(): (i, 0, 0, 22) for i, t in rows[:300]}
    one = sorted(substring_dedup._leaders_of(members, 20))
    monkeypatch.setattr(substring_dedup, "SLICE_BYTES", 20_000)
    assert sorted(substring_dedup._leaders_of(members, 20)) == one and sorted(d for d, *_ in one) == [0] * 21 + list(range(300))


def test_long_text_and_repeated_ids(spark):
    """Rows that repeat an id count as the same document; a long text is cut as whole."""
    import random

    r = random.Random(2)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    long = [r.choice(vocab) for _ in range(120_000)]
    text = " ".join(long[:60_000] + long[20_000:20_050] + long[60_000:])
    rows = [(1, text), (2, " ".join(long[100:160])), (3, "x " * 30), (3, "x " * 30)]
    out = digest(substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted(set(out)) == sorted(brute(rows)) and len(out) == 4


def test_rows_that_share_an_id_alone_are_documents_of_their_own(spark):
    """Other texts under one id: the words of a document before them go from each, and nothing crashes."""
    zero = " ".join(f"w{i}" for i in range(50))
    rows = [(0, zero), (1, " ".join(f"a{i}" for i in range(50)) + " " + zero), (1, zero + " tail"), (1, "short " * 25), (2, None), (2, ""), (2, "x " * 100)]
    out = digest(substring_dedup.repeated_passages(spark.createDataFrame(rows * 3, "doc_id long, text string").repartition(4)))
    assert len(out) == 21 and set(out) == brute(rows)
    assert sorted(r[1:3] for r in set(out) if r[0] == 1) == [(25, 24), (51, 50), (100, 50)]


def test_null_ids_are_spread_over_tasks(spark):
    rows = [(None, f"text {i} " * 30) for i in range(400)] + [(None, "same " * 40)] * 100
    out = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.where("n_removed > 0").count() == 0 and out.count() == 500
    assert out.select(F.spark_partition_id()).distinct().count() == 4


def test_null_id_is_kept_whole_and_empty_table_is_empty(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u v"
    out = digest(substring_dedup.repeated_passages(spark.createDataFrame([(1, text), (None, text)], "doc_id long, text string")))
    assert sorted(r[1:3] for r in out) == [(22, 0), (22, 0)]
    assert digest(substring_dedup.repeated_passages(frame(spark, []))) == []
