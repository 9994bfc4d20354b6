import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from barloom.llm import phrases

from .corpus import awkward, frame

SPLIT, WORD = re.compile("[.,;:!?\x0a-\x0d]"), re.compile("[^\x20\x09]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top, longest=5, absorbed=100):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in SPLIT.split((text or "").translate(LOWER)):
            w = WORD.findall(piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = set()
    for (lang, *w), a in found.items():
        for k in range(2, len(w)):
            gone |= {q for i in range(len(w) - k + 1) if 100 * a >= absorbed * found[q := (lang, *w[i : i + k])]}
    out = []
    for (lang, *w), a in found.items():
        if (lang, *w) not in gone:
            cuts = [(1000 * a * n[lang] // (f[lang, *w[:c]] * f[lang, *w[c:]]), c) for c in range(1, len(w))]
            score, c = min(cuts)
            out.append((lang, " ".join(w), a, f[lang, *w[:c]], f[lang, *w[c:]], n[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        mine = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        ranked += [(lang, i, *o[1:]) for i, o in enumerate(mine[:top], 1)]
    return sorted(ranked)


def corpus():
    r = random.Random(4)
    vocab = ["Ab", "c", "é", "ÉA", "x\x00y", "(d)", "long-word", "z\u0085w"]
    rows = [(t, lang) for _, t, lang, *_ in awkward()]
    for i in range(300):
        words = [r.choice(vocab[: 2 + i % 7]) + r.choice(["", "", "", ",", ".", "?!", "\n", "\t"]) for _ in range(r.randrange(90))]
        rows.append((" ".join(words), [None, "en", "de", "a\tb", ""][i % 5]))
    return rows + [("one two three four five six " * 30, "en"), ("the " * 500, None), (None, None), ("", "en"), ("...", "fr")]


@pytest.mark.parametrize(("least", "top", "longest", "absorbed"), [(20, 2000, 5, 100), (7, 15, 4, 60), (60, 1, 2, 100)])
def test_equals_brute_force(spark, monkeypatch, least, top, longest, absorbed):
    rows = corpus()
    monkeypatch.setattr(phrases, "SLOTS", 1 << 20 if least == 20 else 30)
    monkeypatch.setattr(phrases, "FAN", 2)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, n int, key string").repartition(7)
    got = phrases.collocations(df, least, longest, top, absorbed)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, least, top, longest, absorbed)
    assert sorted(map(tuple, got.collect())) == want and want


def test_few_bits_let_more_through_and_change_nothing(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(phrases, "FILTER_BITS", 1 << 15)
    got = phrases.collocations(spark.createDataFrame(rows, "text string, lang string"), 10)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, 2000)


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 50_000).astype(np.uint64))
    hashed = phrases.PerfectHash(keys)
    assert sorted(hashed(keys).tolist()) == list(range(len(keys)))
    assert (hashed(keys + np.uint64(1 << 63)) == -1).all()
    assert phrases.PerfectHash(keys[:0])(keys[:3]).tolist() == [-1] * 3


def test_words_that_share_a_hash_keep_their_own_counts(spark):
    rows = [(0, 0, [3, 5, 5], [b"en\ta", b"en\tb", b"en\tc"], [2, 4, 1]), (1, 0, [5], [b"en\tc"], [10]), (5, 0, [3], [b"en\ta"], [7])]
    summed = phrases.tree_sum(spark.createDataFrame(rows, "part int, block long, slots array<long>, keys array<binary>, counts array<long>"))
    assert sorted((r.slot, bytes(r.key), r.n) for r in summed.collect()) == [(3, b"en\ta", 9), (5, b"en\tb", 4), (5, b"en\tc", 11)]
    counts, clashes = phrases._slot_counts(summed, 6)
    assert counts[3] == 9 and clashes[b"en\tb"] == 4 and clashes[b"en\tc"] == 11 and b"en\ta" not in clashes
    one = phrases._sum_blocks(pa.table({"part": [0], "block": [0], "slots": [[1]], "keys": [[b"k"]], "counts": [[1 << 40]]}))
    assert one.column("counts").to_pylist() == [[1 << 40]]


def test_large_counts_stay_exact(spark):
    df = spark.sql("SELECT 123456789012L AS a, 9876543210987L AS n, 123456789013L AS l, 123456789012L AS r")
    score = df.selectExpr("(1000 * cast(a as decimal(20,0)) * cast(n as decimal(20,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) AS s").first().s
    assert score == 1000 * 9876543210987 // 123456789013


def test_tables_without_phrases(spark):
    assert phrases.collocations(frame(spark, [])).collect() == []
    assert phrases.collocations(spark.createDataFrame([("a b", "en"), (None, None)], "text string, lang string")).collect() == []
