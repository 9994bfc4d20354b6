import hashlib
import random
import re
import zlib

import numpy as np
from barloom.llm import catalog, periodic_runs

from .corpus import awkward, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, least=6, times=4):
    """All maximal runs by their definition: for each period the stretches where words agree, of which the smallest periods count."""
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i >= q and (i, j + q) not in found:
                found[i, j + q] = q
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= max(least, times * q))


def brute(doc, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc is not None:
        h = zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, n_, q in runs for i in range(s + q, s + n_)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *four, sha("".join(f"{s},{n_},{q}\n" for s, n_, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def found(texts, least=6, times=4):
    ids = np.array([x for t in texts for x in t], dtype=np.int64)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    first = np.cumsum([0, *map(len, texts)])
    out = [[] for _ in texts]
    for s, n, q in zip(*periodic_runs.maximal_runs(ids, text, least, times), strict=True):
        out[text[s]].append((s - first[text[s]], n, q))
    return out


def test_runs_of_random_texts_equal_their_definition():
    r = random.Random(3)
    texts = [[r.randrange(k) for _ in range(r.randrange(60))] for k in (1, 2, 2, 2, 3, 3, 4) for _ in range(60)]
    for _ in range(150):  # loops with errors, nested loops, loops that touch
        a, b = ([r.randrange(3) for _ in range(r.randrange(1, 6))] for _ in range(2))
        t = a * r.randrange(2, 9) + b * r.randrange(2, 9) + (a * 3 + b) * r.randrange(1, 5)
        if r.random() < 0.5:
            t[r.randrange(len(t))] = r.randrange(3)
        texts.append(t[r.randrange(3) :])
    for least, times in ((6, 4), (2, 2), (5, 3), (8, 2), (1, 5)):
        assert found(texts, least, times) == [brute_runs(t, least, times) for t in texts]
    assert sum(map(len, found(texts))) > 100


def test_slices_of_leaves_change_nothing(monkeypatch):
    r = random.Random(5)
    texts = [[r.randrange(2) for _ in range(300)] for _ in range(20)]
    whole = found(texts)
    monkeypatch.setattr(periodic_runs, "LEAVES", 50)
    assert found(texts) == whole and any(whole)


def test_long_loops_take_no_quadratic_time():
    n = 200_000
    one = periodic_runs.maximal_runs(np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64))
    assert [x.tolist() for x in one] == [[0], [n], [1]]
    ids = np.tile(np.arange(1000), 200)
    assert [x.tolist() for x in periodic_runs.maximal_runs(ids, np.zeros(n, dtype=np.int64))] == [[0], [n], [1000]]
    a, b = [0], [0, 1]
    while len(b) < 30_000:  # a Fibonacci word, with many squares but few long runs
        a, b = b, b + a
    assert periodic_runs.maximal_runs(np.array(b), np.zeros(len(b), dtype=np.int64))[0].size == 0


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(d, t) for d, t, *_ in awkward(n=200)] + [(None, "x y " * 9), (None, None), (5, "again " * 7), (5, "again " * 7), (10**12, "ä\u0085b " * 12)]
    rows += [(300 + i, " ".join(random.Random(i).choices("abcdefgh", k=i * 3))) for i in range(120)]
    spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, collapsed string, runs int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = catalog.op13_periodic_runs(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted((brute(*r) for r in rows), key=key)
    assert out.where("n_runs > 0").count() > 10


def test_empty_table(spark):
    assert periodic_runs.run_digests(periodic_runs.collapsed_runs(frame(spark, []))).collect() == []
