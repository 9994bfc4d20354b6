import math
import random

import numpy as np
import pytest
from barloom.llm import code_search, multi_index

SCHEMA = "vec_id long, embedding array<float>, label int, ids string, code long"


def vectors(n=400, dims=16, seed=2):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dims))
    rows = [(i, [float(x) for x in (centres[i % 12] + 0.4 * r.normal(size=dims)).astype("f")], i % 3, "clash", i) for i in range(n)]
    same = rows[7][1]
    rows += [(n + i, same, 0, "", 0) for i in range(120)]  # one very common vector, queries among it
    rows += [(5000, None, 0, "", 0), (5100, [0.0] * dims, 0, "", 0), (5200, [float("nan")] * dims, 0, "", 0), (5300, [float("inf"), *[1.0] * (dims - 1)], 0, "", 0), (5400, [1.0, None] + [0.5] * (dims - 2), 0, "", 0), (5500, [], 0, "", 0)]
    return rows


def good(rows):
    out = {}
    for i, v, *_ in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            out[i] = np.array(v, dtype=float)
    return out


def brute(vecs, every, score, k=10):
    out = {}
    for q, v in vecs.items():
        if q % every == 0:
            near = sorted((score(v, w), i) for i, w in vecs.items() if i != q)[:k]
            out[q] = near
    return out


def test_all_candidates_are_exact_and_few_keep_recall(spark):
    rows = vectors()
    want = brute(good(rows), 20, lambda a, b: math.sqrt(float(((a - b) ** 2).sum())))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    whole = multi_index.nearest(df, every=20, candidates=10**9).collect()
    got = {}
    for r in sorted(whole, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert [i for _, i in got[q]] == [i for _, i in near]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in near], rtol=1e-12)
    some = {(r.query_id, r.vec_id) for r in multi_index.nearest(df, every=20, candidates=100).collect()}
    hits = sum((q, i) in some for q, near in want.items() for _, i in near)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_default_share_keeps_recall_without_structure(spark):
    """Random directions have no clusters to find; the default still looks at enough of them."""
    r = np.random.default_rng(5)
    m = r.normal(size=(6000, 32))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    got = {(x.query_id, x.vec_id) for x in multi_index.nearest(df, candidates=500).collect()}
    want = [(q, int(i)) for q in range(0, 6000, 100) for i in np.argsort(np.where(np.arange(6000) == q, 9, ((m - m[q]) ** 2).sum(axis=1)))[:10]]
    assert sum(p in got for p in want) >= 0.9 * len(want)


def test_walk_goes_by_summed_distance():
    r = random.Random(1)
    left, right = np.array([r.random() for _ in range(5)]), np.array([r.random() for _ in range(6)])
    cells = np.array(sorted(r.sample(range(30), 22)))
    order = [int(cells[x]) for x in multi_index.walk(left, right, multi_index.split_cells(cells, 6), np.ones(22, dtype=int), 22)]
    sums = [left[c // 6] + right[c % 6] for c in order]
    assert sums == sorted(sums) and sorted(order) == cells.tolist()
    assert len(multi_index.walk(left, right, multi_index.split_cells(cells, 6), np.full(22, 4), 9)) == 3


def test_structure_lets_a_walk_stop_early():
    """Clustered vectors need a small share, random directions a large one; both reach the recall they are asked for."""
    r = np.random.default_rng(7)
    centres = r.normal(size=(300, 32))
    shares = []
    for m in (np.repeat(centres, 30, axis=0) + 0.2 * r.normal(size=(9000, 32)), r.normal(size=(9000, 32))):
        m = r.permutation(m).astype(np.float32)
        books = [multi_index.codebook(m[:7500, :16], 512), multi_index.codebook(m[:7500, 16:], 512)]
        shares.append(multi_index.share_needed(m[7500:], books, 16, 9000, 10))
    assert shares[0] < 0.05 < shares[1] < 0.6


def test_repeated_ids_of_vectors(spark):
    """Rows that repeat an id and a vector count once; a query is answered for each of its vectors."""
    rows = [(0, [0.5, 1.0]), (0, [0.5, 1.0]), (100, [0.5, 2.0]), (100, [4.0, 2.0]), (7, [0.5, 1.5]), (7, [0.5, 1.5]), (8, [0.5, 1.5])]
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in multi_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert [g for g in got if g[0] == 0] == [(0, 1, 7, 0.5), (0, 2, 8, 0.5), (0, 3, 100, 1.0), (0, 4, 100, math.hypot(3.5, 1.0))]
    assert len([g for g in got if g[0] == 100]) == 6


@pytest.mark.parametrize(("cuts", "every"), [(None, 50), (4, 50), (7, 10)])
def test_code_search_is_exact(spark, monkeypatch, cuts, every):
    """Whatever the number of segments, so that answers come from rings 0 to 5."""
    if cuts:
        edges = [round(i * 64 / cuts) for i in range(cuts + 1)]
        monkeypatch.setattr(code_search, "segments", lambda n: [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)])
    rows = vectors(n=150, dims=16)
    vecs = {i: v > 0 for i, v in good(rows).items()}
    want = brute(vecs, every, lambda a, b: int((a != b).sum()))
    got = {}
    for r in sorted(code_search.nearest_signs(spark.createDataFrame(rows, SCHEMA), every=every).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert got == want


def test_codes_without_structure_are_searched_by_rings(spark):
    """Random codes, whose k-th distance lies far out, a pair in reach of several rings, and repeated rows."""
    r = random.Random(3)
    codes = [(i, r.getrandbits(64) - (1 << 63)) for i in range(1500)]
    codes += [(2000, codes[0][1]), (2000, codes[0][1]), (2001, codes[0][1] ^ 0x1111), (None, 5), (3, None)]
    got = {}
    for x in sorted(code_search.top_codes(spark.createDataFrame(codes, "vec_id long, code long"), every=100).collect(), key=lambda x: (x.query_id, x.rank)):
        got.setdefault(x.query_id, []).append((x.score, x.vec_id))
    known = {(i, c) for i, c in codes if i is not None and c is not None}
    want = {q: sorted((((a ^ b) & (1 << 64) - 1).bit_count(), i) for i, b in known if i != q)[:10] for q, a in known if q % 100 == 0}
    assert got == want


def test_few_and_no_vectors(spark):
    two = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in multi_index.nearest(two).collect()] == [(0, 1, 1, 0.5)]
    assert [(r.query_id, r.vec_id) for r in code_search.nearest_signs(two).collect()] == [(0, 1)]
    none = spark.createDataFrame([], SCHEMA)
    assert multi_index.nearest(none).collect() == [] and code_search.nearest_signs(none).collect() == []
