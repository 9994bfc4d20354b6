import re

from barloom.llm import mixing

from .corpus import awkward, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes, weights):
    """Targets by the plain loop: cap, share the excess again, until none is above."""
    total, target, free = 1.5 * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left = total - sum(target[i] for i in range(len(sizes)) if i not in free)
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] >= 2 * sizes[i]}
        if not over:
            for i in free:
                target[i] = share[i]
            break
        for i in over:
            target[i] = 2.0 * sizes[i]
        free -= over
    return target


def test_targets_and_words_taken(spark):
    rows = awkward(n=400)
    df = frame(spark, rows)
    out = mixing.mixture(df.repartition(3)).collect()
    again = mixing.mixture(df.repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    size = {}
    for d, t, _, s, *_ in rows:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    want = dict(zip(order, fill([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True))
    source = {d: s for d, _, _, s, *_ in rows}
    got = {}
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == size[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == sum(r.taken_by_pass)
        got[s] = got.get(s, 0) + r.taken
    assert len(out) == len(rows)
    assert all(abs(got[s] - want[s]) <= max(0.01 * want[s], 3) for s in want)


def test_mixed_documents_carry_the_words(spark):
    rows = awkward(n=100)
    df = frame(spark, rows)
    mix = {r.doc_id: r.taken for r in mixing.mixture(df).collect()}
    texts = {}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    for r in out.collect():
        texts[r.doc_id] = texts.get(r.doc_id, 0) + len(WORD.findall(r.text))
    assert texts == {d: n for d, n in mix.items() if n}


def test_one_source_without_words_and_empty_table(spark):
    rows = [(1, None, "en", "a", None, 0, ""), (2, " ", "en", "a", None, 0, "")]
    assert [(r.target, r.taken) for r in mixing.mixture(frame(spark, rows)).collect()] == [(0.0, 0), (0.0, 0)]
    assert mixing.mixture(frame(spark, [])).collect() == []


def test_null_and_repeated_ids_are_rows_of_their_own(spark):
    """Words taken by the mix come out as text, at most twice a row, whatever the ids."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, " ".join(f"r{i}w{k}" for k in range(20 + i)), "en", f"s{i % 2}", None, 0, "") for i in range(60)]
    df = frame(spark, rows)
    want = sum(r.taken for r in mixing.mixture(df).collect())
    got = {}
    for r in mixing.mixed_documents(df).collect():
        words = WORD.findall(r.text)
        i = int(words[0][1:].split("w")[0])
        assert r.doc_id == rows[i][0]
        got[i] = got.get(i, 0) + len(words)
    assert all(n <= 2 * (20 + i) for i, n in got.items())
    assert {i % 3 for i in got} == {0, 1, 2} and sum(got.values()) == want


def test_tiny_sources_beside_a_huge_one(spark):
    """Every source comes near its target, down to one of a few words, and equals the SQL twin."""
    import duckdb

    rows = [(i, " ".join(f"w{k}" for k in range(2000)), "en", "big", None, 0, "") for i in range(400)]
    rows += [(1000 + i, " ".join("abc"[: 1 + i % 3] for _ in range(n)), "en", f"tiny{i}", None, 0, "") for i, n in enumerate((1, 3, 12, 40, 150, 900, 5000))]
    df = frame(spark, rows)
    out = mixing.mixture(df).toPandas()
    source = {r[0]: r[3] for r in rows}
    got = out.assign(source=out.doc_id.map(source)).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((got.taken - got.target).abs() <= (0.003 * got.target).clip(lower=3)).all()
    documents = df.select("doc_id", "text", "source").toPandas()  # noqa: F841 - read by the SQL
    want = duckdb.sql(mixing.ORACLE).df().sort_values("doc_id")
    assert want.taken.tolist() == out.sort_values("doc_id").taken.tolist()
