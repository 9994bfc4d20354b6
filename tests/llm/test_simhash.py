import re

import xxhash
from barloom.llm import simhash
from barloom.llm.components import connected_components

from .corpus import awkward, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    prints = {}
    for doc, text, *_ in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        prints[doc] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    parent = {d: d for d in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {(d, f"{p:016x}", root(d)) for d, p in prints.items()}


def test_equals_brute_force(spark):
    rows = awkward()
    out = simhash.near_duplicate_classes(frame(spark, rows)).collect()
    assert {tuple(r) for r in out} == brute(rows) and len(out) == len(rows)


def test_cells_lose_no_link(spark):
    """Planted chains of fingerprints: every pair within four bits meets, whatever the cell sizes."""
    import random

    r = random.Random(3)
    prints = [r.getrandbits(64) for _ in range(40)]
    for p in list(prints):
        for _ in range(6):
            for b in r.sample(range(64), r.randint(1, 4)):
                p ^= 1 << b
            prints.append(p)
    centre = r.getrandbits(64)
    prints += [centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(a)]
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p, i) for i, p in enumerate(signed)], "fp long, node long")
    got = {r.node: r.component for r in connected_components(simhash.links(simhash.grid_cells(table))).collect()}
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert all(got.get(i, i) == root(i) for i in range(len(prints)))


def test_blocks_of_a_hot_cell_meet(spark, monkeypatch):
    rows = awkward()
    monkeypatch.setattr(simhash, "HOT_CELL", 3)
    out = simhash.near_duplicate_classes(frame(spark, rows)).collect()
    assert {tuple(r) for r in out} == brute(rows)


def test_empty_table(spark):
    assert simhash.near_duplicate_classes(frame(spark, [])).collect() == []


def test_near_copies_by_five_word_shingles(spark):
    """Edited copies join their original, whatever the edit; unrelated texts and null ids stay as they are."""
    import random

    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 9))) for _ in range(4000)]
    common = vocab[:40]
    rows, owner, doc = [], {}, 0
    for _ in range(60):
        words = [r.choice(common) if r.random() < 0.4 else r.choice(vocab) for _ in range(r.randint(120, 400))]
        first = doc
        for copy in range(4):
            w = list(words)
            for _ in range(0 if copy == 0 else max(1, len(w) // 60)):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((doc, " ".join(w), "en", "s", 0, 0, ""))
            owner[doc] = first
            doc += 1
    rows.append((None, None, None, None, None, None, None))
    got = {x.doc_id: x.component_id for x in simhash.near_copies(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    found = sum(got[d] == owner[d] for d in owner)
    assert found >= 0.97 * len(owner)
    assert all(owner[d] == owner[c] for d, c in got.items() if d is not None)


def _copies(rows):
    """Classes by exact similarity of distinct five-word shingles, pair by pair."""
    sets = {}
    for doc, text, *_ in rows:
        w = text.split()
        sets[doc] = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            x, y = sets[a], sets[b]
            if a < b and (10 * len(x & y) >= 8 * len(x | y)):
                i, j = sorted((root(a), root(b)))
                parent[j] = i
    return {d: root(d) for d in sets}


def _edited(seed=11):
    """Contiguous edits at similarities about 0.8 to 0.9, scattered edits at 0.6 to 0.85, and texts that share boilerplate."""
    import random

    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 9))) for _ in range(4000)]
    texts = []
    for _ in range(30):
        words = [r.choice(vocab) for _ in range(r.randint(100, 300))]
        new = lambda n: [r.choice(vocab) for _ in range(n)]
        n = len(words)
        texts += [words, words + new(round(n * r.uniform(0.1, 0.24))), words[: round(n * r.uniform(0.81, 0.9))]]
        k = round(n * r.uniform(0.05, 0.1))
        texts.append(words[:20] + new(k) + words[20 + k :])
        for _ in range(3):
            w = list(words)
            for i in r.sample(range(n), round(n * r.uniform(0.02, 0.05))):
                w[i] = r.choice(vocab)
            texts.append(w)
    line = vocab[:30]
    texts += [line + [r.choice(vocab) for _ in range(60)] for _ in range(80)] + [vocab[:3], vocab[:3], [], []]
    r.shuffle(texts)
    return [(i, " ".join(w), "en", "s", 0, 0, "") for i, w in enumerate(texts)]


def test_near_copies_are_the_exact_similarity(spark):
    rows = _edited()
    want = _copies(rows)
    want |= {i: min(j for j, t, *_ in rows if not t) for i, t, *_ in rows if not t}
    got = {x.doc_id: x.component_id for x in simhash.near_copies(frame(spark, rows)).collect()}
    assert got == want


def test_groups_beyond_their_hubs(spark, monkeypatch):
    """A chain whose far ends do not resemble each other, with few hubs, small blocks and parts."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 100]), "en", "s", 0, 0, "") for i in (5, 70, 3, *range(10, 60, 2))]
    rows += [(i + 200, " ".join(words[9 * i : 9 * i + 100]), "en", "s", 0, 0, "") for i in range(20)]
    for name, value in (("HUBS", 1), ("BLOCK_ROWS", 4), ("HOT_CELL", 5), ("SMALL_CELL", 2)):
        monkeypatch.setattr(simhash, name, value)
    got = {x.doc_id: x.component_id for x in simhash.near_copies(frame(spark, rows)).collect()}
    assert got == _copies(rows)


def test_one_row_of_repeats_and_null_ids_is_kept(spark):
    """Rows that repeat an id, a text or both, and copies without an id: one row of each class stays."""
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    alone = " ".join(f"u{i}" for i in range(60))
    rows = [(7, text), (7, text), (None, text), (3, text + " end"), (7, other), (None, other + " end"), (None, alone), (None, alone), (4, None), (5, ""), (None, " ")]
    frame_ = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, row string, bands int")
    got = simhash.near_copies(frame_).collect()
    assert sorted((x.doc_id, x.component_id) for x in got if x.kept and x.component_id is not None) == [(3, 3), (4, 4), (7, 7)]
    assert sum(x.kept for x in got) == 4 and len(got) == len(rows)
    assert [x.component_id for x in got if x.doc_id == 7] != [7, 7, 7]  # the id's other text has a class of its own
