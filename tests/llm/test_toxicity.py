import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from barloom.llm import toxicity

from .corpus import frame


def corpus(n=900, seed=3):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(300)]
    bad = ["zorgle", "quibnast", "vexhume"]
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(r.choice(vocab) for _ in range(r.randint(3, 9))).capitalize() for _ in range(r.randint(1, 12))]
        toxic = i % 6 == 0
        if toxic:
            k = r.randrange(len(sentences))
            sentences[k] += f" {r.choice(bad)}{r.choice(['', 'en', 'isch'])} {r.choice(bad)}"
        rows.append((i, ". ".join(sentences) + ".", "en", "s", 0, i, ""))
        labels.append((i, 0, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_offending_sentences(spark):
    rows, labels = corpus()
    docs = frame(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = {r.doc_id: r for r in toxicity.scored(docs.withColumn("held", toxicity.held_out()), model).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in out if out[i].held} == set(held)
    right = sum((out[i].score >= toxicity.THRESHOLD) == bool(labels[i][2]) for i in held)
    assert right >= 0.97 * len(held)
    for i in held:
        if labels[i][2]:
            assert any(w in rows[i][1][s.start : s.stop] for s in out[i].offending for w in ("zorgle", "quibnast", "vexhume"))
    assert all(0 <= r.score <= 1 for r in out.values())


def test_only_the_text_counts_and_awkward_rows(spark):
    rows, labels = corpus(300)
    docs = frame(spark, rows)
    table = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (6, 1, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, table)
    odd = frame(spark, [(1, "zorgle quibnast", "en", "a", 1, 0, ""), (2, "zorgle quibnast", None, None, None, None, None), (None, None, None, None, None, None, None), (3, "", "de", "b", 0, 0, ""), (4, "zorgle. " * 30000, "", "", 0, 0, "")])
    out = {r.doc_id: r.score for r in toxicity.scored(odd, model).collect()}
    assert out[1] == out[2] and out[3] == 0 and out[None] == 0 and out[4] > 0.99
    assert toxicity.scored(frame(spark, []), model).collect() == []


def test_without_labels_nothing_is_toxic(spark):
    rows, _ = corpus(20)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(frame(spark, rows), none)
    assert all(r.score < 1e-6 for r in toxicity.scored(frame(spark, rows), model).collect())


def test_scores_are_the_noisy_or_of_sentences(spark):
    """The scorer against the definition, sentence by sentence and word by word."""
    r = random.Random(4)
    vocab = ["alpha", "beta", "betamax", "gam", "delta9", "Über", "epsilon"]
    weights = {"alpha": 1.5, "beta*": 2.0, "betamax": -0.7, "gam": 3.1, "über": 0.4, "epsi*": -2.0, "delt*": 0.2}
    model = toxicity.Model(weights, -3.0)
    texts = ["".join(r.choice(vocab) + r.choice([" ", ". ", "!", "\n", ", "]) for _ in range(r.randint(0, 40))) for _ in range(120)] + [None, "", "...", "gam " * 5000]
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    for row in toxicity.scored(docs, model).collect():
        clean = 0.0
        for sentence in re.findall(r"[^.!?\n]+", texts[row.doc_id] or ""):
            words = re.findall(r"\w+", sentence.lower())
            z = sum(weights.get(f, 0.0) for w in words for f in (w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) > n)))
            clean -= math.log1p(math.exp(min(50.0, max(-50.0, z - 3.0))))
        assert row.score == 1 - math.exp(clean) or abs(row.score - (1 - math.exp(clean))) < 1e-9


def test_gradient_equals_differences_of_the_likelihood():
    r = np.random.default_rng(5)
    docs = [(int(r.random() < 0.4), int(r.integers(0, 3)), [r.integers(0, 6, r.integers(1, 4)).tolist() for _ in range(r.integers(0, 4))]) for _ in range(30)]

    def loss(theta):
        total = 0.0
        for toxic, quiet, sentences in docs:
            clean = -quiet * math.log1p(math.exp(theta[6])) - sum(math.log1p(math.exp(theta[6] + sum(theta[c] for c in s))) for s in sentences)
            total -= math.log(max(1 - math.exp(clean), 1e-300)) if toxic else clean
        return total / len(docs)

    kept = [d for d in docs if not d[0] or d[1] or d[2]]  # a toxic document needs a sentence
    docs = kept
    table = pa.table({"toxic": [d[0] for d in docs], "quiet": [d[1] for d in docs], "sizes": pa.array([[len(s) for s in d[2]] for d in docs], pa.list_(pa.int32())), "codes": pa.array([[c for s in d[2] for c in s] for d in docs], pa.list_(pa.int32()))})
    theta = r.normal(size=7) * 0.7
    got = toxicity._bags(table).gradient(theta)
    for k in range(7):
        step = np.zeros(7)
        step[k] = 1e-5
        assert abs(got[k] - (loss(theta + step) - loss(theta - step)) / 2e-5) < 1e-6


def test_an_id_that_repeats_trains_once(spark):
    rows = [(1, "b zorg"), (1, "a zorg"), (2, "x"), (None, "zorg")]
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, 0, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity._training_rows(spark.createDataFrame(rows, "doc_id long, text string"), labels, 10).collect()
    assert sorted(map(tuple, got)) == [("a zorg", 1), ("x", 0)]
