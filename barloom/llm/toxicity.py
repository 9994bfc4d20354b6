"""Toxicity by multiple-instance learning: document labels, sentence scores.

A document is a bag of sentences. Each sentence has a logistic score over
chosen words and word beginnings; the document is toxic with probability
``1 - prod(1 - p)`` (noisy-or), so training on document labels alone also says
which sentences offend.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents the model is fitted on at most, the first by hash of their id.
TRAIN_DOCS = 12_000
#: Features kept, by their G-test against the label.
FEATURES = 2_000
#: A feature needs this many labelled documents.
LEAST_DOCS = 5
#: Word beginnings that are features besides the word, in characters.
STEMS = (4, 5, 6)
STEPS, RATE, L2 = 300, 0.1, 1e-4
#: A document is rejected from this score on.
THRESHOLD = 0.3
#: Sentences from this score on are reported as offending.
SENTENCE_THRESHOLD = 0.5

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")
_CACHE = 150_000


def features(word: str) -> list[str]:
    """A word and its beginnings, which are marked by a star."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; such rows never train. Without an id a row has no label and is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    """Weights of the features and the bias of every sentence."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0

    def scorer(self):
        """``text -> (score, [(start, stop, sentence score)])``, with the sentences that offend."""
        cache: dict[str, float] = {}
        weights, bias = self.weights, self.bias
        quiet = math.log1p(math.exp(bias))

        def score(text: str) -> tuple[float, list[tuple[int, int, float]]]:
            total, found = 0.0, []
            for m in _SENTENCE.finditer(text):
                z = 0.0
                for w in _WORD.findall(m[0].lower()):
                    x = cache.get(w)
                    if x is None:
                        if len(cache) > _CACHE:
                            cache.clear()
                        x = cache[w] = sum(weights.get(f, 0.0) for f in features(w))
                    z += x
                if z == 0.0:
                    total += quiet
                    continue
                z = max(-50.0, min(50.0, z + bias))
                total += math.log1p(math.exp(z))
                if z > 0 and (p := 1 / (1 + math.exp(-z))) >= SENTENCE_THRESHOLD:
                    found.append((m.start(), m.end(), p))
            return -math.expm1(-total), found

        return score


def _training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``(text, toxic)`` of at most ``most`` labelled documents outside the held-out part; an id that repeats trains once, by its smallest text."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic is not null")
    one = known.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    known = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id")  # at most ``most`` rows are sent
    return known.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def choose_features(rows: DataFrame, most: int = FEATURES) -> list[str]:
    """The features whose presence goes most with the label, by the G-test on document counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                got = {f for w in set(_WORD.findall((text or "").lower())) for f in features(w)}
                got.add("")  # counts documents
                seen[int(toxic > 0)].update(got)
        names = list(seen[0].keys() | seen[1].keys())
        cols = [pa.array(names), pa.array([seen[1][n] for n in names], pa.int64()), pa.array([seen[0][n] for n in names], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["feature", "pos", "neg"])

    counts = rows.mapInArrow(count, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    all_docs = counts.where("feature = ''").select("pos", "neg").first()
    if all_docs is None or not all_docs.pos or not all_docs.neg:
        return []
    p, n = float(all_docs.pos), float(all_docs.neg)
    seen = F.col("pos") + F.col("neg")
    term = lambda got, want: F.when(got > 0, got * F.ln(got / want)).otherwise(0.0)
    parts = [(F.col("pos"), seen * p / (p + n)), (F.col("neg"), seen * n / (p + n)), (p - F.col("pos"), (p + n - seen) * p / (p + n)), (n - F.col("neg"), (p + n - seen) * n / (p + n))]
    g = sum((term(got.cast("double"), want) for got, want in parts), F.lit(0.0))
    best = counts.where((F.col("feature") != "") & (seen >= LEAST_DOCS)).orderBy(F.desc(g), "feature").limit(most)
    return [r.feature for r in best.select("feature").collect()]


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """The noisy-or model of ``labels(doc_id, toxic)`` over ``docs(doc_id, text)``.

    Fitted on at most ``most`` labelled rows outside the held-out part. Without
    both kinds of label every score is 0.
    """
    rows = _training_rows(docs, labels, most)
    chosen = choose_features(rows)
    if not chosen:
        return Model()
    number = {f: i for i, f in enumerate(chosen)}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"toxic": [], "quiet": [], "sizes": [], "codes": []}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                quiet, sizes, codes = 0, [], []
                for m in _SENTENCE.finditer(text or ""):
                    got = [c for w in _WORD.findall(m[0].lower()) for f in features(w) if (c := number.get(f)) is not None]
                    if got:
                        sizes.append(len(got))
                        codes += got
                    else:
                        quiet += 1
                for k, v in zip(out, (int(toxic > 0), quiet, sizes, codes), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("toxic", pa.int32()), ("quiet", pa.int32()), ("sizes", pa.list_(pa.int32())), ("codes", pa.list_(pa.int32()))]))

    table = rows.mapInArrow(bags, "toxic int, quiet int, sizes array<int>, codes array<int>").toArrow()  # bounded by ``most``
    weights, bias = _descend(table, len(chosen))
    del table
    pa.default_memory_pool().release_unused()  # later stages run in this process too
    return Model({f: float(w) for f, w in zip(chosen, weights, strict=True) if abs(w) > 1e-6}, bias)


@dataclass
class Bags:
    """Documents as bags of sentences: labels, sentences without a feature, and the features of the others, one after the other."""

    toxic: np.ndarray
    quiet: np.ndarray
    doc: np.ndarray
    sentence: np.ndarray
    codes: np.ndarray

    def gradient(self, theta: np.ndarray) -> np.ndarray:
        """Of the mean negative log likelihood of the labels under noisy-or; the last entry is the bias of every sentence."""
        n, docs, sentences = len(theta) - 1, len(self.toxic), len(self.doc)
        z = np.clip(theta[n] + np.bincount(self.sentence, theta[self.codes], sentences), -50, 50)
        p, soft = 1 / (1 + np.exp(-z)), np.logaddexp(0, z)
        p0, soft0 = 1 / (1 + np.exp(-theta[n])), np.logaddexp(0, theta[n])
        log_clean = -(np.bincount(self.doc, soft, docs) + self.quiet * soft0)
        # d loss / d log_clean: -1 for clean documents, e^s / (1 - e^s) for toxic ones
        pull = np.where(self.toxic > 0, -np.exp(log_clean) / np.maximum(-np.expm1(log_clean), 1e-9), 1.0)
        dz = pull[self.doc] * p
        return np.append(np.bincount(self.codes, dz[self.sentence], n), dz.sum() + (pull * self.quiet).sum() * p0) / docs


def _bags(table: pa.Table) -> Bags:
    sizes = table.column("sizes").combine_chunks()
    words = sizes.flatten().to_numpy()
    codes = table.column("codes").combine_chunks().flatten().to_numpy()
    doc = np.repeat(np.arange(table.num_rows, dtype=np.int32), np.diff(sizes.offsets.to_numpy()))
    return Bags(table.column("toxic").to_numpy(), table.column("quiet").to_numpy().astype(float), doc, np.repeat(np.arange(len(words), dtype=np.int32), words), codes)


def _descend(table: pa.Table, n: int) -> tuple[np.ndarray, float]:
    """Adam on the noisy-or likelihood of all bags."""
    bags = _bags(table)
    theta = np.zeros(n + 1)
    theta[n] = -4.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, STEPS + 1):
        grad = bags.gradient(theta)
        grad[:n] += L2 * theta[:n]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:n], float(theta[n])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``offending``, the sentences that offend as code-point spans.

    Only the text is an input. Null and empty texts score 0; equal texts score
    equally; existing columns of these names are replaced, others stay.
    """
    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

    rest = docs.drop("score", "offending")
    span = StructType([StructField("start", LongType()), StructField("stop", LongType()), StructField("score", DoubleType())])
    schema = StructType([*rest.schema.fields, StructField("score", DoubleType()), StructField("offending", ArrayType(span))])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for batch in batches:
            got = [score(t or "") for t in batch.column("text").to_pylist()]
            more = [pa.array([g[0] for g in got], pa.float64()), pa.array([[{"start": a, "stop": b, "score": p} for a, b, p in g[1]] for g in got], spans_type)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "score", "offending"])

    return rest.mapInArrow(run, schema)
