"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its words' weights,
and a document's is the noisy-or of its sentences': 1 - prod(1 - p). Only document labels are
known; the gradient of the noisy-or sends each label to the sentences that account for it, so the
trained model also tells which sentences offend.

A word's weight is the sum of those of its features: the word and its beginnings of 3 to 6
characters, so inflected and compound forms share what is learned. Features are kept if a
likelihood ratio test over the sample's documents ties them to label 1; weights are at least 0 and a
penalty on their size leaves at 0 what others explain.

Training takes a bounded sample of labelled documents: about ``SAMPLE`` of each label, by a hash, and
of each the distinct features of ``SAMPLE_SENTENCES`` sentences at most from anywhere in the text.
Scores use whole texts.

Defined cases: a null or empty text has no sentence and the score 0; without documents of both
labels every score is the share of label 1 in what there is (0 without any), a constant; null
labels are no use; a document with several labels counts with each; repeated rows are scored each;
very long texts are scored whole, sentence by sentence; columns besides id and text are not read
(``keep`` carries them along by place, so names may clash); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WorkerCache, annotate, arrow_pass, prepare, restore, text_of

SAMPLE, SAMPLE_SENTENCES, SEED = 1500, 60, 11
EPOCHS, RATE, PENALTY, BIAS = 120, 1.0, 1e-3, -10.0
#: Likelihood ratio that a feature's association with label 1 must reach: chance gives about one in 100,000 so much.
LEAST_RATIO = 20.0
THRESHOLD = 0.5
#: Words that a worker keeps.
CACHE = 150_000

#: Bytes that end sentences become line ends, other ASCII that is no letter or digit becomes blanks, A-Z are lowered.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 10 if chr(c) in ".!?\n" else c if chr(c).isalnum() and c < 128 or c > 127 else 32 for c in range(256))


def sentences_of(text: str) -> list[set[bytes]]:
    """Distinct words of each sentence that has any."""
    return [set(w) for s in text.lower().encode().translate(_FOLD).split(b"\n") if (w := s.split())]


def features_of(word: bytes) -> list[int]:
    """63-bit hashes of the word and its beginnings."""
    text = word.decode(errors="replace")
    parts = [b"=" + word, *(b"^" + text[:k].encode() for k in range(3, 7) if len(text) >= k)]
    return [int.from_bytes(hashlib.blake2b(p, digest_size=8).digest(), "little") >> 1 for p in parts]


class Model:
    """Weights by feature and the bias of a sentence."""

    def __init__(self, weights: dict[int, float], bias: float, constant: float | None = None):
        self.weights, self.bias, self.constant = weights, bias, constant

    def word(self, word: bytes) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features_of(word))


def associated(bags: list[list[list[int]]], y: np.ndarray) -> list[int]:
    """Features that stand in more documents of label 1 than chance explains."""
    has = Counter(f for bag, one in zip(bags, y, strict=True) if one for f in {x for s in bag for x in s})
    also = Counter(f for bag, one in zip(bags, y, strict=True) if not one for f in {x for s in bag for x in s} if f in has)
    n1, n0 = y.sum(), len(y) - y.sum()
    names = sorted(has)
    a, c = np.array([has[f] for f in names], np.float64), np.array([also[f] for f in names], np.float64)
    held, all_held = a + c, n1 + n0
    log = lambda x, of: x * np.log(np.maximum(x, 1e-300) / of)
    ratio = 2 * (log(a, held * n1 / all_held) + log(c, held * n0 / all_held) + log(n1 - a, (all_held - held + 1e-300) * n1 / all_held) + log(n0 - c, (all_held - held + 1e-300) * n0 / all_held))
    return [f for f, r, p, q in zip(names, ratio, a, c, strict=True) if r >= LEAST_RATIO and p * n0 > q * n1]


def train(bags: list[list[list[int]]], labels: list[int]) -> Model:
    """bags: of each document the features of each sentence."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Model({}, BIAS, float(y.mean()) if len(y) else 0.0)
    names = associated(bags, y)
    at = {f: i for i, f in enumerate(names)}
    flat, sent_of, doc_of = [], [], []
    for d, bag in enumerate(bags):
        for s in bag:
            for f in {at[x] for x in s if x in at}:
                flat.append(f)
                sent_of.append(len(doc_of))
            doc_of.append(d)
    flat, sent_of, doc_of = np.array(flat, np.int64), np.array(sent_of, np.int64), np.array(doc_of, np.int64)
    w, b, v_w, v_b = np.zeros(len(names)), BIAS, np.full(len(names), 1e-8), 1e-8
    side = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)  # both labels weigh the same
    for _ in range(EPOCHS):
        z = np.bincount(sent_of, w[flat], len(doc_of)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))  # log of no offending sentence
        q = np.clip(-np.expm1(none), 1e-12, 1)
        pull = side * np.where(y == 1, (1 - q) / q, -1.0) / len(y)  # of the log likelihood, by -none
        g = pull[doc_of] * p
        g_w, g_b = np.bincount(flat, g[sent_of], len(names)), g.sum()
        v_w, v_b = v_w + g_w * g_w, v_b + g_b * g_b
        w = np.maximum(w + RATE * g_w / np.sqrt(v_w) - RATE * PENALTY / np.sqrt(v_w), 0)
        b = min(b + RATE / 5 * g_b / np.sqrt(v_b), BIAS)
    return Model({f: float(x) for f, x in zip(names, w) if abs(x) > 1e-3}, float(b))


class _Bags:
    """A sample's sentences as features."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                bag = sentences_of(text)
                if len(bag) > SAMPLE_SENTENCES:
                    rng = np.random.default_rng(len(text))
                    bag = [bag[i] for i in sorted(rng.choice(len(bag), SAMPLE_SENTENCES, replace=False))]
                out.append(b"\n".join(b" ".join(sorted(x[:64] for x in s)) for s in bag))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), b.column(2)], names=["label", "bag", "h"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from documents whose id has a label."""
    prepare(docs.sparkSession)
    h = F.xxhash64(F.lit("toxic"), F.col("id"))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)").distinct()
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model({}, BIAS, float(next(iter(counts), 0)))
    share = F.when(F.col("label") == 1, min(1.0, SAMPLE / counts[1])).otherwise(min(1.0, SAMPLE / counts[0]))
    picked = known.filter(h <= F.lit(float(1 << 63)) * (2 * share - 1)).orderBy(h, "id", "label").limit(4 * SAMPLE)
    d = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).join(F.broadcast(picked), "id")
    bags = d.select("label", "text", h.alias("h")).mapInArrow(_Bags(), "label int, bag binary, h long").orderBy("h", "label", "bag").limit(6 * SAMPLE).collect()
    cache: dict[bytes, list[int]] = {}

    def of(word: bytes) -> list[int]:
        if word not in cache:
            cache[word] = features_of(word)
        return cache[word]

    return train([[[f for w in s.split() for f in of(w)] for s in bytes(r.bag).split(b"\n")] for r in bags], [r.label for r in bags])


class _Weights(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float:
        x = self.model.word(word)
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[word] = x
        return x


#: By the id of the broadcast model.
_weights = WorkerCache(lambda key, shared: _Weights(shared.value))


def sentence_scores(text: str, model: Model) -> list[float]:
    return [float(1 / (1 + np.exp(-(sum(map(model.word, s)) + model.bias)))) for s in sentences_of(text)]


class _Score:
    def __init__(self, shared, key: int):
        self.shared, self.key = shared, key

    def scores(self, texts) -> np.ndarray:
        model = self.shared.value
        weight = _weights.get(self.key, self.shared).__getitem__
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            if model.constant is not None:
                out[i] = model.constant if text else 0.0
            elif bag := sentences_of(text):
                z = np.array([sum(map(weight, s)) for s in bag]) + model.bias  # a word counts once a sentence, as in training
                out[i] = -np.expm1(-np.logaddexp(0, z).sum())  # log(1 - p) is -log(1 + e^z)
        return out

    def __call__(self, doc_id, texts):
        return [doc_id, self.scores(texts)]


class _ScoreText(_Score):
    def __call__(self, texts):
        return [self.scores(texts)]


class _Offending(_Score):
    def __call__(self, doc_id, texts):
        out: list[list] = [[], [], []]
        for d, text in zip(doc_id.to_pylist(), texts):
            for i, p in enumerate(sentence_scores(text, self.shared.value)):
                if p >= THRESHOLD:
                    for c, v in zip(out, (d, i, p)):
                        c.append(v)
        return out


def _shared(spark, model: Model):
    b = spark.sparkContext.broadcast(model)
    return b, b._jbroadcast.id()


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted; one row for each row of docs."""
    prepare(docs.sparkSession)
    out = arrow_pass(docs, [F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")], _Score(*_shared(docs.sparkSession, model)), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def offending(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentence (from 0), score of each sentence that offends by itself."""
    prepare(docs.sparkSession)
    return arrow_pass(docs, [F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")], _Offending(*_shared(docs.sparkSession, model)), "doc_id long, sentence long, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from labels that are not held out, then scores all: doc_id, held_out, score, predicted."""
    model = fit(docs, labels.filter(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    spark = docs.sparkSession
    model = fit(docs, labels.filter(~held_out()), text_col=text_col)
    scored = annotate(docs, text_col, _ScoreText(*_shared(spark, model)), "_score double")
    return restore(scored.filter(F.col("_score") < THRESHOLD), docs)
