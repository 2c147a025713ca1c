"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes in both directions and gives every byte position a distribution
over the languages; it is trained here in numpy by backpropagation through time. A document's
probabilities pool those of all letter positions of its whole text (their mean).

Letters A-Z are read as a-z, and a run of anything that is neither an ASCII letter nor a non-ASCII
byte as one blank. The state runs on across words, over spans of ``SPAN`` bytes that are read side
by side as the rows of one matrix; a span begins with an empty state, so a text of any length takes
bounded memory.

Training takes a bounded sample: about ``SAMPLE_DOCS`` documents of each language, picked by a hash,
and ``SAMPLE_SPANS`` spans at most from anywhere in each; of more than ``LABELS`` languages the most
frequent. Texts, not ids or sources, are its input.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with no labelled
document every text is ``und``; equal probabilities go to the first language in code point order;
very long texts are read whole, span by span; repeated rows are predicted each; columns besides id,
text and lang are not read, so their names may clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, prepare, text_of

SAMPLE_DOCS, SAMPLE_SPANS, SPAN, LABELS = 300, 8, 64, 1000
EMBED, HIDDEN, STEPS, BATCH, RATE, SEED = 12, 12, 200, 128, 0.02, 7
#: Spans that are read side by side.
ROWS = 2048
BLANK = 32

_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if chr(c).isalpha() and c < 128 or c >= 128 else BLANK for c in range(256))


def folded(text: str) -> bytes:
    return b" ".join(text.encode().translate(_FOLD).split())


def spans_of(raw: bytes) -> np.ndarray:
    """Bytes as rows of SPAN, 0 past the end."""
    flat = np.zeros(-(-len(raw) // SPAN) * SPAN, np.uint8)
    flat[: len(raw)] = np.frombuffer(raw, np.uint8)
    return flat.reshape(-1, SPAN)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    """Two gated recurrent layers, one a direction, and a softmax at every position."""

    def __init__(self, labels: list[str], seed: int = SEED, embed: int = EMBED, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        near = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {"E": rng.normal(0, 0.5, (256, embed)).astype(np.float32), "V": near(2 * hidden, len(labels)), "c": np.zeros(len(labels), np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": near(embed, 3 * hidden), f"U{d}": near(hidden, 2 * hidden), f"Un{d}": near(hidden, hidden), f"b{d}": np.zeros(3 * hidden, np.float32)}

    def _run(self, x: np.ndarray, live: np.ndarray, d: str, keep: bool):
        """States of one direction at each position; live: where a byte stands."""
        p, h_n, (n, width) = self.p, self.hidden, x.shape
        table = p["E"] @ p[f"W{d}"] + p[f"b{d}"]  # what a byte adds to the gates
        h, states, tape = np.zeros((n, h_n), np.float32), np.zeros((n, width, h_n), np.float32), {}
        for t in range(width) if d == "f" else range(width - 1, -1, -1):
            a = table[x[:, t]]
            g = _sigmoid(a[:, : 2 * h_n] + h @ p[f"U{d}"])
            z, r = g[:, :h_n], g[:, h_n:]
            c = np.tanh(a[:, 2 * h_n :] + (r * h) @ p[f"Un{d}"])
            m = live[:, t : t + 1]
            new = h + m * z * (c - h)
            if keep:
                tape[t] = (h, z, r, c, m)
            h = new
            states[:, t] = h
        return states, tape

    def positions(self, x: np.ndarray, live: np.ndarray, keep: bool = False):
        """Distributions at every position."""
        f, tape_f = self._run(x, live, "f", keep)
        b, tape_b = self._run(x, live, "b", keep)
        both = np.concatenate([f, b], axis=2)
        s = both @ self.p["V"] + self.p["c"]
        s = np.exp(s - s.max(axis=2, keepdims=True))
        return s / s.sum(axis=2, keepdims=True), both, (tape_f, tape_b)

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over letter positions, by backpropagation through time."""
        q, both, tapes = self.positions(x, live, True)
        letters = live * (x != BLANK)
        delta = q.copy()
        delta[np.arange(len(y)), :, y] -= 1
        delta *= letters[:, :, None] / max(letters.sum(), 1)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["V"], g["c"] = np.einsum("nth,ntk->hk", both, delta), delta.sum(axis=(0, 1))
        up, h_n, width = delta @ self.p["V"].T, self.hidden, x.shape[1]
        for d, tape, own in (("f", tapes[0], up[:, :, :h_n]), ("b", tapes[1], up[:, :, h_n:])):
            u, un, byte = self.p[f"U{d}"], self.p[f"Un{d}"], np.zeros((256, 3 * h_n), np.float32)
            back = np.zeros((len(x), h_n), np.float32)
            for t in range(width - 1, -1, -1) if d == "f" else range(width):
                h, z, r, c, m = tape[t]
                dh = back + own[:, t]
                dz, dc = dh * m * (c - h), dh * m * z
                back = dh * (1 - m * z)
                dc = dc * (1 - c * c)
                drh = dc @ un.T
                dr = drh * h
                back += drh * r
                dg = np.concatenate([dz * z * (1 - z), dr * r * (1 - r)], axis=1)
                back += dg @ u.T
                g[f"U{d}"] += h.T @ dg
                g[f"Un{d}"] += (r * h).T @ dc
                np.add.at(byte, x[:, t], np.concatenate([dg, dc], axis=1))
            g[f"W{d}"] += self.p["E"].T @ byte
            g[f"b{d}"] += byte.sum(axis=0)
            g["E"] += byte @ self.p[f"W{d}"].T
        return g

    def train(self, x: np.ndarray, labels: np.ndarray, steps: int = STEPS, rate: float = RATE, seed: int = SEED) -> None:
        """On spans, each with its document's label: a fixed number of steps, through all spans again and again."""
        rng = np.random.default_rng(seed)
        live = (x != 0).astype(np.float32)
        first, second, order = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, []
        for step in range(1, steps + 1):
            while len(order) < min(BATCH, len(x)):
                order.extend(rng.permutation(len(x)))
            part, order = order[:BATCH], order[BATCH:]
            for k, v in self.gradients(x[part], live[part], labels[part]).items():
                v = np.clip(v, -1, 1)
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                self.p[k] -= rate / (1 + 3 * step / steps) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Of each span: the sum of its letter positions' distributions, and how many they are."""
        p, h_n, (n, width), k = self.p, self.hidden, x.shape, len(self.labels)
        across, scores = np.ascontiguousarray(x.T), np.zeros((width, n, k), np.float32)
        scores += p["c"]
        for d, out in (("f", p["V"][:h_n]), ("b", p["V"][h_n:])):
            table = p["E"] @ p[f"W{d}"] + p[f"b{d}"]
            gates, fresh = np.ascontiguousarray(-table[:, : 2 * h_n]), np.ascontiguousarray(table[:, 2 * h_n :])
            u, un, h = -p[f"U{d}"], p[f"Un{d}"], np.zeros((n, h_n), np.float32)
            for t in range(width) if d == "f" else range(width - 1, -1, -1):
                g = h @ u
                g += gates[across[t]]
                np.exp(g, out=g)
                g += 1
                np.reciprocal(g, out=g)
                c = (g[:, h_n:] * h) @ un
                c += fresh[across[t]]
                np.tanh(c, out=c)
                c -= h
                c *= g[:, :h_n]
                h += c
                if d == "b" and not across[t].all():
                    h *= (across[t] != 0)[:, None]  # a span's end is its beginning in this direction
                scores[t] += h @ out
        scores -= scores.max(axis=2, keepdims=True)
        np.exp(scores, out=scores)
        letters = (across != 0) & (across != BLANK)
        scores *= (letters / scores.sum(axis=2))[:, :, None]
        return np.concatenate([scores.sum(axis=0), letters.sum(axis=0)[:, None]], axis=1)


class _Sampled:
    """A sample's spans, from anywhere in the text, for training."""

    def __init__(self, most: int):
        self.most = most

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            picked = []
            for text in b.column(1).to_pylist():
                x = spans_of(folded(text))
                if len(x) > self.most:
                    x = x[np.sort(np.random.default_rng(len(text)).choice(len(x), self.most, replace=False))]
                picked.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(picked, pa.binary()), b.column(2)], names=["label", "spans", "h"])


def sample_spans(labelled: DataFrame, docs_each: int = SAMPLE_DOCS, spans_each: int = SAMPLE_SPANS) -> list[tuple[str, bytes]]:
    """From rows of label, key and text: about docs_each of every label, by a hash of the key.

    The shares come from a count over all rows; the bound on rows that reach the driver is held by
    a top-k besides, as many rows may have one key.
    """
    h = F.xxhash64(F.lit("lang"), F.col("key"))
    counts = labelled.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(LABELS).collect()
    if not counts:
        return []
    known = labelled.sparkSession.createDataFrame([(r.label, r.n) for r in counts], "label string, n long")
    share = F.lit(float(1 << 63)) * (F.lit(2.0) * docs_each / F.col("n") - 1)
    picked = labelled.join(F.broadcast(known), "label").filter(h <= share)
    found = picked.select("label", "text", h.alias("h")).mapInArrow(_Sampled(spans_each), "label string, spans binary, h long").orderBy("h", "spans").limit(docs_each * 4 * len(counts))
    return [(r.label, bytes(r.spans)) for r in found.collect()]


def fit(labelled: DataFrame) -> Network | None:
    """Trains on rows of label, key and text; labels that are null are no use."""
    prepare(labelled.sparkSession)
    rows = sorted((label, raw) for label, raw in sample_spans(labelled.filter("label is not null")) if raw)
    labels = sorted({label for label, _ in rows})
    if not labels:
        return None
    net = Network(labels)
    at = {x: i for i, x in enumerate(labels)}
    x = np.frombuffer(b"".join(raw for _, raw in rows), np.uint8).reshape(-1, SPAN)
    net.train(x, np.repeat([at[label] for label, _ in rows], [len(raw) // SPAN for _, raw in rows]))
    return net


class _Predict:
    def __init__(self, net):
        self.net = net

    def __call__(self, doc_id, texts):
        net = self.net.value
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        rows = [spans_of(folded(t)) for t in texts]
        x, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
        sums = np.zeros((len(texts), len(net.labels) + 1))
        owner = np.repeat(np.arange(len(texts)), sizes)
        for lo in range(0, len(x), ROWS):
            np.add.at(sums, owner[lo : lo + ROWS], net.pooled(x[lo : lo + ROWS]))
        for i, s in enumerate(sums):
            if s[-1] and any(c.isalpha() for c in texts[i]):
                k = int(np.argmax(s[:-1]))
                lang[i], score[i] = net.labels[k], min(1.0, float(s[k] / s[-1]))
        return [doc_id, lang, score]


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score; one row for each row of docs."""
    spark = docs.sparkSession
    prepare(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    if net is None:
        return d.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return arrow_pass(d, ["doc_id", "text"], _Predict(spark.sparkContext.broadcast(net)), "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the documents that are not held out, then predicts all: doc_id, held_out, lang_pred, score."""
    labelled = docs.filter(~held_out(id_col)).select(F.col(lang_col).cast("string").alias("label"), F.col(id_col).cast("string").alias("key"), text_of(text_col).alias("text"))
    net = fit(labelled)
    return predict(docs, net, id_col, text_col).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
