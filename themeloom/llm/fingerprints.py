"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph (a line) is hashed to a wide vector of 32-bit lanes, and a document's fingerprint is
the sum of its paragraphs' vectors modulo 2^32. So equal multisets of paragraphs have equal
fingerprints whatever their order, and a paragraph is inserted or deleted by adding or subtracting
its vector: the edited text's fingerprint is made that way, from the paragraphs that change alone.

The lanes of a paragraph's vector: ``DIGEST`` lanes of a cryptographic hash of it, which decide
equality; one lane that counts its features; and ``SKETCH`` lanes that hold the sums of +1 and -1
drawn from a hash of each feature, a feature being three words in a row (all its words if fewer).
The squared distance of two documents' sketch lanes, over SKETCH, estimates how many features are
in one and not in the other; likeness is 1 - that / (features of both), kept in 0 to 1, and is 1
exactly where fingerprints are equal.

Defined cases: null text is empty; an empty text has no paragraph with a word, the zero vector, and
likeness 1 to another such and 0 to all else; a single document is its own next one; null ids come
first; equal doc_ids go by a hash of the text, then by the text; very long texts are read whole;
repeated rows stand in line each; an empty table gives an empty result; other columns are not read,
so their names may clash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WorkerCache, arrow_schema, prepare, text_of

DIGEST, SKETCH, SHINGLE = 16, 64, 3
LANES = DIGEST + 1 + SKETCH
#: Rows that one partition of the ordered pass holds, about, and the most partitions: past it they grow.
SLICE_ROWS, SLICES = 8_000, 16_384

RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _WordHashes(dict):
    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            self[word] = h
        return h


_hashes = WorkerCache(_WordHashes)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C2
    x = (x ^ (x >> np.uint64(29))) * _C1
    return x ^ (x >> np.uint64(32))


def paragraph_vectors(paragraphs: list[bytes]) -> np.ndarray:
    """A row of LANES unsigned 32-bit numbers for each paragraph."""
    out = np.zeros((len(paragraphs), LANES), np.uint32)
    if not paragraphs:
        return out
    words = [p.split() for p in paragraphs]
    n = np.array([len(w) for w in words], np.int64)
    digests = b"".join(hashlib.blake2b(p, digest_size=4 * DIGEST).digest() for p in paragraphs)
    out[:, :DIGEST] = np.frombuffer(digests, "<u4").reshape(-1, DIGEST)
    known = _hashes.get()
    flat = np.fromiter((known[x] for w in words for x in w), np.uint64, int(n.sum()))
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    features = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    out[:, DIGEST] = features
    owner = np.repeat(np.arange(len(paragraphs)), features)
    first = np.repeat(starts, features) + (np.arange(len(owner)) - np.repeat(np.cumsum(features) - features, features))
    last = np.repeat(starts + n, features)
    key = np.zeros(len(owner), np.uint64)
    for k in range(SHINGLE):
        inside = first + k < last
        key = _mixed(key + np.where(inside, flat[np.minimum(first + k, max(len(flat) - 1, 0))], np.uint64(k + 1)) if len(flat) else key)
    some = np.flatnonzero(features)
    at = (np.cumsum(features) - features)[some]
    for lo in range(0, len(some), 4096):
        part = some[lo : lo + 4096]
        a = at[lo : lo + 4096]
        end = a[-1] + features[part[-1]]
        bits = np.unpackbits(key[a[0] : end].view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, a - a[0], axis=0, dtype=np.int64)
        out[part, DIGEST + 1 :] = (2 * ones - features[part][:, None]).astype(np.uint32)
    return out


def paragraphs_of(text: str) -> list[bytes]:
    return [p for p in text.encode().split(b"\n") if p and not p.isspace()]


def total(vectors: np.ndarray) -> np.ndarray:
    return vectors.sum(axis=0, dtype=np.uint32)


def fingerprint(text: str) -> np.ndarray:
    return total(paragraph_vectors(paragraphs_of(text)))


def render(v: np.ndarray) -> str:
    return base64.b64encode(v.astype("<u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of two arrays of fingerprints."""
    apart = (a[:, DIGEST + 1 :] - b[:, DIGEST + 1 :]).astype(np.int32).astype(np.float64)
    both = a[:, DIGEST].astype(np.float64) + b[:, DIGEST]
    near = np.clip(1 - (apart**2).sum(axis=1) / SKETCH / np.maximum(both, 1), 0, 1)
    same = (a == b).all(axis=1)
    return np.where(same, 1.0, np.where(both > 0, np.minimum(near, 1 - 1e-9), 0.0))


def edited(text: str, following: str) -> tuple[str, int]:
    """The text with its last quarter replaced by the start of the next one, and where that begins."""
    cut = len(text) - len(text) // 4
    return text[:cut] + following[: len(text) // 4], cut


def describe(texts: list[str], following: list[str]) -> list:
    """n_chars, edited_sha256, fingerprints and likenesses of each text, given the text after it."""
    fresh, owner, sign = [], [], []

    def add(paragraphs, row, by):
        fresh.extend(paragraphs)
        owner.extend([row] * len(paragraphs))
        sign.extend([by] * len(paragraphs))

    n, shas = len(texts), []
    for i, (text, after) in enumerate(zip(texts, following, strict=True)):
        new, cut = edited(text, after)
        shas.append(hashlib.sha256(new.encode()).hexdigest())
        add(paragraphs_of(text), i, 0)
        at = text.rfind("\n", 0, cut) + 1  # paragraphs before this stay
        if new != text:
            add(paragraphs_of(text[at:]), i, -1)
            add(paragraphs_of(new[at:]), i, 1)
    last = following[-1] if n else ""
    if n and last:
        add(paragraphs_of(last), n, 0)
    v, owner, sign = paragraph_vectors(fresh), np.array(owner, np.int64), np.array(sign, np.int64)
    own, new = np.zeros((n + 1, LANES), np.uint32), np.zeros((n, LANES), np.uint32)
    _sum_into(own, owner[sign == 0], v[sign == 0])
    new[:] = own[:n]
    _sum_into(new, owner[sign == 1], v[sign == 1])
    _sum_into(new, owner[sign == -1], np.uint32(0) - v[sign == -1])
    return [np.array([len(t) for t in texts], np.int64), shas, [render(x) for x in own[:n]], [render(x) for x in new], likeness(own[:n], new), likeness(own[:n], own[1:])]


def _sum_into(out: np.ndarray, owner: np.ndarray, v: np.ndarray) -> None:
    if len(owner):
        at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        out[owner[at]] += np.add.reduceat(v, at, axis=0, dtype=np.uint32)


class _Ordered:
    """Over partitions in which whole slices stand in order; the last row of a slice is a copy of the next slice's first."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, kept = arrow_schema(RESULT), None
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            for lo in range(0, len(rows), 250):
                part = ([kept] if kept else []) + rows[lo : lo + 250]
                kept = part[-1]
                pairs = [(x, y) for x, y in zip(part, part[1:]) if x[0] == y[0] and not x[3]]
                for run in _runs(pairs):
                    cols = describe([x[2] for x, _ in run], [y[2] for _, y in run])
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([[x[1] for x, _ in run], *cols], schema, strict=True)], schema=schema)


def _runs(pairs: list) -> Iterator[list]:
    """Consecutive pairs, so that each row's next is the following row."""
    run: list = []
    for p in pairs:
        if run and run[-1][1] is not p[0]:
            yield run
            run = []
        run.append(p)
    if run:
        yield run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_rows: int = SLICE_ROWS, slices: int = SLICES) -> DataFrame:
    """The result of each row of docs with its edited text and the next document.

    The order is cut into slices of about slice_rows rows, at most ``slices`` of them, by a range
    partitioning of ids and text hashes alone. Their first keys are the one thing that reaches the
    driver, a bounded list; rows find their slice by binary search in it. Each slice's first row is
    also given to the slice before it as its end, so every row meets its next one in its own slice
    and one shuffle of the texts is all that moves. A slice is sorted with spilling and read in
    batches, so its size bounds no memory.
    """
    spark = docs.sparkSession
    prepare(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    d = d.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), F.xxhash64("text").alias("h"))
    n = d.count()
    if not n:
        return spark.createDataFrame([], RESULT)
    ranged = d.select("k", "h").repartitionByRange(min(slices, max(1, round(n / slice_rows))), "k", "h")
    firsts = ranged.groupBy(F.spark_partition_id().alias("at")).agg(F.min(F.struct("k", "h")).alias("first")).select("first.*").collect()
    bounds = np.array(sorted((r.k, r.h) for r in firsts), np.int64)
    place = _place(spark.sparkContext.broadcast(bounds))
    rows = d.withColumn("place", place("k", "h")).select(F.expr("place div 2").cast("int").alias("slice"), "doc_id", "h", "text", (F.col("place") % 2 == 1).alias("first"))
    marks = rows.filter("first").groupBy("slice").agg(F.first("doc_id").alias("doc_id"), F.first("h").alias("h"), F.min("text").alias("text"))
    before = F.pmod(F.col("slice") - 1, F.lit(len(bounds)))  # the first slice follows the last
    both = rows.select("slice", "doc_id", "h", "text", F.lit(False).alias("end")).unionByName(marks.select(before.alias("slice"), "doc_id", "h", "text", F.lit(True).alias("end")))
    dealt = both.repartitionById(len(bounds), F.col("slice")).sortWithinPartitions("slice", "end", F.col("doc_id").asc_nulls_first(), "h", "text")
    return dealt.select("slice", "doc_id", "text", "end").mapInArrow(_Ordered(), RESULT)


def _place(shared):
    """Of a key: twice its slice, and one more where it is the slice's first key."""

    @F.pandas_udf("long")
    def place(k: pd.Series, h: pd.Series) -> pd.Series:
        bounds = shared.value
        lo, hi = np.searchsorted(bounds[:, 0], k, "left"), np.searchsorted(bounds[:, 0], k, "right")
        at, text = hi - 1, h.to_numpy()
        for i in np.flatnonzero(hi - lo > 0):  # the id begins a slice or several
            at[i] = lo[i] + np.searchsorted(bounds[lo[i] : hi[i], 1], text[i], "right") - 1
        first = (bounds[at, 0] == k.to_numpy()) & (bounds[at, 1] == text)
        return pd.Series(2 * at + first)

    return place
