"""Token counts by a map-side two-tier lookup.

A pre-token is a run of spaces with the characters that follow it up to the next space or line end.
No piece of the vocabulary goes across such a border (checked when the model is loaded), so the
tokens of a text are the sum over its pre-tokens.

Tier one is a table of the most frequent pre-tokens with their lengths, at most ``TABLE`` entries
(some MB), broadcast. It is found by one pass over all texts in which each task keeps a bounded
summary; only those summaries, never pre-tokens of all texts, are shuffled. Tier two is a cache in
each worker, emptied when it is full; what neither holds is encoded. Neither tier changes a result.

Defined cases: null or empty text has 0 tokens; an empty table gives an empty result; repeated rows
are counted each; very long texts are counted whole, line by line; columns besides id and text are
not read, so their names may clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WorkerCache, arrow_pass, prepare, text_of, tokenizer_path

MODEL = "piece_bpe_32k.model"
#: Entries of the broadcast table, and of the summary that a task sends for it.
TABLE, SUMMARY = 1 << 16, 1 << 14
#: Entries of a worker's cache, distinct pre-tokens that a task holds while it counts, and the longest that is cached.
CACHE, HELD, LONGEST = 400_000, 200_000, 64
LIMIT = 4096

_BLANKS = re.compile(r" *[^ ]+| +$")


def lines_of(text: str) -> list[str]:
    """The model writes a space as U+2581, so both are one; a text begins with one more."""
    return (" " + text.replace("▁", " ")).split("\n")


def pretokens(line: str) -> list[str]:
    """Of one line: each with the spaces before it."""
    if "  " in line or line[-1:] == " ":
        return _BLANKS.findall(line)
    first, *rest = line.split(" ")
    return ([first] if first else []) + [" " + w for w in rest]


class Lengths(dict):
    """Pre-token to number of tokens: the second tier, and behind it the model."""

    def __init__(self, model: str):
        import sentencepiece

        self.encode = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(model)).encode
        self.apart = True
        sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(model))
        if any(re.search("[^▁]▁|\n", sp.id_to_piece(i)) for i in range(sp.get_piece_size())):
            raise ValueError(f"{model} has pieces that go across pre-tokens")
        self.before = len(self.encode("\n"))

    def __missing__(self, word: str) -> int:
        n = len(self.encode("\n" + word)) - self.before
        if len(word) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[word] = n
        return n


_lengths = WorkerCache(Lengths)


class _Count:
    def __init__(self, model: str, table):
        self.model, self.table = model, table

    def __call__(self, doc_id, texts):
        rare, frequent = _lengths.get(self.model), self.table.value
        n_bytes, n_tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        get, miss = frequent.get, rare.__getitem__
        for i, text in enumerate(texts):
            if not text:
                continue
            n_bytes[i] = len(text.encode())
            lines = lines_of(text)
            total = len(lines) - 1
            for line in lines:
                for w in pretokens(line):
                    n = get(w)
                    total += miss(w) if n is None else n
            n_tokens[i] = total
        return [doc_id, n_bytes, n_tokens]


def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most frequent pre-tokens of one task. Where too many are distinct the rarest are let go, which only costs cache hits."""
    seen: Counter = Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            for line in lines_of(text):
                seen.update(pretokens(line))
            if len(seen) > HELD:
                least = sorted(seen.values(), reverse=True)[HELD // 4]
                seen = Counter({w: n for w, n in seen.items() if n > least})
    top = [(w, n) for w, n in seen.most_common(SUMMARY) if len(w) <= LONGEST and n > 1]
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])


def frequent_table(docs: DataFrame, model: str = MODEL, text_col: str = "text", size: int = TABLE) -> dict[str, int]:
    """The first tier: at most size pre-tokens and their lengths."""
    prepare(docs.sparkSession)
    found = docs.select(text_of(text_col).alias("text")).mapInArrow(summarise, "word string, n long")
    top = found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    lengths = _lengths.get(model)
    return {r.word: lengths[r.word] for r in top.collect()}


def count_tokens(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; one row for each row of docs."""
    spark = docs.sparkSession
    prepare(spark)
    table = spark.sparkContext.broadcast(frequent_table(docs, model, text_col))
    out = arrow_pass(docs, [F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")], _Count(model, table), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
