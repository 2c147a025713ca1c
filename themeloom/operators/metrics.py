"""Answer metrics beyond word overlap: longest common subsequence, indel ratio, numbers, classes."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BETA2 = 1.2**2


def common_length(a, b) -> int:
    """Longest common subsequence of two sequences: one row of the table held as the bits of an integer."""
    places = defaultdict(int)
    for i, x in enumerate(a):
        places[x] |= 1 << i
    row = (1 << len(a)) - 1
    whole = row
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & whole
    return len(a) - row.bit_count()


def rouge_l(prediction: str | None, answer: str | None) -> float:
    """F of the longest common subsequence of words, recall weighed by 1.2 squared; 0 if either has no word."""
    p, a = (prediction or "").split(), (answer or "").split()
    same = common_length(p, a) if p and a else 0
    if not same:
        return 0.0
    precision, recall = same / len(p), same / len(a)
    return (1 + BETA2) * precision * recall / (recall + BETA2 * precision)


def indel_ratio(a: str | None, b: str | None) -> float:
    """Twice the common length over both lengths, in whole hundredths; 1 for two empty texts is not defined and gives 0."""
    a, b = a or "", b or ""
    return round(200 * common_length(a, b) / (len(a) + len(b))) / 100 if a and b else 0.0


def _pairwise(score, prediction: Column, answer: Column) -> Column:
    """A score of two texts over Arrow batches; the UDF is made here because workers import this module without a session."""

    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([score(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    return F.pandas_udf(scored, "double")(prediction, answer)


def rouge(prediction: Column, answer: Column) -> Column:
    return _pairwise(rouge_l, prediction, answer)


def code_similarity(prediction: Column, answer: Column) -> Column:
    """The ratio of the first predicted line that is neither comment nor fence, to the answer."""
    lines = F.filter(F.split(F.regexp_replace(prediction, r"^\n+", ""), "\n"), lambda x: ~x.rlike("`|#|//"))
    return _pairwise(indel_ratio, F.coalesce(F.get(lines, 0), F.lit("")), answer)


def number_share(prediction: Column, wanted: Column) -> Column:
    """Share of the prediction's numbers that are the wanted one, 0 without numbers."""
    numbers = F.regexp_extract_all(F.coalesce(prediction, F.lit("")), F.lit(r"(\d+)"), 1)
    right = F.size(F.filter(numbers, lambda n: n == wanted.cast("string")))
    return F.coalesce(F.when(F.size(numbers) > 0, right / F.size(numbers)), F.lit(0.0))


def retrieval(prediction: Column, answer: Column) -> Column:
    """As number_share, for the paragraph that the answer names."""
    wanted = F.regexp_extract(F.coalesce(answer, F.lit("")), r"Paragraph (\d+)", 1)
    return F.when(wanted == "", 0.0).otherwise(number_share(prediction, wanted))


def classification(prediction: Column, answer: Column, classes: Column) -> Column:
    """1 over the classes that the prediction names, if the answer is one; a class inside the answer's name does not count."""
    named = F.filter(classes, lambda c: F.contains(prediction, c) & (~F.contains(answer, c) | (c == answer)))
    return F.when(F.array_contains(named, answer), 1.0 / F.size(named)).otherwise(0.0)
