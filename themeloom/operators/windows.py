"""What an encoder is fed and gives: windows of whole sentences, word pieces put together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOWS = "array<struct<positions:array<int>,n_tokens:int>>"


def cover(sizes: np.ndarray, room: int) -> list[dict]:
    """Windows over sentences of these sizes: as many as fit, or one alone that is cut at room.

    Each window begins with the sentence that ended the one before; a window of one sentence is not
    begun again. So the last sentence stands alone once more after a window of several. Sentences
    without tokens are in no window.
    """
    live = np.flatnonzero(sizes > 0)
    ends = np.cumsum(sizes[live])
    out, at = [], 0
    while at < len(live):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + room, "right")))
        out.append({"positions": live[at:stop].tolist(), "n_tokens": min(int(ends[stop - 1]) - before, room)})
        at = stop - 1 if stop - 1 > at else stop
    return out


def attention_windows(sizes: Column, room: int = 510) -> Column:
    """Windows of a document's sentences, from the array of their token counts."""

    def each(held: pd.Series) -> pd.Series:
        return held.map(lambda s: [] if s is None else cover(np.asarray(s, dtype=np.int64), room))

    return F.pandas_udf(each, WINDOWS)(sizes)


def whole_words(pieces: Column, weights: Column) -> Column:
    """Words of pieces in order, each with the sum of their weights and the places of its pieces.

    A piece marked ## goes on with the word before it, any other begins one; so does the first.
    """
    bound = F.transform(F.array(F.struct(pieces.alias("p"), weights.alias("w"))), lambda s: _words(s["p"], s["w"]))  # each is worked out once
    return F.when(F.size(pieces) > 0, F.get(bound, F.lit(0))).otherwise(F.array().cast("array<struct<word:string,weight:double,places:array<int>>>"))


def _words(pieces: Column, weights: Column) -> Column:
    opens = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: (i == 0) | ~F.startswith(F.get(pieces, i), F.lit("##")))
    ends = F.concat(F.slice(opens, 2, F.size(opens)), F.array(F.size(pieces)))

    def word(i: Column, end: Column) -> Column:
        bare = F.transform(F.slice(pieces, i + 1, end - i), lambda p: F.replace(F.replace(p, F.lit("▁"), F.lit("")), F.lit("##"), F.lit("")))
        weight = F.aggregate(F.slice(weights, i + 1, end - i), F.lit(0.0), lambda a, x: a + x)
        return F.struct(F.lower(F.array_join(bare, "")).alias("word"), weight.alias("weight"), F.sequence(i, end - 1).alias("places"))

    return F.zip_with(opens, ends, word)
