"""Conversations that grow: one state a conversation, fed by batches or by a stream.

Sentences, their hashes and keywords are made by the plan; the state holds the living rows' hashes
in order (at most ``cap``), totals, and the document frequencies of keywords of living rows. A row
that is let go takes its hash and its keywords with it, so it may be said again. Turns of one batch
are taken in order; a turn at or before the last one taken is counted as late and changes nothing.
The same fold runs over a table (``replay``) and over a stream (``stream``).
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T

RESULT = "conv_id long, turn long, n_rows long, n_added long, n_total long, n_alive long, n_keywords long, late boolean"
STATE = "state string"
CAP = 100_000


def prepared(messages: DataFrame) -> DataFrame:
    """conv_id, turn, rows: hash and keywords of each sentence; only users and assistants are remembered."""
    said = messages.filter(F.col("role").isin("user", "assistant"))
    rows = F.transform(T.sentence_parts(F.coalesce("text", F.lit(""))), lambda s: F.struct(T.norm_hash(s).alias("hash"), T.content_words(s).alias("kws")))
    return said.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), rows.alias("rows"))


class Memory:
    """The state of one conversation."""

    def __init__(self, stored: str | None = None):
        held = json.loads(stored) if stored else {"rows": [], "total": 0, "last": None}
        self.rows: dict[str, list[str]] = dict(held["rows"])
        self.total, self.last = held["total"], held["last"]
        self.df = Counter(k for kws in self.rows.values() for k in kws)

    def stored(self) -> str:
        return json.dumps({"rows": list(self.rows.items()), "total": self.total, "last": self.last})

    def take(self, conv: int, turn: int, rows: Iterable, cap: int) -> tuple:
        late = self.last is not None and turn <= self.last
        rows, added = list(rows), 0
        for r in rows if not late else ():
            if r["hash"] in self.rows:
                continue
            self.rows[r["hash"]] = list(r["kws"])
            self.df.update(self.rows[r["hash"]])
            added += 1
            if len(self.rows) > cap:
                gone = self.rows.pop(next(iter(self.rows)))
                self.df -= Counter(gone)
        if not late:
            self.last, self.total = turn, self.total + added
        return conv, turn, len(rows), added, self.total, len(self.rows), len(self.df), late


def _table(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])


def _fold(memory: Memory, part: pd.DataFrame, cap: int) -> list[tuple]:
    part = part.sort_values("turn", kind="stable")
    return [memory.take(int(c), int(t), r, cap) for c, t, r in zip(part["conv_id"], part["turn"], part["rows"], strict=True)]


def replay(messages: DataFrame, cap: int = CAP) -> DataFrame:
    """What each turn did to its conversation's memory, over a whole table."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        return _table(_fold(Memory(), part, cap))

    return prepared(messages).groupBy("conv_id").applyInPandas(one, RESULT)


def stream(messages: DataFrame, cap: int = CAP) -> DataFrame:
    """The same over a streaming table, in append mode."""

    def grown(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory = Memory(state.get[0] if state.exists else None)
        whole = pd.concat(list(parts), ignore_index=True)
        rows = _fold(memory, whole, cap)
        state.update((memory.stored(),))
        yield _table(rows)

    return prepared(messages).groupBy("conv_id").applyInPandasWithState(grown, RESULT, STATE, "append", GroupStateTimeout.NoTimeout)


def tumbling(events: DataFrame, at: str, width: str, late: str = "0 seconds") -> DataFrame:
    """Counts by width of event time, behind a watermark where the table is a stream."""
    events = events.withColumn(at, F.col(at).cast("timestamp"))
    timed = events.withWatermark(at, late) if events.isStreaming else events
    return timed.groupBy(F.window(at, width)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")
