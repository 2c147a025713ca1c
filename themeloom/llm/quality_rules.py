"""Quality rules as a bitmask ledger.

One pass evaluates every rule on every whole text and stores the measurements and one failure bit
a rule. Policies are masks over those bits with a version, so applying another policy, or asking
what a rule costs, reads the ledger and never the texts.

Defined cases: a null text has no words, so it fails ``few_words``; very long texts are measured whole; columns besides id and text are not read (``keep`` carries
them along by place, so names may clash); an empty table gives an empty
ledger; repeated rows and ties are judged row by row; other columns of the input are not read.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, annotate, arrow_pass, prepare, restore, text_of, word_chunks

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_bangs")
LEDGER = ", ".join(f"{m} long" for m in MEASURES)
SYMBOLS = b"#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A rule fails where its SQL condition over the measurements holds."""

    bit: int
    name: str
    fails: str


#: Bits are never reused: a ledger written today keeps its meaning under later policies.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "long_words", "word_chars > 15 * n_words"),
    Rule(5, "short_words", "word_chars < 2 * n_words"),
    Rule(6, "upper_case", "n_upper + n_lower >= 40 and n_upper > n_lower"),
    Rule(7, "exclamations", "5 * n_bangs > n_words"),
    Rule(8, "very_long", "n_words > 100000"),
)
BASE = ("few_words", "repeated_words")


def mask(names) -> int:
    by = {r.name: r.bit for r in RULES}
    return sum(1 << by[n] for n in names)


#: version -> mask
POLICIES = {
    "base": mask(BASE),
    "v1": mask((*BASE, "symbols", "duplicate_lines", "long_words", "short_words", "upper_case", "exclamations")),
    "strict": mask(r.name for r in RULES),
}

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]


def repeated_words(ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Words of each text that stand in a five-word window found twice or more in that text."""
    total = len(ids)
    doc = np.repeat(np.arange(n), np.diff(np.append(starts, total)))
    out = np.zeros(n, np.int64)
    if total < WINDOW + 1:
        return out
    at = np.flatnonzero(doc[: -(WINDOW - 1)] == doc[WINDOW - 1 :])
    if not len(at):
        return out
    wide, key = ids.astype(np.uint64), doc[at].astype(np.uint64) * np.uint64(_ODD[5])
    for k in range(WINDOW):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(_ODD[k]) + wide[at + k]
    key = (key ^ (key >> np.uint64(32))) * np.uint64(_ODD[0])
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    near = np.flatnonzero(ranked[1:] == ranked[:-1])
    if not len(near):
        return out
    a, b = at[order[near]], at[order[near + 1]]  # equal hashes are compared word by word
    same = doc[a] == doc[b]
    for k in range(WINDOW):
        same &= ids[a + k] == ids[b + k]
    edge = np.zeros(total + 1, np.int64)
    hit = np.unique(np.concatenate([a[same], b[same]]))
    edge[hit] += 1
    edge[hit + WINDOW] -= 1
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(doc[covered], minlength=n).astype(np.int64)


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """Every measurement of every text."""
    got = {m: np.zeros(len(texts), np.int64) for m in MEASURES}
    for lo, hi in word_chunks(texts):
        ids: dict = defaultdict(itertools.count().__next__)
        words, starts, total = [], np.zeros(hi - lo, np.int64), 0
        for j in range(lo, hi):
            raw = texts[j].encode()
            own = raw.split()
            starts[j - lo] = total
            total += len(own)
            words.append(np.fromiter(map(ids.__getitem__, own), np.int64, len(own)))
            bare = len(raw) - len(raw.translate(None, SPACES))
            got["n_words"][j], got["word_chars"][j] = len(own), len(texts[j]) - bare
            got["n_symbols"][j] = len(raw) - len(raw.translate(None, SYMBOLS))
            got["n_upper"][j] = len(raw) - len(raw.translate(None, _UPPER))
            got["n_lower"][j] = len(raw) - len(raw.translate(None, _LOWER))
            got["n_bangs"][j] = raw.count(b"!!")
            lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
            got["n_lines"][j] = len(lines)
            got["n_dup_lines"][j] = len(lines) - len(set(lines))
        got["n_repeat_words"][lo:hi] = repeated_words(np.concatenate(words), starts, hi - lo)
    return got


def _ids_only(doc_id, texts):
    got = measure(texts)
    return [doc_id, *(got[m] for m in MEASURES)]


def _measures_only(texts):
    got = measure(texts)
    return [got[m] for m in MEASURES]


def failed_bits() -> Column:
    """The ledger's bitmask from its measurements."""
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(0).cast("long"))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and failed_bits; one row for each row of docs."""
    prepare(docs.sparkSession)
    out = arrow_pass(docs, [F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")], _ids_only, f"doc_id long, {LEDGER}")
    return out.withColumn("failed_bits", failed_bits())


def apply_policy(rows: DataFrame, version: str = "v1") -> DataFrame:
    """Adds kept: no bit of the policy failed."""
    return rows.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablations(rows: DataFrame, version: str = "v1") -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail nothing else, and that stay without it.

    The ledger is first counted by its bit pattern (at most 2^rules rows, summed on the map side), so
    the per-rule figures come from a handful of rows.
    """
    m = POLICIES[version]
    seen = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("docs"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if m >> r.bit & 1])
    each = seen.select("bits", "docs", F.explode(rules).alias("r"))
    failed, alone = F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("bits") == F.col("r.bit")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(failed, F.col("docs")).otherwise(0)).alias("failed"),
        F.sum(F.when(alone, F.col("docs")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.lit(m).bitwiseXOR(F.col("r.bit"))) == 0, F.col("docs")).otherwise(0)).alias("kept_without"),
    )


def keep(docs: DataFrame, version: str = "v1", text_col: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, with all their columns. The texts are read once."""
    judged = annotate(docs, text_col, _measures_only, LEDGER).withColumn("failed_bits", failed_bits())
    return restore(apply_policy(judged, version).filter("kept"), docs)
