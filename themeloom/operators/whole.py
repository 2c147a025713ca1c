"""Documents read whole: texts to units, themes, paths and trie nodes of one document in plain Python.

Each function gives what the Column expression or plan of its name gives (``functions.text``,
``segment``, ``themes``), so that a selection, which needs all of a document's units and nothing of
any other's, is one pass over the scan without a shuffle. Fixed values are those of ``functions.text``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions import text as T
from . import segment

#: Documents of one Arrow batch, and words or stems that a worker remembers.
BATCH_DOCS, MOST_HELD = 200, 50_000
BLANKS = " \t\r\n"


def java(pattern: str) -> str:
    """A pattern with Java's classes: digits and blanks of ASCII, a dot that ends at any line's end; word edges know all letters in both."""
    for a, b in ((r"[\d.]", "[0-9.]"), (r"\d", "[0-9]"), (r"\s", r"[ \t\n\x0b\f\r]"), (".*", r"[^\n\r\x85  ]*")):
        pattern = pattern.replace(a, b)
    return pattern


_SPLIT = re.compile(r"(?<=[.!?;])[ \t\r\n]+|\n+")
_CUT = re.compile(rf"[\s\S]{{1,{T.CUT}}}\Z|[\s\S]{{1,{T.CUT - 1}}}(?= )|[\s\S]{{{T.CUT}}}")
_BEGUN = re.compile("(?:" + "|".join(java(p) for p in T.JUNK_STARTS) + ")")
_INSIDE = re.compile("|".join(java(p) for p in T.JUNK_INSIDE))
_MARKS = ("|", "thumb", "upright", "px")
_WIKI = [(re.compile(p, re.ASCII), r.replace("$1", r"\1")) for p, r in (*T.WIKI, *((e, "") for e in (r"^\s+|\s+$", r"^\|+|\|+$", r"^\s+|\s+$")))]
_KEY = re.compile("[a-z0-9]+")


def sentence_parts(text: str) -> list[str]:
    for a in T.ABBREVIATIONS_MANY_DOTS:
        text = text.replace(a, a.replace(".", T.HOLD))
    parts = text.split(".")
    text = "".join(chain.from_iterable((p, T.HOLD if p.endswith(T.ABBREVIATIONS) else ".") for p in parts[:-1])) + parts[-1]
    out = []
    for part in _SPLIT.split(text):
        part = part.strip(BLANKS).replace(T.HOLD, ".")
        if len(part) < T.TOO_LONG:
            out.append(part)
        else:
            out += [p.strip(BLANKS) for p in (part.split(",") if "," in part else _CUT.findall(part))]
    return [p for p in out if p]


def words_of(text: str) -> list[str]:
    for blank in BLANKS[1:]:
        if blank in text:
            text = text.replace(blank, " ")
    return [w for w in text.split(" ") if w]


class _Held(dict):
    """What a function of one word gave, for the words last met."""

    def __init__(self, f: Callable[[str], str]):
        self.f = f

    def __missing__(self, word: str) -> str:
        if len(self) >= MOST_HELD:
            self.clear()
        out = self[word] = self.f(word)
        return out


def _strip_word(word: str) -> str:
    word = word.strip(T.STRIPPED)
    return word[:-2] if word.endswith(("'s", "’s", "‘s")) else word


def _content_word(word: str) -> str:
    word = strip_word[word]
    return word if len(word) > 2 and word != "the" and word.isalpha() else ""


def _soft_stem(word: str) -> str:
    w = word.lower()
    if len(w) < 4:
        return w
    for s in T.STEM_SUFFIXES:
        if w.endswith(s) and len(w) > len(s) + 2:
            return w[: -len(s)]
    return w[:-1] if w.endswith("e") or (w.endswith("s") and not w.endswith("ss")) else w


strip_word, content_word, soft_stem = _Held(_strip_word), _Held(_content_word), _Held(_soft_stem)


def content_words(low_words: list[str]) -> list[str]:
    """Distinct content words of a unit's lower-case words, in order. Nothing is stripped of a word of letters alone."""
    found = dict.fromkeys([w if w.isalpha() else content_word[w] for w in low_words])
    return [w for w in found if len(w) > 2 and w != "the"]


def wiki_clean(text: str) -> str:
    for p, by in _WIKI:
        text = p.sub(by, text)
    return text


def is_short_junk(text: str) -> bool:
    text = text.strip(" ")
    return len(text) < 30 or len(words_of(text)) < 5


def is_junk(text: str, low: str, n_words: int) -> bool:
    """Of a text without blanks at its ends."""
    if len(text) < 30 or n_words < 5 or _BEGUN.match(low):
        return True
    return any(m in low for m in _MARKS) and _INSIDE.search(low) is not None and is_short_junk(wiki_clean(text))


class Unit(NamedTuple):
    """low: the unit's words in lower case."""

    pos: int
    text: str
    low: list[str]


def kept_units(text: str | None) -> list[Unit]:
    """``segment.filtered`` of ``segment.sentences``."""
    seen, keys, out = set(), set(), []
    for pos, unit in enumerate(sentence_parts(text or "")):
        low = unit.lower()
        if low in seen:
            continue
        seen.add(low)
        words = words_of(low) if len(unit) >= 30 else []
        if is_junk(unit, low, len(words)):
            continue
        key = " ".join(_KEY.findall(low))
        if key not in keys:
            keys.add(key)
            out.append(Unit(pos, unit, words))
    return out


class Profile(NamedTuple):
    """df of all keywords; themes in rank order."""

    df: Counter
    themes: list[str]


def profile(kws: list[list[str]], percentile: float) -> Profile:
    """``themes.keyword_df`` and ``themes.themes``."""
    df = Counter(chain.from_iterable(kws))
    if not df:
        return Profile(df, [])
    least = sorted(df.values())[min(int(len(df) * percentile), len(df) - 1)]
    return Profile(df, sorted(sorted(w for w, n in df.items() if n >= least), key=df.__getitem__, reverse=True))


def paths(kws: list[list[str]], themes: list[str]) -> list[list[int]]:
    """Of each unit its themes, as their places in rank order."""
    rank = {w: i for i, w in enumerate(themes)}
    return [sorted(map(rank.__getitem__, filter(rank.__contains__, own))) for own in kws]


class Trie(NamedTuple):
    """ids: node by parent (or -1) * wide + theme; covers: of each path its nodes; of each node its weight, parent and theme."""

    wide: int
    ids: dict[int, int]
    covers: list[list[int]]
    weights: list[float]
    parents: list[int]
    themes: list[int]

    def prefix(self, node: int) -> list[int]:
        out = []
        while node >= 0:
            out.append(self.themes[node])
            node = self.parents[node]
        return out

    def node(self, prefix: Iterable[int]) -> int | None:
        node = -1
        for theme in prefix:
            node = self.ids.get(node * self.wide + theme)
            if node is None:
                return None
        return node


def trie(path_rows: list[list[int]]) -> Trie:
    """``themes.nodes``: df over its largest, split by support; a theme's df is the number of paths that hold it."""
    df = Counter(chain.from_iterable(path_rows))
    wide, ids, covers, support, parents, kinds = max(df, default=0) + 1, {}, [], [], [], []
    for path in path_rows:
        node, at = -1, []
        for theme in path:
            key = node * wide + theme
            if key in ids:
                node = ids[key]
                support[node] += 1
            else:
                parents.append(node)
                kinds.append(theme)
                node = ids[key] = len(support)
                support.append(1)
            at.append(node)
        covers.append(at)
    top = max(df.values(), default=1)
    part = {t: n / top for t, n in df.items()}
    return Trie(wide, ids, covers, [part[t] * n / df[t] for n, t in zip(support, kinds, strict=True)], parents, kinds)


def hits(words: set[str], sought: set[str]) -> dict[str, set[str]]:
    """Of lower-case words those with a form, stripped or stem, that is sought, and these forms. A form begins the stripped word."""
    begun, found = {form[:3] for form in sought}, {}  # no stem is cut to less than three letters
    for word in words:
        bare = word if word.isalpha() else strip_word[word]
        if bare[:3] in begun and (own := sought & {bare, soft_stem[bare]}):
            found[word] = own
    return found


def each(docs: DataFrame, columns: Iterable[str], rows: Callable[..., list[tuple]], ddl: str) -> DataFrame:
    """The rows (tuples as ddl has them) that ``rows`` makes of each document's columns, by one pass."""
    columns = list(columns)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_DOCS))
    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [row for values in zip(*(c.to_pylist(maps_as_pydicts="strict") for c in batch.columns), strict=True) for row in rows(*values)]
            held = list(zip(*made, strict=True)) if made else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array([list(v.items()) if isinstance(v, dict) else v for v in c], f.type) for c, f in zip(held, schema, strict=True)], schema=schema)

    return segment.spread(docs.select(*columns)).mapInArrow(passed, ddl)
