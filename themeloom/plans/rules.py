"""Rules over signal columns: an expression language compiled to Columns.

``a > 3 and not (b == none or c)``: comparisons, ``and``, ``or``, ``not``, brackets, numbers (with a minus or without), the
words true, false, none, null, and names of signals. An ordering against nothing does not fire; equality
takes nothing as a value; a bare name is true if it is neither null, false, NaN nor 0. Rules are
compiled once on the driver and run inside the plan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEXER = re.compile(r"\s*(?:(?P<op><=|>=|==|!=|<|>)|(?P<bracket>[()])|(?P<number>-?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*))")
ORDERINGS = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}
CONSTANTS = {"true": True, "false": False, "none": None, "null": None}
DEPTH = 64


class RuleError(ValueError):
    """A rule that cannot be read, or that names what is not there."""


@dataclass(frozen=True)
class Value:
    """A compiled part: its column, and whether it is already a test that is never null."""

    column: Column
    test: bool = False

    def truth(self) -> Column:
        if self.test:
            return self.column
        text = F.lower(self.column.cast("string"))
        return F.coalesce(~text.isin("false", "nan", "0", "0.0", ""), F.lit(False))


class Compiler:
    """Precedence climbing: ``or`` binds least, then ``and``, ``not``, comparisons."""

    BINDING = ("or", "and")

    def __init__(self, text: str, signals: Iterable[str]):
        self.text, self.signals, self.used = text, set(signals), set()
        self.tokens = list(self.split(text))
        self.next = 0

    @staticmethod
    def split(text: str):
        at, end = 0, len(text.rstrip())
        while at < end:
            m = LEXER.match(text, at)
            if not m:
                raise RuleError(f"{text!r}: not part of the language from position {at}")
            yield m.lastgroup, m[m.lastgroup]
            at = m.end()

    def accept(self, *values: str) -> str | None:
        if self.next < len(self.tokens) and self.tokens[self.next][1] in values:
            self.next += 1
            return self.tokens[self.next - 1][1]
        return None

    def compile(self) -> Column:
        out = self.joined(0, 0).truth()
        if self.next < len(self.tokens):
            raise RuleError(f"{self.text!r}: {self.tokens[self.next][1]!r} is left over")
        return out

    def joined(self, level: int, depth: int) -> Value:
        if depth > DEPTH:
            raise RuleError(f"{self.text[:80]!r}: nested too deeply")
        if level == len(self.BINDING):
            if self.accept("not"):
                return Value(~self.joined(level, depth + 1).truth(), True)
            return self.compared(depth)
        parts = [self.joined(level + 1, depth)]
        while self.accept(self.BINDING[level]):
            parts.append(self.joined(level + 1, depth))
        if len(parts) == 1:
            return parts[0]
        join = Column.__or__ if level == 0 else Column.__and__
        return Value(reduce(join, [p.truth() for p in parts]), True)

    def compared(self, depth: int) -> Value:
        left = self.operand(depth)
        op = self.accept("==", "!=", *ORDERINGS)
        if not op:
            return left
        right = self.operand(depth)
        if op in ORDERINGS:
            return Value(F.coalesce(ORDERINGS[op](left.column, right.column), F.lit(False)), True)
        same = left.column.eqNullSafe(right.column)
        return Value(same if op == "==" else ~same, True)

    def operand(self, depth: int) -> Value:
        if self.accept("("):
            inner = self.joined(0, depth + 1)
            if not self.accept(")"):
                raise RuleError(f"{self.text!r}: a bracket is not closed")
            return inner
        if self.next >= len(self.tokens):
            raise RuleError(f"{self.text!r}: stops early")
        kind, word = self.tokens[self.next]
        self.next += 1
        if kind == "number":
            return Value(F.lit(float(word) if "." in word else int(word)))
        if kind != "name" or word in ("and", "or", "not"):
            raise RuleError(f"{self.text!r}: {word!r} where a signal or a value belongs")
        if word in CONSTANTS:
            return Value(F.lit(CONSTANTS[word]))
        if word not in self.signals:
            raise RuleError(f"{self.text!r}: no signal is called {word!r}")
        self.used.add(word)
        return Value(F.col(word))


@dataclass(frozen=True)
class Rule:
    id: str
    when: str
    then: dict


def checked(rules: list[Rule], signals: Iterable[str], switches: dict[str, type]) -> list[Rule]:
    """The rules, or an error that names what is wrong: a repeated id, an unknown signal or switch, a value of another kind."""
    seen = set()
    for r in rules:
        if r.id in seen:
            raise RuleError(f"rule {r.id!r} is there twice")
        seen.add(r.id)
        Compiler(r.when, signals).compile()
        if not r.then:
            raise RuleError(f"rule {r.id!r} sets nothing")
        for name, value in r.then.items():
            if name not in switches:
                raise RuleError(f"rule {r.id!r}: no switch is called {name!r}")
            if not isinstance(value, switches[name]) or isinstance(value, bool) != (switches[name] is bool):
                raise RuleError(f"rule {r.id!r}: {value!r} is no value of {name!r}")
    return rules


def decided(rows: DataFrame, rules: list[Rule], switches: dict[str, type]) -> DataFrame:
    """rows with fired (ids of the rules that are true) and a column a switch that any rule sets; the last true rule wins, null if none."""
    checked(rules, rows.columns, switches)
    fires = {r.id: Compiler(r.when, rows.columns).compile() for r in rules}
    fired = F.filter(F.array(*[F.when(c, F.lit(i)) for i, c in fires.items()]), lambda x: x.isNotNull())
    out = {"fired": fired}
    for s in dict.fromkeys(s for r in rules for s in r.then):
        out[s] = F.coalesce(*[F.when(fires[r.id], F.lit(r.then[s])) for r in reversed(rules) if s in r.then])
    return rows.withColumns(out)


def census(decisions: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule, fires, asked: how often each rule was true, rules that never were included."""
    counts = decisions.agg(F.count("*").alias("asked"), *[F.count_if(F.array_contains("fired", r.id)).alias(f"f{i}") for i, r in enumerate(rules)])
    each = F.array(*[F.struct(F.lit(r.id).alias("rule"), F.col(f"f{i}").alias("fires")) for i, r in enumerate(rules)])
    return counts.select("asked", F.explode(each).alias("r")).select("r.rule", "r.fires", "asked")
