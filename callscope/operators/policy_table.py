"""Policies of any number of rules, read as data.

A rule is a pattern of Python's dialect. What every match of it must contain is a literal of its own; the
literals of all rules make one automaton, which a text goes through once. Only rules whose
literal was found are tried, and a rule that is nothing but its literal needs no trial. Rules
without such a literal (alternatives, case folding, one character) are tried on every text. So cost
grows with the texts and with what they contain, hardly with the number of rules.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from re import _parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.functions import constants as K
from callscope.operators.policy import Rule, read_policy

#: Shorter literals are found too often to be of use.
SHORTEST = 2


def _literals(parsed, found: list[str]) -> str | None:
    """Collect what each match contains; the whole match if that is one fixed string."""
    run, fixed = "", True
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            run += chr(value)
            continue
        inner = None
        if name == "SUBPATTERN" and not value[1] and not value[2]:
            inner = _literals(value[3], found)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            _literals(value[2], found)
        if inner is None:
            found.append(run)
            run, fixed = "", False
        else:
            run += inner
    found.append(run)
    return run if fixed else None


def required_literal(pattern: str) -> tuple[str | None, bool]:
    """The longest literal in every match, and whether it is all of the pattern."""
    parsed = _parser.parse(pattern)
    if parsed.state.flags & (re.IGNORECASE | re.VERBOSE | re.LOCALE):
        return None, False
    found: list[str] = []
    whole = _literals(parsed, found)
    best = max(found, key=len)
    if len(best) < SHORTEST:
        return None, False
    return best, whole == best


class Matcher:
    """The rules that apply to a text; counts the patterns it has tried."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules, self.tried = rules, 0
        self.always, by_literal = [], {}
        self.surely = set()
        for n, rule in enumerate(rules):
            literal, whole = required_literal(rule.pattern)
            if literal is None:
                self.always.append(n)
            else:
                by_literal.setdefault(literal, []).append(n)
                if whole:
                    self.surely.add(n)
        self.patterns: dict[int, re.Pattern] = {}
        self.automaton = ahocorasick.Automaton()
        for literal, numbers in by_literal.items():
            self.automaton.add_word(literal, numbers)
        if by_literal:
            self.automaton.make_automaton()

    def _applies(self, n: int, text: str) -> bool:
        if n in self.surely:
            return True
        self.tried += 1
        if n not in self.patterns:
            self.patterns[n] = re.compile(self.rules[n].pattern)
        return self.patterns[n].search(text) is not None

    def hits(self, text: str | None) -> list[Rule]:
        if text is None:
            return []
        candidates = set(self.always)
        if len(self.automaton):
            for _, numbers in self.automaton.iter(text):
                candidates.update(numbers)
        return [self.rules[n] for n in sorted(candidates) if self._applies(n, text)]


@functools.lru_cache(maxsize=4)
def matcher(rules: tuple[Rule, ...]) -> Matcher:
    """One automaton per process and policy."""
    return Matcher(rules)


def verdict(hits: list[Rule]) -> str:
    """The strictest verdict; a category may lead to several."""
    return max((r.verdict for r in hits), key=K.SEVERITY.__getitem__, default=K.DEFAULT_VERDICT)


def apply_policy_table(messages: DataFrame, policy: DataFrame, text: str = "text") -> DataFrame:
    """Add ``verdict`` and the sorted ``categories`` that apply, for a policy table
    (``category, verdict, pattern``; a category may have several verdicts).

    The rules go to every task; a policy is written by people and does not grow with the
    messages. A null text hits no rule. A pattern that is none, or an unknown verdict, is an error
    here, before any message is read.
    """
    rules = tuple(sorted(set(read_policy(policy))))
    for rule in rules:
        re.compile(rule.pattern)
        K.SEVERITY[rule.verdict]  # noqa: B018
    kept = [c for c in messages.columns if c not in ("verdict", "categories")]
    given = messages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("_judged"))
    added = T.StructType().add("verdict", "string").add("categories", T.ArrayType(T.StringType()))
    schema = T.StructType([*given.schema.fields[:-1], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = matcher(rules)
        for batch in batches:
            found = [match.hits(value) for value in batch.column(len(kept)).to_pylist()]
            words = pa.array([verdict(hits) for hits in found], pa.string())
            categories = pa.array([sorted({r.category for r in hits}) for hits in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], words, categories], names=schema.names)

    return given.mapInArrow(run, schema)
