"""Rule-based classification, and how labels compare with expected ones."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions import constants as K
from callscope.functions import metrics as M
from callscope.functions.text import strict_format


class Rule(NamedTuple):
    """One pattern of one category and the verdict it leads to."""

    category: str
    verdict: str
    pattern: str


def read_policy(policy: DataFrame) -> list[Rule]:
    """The rules of a policy table (``category, verdict, pattern``).

    They become literals of the plan, so they come to the driver; a policy is written by
    people and does not grow with the messages.
    """
    return [Rule(*row) for row in policy.select("category", "verdict", "pattern").collect()]


def policy_severity(hits: Sequence[Column], rules: Sequence[Rule]) -> Column:
    """Severity of the strictest rule that applies; the default verdict's without any.

    ``hits`` says per rule whether it applies. Strictest first: coalesce stops there.
    """
    pairs = sorted(zip(hits, rules), key=lambda pair: -K.SEVERITY[pair[1].verdict])
    found = [F.when(hit, F.lit(K.SEVERITY[rule.verdict])) for hit, rule in pairs]
    return F.coalesce(*found, F.lit(K.SEVERITY[K.DEFAULT_VERDICT]))


def verdict_of(severity: Column) -> Column:
    """The verdict word of a severity."""
    words = [F.lit(x) for word, level in K.SEVERITY.items() for x in (level, word)]
    return F.element_at(F.create_map(*words), severity)


def policy_verdict(text: Column, rules: Sequence[Rule]) -> Column:
    """Block over review over allow; allow when no rule applies.

    Rules become literal patterns of one projection, each compiled once per task;
    a join on ``rlike`` would pair every message with every rule and compile a
    pattern per pair. Works on batches and streams alike.
    """
    return verdict_of(policy_severity([text.rlike(rule.pattern) for rule in rules], rules))


def apply_policy(messages: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """Add ``verdict`` and the sorted ``categories`` that apply, one match per rule."""
    matched = F.array(*[F.col(text).rlike(rule.pattern) for rule in rules])
    hits = [F.col("_hits")[i] for i in range(len(rules))]
    categories = F.array(*[F.when(hit, F.lit(rule.category)) for hit, rule in zip(hits, rules)])
    return (
        messages.withColumn("_hits", matched)
        .withColumns(
            {
                "verdict": verdict_of(policy_severity(hits, rules)),
                "categories": F.array_sort(F.array_distinct(F.array_compact(categories))),
            }
        )
        .drop("_hits")
    )


def label_distribution(calls: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Calls per label."""
    return calls.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("calls"))


def accuracy(
    labelled: DataFrame, expected: DataFrame, key: str, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Share of labels that equal the expected ones, over items that have both."""
    joined = labelled.join(expected, key)
    right = F.count_if(F.col("label") == F.col("expected"))
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items"),
        right.alias("right"),
        M.mean(right, F.nullif(F.count(F.lit(1)), F.lit(0))).alias("accuracy"),
    )


def confusion(labelled: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Items per expected and given label."""
    return (
        labelled.join(expected, key)
        .groupBy("expected", "label")
        .agg(F.count(F.lit(1)).alias("items"))
    )


def format_compliance(
    calls: DataFrame, keys: tuple[str, ...] = (), text: str = "response_text"
) -> DataFrame:
    """Share of replies that are one label word and nothing else."""
    strict = F.count_if(strict_format(F.col(text)))
    return calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("replies"),
        strict.alias("strict"),
        M.mean(strict, F.nullif(F.count(F.lit(1)), F.lit(0))).alias("compliance"),
    )
