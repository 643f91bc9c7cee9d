"""Rule banks: ordered patterns compiled to columns.

The patterns stay literals of the plan, so a bank of any length is one pass over
the text and no join with a rules table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A label and the pattern that gives it, in the dialect shared by Java and RE2."""

    label: str
    pattern: str


def matches(text: Column, pattern: str) -> Column:
    """True where the pattern occurs, whatever the case of letters; null text is false."""
    return F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))


def first_match(text: Column, bank: Sequence[Rule], default: Column | None = None) -> Column:
    """The label of the first rule that matches."""
    start = F.lit(None).cast("string") if default is None else default
    return reduce(lambda rest, rule: F.when(matches(text, rule.pattern), rule.label).otherwise(rest), reversed(bank), start)


def all_matches(text: Column, bank: Sequence[Rule]) -> Column:
    """The labels of all rules that match, in rule order, each once."""
    hits = F.array(*[F.when(matches(text, r.pattern), r.label) for r in bank]) if bank else F.array().cast("array<string>")
    return F.array_distinct(F.filter(hits, lambda x: x.isNotNull()))


def scoped_match(scopes: Sequence[tuple[Column, Sequence[Rule]]], default: Column) -> Column:
    """The first match of the first scope that has one; scopes are (text, bank) in order."""
    return F.coalesce(*[first_match(text, bank) for text, bank in scopes], default)


def phrase_counts(text: Column, phrases: dict[str, str]) -> dict[str, Column]:
    """How often each named phrase occurs."""
    return {name: F.coalesce(F.regexp_count(F.lower(text), F.lit(p)), F.lit(0)) for name, p in phrases.items()}
