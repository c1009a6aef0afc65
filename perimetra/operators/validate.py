"""Row validation: an array of error strings, empty for a good row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_ERRORS = 12


@dataclass(frozen=True)
class Rule:
    """A message for rows that are bad."""

    bad: Column
    message: str


@dataclass
class Schema:
    """Checks of one level of a document, by path; unknown keys are errors."""

    rules: list[Rule] = field(default_factory=list)

    def required(self, column: Column, path: str) -> Schema:
        self.rules.append(Rule(column.isNull(), f"{path}: required"))
        return self

    def matches(self, column: Column, path: str, pattern: str, longest: int = 256) -> Schema:
        self.rules.append(Rule(~column.rlike(pattern) | (F.length(column) > longest), f"{path}: bad format"))
        return self

    def between(self, column: Column, path: str, low: float, high: float) -> Schema:
        self.rules.append(Rule(~column.between(low, high), f"{path}: out of range"))
        return self

    def one_of(self, column: Column, path: str, values: Sequence[str]) -> Schema:
        self.rules.append(Rule(~column.isin(*values), f"{path}: not allowed"))
        return self

    def longest(self, column: Column, path: str, size: int) -> Schema:
        self.rules.append(Rule(F.size(column) > size, f"{path}: too many"))
        return self

    def known_keys(self, raw: Column, path: str, allowed: Sequence[str]) -> Schema:
        """raw: the level's JSON text."""
        extra = F.array_except(F.json_object_keys(raw), F.array(*[F.lit(a) for a in allowed]))
        self.rules.append(Rule(F.size(extra) > 0, f"{path}: unknown key"))
        return self

    def check(self, bad: Column, message: str) -> Schema:
        self.rules.append(Rule(bad, message))
        return self

    def errors(self, most: int = MOST_ERRORS) -> Column:
        every = F.array(*[F.when(F.coalesce(r.bad, F.lit(False)), F.lit(r.message)) for r in self.rules])
        return F.slice(F.array_compact(every), 1, most)


def consistent_event(stage: Column, explanation: Column, evidence: Column) -> Schema:
    """Provisional events have no explanation, later ones do; evidence goes with sealed and only with it."""
    return (
        Schema()
        .check((stage == "provisional") & explanation.isNotNull(), "explanation: not while provisional")
        .check((stage != "provisional") & explanation.isNull(), "explanation: required after provisional")
        .check((stage == "sealed") != evidence.isNotNull(), "evidence: goes with sealed")
    )
