"""Signature rules as predicates over event columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from hawkframe.functions.decisions import any_of


@dataclass(frozen=True)
class Rule:
    """All fields of `selection` must match; a list means any of its values.

    A key may carry `|contains`, `|startswith` or `|endswith`; matching
    ignores case.  A Python rule gives `condition` instead.
    """

    name: str
    level: str
    techniques: tuple[str, ...] = ()
    selection: dict = field(default_factory=dict)
    condition: Callable[[], Column] | None = None

    def matches(self) -> Column:
        if self.condition is not None:
            return F.coalesce(self.condition(), F.lit(False))
        hit = F.lit(True)
        for key, wanted in self.selection.items():
            name, _, how = key.partition("|")
            values = wanted if isinstance(wanted, (list, tuple)) else [wanted]
            hit = hit & any_of([_compare(name, how, v) for v in values])
        return F.coalesce(hit, F.lit(False))


def _compare(name: str, how: str, value) -> Column:
    col = F.lower(F.col(name).cast("string"))
    text = F.lit(str(value).lower())
    if how == "contains":
        return F.contains(col, text)
    if how == "endswith":
        return F.endswith(col, text)
    if how == "startswith":
        return F.startswith(col, text)
    if how:
        raise ValueError(f"unknown modifier: {how}")
    return col == text


def matched_rules(rules: list[Rule]) -> Column:
    """Array of (rule, level, techniques) for every rule that matches the row."""
    hits = [
        F.when(
            r.matches(),
            F.struct(
                F.lit(r.name).alias("rule"),
                F.lit(r.level).alias("level"),
                F.array(*[F.lit(t) for t in r.techniques]).cast("array<string>").alias("techniques"),
            ),
        )
        for r in rules
    ]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def technique_list(matched: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(matched, lambda m: m["techniques"])))


def technique_count(matched: Column) -> Column:
    return F.size(technique_list(matched))
