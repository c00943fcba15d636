"""Predicates on doc values. A field that is absent, or of the other class, is never true, in negations too."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .model import IndexSpec


def value(spec: IndexSpec, name: str, text: bool) -> Column | None:
    f = spec.by_name.get(name)
    return F.col(name) if f and f.doc_value and (f.kind == "string") == text else None


class Filter:
    text = False

    def holds(self, c: Column) -> Column:
        raise NotImplementedError

    def expr(self, spec: IndexSpec) -> Column:
        c = value(spec, self.field, self.text)
        return F.lit(False) if c is None else F.coalesce(self.holds(c), F.lit(False))


@dataclass(frozen=True)
class Equal(Filter):
    field: str
    to: int | str

    @property
    def text(self) -> bool:
        return isinstance(self.to, str)

    def holds(self, c: Column) -> Column:
        return c == F.lit(self.to)


class NotEqual(Equal):
    def holds(self, c: Column) -> Column:
        return c != F.lit(self.to)


@dataclass(frozen=True)
class Range(Filter):
    """Both ends belong to it."""

    field: str
    low: int
    high: int

    def holds(self, c: Column) -> Column:
        return c.between(self.low, self.high)


@dataclass(frozen=True)
class Contains(Filter):
    field: str
    part: str
    text = True

    def holds(self, c: Column) -> Column:
        return F.contains(c, F.lit(self.part))


class NotContains(Contains):
    def holds(self, c: Column) -> Column:
        return ~F.contains(c, F.lit(self.part))


@dataclass(frozen=True)
class InList(Filter):
    field: str
    values: tuple[int, ...]

    def holds(self, c: Column) -> Column:
        return c.isin(list(self.values))


class NotInList(InList):
    def holds(self, c: Column) -> Column:
        return ~c.isin(list(self.values))


@dataclass(frozen=True)
class MatchStrings(Filter):
    """At least `least` (default: all) of the strings are contained; revert: fewer are."""

    field: str
    parts: tuple[str, ...]
    revert: bool = False
    least: int | None = None
    text = True

    def holds(self, c: Column) -> Column:
        need = len(self.parts) if self.least is None else min(self.least, len(self.parts))
        good = count([F.contains(c, F.lit(p)) for p in self.parts]) >= need
        return c.isNotNull() & (~good if self.revert else good)


def count(conditions: list[Column]) -> Column:
    total = F.lit(0)
    for c in conditions:
        total = total + c.cast("int")
    return total


def passes(filters: list[Filter], spec: IndexSpec, min_match: int = 0) -> Column:
    """At least min_match filters are true; 0 or more than there are: all. Without filters: true."""
    if not filters:
        return F.lit(True)
    need = min_match if 0 < min_match <= len(filters) else len(filters)
    own = [f.expr(spec) for f in filters]
    if need == len(filters):  # as a conjunction Catalyst can push it down
        out = own[0]
        for c in own[1:]:
            out &= c
        return out
    return count(own) >= need
