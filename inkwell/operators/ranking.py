"""Orders of hits, and scores from stored text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .filters import value
from .model import IndexSpec


@dataclass(frozen=True)
class SortKey:
    """A doc value, descending unless told. Descending: absent ones last, by id descending; ascending: first, by id ascending."""

    field: str
    desc: bool = True

    def columns(self, spec: IndexSpec, stored: bool = False) -> list[Column]:
        """stored: the rows have the fields that are stored, in place of those with doc values."""
        f = spec.by_name.get(self.field)
        c = value(spec, self.field, f is not None and f.kind == "string")
        c = F.lit(None).cast("long") if c is None or (stored and not f.store) else c
        own = F.when(c.isNull(), F.col("doc_id"))
        return [c.desc_nulls_last(), own.desc_nulls_last()] if self.desc else [c.asc_nulls_first(), own.asc_nulls_last()]


def order(keys: list[SortKey], spec: IndexSpec, stored: bool = False) -> list[Column]:
    """The keys one after the other, then id descending."""
    return [*(c for k in keys for c in k.columns(spec, stored)), F.desc("doc_id")]


@dataclass(frozen=True)
class StringScore:
    """0 unless the match is in the field; else 10 if it contains the pattern, and 10 x query terms / its terms.

    own() is made of stored columns alone, so it can be computed where they are; expr() of it and the match.
    """

    pattern: str
    n_terms: int
    field: str
    weight: float = 10.0

    def own(self) -> Column:
        c, own = F.col(self.field), F.size(F.element_at("terms", self.field))
        by_terms = F.when(own > 0, F.lit(float(self.n_terms)) / own).otherwise(0.0)
        score = F.when(F.contains(c, F.lit(self.pattern)), self.weight).otherwise(0.0) + self.weight * F.coalesce(by_terms, F.lit(0.0))
        return F.when(c.isNotNull(), score).otherwise(0.0)

    def expr(self, own: Column) -> Column:
        return F.when(F.col("match_field") == self.field, own).otherwise(0.0)
