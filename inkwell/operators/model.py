"""Fields, indexes and status codes."""

from __future__ import annotations

from dataclasses import dataclass, field

# The status codes of reads and writes.
OK = 0
EXISTS = 18526
NOT_EXIST = 18527
ID_ZERO = 18530
OTHER_DOC_ERROR = 18533
TOO_LARGE = 18537
PREFIX_CAP = 18538


@dataclass(frozen=True)
class FieldSpec:
    """A column of the documents and what the index does with it.

    kind: string, u32 or u64 (longs from 0 on). analyzer: of functions.analysis.ANALYZERS, or
    "terms" where the column is an array of ready terms.
    """

    name: str
    kind: str = "string"
    analyzer: str = "word"
    invert: bool = True
    store: bool = True
    doc_value: bool = True
    suffix: bool = False
    keep_terms: bool = True


@dataclass(frozen=True)
class IndexSpec:
    """The fields of an index; doc_id is a long above 0."""

    fields: tuple[FieldSpec, ...]
    by_name: dict[str, FieldSpec] = field(init=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "by_name", {f.name: f for f in self.fields})

    def only(self, names: set[str]) -> IndexSpec:
        """The fields of these names."""
        return IndexSpec(tuple(f for f in self.fields if f.name in names))


@dataclass(frozen=True)
class CompatLimits:
    """Caps that a single-machine index has; None, the default, is no cap."""

    candidates: int | None = None
    postings_per_term: int | None = None
    batch: int = 10_000
