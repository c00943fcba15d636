"""Queries over postings: terms, numbers and prefixes, in any nesting of And and Or.

All leaves are found in one scan; each document's leaves become bits of a mask, and the query
a truth value of the mask. One shuffle on doc_id, whatever the nesting.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.analysis import query_terms

from .index import document_frequency

BITS = 62


class Query:
    """A node of a query."""

    def leaves(self) -> list[Leaf]:
        return [x for c in self.children for x in c.leaves()]


class Leaf(Query):
    def leaves(self) -> list[Leaf]:
        return [self]

    def holds(self) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Term(Leaf):
    """A field has exactly this term."""

    field: str
    value: str

    def holds(self) -> Column:
        return (F.col("field") == self.field) & (F.col("term_type") == "s") & (F.col("term") == self.value)


@dataclass(frozen=True)
class TermU64(Leaf):
    """A number as it was indexed; u32 and u64 are different terms."""

    field: str
    value: int
    width: str = "u64"

    def holds(self) -> Column:
        return (F.col("field") == self.field) & (F.col("term_type") == self.width) & (F.col("num") == self.value)


def TermU32(field: str, value: int) -> TermU64:  # noqa: N802
    return TermU64(field, value, "u32")


@dataclass(frozen=True)
class Prefix(Leaf):
    """A field has a term with this beginning. max_bytes: terms in order are taken while those before
    them have fewer bytes of postings (1 + 9 for each document); None takes all."""

    field: str
    prefix: str
    max_bytes: int | None = None

    def holds(self) -> Column:
        return (F.col("field") == self.field) & (F.col("term_type") == "s") & F.startswith(F.col("term"), F.lit(self.prefix))


@dataclass(frozen=True)
class Not(Leaf):
    """Extension: true where the child isn't; only documents that match some other leaf are seen."""

    child: Query

    def leaves(self) -> list[Leaf]:
        return self.child.leaves()


class And(Query):
    """All children; without any, nothing."""

    def __init__(self, *children: Query):
        self.children = [x for c in children for x in (c.children if isinstance(c, And) else [c])]


class Or(Query):
    """Any child; without any, nothing."""

    def __init__(self, *children: Query):
        self.children = [x for c in children for x in (c.children if isinstance(c, Or) else [c])]


def nodes(query: Query) -> list[Query]:
    """The query and all below it."""
    below = [query.child] if isinstance(query, Not) else [] if isinstance(query, Leaf) else query.children
    return [query, *(x for c in below for x in nodes(c))]


def text_query(field: str, text: str, analyzer: str = "word") -> And:
    """All terms that the analyzer makes of a text."""
    return And(*(Term(field, t) for t in query_terms(text, analyzer)))


def any_of(leaves: list[Leaf]) -> Column:
    """What some leaf may match."""
    out = F.lit(False)
    for x in leaves:
        out = out | x.holds()
    return out


def admitted(own: DataFrame, leaf: Prefix) -> DataFrame:
    """(term, cut) of the terms a capped prefix takes; cut: whether the cap left some out.

    A list has 10 bytes at least, so max_bytes / 10 terms bound what is ordered and broadcast.
    """
    df = document_frequency(own.where(leaf.holds())).select("term", "df")
    df = df.orderBy("term").limit(leaf.max_bytes // 10 + 2).withColumn("one", F.lit(1))
    before = F.sum(1 + 9 * F.col("df")).over(Window.partitionBy("one").orderBy("term")) - (1 + 9 * F.col("df"))
    return df.select("term", (before < leaf.max_bytes).alias("taken"))


def match(own: DataFrame, query: Query) -> DataFrame:
    """(doc_id, match_field): of And the first child's field, of Or the first true child's."""
    leaves = list(dict.fromkeys(query.leaves()))
    if not leaves:
        return own.select("doc_id", F.col("field").alias("match_field")).limit(0)
    holds = []
    for k, leaf in enumerate(leaves):
        if isinstance(leaf, Prefix) and leaf.max_bytes is not None:
            taken = admitted(own, leaf).where("taken").select(F.col("term").alias(f"t{k}"))
            own = own.join(F.broadcast(taken), leaf.holds() & (F.col("term") == F.col(f"t{k}")), "left")
            holds.append(F.col(f"t{k}").isNotNull())
        else:
            holds.append(leaf.holds())
    anything = holds[0]
    for h in holds[1:]:
        anything |= h
    hits = own.where(anything)
    if len(leaves) == 1 and not any(isinstance(q, Not) for q in nodes(query)):
        # Postings are a set, so a term has a document once; a prefix has one for each of its terms.
        ids = hits.select("doc_id")
        return (ids.distinct() if isinstance(leaves[0], Prefix) else ids).withColumn("match_field", F.lit(leaves[0].field))
    masks = []
    for low in range(0, len(leaves), BITS):
        bits = [F.when(h, F.lit(1 << k)).otherwise(F.lit(0)) for k, h in enumerate(holds[low : low + BITS])]
        total = bits[0].cast("long")
        for b in bits[1:]:
            total = total.bitwiseOR(b.cast("long"))
        masks.append(F.bit_or(total).alias(f"m{low // BITS}"))
    found = hits.groupBy("doc_id").agg(*masks)
    place = {leaf: k for k, leaf in enumerate(leaves)}

    def truth(q: Query) -> Column:
        if isinstance(q, Not):
            return ~truth(q.child)
        if isinstance(q, Leaf):
            return F.col(f"m{place[q] // BITS}").bitwiseAND(F.lit(1 << place[q] % BITS)) != 0
        if not q.children:
            return F.lit(False)
        out = truth(q.children[0])
        for c in q.children[1:]:
            out = out & truth(c) if isinstance(q, And) else out | truth(c)
        return out

    def field(q: Query) -> Column:
        if isinstance(q, Not):
            return F.lit(None).cast("string")
        if isinstance(q, Leaf):
            return F.lit(q.field)
        if isinstance(q, And):
            return field(q.children[0])
        return F.coalesce(*(F.when(truth(c), field(c)) for c in q.children))

    return found.where(truth(query)).select("doc_id", field(query).alias("match_field"))


def prefix_status(own: DataFrame, leaf: Prefix) -> DataFrame:
    """(status): PREFIX_CAP if the cap leaves terms out, else OK; one row."""
    from .model import OK, PREFIX_CAP

    return admitted(own, leaf).agg(F.when(F.coalesce(F.bool_or(~F.col("taken")), F.lit(False)), PREFIX_CAP).otherwise(OK).alias("status"))
