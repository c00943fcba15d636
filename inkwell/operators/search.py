"""Search: retrieval, filters, order or re-ranking, offset and limit, and fetching of hits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.analysis import suffixes
from inkwell.sources.shared import numbered
from inkwell.sources.store import Store

from . import index as ix
from .filters import Filter, passes
from .model import NOT_EXIST, OK, CompatLimits, FieldSpec, IndexSpec
from .query import Leaf, Prefix, Query, any_of, match
from .ranking import SortKey, StringScore, order
from .stats import Trace


class Index:
    """Postings, doc values and stored documents, each read only as far as a search asks.

    All are functions of names of fields. That of postings gets the search's leaves too, and may leave out what none of them matches.
    """

    def __init__(self, spec: IndexSpec, postings: Callable[..., DataFrame], doc_values: Callable[[set[str]], DataFrame], stored: Callable[[set[str]], DataFrame], docs: DataFrame | None = None):
        self.spec, self.postings, self.doc_values, self.stored, self.docs = spec, postings, doc_values, stored, docs
        self.names = {f.name for f in spec.fields}

    @classmethod
    def of(cls, docs: DataFrame, spec: IndexSpec) -> Index:
        """Built from documents as part of the search's own plan: only the fields a query asks are analysed."""
        docs = docs.where("doc_id > 0")
        return cls(spec, lambda fields, leaves=(): ix.postings(docs, spec.only(fields)), lambda names: ix.doc_values(docs, spec.only(names)), lambda names: ix.stored(docs, spec.only(names)), docs)

    @classmethod
    def written(cls, store: Store, name: str, spec: IndexSpec, docs: Callable[[set[str]], DataFrame]) -> Index:
        """The index of documents, docs(names) with these fields: a field's postings are written when a search first asks for
        them, and read from there by every later one. Doc values and stored fields are read where the documents are."""
        own = lambda names: docs(names).where("doc_id > 0")

        def postings(fields: set[str], leaves: tuple[Leaf, ...] = ()) -> DataFrame:
            for f in spec.fields:
                if f.invert and f.name in fields and not store.versions(field_table(name, f)):
                    write_field(store, name, f, own({f.name}))
            return read_postings(store, name, spec.only(fields), leaves)

        return cls(spec, postings, lambda names: ix.doc_values(own(names), spec.only(names)), lambda names: ix.stored(own(names), spec.only(names)))

    def write(self, store: Store, name: str) -> None:
        """All postings, doc values and stored documents of an index made by of(), as tables of their own."""
        for f in self.spec.fields:
            if f.invert:
                write_field(store, name, f, self.docs)
        for part, df in (("values", self.doc_values(self.names)), ("stored", self.stored(self.names))):
            store.write(f"{name}_{part}", df)

    @classmethod
    def read(cls, store: Store, name: str, spec: IndexSpec) -> Index:
        """What write() made; searches look its terms up and analyse no text."""
        values, stored = store.read(f"{name}_values"), store.read(f"{name}_stored")
        return cls(spec, lambda fields, leaves=(): read_postings(store, name, spec.only(fields), leaves), lambda names: values, lambda names: stored)

    def matches(self, query: Query, limits: CompatLimits = CompatLimits()) -> DataFrame:
        """(doc_id, match_field) of the candidates, within the limits."""
        leaves = query.leaves()
        own = self.postings({x.field for x in leaves}, tuple(leaves))
        if limits.postings_per_term is not None:  # a term's cap depends on no other term
            own = ix.capped(own.where(any_of(leaves)), limits.postings_per_term)
        found = match(own, query)
        return found if limits.candidates is None else found.orderBy(F.desc("doc_id")).limit(limits.candidates + 1)

    def passing(self, found: DataFrame, filters: list[Filter], min_match: int, values: set[str]) -> DataFrame:
        """Those of found that pass, with the doc values asked for; without any nothing is joined."""
        asked = {x.field for x in filters} | values
        names = [f.name for f in self.spec.fields if f.doc_value and f.name in asked]
        if names:
            found = found.join(self.doc_values(set(names)).select("doc_id", *names), "doc_id", "left")
        return found.where(passes(list(filters), self.spec, min_match)) if filters else found

    def hits(self, query: Query, filters: list[Filter] = (), min_match: int = 0, limits: CompatLimits = CompatLimits(), values: tuple[str, ...] = ()) -> DataFrame:
        """All hits (doc_id, match_field) with the doc values asked for and those the filters read, unordered."""
        return self.passing(self.matches(query, limits), list(filters), min_match, set(values))

    def search(self, query: Query, offset: int = 0, limit: int = 10, filters: list[Filter] = (), sort: list[SortKey] = (), scores: list[StringScore] = (), max_score_docs: int | None = None, min_match: int = 0, with_total: bool = False, limits: CompatLimits = CompatLimits(), trace: Trace | None = None) -> DataFrame:
        """(rank, doc_id, match_field[, score][, total]): rank counts from 1 in the final order.

        Scores choose which hits are kept; their order is that of the sort keys, or id descending.
        max_score_docs: batches of candidates, in id order, are scored until so many hits are. trace: gets
        the numbers of candidates, hits and results when the result is run.
        """
        candidates = self.matches(query, limits)
        candidates = trace.count(candidates, "candidates") if trace else candidates
        found = self.passing(candidates, list(filters), min_match, set() if scores else {k.field for k in sort})
        found = trace.count(found, "hits") if trace else found
        extra = []
        if scores:
            ranked = found.select("doc_id", "match_field")
            if max_score_docs is not None:
                ranked = self.first_batches(candidates.select("doc_id"), ranked, max(max_score_docs, offset + limit), limits.batch)
            # What scores need of the texts is computed where they are, so no text is shuffled.
            keys = [f.name for f in self.spec.fields if f.store and f.name in {k.field for k in sort}]
            own = self.stored({s.field for s in scores} | set(keys)).select("doc_id", *keys, *(s.own().alias(f"score_{i}") for i, s in enumerate(scores)))
            score = sum((s.expr(F.col(f"score_{i}")) for i, s in enumerate(scores)), F.lit(0.0))
            ranked = ranked.join(own, "doc_id").withColumn("score", score)
            top = ranked.orderBy(F.desc("score"), F.desc("doc_id")).offset(offset).limit(limit)
            extra = ["score"]
        else:
            top = found.orderBy(*order(list(sort), self.spec)).offset(offset).limit(limit)
        # What is left is offset + limit rows at most, so one task numbers it. Scored hits are sorted by stored values.
        rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order(list(sort), self.spec, stored=bool(scores))))
        top = top.withColumn("rank", rank).select("rank", "doc_id", "match_field", *extra)
        if with_total:
            total = found.agg(F.count("*").alias("total")).withColumn("one", F.lit(1))
            top = top.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").drop("one")
        return trace.count(top, "results") if trace else top

    def first_batches(self, candidates: DataFrame, found: DataFrame, bound: int, size: int) -> DataFrame:
        """Hits of the batches of candidates, in id order, that come before `bound` hits are reached."""
        every = numbered(candidates, F.desc("doc_id"), name="place")
        own = found.join(every, "doc_id").withColumn("hit_batch", F.floor(F.col("place") / size)).drop("place")
        # A hit's number among the hits: those before its batch's first hit are in earlier batches.
        hits = numbered(own, F.desc("doc_id"), name="hit")
        last = hits.where(F.col("hit") < bound).agg(F.max("hit_batch").alias("last_batch")).withColumn("one", F.lit(1))
        first = hits.withColumn("one", F.lit(1)).join(F.broadcast(last), "one")
        return first.where("hit_batch <= last_batch").select("doc_id", "match_field")

    def fetch(self, ids: DataFrame, source: str = "stored") -> DataFrame:
        """Each id (doc_id) with its stored document or doc values, and status OK or NOT_EXIST."""
        own = (self.stored if source == "stored" else self.doc_values)(self.names).withColumn("there", F.lit(True))
        return ids.join(own, "doc_id", "left").withColumn("status", F.when(F.col("there"), OK).otherwise(NOT_EXIST)).drop("there")

    def facets(self, query: Query, field: str, filters: list[Filter] = ()) -> DataFrame:
        """Extension: hits by value of a doc-value field."""
        return self.hits(query, filters, values=(field,)).groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n"))


def field_table(name: str, f: FieldSpec) -> str:
    """The table of a field's postings. Those of suffixes are made of whole terms when they are read."""
    return f"{name}_postings_{f.name}_{f.analyzer if f.kind == 'string' else f.kind}"


def write_field(store: Store, name: str, f: FieldSpec, docs: DataFrame) -> None:
    """A field's postings, each task's sorted by term: of every file a search reads the pages its terms are in. One
    analysis of the texts and no shuffle, so a term that many documents have is in many files and in no task whole."""
    value = "term" if f.kind == "string" else "num"
    store.write(field_table(name, f), ix.of_field(None, docs, f).select(value, "doc_id").sortWithinPartitions(value, "doc_id"))


def read_postings(store: Store, name: str, spec: IndexSpec, leaves: tuple[Leaf, ...] = ()) -> DataFrame:
    """Postings of the fields of spec from their tables."""
    out = None
    for f in spec.fields:
        if not f.invert:
            continue
        own = store.read(field_table(name, f))
        if f.suffix:
            # A suffix begins with what is asked, so its term contains it.
            asked = [F.contains("term", F.lit(x.prefix if isinstance(x, Prefix) else x.value)) for x in leaves if x.field == f.name and isinstance(getattr(x, "value", ""), str)]
            if asked:
                own = own.where(reduce(Column.__or__, asked))
            # Words of one document may end alike.
            own = own.select("doc_id", F.explode(suffixes(F.col("term"))).alias("term")).distinct()
        own = ix.named(own, f)
        out = own if out is None else out.unionByName(own)
    return store.spark.createDataFrame([], ix.POSTING) if out is None else out
