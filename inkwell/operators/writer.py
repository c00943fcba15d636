"""Batch maintenance of documents: six write modes, term-level index differences, folding.

Documents are wide rows (doc_id and a column for each field). Only the batch is joined and written
here; every part of a result is a DataFrame, for the caller to write where the table's next version lives.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.sources.shared import materialise

from . import index as ix
from .model import EXISTS, ID_ZERO, NOT_EXIST, OK, OTHER_DOC_ERROR, TOO_LARGE, IndexSpec

KEY = ("field", "term_type", "term", "num", "doc_id")


@dataclass
class WriteResult:
    """statuses (doc_id, status); docs: the table afterwards; delta: changes of postings (KEY, state: 0
    add, 1 delete); failed: whether the batch failed and changed nothing."""

    statuses: DataFrame
    docs: DataFrame
    delta: DataFrame
    failed: bool


def _write(old: DataFrame, new: DataFrame, spec: IndexSpec, mode: str, max_bytes: int | None = None) -> WriteResult:
    names = [f.name for f in spec.fields]
    batch = new.groupBy("doc_id").agg(F.count("*").alias("times"), *(F.first(n).alias(n) for n in names if n in new.columns))
    batch = batch.select("doc_id", "times", *(F.col(n) if n in batch.columns else F.lit(None).cast(old.schema[n].dataType).alias(n) for n in names))
    both = batch.join(old.select("doc_id", F.struct(*names).alias("was")), "doc_id", "left")
    there = F.col("was").isNotNull()
    own = F.when(F.coalesce("doc_id", F.lit(0)) <= 0, ID_ZERO).when(F.col("times") > 1, OTHER_DOC_ERROR)
    if mode == "add":
        own = own.when(there, EXISTS)
    if mode in ("update", "delete"):
        own = own.when(~there, NOT_EXIST)
    size = sum((F.coalesce(F.octet_length(F.col(n).cast("string")), F.lit(0)) for n in names), F.lit(0))
    # The batch beside what it meets is written once; statuses, documents and postings are read from it.
    state = materialise(both.withColumns({"own": own.otherwise(OK), "bytes": size}), "batch")
    # A missing document is no failure of a deletion.
    bad = (F.col("own") != OK) & ((F.col("own") != NOT_EXIST) if mode == "delete" else F.lit(True))
    wrong, total = state.agg(F.coalesce(F.bool_or(bad), F.lit(False)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    large = max_bytes is not None and total > max_bytes
    failed = wrong or large
    status = F.when((F.col("own") == OK) & F.lit(failed), TOO_LARGE if large else OTHER_DOC_ERROR).otherwise(F.col("own"))
    statuses = state.select("doc_id", status.alias("status"))
    done = state.limit(0) if failed else state

    def merged(n: str) -> Column:
        return F.coalesce(n, F.col("was")[n]).alias(n) if mode in ("update", "upsert") else F.col(n)

    after = done.select("doc_id", *map(merged, names))
    docs = old.select("doc_id", *names)
    if not failed:
        docs = docs.join(state.select("doc_id"), "doc_id", "left_anti")
        docs = docs if mode == "delete" else docs.unionByName(after)
    was = done.where(there).select("doc_id", "was.*")
    gone = was.limit(0) if mode == "append" else was
    kept = [f.name for f in spec.fields if f.invert and not f.keep_terms]
    old_terms = ix.postings(gone, spec)
    if kept:  # terms that were not kept with the document can't be taken back
        old_terms = old_terms.where(~F.col("field").isin(kept))
    delta = posting_diff(old_terms, ix.postings(after if mode != "delete" else after.limit(0), spec))
    return WriteResult(statuses, docs, delta, failed)


def add(old: DataFrame, new: DataFrame, spec: IndexSpec, max_bytes: int | None = None) -> WriteResult:
    """New documents only; one that exists fails the batch."""
    return _write(old, new, spec, "add", max_bytes)


def update(old: DataFrame, new: DataFrame, spec: IndexSpec, max_bytes: int | None = None) -> WriteResult:
    """Documents that exist; fields that aren't given (null) stay."""
    return _write(old, new, spec, "update", max_bytes)


def upsert(old: DataFrame, new: DataFrame, spec: IndexSpec, max_bytes: int | None = None) -> WriteResult:
    return _write(old, new, spec, "upsert", max_bytes)


def replace(old: DataFrame, new: DataFrame, spec: IndexSpec, max_bytes: int | None = None) -> WriteResult:
    """Whole documents, whether or not they existed."""
    return _write(old, new, spec, "replace", max_bytes)


def delete(old: DataFrame, ids: DataFrame, spec: IndexSpec) -> WriteResult:
    """A missing document has its status, but the batch goes on."""
    return _write(old, ids.select("doc_id"), spec, "delete")


def append(old: DataFrame, new: DataFrame, spec: IndexSpec) -> WriteResult:
    """Without a look at what was: postings of an overwritten document stay behind."""
    return _write(old, new, spec, "append")


def posting_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(KEY, state): 0 for terms only in new, 1 for terms only in old. Counted in one shuffle of both."""
    both = old.select(*KEY, F.lit(1).alias("side")).unionByName(new.select(*KEY, F.lit(2).alias("side")))
    sides = both.groupBy(*KEY).agg(F.bit_or("side").alias("sides")).where("sides <> 3")
    return sides.select(*KEY, F.when(F.col("sides") == 2, 0).otherwise(1).alias("state"))


def fold(changes: DataFrame, purge: bool = True) -> DataFrame:
    """Of changes (KEY, state, seq) the newest for each key; purge: without those that delete."""
    last = changes.groupBy(*KEY).agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))
    return last.where("state = 0").select(*KEY) if purge else last


def ingest(postings: DataFrame, more: DataFrame) -> DataFrame:
    """Postings with lists made elsewhere: more (field, term, doc_ids). Postings are a set, so only those of the lists are
    compared with them, and of them nothing is shuffled while the lists are small enough to be broadcast."""
    own = more.select("field", F.lit("s").alias("term_type"), "term", F.lit(None).cast("long").alias("num"), F.explode("doc_ids").alias("doc_id")).distinct()
    key = ["field", "term", "doc_id"]
    known = postings.where("term_type = 's'").select(*key).join(own.select(*key), key, "left_semi")
    return postings.select(*KEY).unionByName(own.join(known, key, "left_anti"))


def drop_table(rows: DataFrame, business_type: int, partition_set: int) -> DataFrame:
    """Rows without those of one table; key mappings are no rows of it and stay."""
    return rows.where((F.col("business_type") != business_type) | (F.col("partition_set") != partition_set))


def delete_page(rows: DataFrame, key: str, after: int | None, n: int) -> tuple[DataFrame, DataFrame]:
    """(rows without the next n keys after the cursor, the keys of that page)."""
    if n <= 1:
        raise ValueError("a page has more than one key")
    page = (rows if after is None else rows.where(F.col(key) > after)).select(key).distinct().orderBy(key).limit(n)
    return rows.join(page, key, "left_anti"), page
