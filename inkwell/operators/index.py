"""The inverted index, doc values and stored documents of a table of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.analysis import ANALYZERS, suffixes
from inkwell.sources.shared import ranked

from .model import FieldSpec, IndexSpec


POSTING = "field string, term_type string, term string, num long, doc_id long"
TERM = ["field", "term_type", "term", "num"]
#: Up to so many documents of a term are ranked by a window, before whose shuffle each task keeps no more of a term (Spark's own bound
#: for that); more are ranked by ranges.
WINDOW = 1000


def words(f: FieldSpec) -> Column:
    """array<string> of a string field's terms, whose suffixes are not yet made."""
    c = F.col(f.name)
    return c if f.analyzer == "terms" else ANALYZERS[f.analyzer](c)


def terms(f: FieldSpec) -> Column:
    """array<struct<field, term_type, term, num>> of a field; empty where it is null."""
    c = F.col(f.name)
    if f.kind != "string":
        own = F.array(F.struct(F.lit(f.name).alias("field"), F.lit(f.kind).alias("term_type"), F.lit(None).cast("string").alias("term"), c.cast("long").alias("num")))
    else:
        found = words(f)
        if f.suffix:
            found = F.array_distinct(F.flatten(F.transform(found, lambda t: suffixes(t))))
        own = F.transform(found, lambda t: F.struct(F.lit(f.name).alias("field"), F.lit("s").alias("term_type"), t.alias("term"), F.lit(None).cast("long").alias("num")))
    return F.when(c.isNotNull(), own).otherwise(F.array().cast("array<struct<field:string,term_type:string,term:string,num:bigint>>"))


def postings(docs: DataFrame, spec: IndexSpec) -> DataFrame:
    """(field, term_type, term, num, doc_id): one scan, no shuffle; of each field its distinct terms."""
    inverted = [terms(f) for f in spec.fields if f.invert]
    if not inverted:
        return docs.sparkSession.createDataFrame([], POSTING)
    if len(inverted) == 1:  # what all rows have in common is literal, so they are narrow
        f = next(f for f in spec.fields if f.invert)
        return of_field(F.transform(terms(f), lambda t: t["term"]) if f.suffix else None, docs, f)
    return docs.select("doc_id", F.explode(F.concat(*inverted)).alias("t")).select("t.*", "doc_id")


def of_field(found: Column | None, docs: DataFrame, f: FieldSpec) -> DataFrame:
    """postings() of one field: its terms or, if given, those of `found`."""
    if f.kind != "string":
        return named(docs.where(F.col(f.name).isNotNull()).select("doc_id", F.col(f.name).cast("long").alias("num")), f)
    return named(docs.select("doc_id", F.explode(words(f) if found is None else found).alias("term")), f)


def named(own: DataFrame, f: FieldSpec) -> DataFrame:
    """own (doc_id, term or num) of one field with all columns of postings."""
    text = f.kind == "string"
    value = ["term", F.lit(None).cast("long").alias("num")] if text else [F.lit(None).cast("string").alias("term"), "num"]
    return own.select(F.lit(f.name).alias("field"), F.lit("s" if text else f.kind).alias("term_type"), *value, "doc_id")


def doc_values(docs: DataFrame, spec: IndexSpec) -> DataFrame:
    """What filters and sorts see. Columns nobody asks for are never read."""
    return docs.select("doc_id", *(f.name for f in spec.fields if f.doc_value))


def stored(docs: DataFrame, spec: IndexSpec) -> DataFrame:
    """What is fetched for hits, with the terms of the fields that keep them."""
    kept = [F.lit(f.name) if i == 0 else terms(f) for f in spec.fields if f.invert and f.keep_terms and f.store for i in (0, 1)]
    all_terms = F.create_map(*kept) if kept else F.lit(None)
    return docs.select("doc_id", *(f.name for f in spec.fields if f.store), all_terms.alias("terms"))


def document_frequency(own: DataFrame) -> DataFrame:
    """How many documents each term is in."""
    return own.groupBy("field", "term_type", "term", "num").agg(F.count("*").alias("df"))


def capped(own: DataFrame, most: int) -> DataFrame:
    """At most `most` documents of a term, those of the largest ids. A term may be in any number of documents."""
    if most <= WINDOW:
        place = F.row_number().over(Window.partitionBy(*TERM).orderBy(F.desc("doc_id")))
        return own.withColumn("rank", place).where(F.col("rank") <= most).drop("rank")
    ranks = ranked(own, TERM, F.desc("doc_id"), name="rank")
    return ranks.where(F.col("rank") <= most).drop("rank")
