"""The queries over the test tables, each with the SQL that gives the same rows.

Documents are indexed by doc_id + 1, as 0 is no id, and given back by doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import analysis as an
from inkwell.operators import index as ix
from inkwell.operators import sequence, stats, writer
from inkwell.operators.filters import Contains, Equal, InList, MatchStrings, NotContains, NotEqual, NotInList, Range
from inkwell.operators.model import CompatLimits, FieldSpec, IndexSpec
from inkwell.operators.query import And, Not, Or, Prefix, Query, Term, TermU32, TermU64, prefix_status, text_query
from inkwell.operators.ranking import SortKey, StringScore
from inkwell.operators.search import Index
from inkwell.sources import store
from inkwell.sources.shared import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DOCS = IndexSpec((FieldSpec("text"), FieldSpec("lang", analyzer="whole"), FieldSpec("source", analyzer="whole"), FieldSpec("n_chars", "u64"), FieldSpec("quality", "u64"), FieldSpec("toxic", "u64")))
ORDERS = IndexSpec((FieldSpec("o_custkey", "u64"), FieldSpec("o_orderstatus", analyzer="whole"), FieldSpec("o_orderpriority", analyzer="whole"), FieldSpec("total", "u64")))
PARTS = IndexSpec((FieldSpec("p_name", analyzer="word", suffix=True),))
EVENTS = IndexSpec((FieldSpec("event_type", analyzer="whole"), FieldSpec("user_id", "u64"), FieldSpec("cents", "u64")))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = rf"list_distinct(regexp_extract_all(translate({{}}, '{UPPER}', '{LOWER}'), '[a-z0-9]+(?:\.[a-z0-9]+)*', 0))"
TOK = f"tok AS (SELECT doc_id, unnest({WORDS.format('text')}) AS term FROM documents), "
WITH = f"WITH {TOK}docs AS (SELECT d.doc_id + 1 AS id, d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
ORD = "WITH o AS (SELECT o_orderkey + 1 AS id, o_orderkey, o_custkey, o_orderstatus, o_orderpriority, floor(o_totalprice)::BIGINT AS total FROM orders)"


def query(sql: str) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, names: set[str] | None = None) -> DataFrame:
    """Documents with their labels, which are joined only if fields of these names (None: all) are theirs."""
    if names is not None and not names & {"quality", "toxic"}:
        return table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id") + 1)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long"), F.col("toxic").cast("long"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").withColumn("doc_id", F.col("doc_id") + 1)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("doc_id"), "o_custkey", "o_orderstatus", "o_orderpriority", F.floor("o_totalprice").alias("total"))


def events(spark: SparkSession, sf_dir: str, residue: int) -> DataFrame:
    own = table(spark, sf_dir, "events").where(F.col("event_id") % 3 != residue)
    return own.select((F.col("event_id") + 1).alias("doc_id"), "event_type", "user_id", F.floor(F.col("value") * (100 if residue == 2 else 10)).alias("cents"))


def stored_index(spark: SparkSession, sf_dir: str, spec: IndexSpec, docs: Callable, *tables: str) -> Index:
    """The index of documents, docs(spark, sf_dir, names), in the shared folder: each field's postings are written once, by the
    first search that asks for them. It belongs to the tables' files as they are: their names, sizes and times are its own name."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = []
    for t in tables:
        at = path(f"{sf_dir}/{t}.parquet")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        own = fs.listStatus(at) if fs.getFileStatus(at).isDirectory() else [fs.getFileStatus(at)]
        files += sorted((x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in own)
    name = hashlib.md5(repr(files).encode()).hexdigest()
    return Index.written(store.Store(spark, f"{shared_dir(spark)}/inkwell-index"), name, spec, lambda names: docs(spark, sf_dir, names))


def doc_index(spark: SparkSession, sf_dir: str) -> Index:
    return stored_index(spark, sf_dir, DOCS, documents, "documents", "labels")


def order_index(spark: SparkSession, sf_dir: str) -> Index:
    return stored_index(spark, sf_dir, ORDERS, lambda spark, sf_dir, _: orders(spark, sf_dir), "orders")


def plain(df: DataFrame) -> DataFrame:
    """Ids as they were, and longs."""
    return df.withColumn("doc_id", F.col("doc_id") - 1)


def doc_hits(name: str, q: Query, sql: str) -> None:
    """A query whose result is the ids of its hits."""
    QUERIES[name] = lambda spark, sf_dir: plain(doc_index(spark, sf_dir).hits(q).select("doc_id"))
    ORACLE_SQL[name] = f"{WITH} {sql}"


def has(term: str) -> str:
    return f"SELECT doc_id FROM tok WHERE term = '{term}'"


doc_hits("term_eq", Term("text", "license"), has("license"))
doc_hits("term_eq_untokenized", Term("lang", "de"), "SELECT doc_id FROM docs WHERE lang = 'de'")
doc_hits("term_absent", Term("text", "nosuchterm"), has("nosuchterm"))
doc_hits("and_terms", And(Term("text", "the"), Term("text", "and")), f"{has('the')} INTERSECT {has('and')}")
doc_hits("or_terms", Or(Term("text", "apache"), Term("text", "idiot")), f"{has('apache')} UNION {has('idiot')}")
doc_hits("and_empty", And(), "SELECT doc_id FROM docs WHERE false")
doc_hits("nested_and_or", Or(And(Term("text", "the"), Or(Term("text", "idiot"), Term("text", "scum"))), Prefix("text", "lic")), f"({has('the')} INTERSECT ({has('idiot')} UNION {has('scum')})) UNION SELECT DISTINCT doc_id FROM tok WHERE term LIKE 'lic%'")
doc_hits("and_multi_field", And(Term("text", "the"), Term("source", "src3"), Term("lang", "en")), f"{has('the')} INTERSECT SELECT doc_id FROM docs WHERE source = 'src3' AND lang = 'en'")
doc_hits("prefix_term", Prefix("text", "with"), "SELECT DISTINCT doc_id FROM tok WHERE term LIKE 'with%'")
doc_hits("prefix_capped", Prefix("text", "th", 5000), "SELECT DISTINCT doc_id FROM tok JOIN (SELECT term FROM (SELECT term, sum(1 + 9 * count(*)) OVER (ORDER BY term) - (1 + 9 * count(*)) AS used FROM tok WHERE term LIKE 'th%' GROUP BY term) WHERE used < 5000) USING (term)")
doc_hits("not_extension", And(Term("text", "the"), Not(Term("text", "and"))), f"{has('the')} EXCEPT {has('and')}")
doc_hits("number_of_labels", TermU64("toxic", 1), "SELECT doc_id FROM docs WHERE toxic = 1")


@query(f"{WITH} SELECT CASE WHEN (SELECT sum(1 + 9 * n) FROM (SELECT count(*) AS n FROM tok WHERE term LIKE 'th%' GROUP BY term)) > 5000 THEN 18538 ELSE 0 END AS status")
def prefix_cap_status(spark, sf_dir):
    return prefix_status(doc_index(spark, sf_dir).postings({"text"}), Prefix("text", "th", 5000))


@query(f"{ORD} SELECT o_orderkey FROM o WHERE o_custkey = 7")
def term_eq_numeric(spark, sf_dir):
    return plain(order_index(spark, sf_dir).hits(TermU64("o_custkey", 7)).select("doc_id")).withColumnRenamed("doc_id", "o_orderkey")


@query(f"{WITH} SELECT doc_id, CASE WHEN doc_id IN ({has('scum')}) THEN 'text' ELSE 'lang' END AS match_field FROM docs WHERE lang = 'fr' OR doc_id IN ({has('scum')})")
def matched_field(spark, sf_dir):
    q = Or(Term("text", "scum"), Term("lang", "fr"))
    return plain(doc_index(spark, sf_dir).hits(q).select("doc_id", "match_field"))


SUFFIX = f"terms AS (SELECT p_partkey, unnest({WORDS.format('p_name')}) AS t FROM part), suf AS (SELECT DISTINCT p_partkey, unnest(CASE WHEN strlen(t) <= 64 THEN list_filter(list_transform(range(1, length(t) + 1), lambda i: substr(t, i)), lambda s: strlen(s) >= least(5, strlen(t))) ELSE [t] END) AS term FROM terms)"


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part").withColumn("doc_id", F.col("p_partkey") + 1)


@query(f"WITH {SUFFIX} SELECT p_partkey, term FROM suf")
def suffix_postings(spark, sf_dir):
    return ix.postings(parts(spark, sf_dir), PARTS).select((F.col("doc_id") - 1).alias("p_partkey"), "term")


@query(f"WITH {SUFFIX} SELECT DISTINCT p_partkey FROM suf WHERE starts_with(term, 'art')")
def fuzzy_infix(spark, sf_dir):
    return Index.of(parts(spark, sf_dir), PARTS).hits(Prefix("p_name", "art")).select((F.col("doc_id") - 1).alias("p_partkey"))


CITED = f"WITH {SUFFIX.replace('p_partkey', 'doc_id').replace('p_name', 'text').replace('FROM part)', 'FROM documents)')}"


@query(f"{CITED} SELECT DISTINCT doc_id FROM suf WHERE starts_with(term, 'icense')")
def fuzzy_infix_hits(spark, sf_dir):
    """Words that hold `icense` behind their beginning, at least."""
    spec = IndexSpec((FieldSpec("text", suffix=True),))
    return plain(stored_index(spark, sf_dir, spec, documents, "documents", "labels").hits(Prefix("text", "icense")).select("doc_id"))


@query(f"{WITH} {has('the')} INTERSECT {has('and')} INTERSECT {has('of')}")
def text_query_terms(spark, sf_dir):
    """A text becomes the conjunction of its terms."""
    return plain(doc_index(spark, sf_dir).hits(text_query("text", "The AND of; the")).select("doc_id"))


@query(f"{ORD} SELECT o_orderkey FROM o WHERE o_custkey % 4294967296 = 11")
def term_eq_u32(spark, sf_dir):
    """A number of 32 bits is another term than the same one of 64."""
    spec = IndexSpec((FieldSpec("o_custkey", "u32"),))
    own = Index.of(orders(spark, sf_dir), spec)
    return plain(own.hits(Or(TermU32("o_custkey", 11), TermU64("o_custkey", 7))).select("doc_id")).withColumnRenamed("doc_id", "o_orderkey")


@query(f"{WITH} SELECT doc_id, lang, n_chars, 0 AS status FROM docs WHERE doc_id IN ({has('license')})")
def fetch_doc_values(spark, sf_dir):
    """Hits with their doc values."""
    own = doc_index(spark, sf_dir)
    return plain(own.fetch(own.hits(Term("text", "license")).select("doc_id"), "doc_values").select("doc_id", "lang", "n_chars", "status"))


@query("SELECT doc_id, md5(term) AS term FROM (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(text, '[ \t\r]+'), lambda x: x <> ''))) AS term FROM documents)")
def analyzer_whitespace(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(an.whitespace(F.col("text"))).alias("t")).select("doc_id", F.md5("t").alias("term"))


@query(f"SELECT page_id, unnest({WORDS.format('html')}) AS term FROM pages")
def analyzer_word(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(an.word(F.col("html"))).alias("term"))


@query(f"SELECT doc_id, md5(translate(text, '{UPPER}', '{LOWER}')) AS digest FROM documents")
def ascii_lower(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(an.ascii_lower(F.col("text"))).alias("digest"))


@query(f"WITH {TOK[:-2]} SELECT term, count(*) AS df FROM tok GROUP BY term")
def postings_df(spark, sf_dir):
    spec = IndexSpec((FieldSpec("text"),))
    own = ix.postings(table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id") + 1), spec)
    return ix.document_frequency(own).select("term", "df")


@query(f"{WITH} SELECT 'text' AS field, 's' AS term_type, term, NULL::BIGINT AS num, doc_id FROM tok UNION ALL SELECT 'lang', 's', lang, NULL, doc_id FROM docs UNION ALL SELECT 'quality', 'u64', NULL, quality, doc_id FROM docs WHERE quality IS NOT NULL")
def export_postings(spark, sf_dir):
    spec = IndexSpec((FieldSpec("text"), FieldSpec("lang", analyzer="whole"), FieldSpec("quality", "u64")))
    return plain(ix.postings(documents(spark, sf_dir), spec))


@query(f"WITH {TOK[:-2]} SELECT term, doc_id FROM (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY doc_id DESC) AS r FROM tok) WHERE r <= 3")
def postings_capped(spark, sf_dir):
    spec = IndexSpec((FieldSpec("text"),))
    return plain(ix.capped(ix.postings(documents(spark, sf_dir, {"text"}), spec), 3).select("term", "doc_id"))


def filtered(name: str, filters: list, sql: str, min_match: int = 0) -> None:
    """Documents with the word `the` that pass filters."""
    QUERIES[name] = lambda spark, sf_dir: plain(doc_index(spark, sf_dir).hits(Term("text", "the"), filters, min_match).select("doc_id"))
    ORACLE_SQL[name] = f"{WITH} SELECT doc_id FROM docs WHERE doc_id IN ({has('the')}) AND coalesce({sql}, false)"


filtered("filter_equal", [Equal("lang", "en"), Equal("quality", 1)], "lang = 'en' AND quality = 1")
filtered("filter_not_equal", [NotEqual("quality", 1)], "quality <> 1")
filtered("filter_range", [Range("n_chars", 500, 2000)], "n_chars BETWEEN 500 AND 2000")
filtered("filter_contains", [Contains("text", "scum")], "contains(text, 'scum')")
filtered("filter_not_contains", [NotContains("text", "th")], "NOT contains(text, 'th')")
filtered("filter_in_list", [InList("n_chars", tuple(range(100, 1000, 3)))], "n_chars BETWEEN 100 AND 999 AND n_chars % 3 = 1")
filtered("filter_not_in_list", [NotInList("quality", (0, 5))], "quality NOT IN (0, 5)")
filtered("filter_match_list", [MatchStrings("text", ("the", "scum", "idiot"), least=2)], "(contains(text, 'the')::INT + contains(text, 'scum')::INT + contains(text, 'idiot')::INT) >= 2")
filtered("filter_match_list_revert", [MatchStrings("text", ("and", "of"), revert=True)], "NOT (contains(text, 'and') AND contains(text, 'of'))")
filtered("filter_min_match", [Equal("quality", 1), Equal("toxic", 0), Range("n_chars", 0, 1000)], "coalesce(quality = 1, false)::INT + coalesce(toxic = 0, false)::INT + (n_chars <= 1000)::INT >= 2", 2)
filtered("filter_absent_field", [NotEqual("nosuchfield", 1)], "false")
filtered("filter_wrong_class", [Equal("n_chars", "en")], "false")


def sorted_orders(name: str, keys: list, by: str, offset: int = 0, limit: int = 50) -> None:
    """Orders with status F in an order; rank keeps it."""

    def run(spark, sf_dir):
        own = order_index(spark, sf_dir).search(Term("o_orderstatus", "F"), offset, limit, sort=keys)
        return plain(own).select("rank", F.col("doc_id").alias("o_orderkey"))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"{ORD} SELECT row_number() OVER (ORDER BY {by})::INT AS rank, o_orderkey FROM (SELECT * FROM o WHERE o_orderstatus = 'F' ORDER BY {by} LIMIT {limit} OFFSET {offset})"


sorted_orders("sort_numeric_desc", [SortKey("total")], "total DESC, id DESC")
sorted_orders("sort_numeric_asc", [SortKey("total", False)], "total, id DESC")
sorted_orders("sort_string_asc", [SortKey("o_orderpriority", False)], "o_orderpriority, id DESC")
sorted_orders("sort_multi_key", [SortKey("o_orderpriority"), SortKey("total", False)], "o_orderpriority DESC, total, id DESC")
sorted_orders("default_order_topn", [], "id DESC", limit=20)
sorted_orders("offset_limit", [SortKey("o_custkey", False)], "o_custkey, id DESC", offset=30, limit=25)


def sorted_docs(name: str, desc: bool) -> None:
    by = "quality DESC NULLS LAST, CASE WHEN quality IS NULL THEN id END DESC, id DESC" if desc else "quality NULLS FIRST, CASE WHEN quality IS NULL THEN id END, id DESC"

    def run(spark, sf_dir):
        own = doc_index(spark, sf_dir).search(Term("lang", "en"), 0, 400, sort=[SortKey("quality", desc)])
        return plain(own).select("rank", "doc_id")

    QUERIES[name] = run
    ORACLE_SQL[name] = f"{WITH} SELECT row_number() OVER (ORDER BY {by})::INT AS rank, doc_id FROM (SELECT * FROM docs WHERE lang = 'en' ORDER BY {by} LIMIT 400)"


sorted_docs("sort_missing_desc", True)
sorted_docs("sort_missing_asc", False)


@query(f"{WITH} SELECT row_number() OVER (ORDER BY doc_id DESC)::INT AS rank, doc_id, (SELECT count(*) FROM tok WHERE term = 'the') AS total FROM (SELECT doc_id FROM tok WHERE term = 'the' ORDER BY doc_id DESC LIMIT 5)")
def match_total_count(spark, sf_dir):
    own = doc_index(spark, sf_dir).search(Term("text", "the"), limit=5, with_total=True)
    return plain(own).select("rank", "doc_id", "total")


@query(f"{WITH} SELECT doc_id FROM (SELECT * FROM docs WHERE doc_id IN ({has('the')}) ORDER BY id DESC LIMIT 101) WHERE coalesce(quality = 1, false)")
def candidate_cap(spark, sf_dir):
    return plain(doc_index(spark, sf_dir).hits(Term("text", "the"), [Equal("quality", 1)], limits=CompatLimits(candidates=100)).select("doc_id"))


SCORED = f"{WITH}, c AS (SELECT id, doc_id, n_chars, CASE WHEN contains(text, 'scum') THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END + 10.0::DOUBLE * (2.0::DOUBLE / len({WORDS.format('text')})) AS score, row_number() OVER (ORDER BY id DESC) - 1 AS r FROM docs WHERE doc_id IN ({has('the')}))"


def scored(name: str, sort: list, by: str, bound: int | None = None) -> None:
    """Hits of `the` chosen by score, ten after the first five."""

    def run(spark, sf_dir):
        own = doc_index(spark, sf_dir).search(Term("text", "the"), 5, 10, sort=sort, scores=[StringScore("scum", 2, "text")], max_score_docs=bound, limits=CompatLimits(batch=50))
        return plain(own).select("rank", "doc_id", F.round("score", 9).alias("score"))

    QUERIES[name] = run
    admit = f"WHERE (r // 50) * 50 < {max(bound, 15)}" if bound is not None else ""
    ORACLE_SQL[name] = f"{SCORED} SELECT row_number() OVER (ORDER BY {by})::INT AS rank, doc_id, round(score, 9) AS score FROM (SELECT * FROM c {admit} ORDER BY score DESC, id DESC LIMIT 10 OFFSET 5)"


scored("rerank_string", [], "id DESC")
scored("rerank_then_sort", [SortKey("n_chars", False)], "n_chars, id DESC")
scored("rerank_bounded", [], "id DESC", 120)

@query(f"{WITH}, c AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS r FROM tok WHERE term = 'the'), k AS (SELECT doc_id, (r - 1) // 40 AS batch FROM c WHERE r <= 200), h AS (SELECT k.*, row_number() OVER (ORDER BY doc_id DESC) AS n FROM k JOIN docs USING (doc_id) WHERE lang = 'en'), s AS (SELECT doc_id FROM h WHERE batch <= (SELECT max(batch) FROM h WHERE n <= 60)) SELECT row_number() OVER (ORDER BY doc_id DESC)::INT AS rank, doc_id FROM (SELECT doc_id, CASE WHEN contains(text, 'scum') THEN 10.0 ELSE 0.0 END + 20.0 / len({WORDS.format('text')}) AS score FROM s JOIN docs USING (doc_id) ORDER BY score DESC, doc_id DESC LIMIT 30)")
def rerank_capped_bounded(spark, sf_dir):
    """Batches count the candidates that the posting cap leaves."""
    own = doc_index(spark, sf_dir).search(Term("text", "the"), 0, 30, [Equal("lang", "en")], scores=[StringScore("scum", 2, "text")], max_score_docs=60, limits=CompatLimits(postings_per_term=200, batch=40))
    return plain(own).select("rank", "doc_id")


EV = "WITH old AS (SELECT event_id, event_type, user_id, floor(value * 10)::BIGINT AS cents FROM events WHERE event_id % 3 <> 1), new AS (SELECT event_id, event_type, user_id, floor(value * 100)::BIGINT AS cents FROM events WHERE event_id % 3 <> 2)"


def written(spark, sf_dir, mode: str, change: Callable | None = None):
    old, new = events(spark, sf_dir, 1), events(spark, sf_dir, 2)
    return getattr(writer, mode)(old, change(new) if change else new, EVENTS)


def back(df: DataFrame) -> DataFrame:
    return df.withColumn("event_id", F.col("doc_id") - 1).drop("doc_id")


@query(f"{EV} SELECT event_id, CASE WHEN event_id IN (SELECT event_id FROM old) THEN 18526 ELSE 18533 END AS status FROM new")
def write_add_status(spark, sf_dir):
    return back(written(spark, sf_dir, "add").statuses)


@query(f"{EV} SELECT * FROM old UNION ALL SELECT * FROM new WHERE event_id % 3 = 1")
def write_add(spark, sf_dir):
    """Only new documents: the batch is added."""
    return back(written(spark, sf_dir, "add", lambda n: n.where("(doc_id - 1) % 3 = 1")).docs)


@query(f"{EV} SELECT event_id, 0 AS status FROM new WHERE event_id % 3 = 1")
def write_add_fresh_status(spark, sf_dir):
    return back(written(spark, sf_dir, "add", lambda n: n.where("(doc_id - 1) % 3 = 1")).statuses)


@query(f"{EV} SELECT event_id, CASE WHEN event_id = 0 THEN 18530 ELSE 18533 END AS status FROM (SELECT event_id FROM new UNION SELECT 0)")
def write_id_zero_status(spark, sf_dir):
    """An id of 0 fails the batch."""
    old, new = events(spark, sf_dir, 1), events(spark, sf_dir, 2).where("doc_id <> 1").unionByName(events(spark, sf_dir, 2).limit(1).withColumn("doc_id", F.lit(0).cast("long")))
    return writer.replace(old, new, EVENTS).statuses.select(F.greatest(F.col("doc_id") - 1, F.lit(0)).alias("event_id"), "status")


@query(f"{EV} SELECT event_id, 18537 AS status FROM new")
def write_too_large_status(spark, sf_dir):
    return back(writer.upsert(events(spark, sf_dir, 1), events(spark, sf_dir, 2), EVENTS, 1000).statuses)


@query(f"{EV} SELECT event_id, CASE WHEN event_id IN (SELECT event_id FROM old) THEN 18533 ELSE 18527 END AS status FROM new")
def write_update_status(spark, sf_dir):
    return back(written(spark, sf_dir, "update").statuses)


@query(f"{EV} SELECT o.event_id, o.event_type, o.user_id, coalesce(n.cents, o.cents) AS cents FROM old o LEFT JOIN (SELECT * FROM new WHERE event_id % 3 = 0) n USING (event_id)")
def write_update_merge(spark, sf_dir):
    return back(written(spark, sf_dir, "update", lambda n: n.where("(doc_id - 1) % 3 = 0").select("doc_id", "cents")).docs)


@query(f"{EV} SELECT event_id, coalesce(n.event_type, o.event_type) AS event_type, o.user_id, coalesce(n.cents, o.cents) AS cents FROM old o FULL JOIN new n USING (event_id)")
def write_upsert(spark, sf_dir):
    return back(written(spark, sf_dir, "upsert", lambda n: n.drop("user_id")).docs)


@query(f"{EV} SELECT event_id, CASE WHEN n.event_id IS NULL THEN o.event_type END AS event_type, CASE WHEN n.event_id IS NULL THEN o.user_id END AS user_id, CASE WHEN n.event_id IS NULL THEN o.cents ELSE n.cents END AS cents FROM old o FULL JOIN new n USING (event_id)")
def write_replace(spark, sf_dir):
    return back(written(spark, sf_dir, "replace", lambda n: n.select("doc_id", "cents")).docs)


@query(f"{EV} SELECT * FROM old WHERE event_id NOT IN (SELECT event_id FROM new)")
def write_delete(spark, sf_dir):
    return back(written(spark, sf_dir, "delete").docs)


@query(f"{EV} SELECT event_id, CASE WHEN event_id IN (SELECT event_id FROM old) THEN 0 ELSE 18527 END AS status FROM new")
def write_delete_status(spark, sf_dir):
    return back(written(spark, sf_dir, "delete").statuses)


@query(f"{EV} SELECT * FROM old")
def write_batch_atomic(spark, sf_dir):
    return back(written(spark, sf_dir, "add").docs)



@query(f"{EV} SELECT *, 'cents' AS field, 0 AS state FROM (SELECT event_id, cents AS num FROM new WHERE event_id % 3 = 0 EXCEPT SELECT event_id, cents FROM old) UNION ALL SELECT *, 'cents', 1 FROM (SELECT event_id, cents AS num FROM old WHERE event_id % 3 = 0 EXCEPT SELECT event_id, cents FROM new)")
def posting_diff(spark, sf_dir):
    """Only the changed field's terms differ."""
    own = written(spark, sf_dir, "update", lambda n: n.where("(doc_id - 1) % 3 = 0").select("doc_id", "cents")).delta
    return back(own.select("doc_id", "num", "field", "state"))


@query(f"{EV} SELECT event_id, 'event_type' AS field, event_type AS term, NULL::BIGINT AS num FROM (SELECT event_id, event_type FROM old UNION SELECT event_id, event_type FROM new) UNION ALL SELECT event_id, 'user_id', NULL, user_id FROM (SELECT event_id, user_id FROM old UNION SELECT event_id, user_id FROM new) UNION ALL SELECT event_id, 'cents', NULL, coalesce(n.cents, o.cents) FROM old o FULL JOIN new n USING (event_id)")
def posting_fold(spark, sf_dir):
    first = ix.postings(events(spark, sf_dir, 1), EVENTS).withColumn("state", F.lit(0))
    changes = store.write_batches([("first", first), ("second", written(spark, sf_dir, "upsert").delta)])
    return back(writer.fold(changes).select("doc_id", "field", "term", "num"))


@query(f"{EV}, e AS (SELECT * FROM old UNION ALL SELECT * FROM new) SELECT event_id, 'cents' AS field, NULL AS term, cents AS num FROM e UNION SELECT event_id, 'user_id', NULL, user_id FROM e UNION SELECT event_id, 'event_type', event_type, NULL FROM e")
def append_keeps_stale(spark, sf_dir):
    """Postings of what was overwritten stay, in every field."""
    first = ix.postings(events(spark, sf_dir, 1), EVENTS).withColumn("state", F.lit(0))
    changes = store.write_batches([("first", first), ("second", written(spark, sf_dir, "append").delta)])
    return back(writer.fold(changes).select("doc_id", "field", "term", "num"))


@query(f"{EV} SELECT event_id, event_type AS term FROM old WHERE NOT (event_type >= 'c' AND event_type < 'q')")
def buffer_delete_range(spark, sf_dir):
    """A range of a field's terms is deleted."""
    spec = IndexSpec((FieldSpec("event_type", analyzer="whole"),))
    own = ix.postings(events(spark, sf_dir, 1), spec)
    changes = store.write_batches([("first", own.withColumn("state", F.lit(0)))])
    return back(writer.fold(changes.unionByName(store.delete_range(own, "event_type", "c", "q", 1))).select("doc_id", "term"))


@query("SELECT count(*) AS kv_count, sum(strlen('event_type') + 1 + strlen(event_type) + strlen((event_id + 1)::VARCHAR) + 1)::BIGINT AS data_size FROM events WHERE event_id % 3 <> 1")
def buffer_size(spark, sf_dir):
    """How many changes a write buffer holds, and their bytes: field, kind, term, id and state."""
    own = ix.postings(events(spark, sf_dir, 1), IndexSpec((FieldSpec("event_type", analyzer="whole"),)))
    return store.data_size(own.withColumn("state", F.lit(0)))


@query("WITH k AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS seq FROM customer WHERE c_custkey % 2 = 0) SELECT c_name AS user_id, coalesce(k.seq, (SELECT max(seq) FROM k) + count(*) FILTER (WHERE k.seq IS NULL) OVER (ORDER BY c_custkey)) AS seq FROM customer LEFT JOIN k USING (c_custkey)")
def sequence_acquire(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("user_id"), F.col("c_custkey").alias("pos"))
    none = spark.createDataFrame([], "user_id string, seq long")
    return sequence.acquire(sequence.acquire(none, c.where("pos % 2 = 0")), c)


@query("WITH k AS (SELECT c_name, row_number() OVER (ORDER BY c_custkey) AS seq FROM customer WHERE c_custkey % 2 = 0) SELECT c_name AS user_id, k.seq, (SELECT max(seq) FROM k) AS max_seq FROM customer LEFT JOIN k USING (c_name)")
def sequence_current(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("user_id"), F.col("c_custkey").alias("pos"))
    none = spark.createDataFrame([], "user_id string, seq long")
    return sequence.current(sequence.acquire(none, c.where("pos % 2 = 0")), c)


@query("SELECT page_id, url FROM pages WHERE page_id > 40 ORDER BY page_id LIMIT 30")
def scan_page(spark, sf_dir):
    return store.scan_page(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id", 40, 30)


@query("SELECT page_id FROM (SELECT page_id, sum(strlen(html)) OVER (ORDER BY page_id) - strlen(html) AS used FROM (SELECT * FROM pages WHERE page_id > 10 ORDER BY page_id LIMIT 100)) WHERE used < 60000")
def scan_page_bytes(spark, sf_dir):
    return store.scan_page(table(spark, sf_dir, "pages"), "page_id", 10, 100, F.octet_length("html"), 60000).select("page_id")


@query("SELECT DISTINCT n_nationkey::BIGINT AS partition_set FROM nation WHERE n_regionkey = 2 AND n_nationkey > 8 ORDER BY 1 LIMIT 3")
def list_partitions(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("business_type"), F.col("n_nationkey").cast("long").alias("partition_set"))
    return store.list_partitions(rows, 2, 8, 3)


@query("SELECT c_custkey, c_nationkey FROM customer WHERE NOT (c_nationkey = 3 AND c_mktsegment = 'BUILDING')")
def drop_table(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumns({"business_type": F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0), "partition_set": F.col("c_nationkey")})
    return writer.drop_table(rows, 1, 3).select("c_custkey", "c_nationkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey > 20 ORDER BY c_custkey LIMIT 15)")
def delete_page(spark, sf_dir):
    return writer.delete_page(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 20, 15)[0]


@query(f"WITH {TOK[:-2]} SELECT term, doc_id FROM tok UNION SELECT 'bench', item_id FROM benchmark")
def ingest_postings(spark, sf_dir):
    own = ix.postings(table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id") + 1), IndexSpec((FieldSpec("text"),)))
    more = table(spark, sf_dir, "benchmark").select(F.lit("text").alias("field"), F.lit("bench").alias("term"), F.array(F.col("item_id") + 1).alias("doc_ids"))
    return plain(writer.ingest(own, more).select("term", "doc_id"))


@query("SELECT k.item_id AS doc_id, d.lang, CASE WHEN d.doc_id IS NULL THEN 18527 ELSE 0 END AS status FROM (SELECT item_id * 50 AS item_id FROM benchmark) k LEFT JOIN documents d ON d.doc_id = k.item_id")
def fetch_documents(spark, sf_dir):
    ids = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 50 + 1).alias("doc_id"))
    return plain(doc_index(spark, sf_dir).fetch(ids).select("doc_id", "lang", "status"))


@query("SELECT k.item_id AS doc_id, d.n_chars, CASE WHEN d.doc_id IS NULL THEN 18527 ELSE 0 END AS status FROM (SELECT item_id * 50 AS item_id FROM benchmark) k LEFT JOIN documents d ON d.doc_id = k.item_id")
def multi_get(spark, sf_dir):
    ids = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 50).alias("doc_id"))
    return store.multi_get(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ids, "doc_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 900")
def scan_range(spark, sf_dir):
    return store.scan_range(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100, 900)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC)::INT AS place FROM orders WHERE o_orderkey <= 300")
def scan_range_desc(spark, sf_dir):
    own = store.scan_range(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", None, 300, desc=True)
    return own.select("o_orderkey", (F.lit(301) - F.col("o_orderkey")).cast("int").alias("place"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 77")
def point_get(spark, sf_dir):
    return store.get(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 77)


@query("SELECT CASE WHEN value < 1 THEN 0.0::DOUBLE ELSE round(power(2.0, floor(log2(value) + 1e-9)), 6) END AS low, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def timing_histogram(spark, sf_dir):
    """Histograms of two halves as one."""
    own = table(spark, sf_dir, "events")
    halves = [stats.histogram(own.where(F.col("event_id") % 2 == k), "value", 2.0) for k in (0, 1)]
    return stats.merged_histograms(*halves).select(F.round("low", 6).alias("low"), "n")


@query(f"{WITH} SELECT lang AS value, count(*) AS n FROM docs WHERE doc_id IN ({has('the')}) GROUP BY lang")
def facets_extension(spark, sf_dir):
    return doc_index(spark, sf_dir).facets(Term("text", "the"), "lang")


@query("SELECT event_type, count(value) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.8), 6) AS p80, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def timing_summary(spark, sf_dir):
    own = stats.summary(table(spark, sf_dir, "events"), "value", "event_type")
    return own.select("event_type", "n", "least", "most", *(F.round(c, 6).alias(c) for c in ("mean", "deviation", "p50", "p80", "p90")))


FLAGSHIP = f"SELECT row_number() OVER (ORDER BY n_chars DESC, id DESC)::INT AS rank, doc_id FROM (SELECT * FROM docs WHERE doc_id IN ({has('the')} INTERSECT {has('and')}) AND n_chars BETWEEN 200 AND 5000 ORDER BY n_chars DESC, id DESC LIMIT 20)"


@query(f"{WITH} {FLAGSHIP}")
def flagship(spark, sf_dir):
    """Two terms, a range, a sort and a limit."""
    own = doc_index(spark, sf_dir).search(And(Term("text", "the"), Term("text", "and")), 0, 20, [Range("n_chars", 200, 5000)], [SortKey("n_chars")])
    return plain(own).select("rank", "doc_id")
