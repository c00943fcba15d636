import statistics

from pyspark.sql import functions as F

from inkwell.functions import analysis as an
from inkwell.operators import index as ix
from inkwell.operators import sequence, stats, writer
from inkwell.operators.model import CompatLimits, FieldSpec, IndexSpec
from inkwell.operators.query import And, Not, Or, Prefix, Term, TermU32, TermU64, text_query
from inkwell.operators.ranking import SortKey, StringScore
from inkwell.operators.search import Index
from inkwell.sources import store
from inkwell.sources.shared import numbered, ranked, shared_dir
from inkwell.streaming.upserts import upsert_stream

SPEC = IndexSpec((FieldSpec("body"), FieldSpec("size", "u32", store=False), FieldSpec("tags", analyzer="terms", doc_value=False, store=False), FieldSpec("kind", analyzer="whole")))
DOCS = [(1, "one two three", 5, ["x", "y"], "a"), (2, "two three four", 3, None, "b"), (3, "ONE four", None, ["y"], None), (0, "no id", 1, None, None)]


def documents(spark):
    return spark.createDataFrame(DOCS, "doc_id long, body string, size long, tags array<string>, kind string")


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_stored_index_gives_what_a_scan_gives(spark, tmp_path):
    own, kept = Index.of(documents(spark), SPEC), store.Store(spark, f"file://{tmp_path}/store")
    own.write(kept, "t")
    read = Index.read(kept, "t", SPEC)
    for q, want in ((Term("body", "one"), [1, 3]), (And(Term("body", "two"), TermU32("size", 3)), [2]), (TermU64("size", 3), []), (Or(Term("tags", "y"), Prefix("body", "fo")), [1, 2, 3]), (And(), []), (text_query("body", "Four, THREE"), [2]), (Term("nosuch", "x"), [])):
        assert ids(own.hits(q)) == ids(read.hits(q)) == want
    assert [r.doc_id for r in read.search(Term("body", "two"), sort=[SortKey("size", False)]).orderBy("rank").collect()] == [2, 1]
    # Scored hits are sorted by stored values: size isn't stored, so it is absent.
    scored = read.search(Term("body", "four"), sort=[SortKey("size")], scores=[StringScore("one", 1, "body")])
    assert [r.doc_id for r in scored.orderBy("rank").collect()] == [3, 2]
    assert {(r.doc_id, r.kind, r.status) for r in read.fetch(spark.createDataFrame([(1,), (9,)], "doc_id long"), "doc_values").collect()} == {(1, "a", 0), (9, None, 18527)}
    assert not any("RegExp" in x or "regexp" in x for x in read.hits(Term("body", "one"))._jdf.queryExecution().toString().split("\n"))


def test_store_versions_compaction_and_drop(spark, tmp_path):
    kept = store.Store(spark, f"file://{tmp_path}/store")
    first = ix.postings(documents(spark).where("doc_id > 0"), SPEC).withColumn("state", F.lit(0))
    gone = first.where("doc_id = 1").withColumn("state", F.lit(1))
    assert kept.write("postings", store.write_batches([("a", first)])) == 1
    assert kept.write("postings", store.write_batches([("a", first), ("b", gone)])) == 2
    assert kept.versions("postings") == [1, 2] and kept.read("postings", 1).count() == first.count()
    assert kept.claim("postings") == 3 and kept.claim("postings") == 4 and kept.versions("postings") == [1, 2]
    assert kept.compact(keep=F.col("field") != "kind") == 5
    rows = kept.read("postings")
    assert rows.where("doc_id = 1 OR field = 'kind'").count() == 0 and rows.where("state = 0").count() == rows.count() > 0
    assert store.get(rows, "doc_id", 2).count() == rows.where("doc_id = 2").count()
    both = store.merged([spark.range(0, 10, 2).toDF("k"), spark.range(1, 10, 2).toDF("k")], "k")
    assert [r.k for r in both.collect()] == [*range(10)]
    kept.drop("postings")
    assert kept.versions("postings") == []
    kept.write("other", spark.range(1))
    kept.drop()
    assert kept.versions("other") == []


def test_deltas_of_a_stream(spark, tmp_path):
    spec = IndexSpec((FieldSpec("body"), FieldSpec("size", "u64")))
    kept = store.Store(spark, f"file://{tmp_path}/store")
    kept.write("docs", spark.createDataFrame([(1, "old", 1), (5, "stays", 5)], "doc_id long, body string, size long"))

    def arrive(rows):
        spark.createDataFrame(rows, "doc_id long, body string, size long, seen long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema("doc_id long, body string, size long, seen long").parquet(f"{tmp_path}/in")
        upsert_stream(stream, kept, "docs", spec, f"{tmp_path}/checkpoint", newest="seen").awaitTermination()
        return {tuple(r) for r in kept.documents("docs", ["body", "size"]).collect()}

    arrive([(1, "new", None, 1), (2, "a", 2, 1), (2, "b", 3, 2), (0, "bad", 9, 1), (None, "bad", 9, 1)])
    assert run() == {(1, "new", 1), (2, "b", 3), (5, "stays", 5)}
    arrive([(2, None, 4, 9), (6, "c", 6, 9)])
    assert run() == {(1, "new", 1), (2, "b", 4), (5, "stays", 5), (6, "c", 6)}
    assert kept.documents("docs_rejected", ["body", "status"]).count() == 2
    kept.merge_deltas("docs", ["body", "size"])
    assert run() == {tuple(r) for r in kept.read("docs").collect()} and kept.read("docs").count() == 4


def test_analysis(spark):
    texts = ["Ab.c d-e 1.2. 你好吗 x", "", None, "好", "a\tb\rc\nd b", "dsw,d.w"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name, f in an.ANALYZERS.items():
        for t, got in zip(texts, df.select(f(F.col("t"))).collect(), strict=True):
            assert (got[0] or []) == ([] if t is None else an.query_terms(t, name)), (name, t)
    assert an.query_terms("Ab.c 1.2. 你好吗 好") == ["ab.c", "1.2", "你好", "好吗", "好"]
    got = df.select(an.split_string(F.col("t"), "d,."), an.trim_string(F.lit("--x-"), "-")).collect()[-1]
    assert list(got) == [["sw", "w"], "x"]


def test_numbers_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(7)
    want = sorted((r.k for r in df.collect()), reverse=True)
    assert [(r.k, r.number) for r in numbered(df, F.desc("k"), start=5).orderBy("number").collect()] == [(k, i + 5) for i, k in enumerate(want)]
    assert numbered(df.limit(0), "k").collect() == []
    rows = [(None if i % 5 == 0 else f"k{i % 5 % 2}", i) for i in range(300)]
    want = {(k, i): 1 + sum(k == q and j > i for q, j in rows) for k, i in rows}
    assert {(r.k, r.i): r["rank"] for r in ranked(spark.createDataFrame(rows, "k string, i long").repartition(5), ["k"], F.desc("i")).collect()} == want
    none = spark.createDataFrame([], "user_id string, seq long")
    asked = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 4)], "user_id string, pos long")
    first = sequence.acquire(none, asked.where("pos < 3"))
    assert {tuple(r) for r in sequence.acquire(first, asked).collect()} == {("b", 1), ("a", 2), ("c", 3)}
    assert {tuple(r) for r in sequence.current(none, asked.select("user_id")).collect()} == {("a", None, 0), ("b", None, 0), ("c", None, 0)}


def test_writes_of_odd_batches(spark):
    old, spec = documents(spark).where("doc_id > 0"), SPEC
    twice = writer.upsert(old, old.limit(1).union(old.limit(1)), spec)
    assert twice.failed and [r.status for r in twice.statuses.collect()] == [18533] and twice.docs.count() == 3 and twice.delta.count() == 0
    bad = writer.add(old, documents(spark).where("doc_id = 0"), spec)
    assert bad.failed and [r.status for r in bad.statuses.collect()] == [18530]
    gone = writer.delete(old, spark.createDataFrame([(1,), (7,)], "doc_id long"), spec)
    assert {tuple(r) for r in gone.statuses.collect()} == {(1, 0), (7, 18527)} and ids(gone.docs) == [2, 3]
    assert gone.delta.where("state = 1 AND doc_id = 1").count() == gone.delta.count() == ix.postings(old.where("doc_id = 1"), spec).count()
    blind = IndexSpec((FieldSpec("body", keep_terms=False), FieldSpec("kind", analyzer="whole")))
    delta = writer.replace(old.select("doc_id", "body", "kind"), spark.createDataFrame([(1, "six", "a")], "doc_id long, body string, kind string"), blind).delta
    assert {(r.term, r.state) for r in delta.collect()} == {("six", 0)}


def test_trace_and_figures(spark):
    trace = stats.Trace()
    with trace.timer("search"):
        own = Index.of(documents(spark), SPEC).search(Or(Term("body", "one"), Term("body", "two")), limit=2, trace=trace).collect()
    assert len(own) == 2 and trace.counters() == {"candidates": 3, "hits": 3, "results": 2} and trace.seconds["search"] > 0
    values = [(i % 2, float(i * i % 97)) for i in range(501)] + [(2, 4.0), (3, None), (None, 7.0)]
    df = spark.createDataFrame(values, "k int, v double")
    got = {r.k: r for r in stats.summary(df, "v", "k").collect()}
    for k in (0, 1):
        mine = [v for j, v in values if j == k]
        assert (got[k].n, got[k].p50) == (len(mine), statistics.median(mine)) and abs(got[k].p80 - statistics.quantiles(mine, n=10, method="inclusive")[7]) < 1e-9
    assert got[2].p90 == 4.0 and got[None].p50 == 7.0 and 3 not in got
    assert stats.summary(df, "v").collect()[0].n == 503
    low = stats.histogram(spark.createDataFrame([(0.5,), (1.0,), (1.4,), (1.5,), (None,)], "v double"), "v")
    assert {(round(r.low, 6), r.n) for r in low.collect()} == {(0.0, 1), (1.0, 2), (1.5, 1)}
    assert {(round(r.low, 6), r.n) for r in stats.merged_histograms(low, low).collect()} == {(0.0, 2), (1.0, 4), (1.5, 2)}
    assert abs(stats.histogram_quantile(low, 0.5).first().value - 1.25) < 1e-9


def test_shared_folder_is_required_on_clusters(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_only_asked_fields_are_written(spark, tmp_path):
    seen, kept = [], store.Store(spark, f"file://{tmp_path}/store")
    own = Index.written(kept, "t", SPEC, lambda names: seen.append(set(names)) or documents(spark))
    assert ids(own.hits(And())) == [] and seen == []
    assert ids(own.hits(Term("body", "one"))) == ids(own.hits(Term("body", "one"))) == [1, 3] and seen == [{"body"}]
    tables = [p.name for p in (tmp_path / "store").iterdir()]
    assert tables == ["t_postings_body_word"] and kept.versions(tables[0]) == [1]


def test_suffixes_are_made_of_stored_terms(spark, tmp_path):
    spec = IndexSpec((FieldSpec("body", suffix=True),))
    docs = spark.createDataFrame([(1, "relicense sublicense"), (2, "licenses"), (3, "silence")], "doc_id long, body string")
    own, kept = Index.of(docs, spec), store.Store(spark, f"file://{tmp_path}/store")
    own.write(kept, "t")
    read = Index.read(kept, "t", spec)
    for q in (Prefix("body", "icense"), Term("body", "license"), Prefix("body", "licens", 25), And(Prefix("body", "licen"), Not(Term("body", "icenses")))):
        assert sorted(own.hits(q).collect()) == sorted(read.hits(q).collect()) != []
    assert kept.read("t_postings_body_word").count() == 4  # whole words


def test_scores_shuffle_no_texts(spark):
    rows = Index.of(documents(spark), SPEC).search(Term("body", "four"), scores=[StringScore("one", 1, "body")])
    plan = rows._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joined = next(i for i, x in enumerate(plan) if "Join" in x)
    assert not any("Contains(body" in x for x in plan[:joined]) and any("Contains(body" in x for x in plan[joined:])


def test_caps_rank_the_asked_terms_alone(spark):
    docs = spark.createDataFrame([(i, "all even" if i % 2 == 0 else "all") for i in range(1, 41)], "doc_id long, body string")
    own = ix.capped(ix.postings(docs, IndexSpec((FieldSpec("body"),))), 3)
    assert sorted((r.term, r.doc_id) for r in own.collect()) == [("all", 38), ("all", 39), ("all", 40), ("even", 36), ("even", 38), ("even", 40)]
    assert "WindowGroupLimit" in own._jdf.queryExecution().optimizedPlan().toString()
    assert ids(Index.of(docs, IndexSpec((FieldSpec("body"),))).hits(Term("body", "even"), limits=CompatLimits(postings_per_term=2))) == [38, 40]


def test_ingest_adds_what_is_new(spark):
    own = ix.postings(documents(spark).where("doc_id > 0"), IndexSpec((FieldSpec("body"),)))
    more = spark.createDataFrame([("body", "one", [1, 7, 7]), ("body", "new", [7])], "field string, term string, doc_ids array<long>")
    got = sorted((r.term, r.doc_id) for r in writer.ingest(own, more).collect())
    assert got == sorted({*((r.term, r.doc_id) for r in own.collect()), ("one", 7), ("new", 7)})
    plan = writer.ingest(own, more)._jdf.queryExecution().optimizedPlan().toString().strip().split("\n")
    assert plan[0].startswith("Union")  # what was there is passed on as it is
