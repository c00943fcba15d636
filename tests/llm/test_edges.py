"""Odd rows that the operators' other tests leave out: null and repeated keys, very long texts, columns of clashing names."""

import time

import numpy as np
from pyspark.sql import functions as F

from inkwell.llm import common
from inkwell.llm.common import bit_map, components, discard, materialise, may_hold, stars
from inkwell.llm.hnsw import near_vectors
from inkwell.llm.mixing import mix
from inkwell.llm.quotes import reply_order
from inkwell.llm.tokens import digests, token_counts
from inkwell.llm.toxicity import fit, score, severity_grades
from inkwell.sources.shared import CLEANUP


def test_null_and_repeated_keys_of_texts(spark):
    df = spark.createDataFrame([(1, "a b", 7), (1, "a b", 8), (1, "c", 7), (None, "a b", 7), (None, None, 7)], "doc_id long, text string, n_tokens int")
    for f in (digests, token_counts):
        rows = f(df).collect()
        assert sorted((r.doc_id is None, r.n_tokens) for r in rows) == sorted([(False, 2), (False, 2), (False, 1), (True, 2), (True, 0)])


def test_odd_keys_of_vectors(spark):
    a, b = [1.0, 0.0], [0.999, 0.001]
    rows = [(1, a, "1.2", 5), (1, [0.0, 1.0], "1.9", 5), (2, b, "1.2", 5), (3, a, "1.9", 5), (None, a, "1.2", 5), (4, a, None, 5), (5, [1.0, 0.0, 0.0], "1.2", 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, component_id int")
    got = sorted(map(tuple, near_vectors(df).collect()), key=repr)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (None, 0, None, False), (4, 0, 4, True), (5, 0, 5, True)], key=repr)


def test_long_texts(spark):
    long = " ".join(f"word{i % 7919}" for i in range(300_000))
    docs = spark.createDataFrame([(1, long, "s", "en"), (1, long, "s", "en"), (2, "you idiot", "s", "en"), (3, None, None, None), (4, "fine words", "s", "en")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (4, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    rows = score(docs, fit(docs, severity_grades(labels))).collect()
    assert len(rows) == 5 and all(0 <= r.p_toxic <= 1 for r in rows)
    rows = mix(docs).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 2, 2, 300_000, 300_000] and len({r.sampled for r in rows if r.doc_id == 1}) == 1
    quote = "\n".join("> " + long[i : i + 5000] for i in range(0, 400_000, 5001))
    mails = spark.createDataFrame([(1, 0, "u", long), (1, 1, "a", quote + "\nyes"), (1, 2, "u", "> word0 word1 word2 word3\nno")], "conv_id long, turn long, role string, text string")
    assert [(r.turn, r.body, r.reply_to) for r in reply_order(mails).collect()] == [(0, long, None), (1, "yes", 0), (2, "no", 0)]


def test_components_of_stars_and_chains(spark):
    edges = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(400), 0) | dict.fromkeys(range(1000, 1101), 1000) | {5000: 5000}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_bit_maps_hold_what_is_in_them(spark):
    h = spark.range(2000).select(F.xxhash64("id").alias("h"))
    own = np.array([r.h for r in h.collect()])
    bits = bit_map(h, "h")
    assert may_hold(bits, own).all() and may_hold(bits, own ^ 0x5555555555555555).mean() < 0.01
    assert not may_hold(bit_map(h.limit(0), "h"), own).any()


def test_only_own_tables_are_deleted(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/user")
    user, own = spark.read.parquet(f"{tmp_path}/user"), materialise(spark.range(3), "t")
    discard(user, own)
    assert user.count() == 3 and spark.read.parquet(f"{tmp_path}/user").count() == 3


def test_written_steps_leave_no_shuffle_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(found.size()) if (n := found.apply(i).getName()).startswith("shuffle_")}

    setting, was = spark.conf.get(CLEANUP, "false"), files()
    own = materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "t")
    end = time.time() + 20  # they are deleted in the background
    while files() - was and time.time() < end:
        time.sleep(0.1)
    assert not files() - was and spark.conf.get(CLEANUP, "false") == setting
    assert own.count() == 7


def test_stars_join_what_edges_join(spark):
    edges = [(0, i) for i in range(1, 50)] + [(i + 1, i) for i in range(100, 150)] + [(200, 200)]
    rows = stars(spark.createDataFrame(edges, "a long, b long").coalesce(1)).collect()
    assert {(r.a, r.b) for r in rows} == {(i, 0) for i in range(1, 50)} | {(i, 100) for i in range(101, 151)}


def test_components_make_no_row_for_parts_of_nodes(spark, monkeypatch):
    """Rows are in proportion to edges: only the nodes' own step explodes anything."""
    plans, plain = [], common.materialise
    monkeypatch.setattr(common, "materialise", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or plain(df, name))
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 200)], "a long, b long")
    found = {r.node: r.component for r in common.components(edges).collect()}
    assert found == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 300)}
    assert any(name == "cc-step" for name, _ in plans) and not any("Generate" in p for name, p in plans if name != "cc-nodes")
