import numpy as np
from pyspark.sql import functions as F

from inkwell.llm.mixing import cell_weights, mix
from inkwell.llm.quotes import reply_order
from inkwell.llm.toxicity import fit, fit_ordinal, score, severity_grades


def test_ordinal_weights_are_found_again():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 5)) < 0.4
    w, theta = np.array([2.0, -1.0, 0.5, 0, 1.5]), np.array([0.5, 2.5])
    latent = x @ w + rng.logistic(size=4000)
    row, col = np.nonzero(x)
    got, cuts = fit_ordinal(row, col, np.ones(len(row)), (latent[:, None] > theta).sum(1), 5, ridge=0, steps=1500)
    assert np.abs(got - w).max() < 0.25
    assert np.abs(cuts - theta).max() < 0.25


def test_held_out_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = fit(docs, severity_grades(labels.where("doc_id % 2 = 0")))
    held = score(docs.join(labels.where("doc_id % 2 = 1").select("doc_id", F.col("toxic").alias("truth")), "doc_id"), model)
    n = {(r.truth, r.toxic): r["count"] for r in held.groupBy("truth", "toxic").count().collect()}
    assert n[1, True] >= 0.8 * (n[1, True] + n.get((1, False), 0))
    assert n.get((0, True), 0) <= 0.015 * n[0, False]


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "you idiot", 5), (2, None, 5), (2, "", 5), (None, "fine", 5)], "doc_id long, text string, grade int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r.severity, r.grade, r.toxic) for r in score(docs, fit(docs, severity_grades(none))).collect()] == [(0.0, 0, False)] * 4
    odd = spark.createDataFrame([(1, 1, 1), (1, 0, 1), (2, 1, 0), (None, 1, 1), (9, 1, None)], "doc_id long, quality int, toxic int")
    assert {tuple(r) for r in severity_grades(odd).collect()} == {(1, 2), (2, 0)}
    assert score(docs.limit(0), fit(docs, severity_grades(odd))).collect() == []


def test_toxicity_without_telling_words(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "three four"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    rows = score(docs, fit(docs, severity_grades(labels))).collect()
    assert len({r.p_toxic for r in rows}) == 1 and abs(rows[0].p_toxic - 1 / 3) < 0.01


def test_raked_marginals(spark, mid):
    docs = spark.read.parquet(f"{mid}/documents.parquet")
    goal = {"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}
    out = mix(docs, targets=goal)
    by = {r.lang: r.t for r in out.groupBy("lang").agg(F.sum(F.col("n_tokens") * F.col("weight")).alias("t")).collect()}
    total = sum(by.values())
    assert all(abs(by[k] / total - v) < 1e-4 for k, v in goal["lang"].items())
    part, most = out.agg(F.sum(F.col("n_tokens") * F.col("probability")) / F.sum("n_tokens"), F.max("probability")).first()
    assert abs(part - 0.5) < 1e-6 and most <= 1
    drawn = out.where("sampled").count()
    assert abs(drawn - out.agg(F.sum("probability")).first()[0]) < 5 * drawn**0.5


def test_mix_against_a_plain_version(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("topic", F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b"))
    goal = {"topic": {"a": 0.5, "b": 0.5}}
    rows = mix(docs, targets=goal).withColumn("draw", F.shiftrightunsigned(F.xxhash64(F.lit(17), "doc_id"), 11) / F.lit(float(1 << 53))).collect()
    cells = {}
    for r in rows:
        assert r.n_tokens == max(1, len([x for x in __import__("re").split(r"[ \t\n\x0b\f\r]+", r.text) if x]))
        key = (r.source, r.lang, r.topic)
        cells[key] = cells.get(key, 0) + r.n_tokens
    total, w, want = sum(cells.values()), dict.fromkeys(cells, 1.0), []
    for m in range(3):
        own = {}
        for k, n in cells.items():
            own[k[m]] = own.get(k[m], 0) + n
        raw = goal["topic"] if m == 2 else {v: (n / total) ** 0.7 for v, n in own.items()}
        want.append({v: x / sum(raw.values()) for v, x in raw.items()})
    for _ in range(2000):
        for m in range(3):
            mass = {}
            for k, n in cells.items():
                mass[k[m]] = mass.get(k[m], 0) + w[k] * n
            w = {k: x * want[m][k[m]] * total / mass[k[m]] for k, x in w.items()}
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(1, mid * w[k]) * n for k, n in cells.items()) < 0.5 * total else (low, mid)
    for r in rows:
        k = (r.source, r.lang, r.topic)
        assert abs(r.weight - w[k]) < 1e-6 * max(1, w[k]) and abs(r.probability - min(1, high * w[k])) < 1e-6
        assert r.sampled == (r.draw < r.probability)


def test_given_counts_and_clashing_columns(spark):
    df = spark.createDataFrame([(i, "a b", "s", "en", 10 * i or None, f"c{i}") for i in range(4)], "doc_id long, text string, source string, lang string, n_tokens int, mix_cell string")
    out = mix(df, tokens=F.col("n_tokens"), topic=F.lit("t"))
    assert sorted((r.doc_id, r.n_tokens, r.mix_cell) for r in out.collect()) == [(0, 1, "c0"), (1, 10, "c1"), (2, 20, "c2"), (3, 30, "c3")]


def test_large_mixtures_are_raked_as_a_table(spark):
    cells = spark.createDataFrame([(f"{s}{t}", s, "en" if i else None, t, 10 + 7 * i + 3 * j) for i, s in enumerate("ab") for j, t in enumerate("xyz")], "cell string, source string, lang string, topic string, tokens long")
    a, b = ({r.cell: r.probability for r in cell_weights(cells, most=m).collect()} for m in (100, 0))
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a) and len(a) == len(b) == 6


def test_mix_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, None, "x"), (1, None, None, None, "x"), (None, "a b", "s", "en", "x"), (3, "", "s", None, "x")], "doc_id long, text string, source string, lang string, probability string")
    rows = mix(df).collect()
    assert len(rows) == 4 and all(0 < r.probability <= 1 for r in rows)
    assert mix(df.limit(0)).collect() == []


def test_quotes_are_linked_and_taken_out(spark):
    rows = [(1, 0, "u", "Hello there\nHow are you"), (1, 1, "a", "> How are  YOU\nfine"), (1, 2, "u", "new topic"), (1, 3, "u", "On Monday x wrote:\n> fine\n> > How are you\nGreat"),
            (1, 4, "a", "> never said\n> > new topic\nok"), (1, 5, "u", "> Great\nyes"), (None, 1, "u", "> x"), (2, 0, "u", None), (2, 1, "u", "> Hello there"), (1, 3, "u", "Hello there"), (2, None, "u", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    out = [(r.conv_id, r.turn, r.body, r.reply_to, r.thread, r.depth, r.n_quotes, r.n_linked) for r in reply_order(df).collect()]
    assert [x for x in out if x[0] == 1] == [
        (1, 0, "Hello there\nHow are you", None, 0, 0, 0, 0), (1, 1, "fine", 0, 0, 1, 1, 1), (1, 3, "Great", 1, 0, 2, 2, 2), (1, 3, "Hello there", 1, 0, 2, 2, 2),
        (1, 5, "yes", 3, 0, 3, 1, 1), (1, 2, "new topic", None, 2, 0, 0, 0), (1, 4, "ok", 2, 2, 1, 2, 1)]
    assert (2, 1, "", None, 1, 0, 1, 0) in out and (2, 0, "", None, 0, 0, 0, 0) in out
    assert len(out) == len(rows)
    assert reply_order(df.limit(0)).collect() == []


def test_long_reply_chains(spark):
    df = spark.createDataFrame([(7, i, "u", (f"> line {i - 1}\n" if i else "") + f"line {i}") for i in range(70)], "conv_id long, turn long, role string, text string")
    assert [(r.turn, r.reply_to, r.thread, r.depth) for r in reply_order(df).collect()] == [(i, i - 1 if i else None, 0, i) for i in range(70)]


def test_rewrapped_and_partial_quotes(spark):
    long = "We moved the whole index to the new store last week and nobody has noticed any change since then, which I count as a success for all of us."
    other = "We moved the whole index to the new store but then it failed."
    wrapped = "> We moved the whole index\n> to the NEW store last week and\n>   nobody has noticed any change"
    rows = [(1, 0, "u", other + "\nok then"), (1, 1, "a", long), (1, 2, "u", wrapped + "\nGood"), (1, 3, "a", "> > to the new store last\n> > week and nobody has noticed\n> Good\nFine"), (1, 4, "u", "> count as a success\nyes"), (1, 5, "a", "> ok\nno"),
            *((2, i, "u", (wrapped + "\n" if i % 2 else long + "\n") + f"own {i}") for i in range(300)), (3, 1, "a", wrapped), (3, 2, "u", long)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {(r.conv_id, r.turn): (r.body, r.reply_to, r.n_quotes, r.n_linked) for r in reply_order(df).collect()}
    assert [out[1, i] for i in range(2, 6)] == [("Good", 1, 1, 1), ("Fine", 2, 2, 2), ("yes", 1, 1, 1), ("no", None, 1, 0)]
    assert all(out[2, i] == (f"own {i}", 0, 1, 1) for i in range(1, 300, 2)) and out[3, 1][1:] == (None, 1, 0)
