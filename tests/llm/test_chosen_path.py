import random
from collections import Counter

from inkwell.llm.chosen_path import near_duplicates

from .brute import jaccard_pairs, shingle_set, smallest_reachable

SCHEMA = "doc_id long, text string, n long, class_id string"


def expect(rows):
    texts = dict(rows)
    pairs = jaccard_pairs({k: shingle_set(t) for k, t in texts.items()})
    links = Counter(x for p in pairs for x in p)
    root = smallest_reachable(texts, pairs)
    return {k: (root[k], links[k]) for k in texts}


def result(df):
    rows = near_duplicates(df).collect()
    return {r.doc_id: (r.class_id, r.n_links) for r in rows}, len(rows)


def test_documents_against_brute_force(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    got, n = result(df)
    assert got == expect([(r.doc_id, r.text) for r in df.collect()])
    assert n == df.count()


def test_large_groups_and_odd_rows(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(700):  # near copies of one text, more than a bucket and a block hold
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(120)] = "edit" + str(rng.randrange(1000))
        rows.append((10 + i, " ".join(w)))
    rows += [(2000 + i, "the same five words here again") for i in range(300)]
    rows += [(3000, ""), (3001, None), (3002, "one"), (3003, "ONE"), (3004, "\n \t"), (3005, "w1 " * 50_000)]
    rows += [(4000 + i, " ".join(rng.choice(vocabulary) for _ in range(40))) for i in range(50)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(5)
    got, n = result(df)
    assert got == expect(rows)
    assert n == len(rows)


def test_repeated_ids_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 0, None), (1, "a b c d e f", 0, None), (2, "a b c d e f", 0, None), (None, "a b c d e f", 0, None)], SCHEMA)
    rows = sorted(map(tuple, near_duplicates(df).collect()), key=str)
    assert rows == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (None, None, 0)]
    assert near_duplicates(df.limit(0)).collect() == []
