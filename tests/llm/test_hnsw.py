import numpy as np

from inkwell.llm.hnsw import near_vectors

from .brute import smallest_reachable


def expect(rows):
    ids = [r[0] for r in rows]
    good = [(i, np.array(e, float), lab) for i, e, lab in rows if lab is not None and e is not None and None not in e and len(e) and np.isfinite(np.array(e, float)).all() and np.any(np.array(e, float))]
    pairs = []
    for lab in {g[2] for g in good}:
        own = [g for g in good if g[2] == lab]
        m = np.array([g[1] / np.sqrt(g[1] @ g[1]) for g in own])
        a, b = np.nonzero(np.triu(m @ m.T >= 0.98, 1))
        pairs += [(own[x][0], own[y][0]) for x, y in zip(a, b)]
    root = smallest_reachable(ids, pairs)
    n = {i: 0 for i in ids}
    for p in pairs:
        for x in p:
            n[x] += 1
    return {i: (n[i], root[i], root[i] == i) for i in ids}


def test_groups_shards_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=32).astype(np.float32).tolist(), i % 2) for i in range(9000)]  # two shards and more of a label
    for c in range(40):
        centre = rng.normal(size=32)
        for _ in range(10 if c else 300):
            rows.append((len(rows), (centre + rng.normal(size=32) * 0.05).astype(np.float32).tolist(), c % 2))
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 32, 0), (n + 2, [float("nan")] * 32, 0), (n + 3, rows[-1][1], None), (n + 4, [None] * 32, 1), (n + 5, [], 1), (n + 6, rows[-1][1], 77)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()}
    want = expect(rows)
    assert len(got) == len(rows)
    assert sum(v[0] for v in got.values()) >= 0.98 * sum(v[0] for v in want.values())
    assert all(got[i][0] <= want[i][0] for i in got)  # none below the threshold
    assert sum(got[i][1] == want[i][1] for i in got) >= 0.995 * len(got)
    assert near_vectors(df.limit(0)).collect() == []
