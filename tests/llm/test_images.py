import numpy as np
from pyspark.sql import functions as F

from inkwell.llm.common import mix64
from inkwell.llm.images import BITS, CELL_BITS, agreeing, alike_pairs, blur, candidates, checked, copies, features, image_features, op1_image_copies, pack, page_pictures, picture, united, whole_buckets

SCHEMA = "image_id long, height int, width int, pixels binary"


def scene(k, side=64):
    """Boxes over one another, with grain."""
    h = mix64(np.arange(150, dtype=np.uint64) + (np.uint64(k) << np.uint64(8)))
    m = np.full((side, side), 40 + int(h[149] % 100), dtype=np.float64)
    for j in range(24):
        y, x, dy, dx, v = (int(v) for v in h[6 * j : 6 * j + 5] >> np.uint64(20))
        y, x = y % (side - 4), x % (side - 4)
        m[y : y + 4 + dy % 22, x : x + 4 + dx % 22] = v % 256
    m += blur((mix64(np.arange(side * side, dtype=np.uint64) + h[148]) >> np.uint64(59)).astype(np.float64).reshape(1, side, side))[0] * 2
    return np.clip(m, 0, 255).astype(np.uint8)


def placed(m, turn, zoom):
    """The image turned and rescaled about its middle, bilinear."""
    n = int(len(m) * zoom)
    y, x = np.mgrid[:n, :n] - n / 2
    y, x = ((y * np.cos(turn) + x * np.sin(turn)) / zoom + len(m) / 2, (x * np.cos(turn) - y * np.sin(turn)) / zoom + len(m) / 2)
    y, x = np.clip(y, 0, len(m) - 1.01), np.clip(x, 0, len(m) - 1.01)
    y0, x0 = y.astype(int), x.astype(int)
    fy, fx, m = y - y0, x - x0, m.astype(float)
    return (m[y0, x0] * (1 - fx) + m[y0, x0 + 1] * fx) * (1 - fy) + (m[y0 + 1, x0] * (1 - fx) + m[y0 + 1, x0 + 1] * fx) * fy


def boxed(m):
    m = m.copy()
    m[20:34, 24:40] = 128
    return m * 0.8 + 25


RNG = np.random.default_rng(0)
EDITS = {
    "crop": lambda m: m[7:55, 11:59], "noise": lambda m: m + RNG.normal(0, 8, m.shape), "blur": lambda m: blur(m[None].astype(float))[0], "box": boxed, "quarter turn": np.rot90,
    "turn": lambda m: placed(m, 0.35, 1), "enlarged": lambda m: placed(m, 0, 1.5), "a quarter larger": lambda m: placed(m, 0, 1.25), "a fifth smaller": lambda m: placed(m, 0, 0.8),
}


def frame(spark, images):
    return spark.createDataFrame([(i, *m.shape, m.tobytes()) for i, m in images], SCHEMA)


def test_recall_of_edited_images_against_all_pairs(spark):
    own = [(100 * k + e, m if not e else np.clip(list(EDITS.values())[e - 1](m), 0, 255).astype(np.uint8)) for k, m in enumerate(map(scene, range(12))) for e in range(len(EDITS) + 1)]
    group = {r.image_id: r.group_id for r in copies(frame(spark, own)).collect()}
    assert all(g // 100 == i // 100 for i, g in group.items())
    found = {name: sum(group[100 * k + e] == 100 * k for k in range(12)) / 12 for e, name in enumerate(EDITS, 1)}
    assert all(x >= 0.9 for x in found.values()), found
    # Brute force: every pair of images is checked.
    made = [(i, *features(m[None])[0]) for i, m in own]
    links = [(i, j) for x, (i, a, da) in enumerate(made) for j, b, db in made[:x] if agreeing(a, da, b, db)]
    assert all(i // 100 == j // 100 for i, j in links)
    assert sum(group[i] == group[j] for i, j in links) >= 0.98 * len(links)


def test_large_groups_of_copies(spark):
    base = scene(1)
    own = [(i, np.clip(base + RNG.normal(0, 4, base.shape), 0, 255).astype(np.uint8)) for i in range(150)] + [(1000 + i, scene(50 + i)) for i in range(40)]
    df = frame(spark, own)
    group = {r.image_id: r.group_id for r in copies(df).collect()}
    assert sum(group[i] == 0 for i in range(150)) >= 148 and all(group[1000 + i] == 1000 + i for i in range(40))


def test_pairs_grow_with_rows(spark):
    key = np.zeros(5000, np.int64)
    a, b, first = alike_pairs(key, np.arange(5000) << CELL_BITS)
    assert len(a) < 10000 and first == 0 and set((b >> CELL_BITS).tolist()) == set(range(1, 5000))
    rows = spark.createDataFrame([(k << 40, n << CELL_BITS | k) for n in range(300) for k in range(3)], "key long, spot long")
    pairs = {(r.a, r.b) for r in candidates(rows).collect()}
    assert {b for _, b in pairs} == set(range(1, 300)) and len(pairs) <= 600


def test_copies_behind_many_partners(spark, monkeypatch):
    # Every corner of the two copies is in all images, elsewhere there: among the corners' rows others stand between the two.
    rng = np.random.default_rng(7)
    bits = rng.integers(0, 256, (16, BITS // 8), dtype=np.uint8).tobytes()
    places = [np.column_stack([rng.permutation(900)[:16], rng.permutation(900)[:16], np.ones(16), np.zeros(16)]).astype(np.float32) for _ in range(60)]
    places[55] = places[20] + np.array([3, 5, 0, 0], np.float32)
    rows = [(i, pack(at), bits, b"%d" % i) for i, at in enumerate(places)]
    made = spark.createDataFrame(rows, "image_id long, at binary, bits binary, digest binary").coalesce(1)
    monkeypatch.setattr("inkwell.llm.images.image_features", lambda images: images)
    group = {r.image_id: r.group_id for r in copies(made).collect()}
    assert group == {i: 20 if i == 55 else i for i in range(60)}


def test_large_bucket_in_blocks(spark):
    # Two descriptors in 1100 images, each in three blocks: every pair meets once, whatever the table, but for what is united.
    at = pack(np.array([[20, 20, 1, 0], [60, 60, 1, 0]], np.float32))
    rows = spark.createDataFrame([(n, at, bytes(16) + b"\xff" * 16, n // 2) for n in range(1100)], "node long, at binary, bits binary, component long")
    assert whole_buckets(rows).select("a", "b").distinct().count() == whole_buckets(rows).count() == 1100 * 1099 // 2 - 550


def test_few_links_in_a_task(spark, monkeypatch):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 40) if k % 10 < 9], "a long, b long")
    want = {(k, k - k % 10) for k in range(40) if k % 10}
    assert {(r.node, r.component) for r in united(links).collect()} == want
    monkeypatch.setattr("inkwell.llm.images.EDGES", 5)
    assert {(r.node, r.component) for r in united(links).collect()} == want
    monkeypatch.setattr("inkwell.llm.images.EDGES", 36)
    monkeypatch.setattr("inkwell.llm.images.components", None)
    assert united(links).count() == 36 and united(links.limit(0)).count() == 0


def test_pairs_in_blocks(spark, monkeypatch):
    # Every pair is checked once, whatever the blocks: of one image's pairs some are in each.
    made = [(k, *features(m[None])[0]) for k, m in enumerate([scene(x) for x in range(4)] + [boxed(scene(x)).astype(np.uint8) for x in range(4)] + [np.rot90(scene(1))])]
    shown = spark.createDataFrame([(k, pack(at), bits.tobytes()) for k, at, bits in made], "node long, at binary, bits binary")
    pairs = [(i, j) for j in range(9) for i in range(j)]
    want = sorted((i, j) for i, j in pairs if agreeing(*made[i][1:], *made[j][1:]))
    assert len(want) >= 5
    for most in ((4, 2), (1, 1), (100, 100)):
        monkeypatch.setattr("inkwell.llm.images.PAIRS", most[0])
        monkeypatch.setattr("inkwell.llm.images.UNIT", most[1])
        assert sorted((r.a, r.b) for r in checked(spark.createDataFrame(pairs, "a long, b long"), shown).collect()) == want


def test_images_of_few_places_have_no_features(spark):
    few = np.full((24, 24), 90, np.uint8)
    few[10:20, 10:20] = 200
    rows = {r.image_id: r for r in image_features(frame(spark, [(1, few), (2, scene(2))])).collect()}
    assert 0 < len(features(few[None])[0][0]) and rows[1].bits is None and rows[1].digest and rows[2].bits


def test_odd_rows(spark):
    m = scene(3)
    rows = [(5, 64, 64, m.tobytes()), (1000, 64, 64, m.tobytes()), (1001, 64, 64, None), (1002, 64, 64, b"short"), (1003, 8, 8, bytes(64)), (None, 64, 64, m.tobytes()), (None, None, None, None), (7, 64, 64, m.tobytes()), (7, 64, 64, m.tobytes())]
    rows += [(1, 8, 8, b"a" * 64), (2, 8, 8, b"a" * 64), (3, 4, 16, b"a" * 64), (4, 64, 64, bytes(4096)), (6, 64, 64, bytes(4096)), (8, 8, 8, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"node": F.lit("x"), "digest": F.lit(1), "group_id": F.lit(0)})
    got = sorted(((r.image_id, r.group_id, r.n_equal) for r in copies(df).collect()), key=repr)
    assert got == sorted([(5, 5, 2), (1000, 5, 2), (7, 5, 2), (7, 5, 2), (1001, 1001, 0), (1002, 1002, 0), (1003, 1003, 0), (None, None, 0), (None, None, 0), (1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 1), (6, 4, 1), (8, 8, 0)], key=repr)
    assert copies(df.limit(0)).collect() == []


def test_pictures_of_pages(spark):
    assert picture(None).shape == picture("<script>x</script>").shape == (16, 40)
    assert picture("<p>" + "long words " * 5000 + "</p>").shape == (688, 40)
    text = [" ".join(f"w{mix64(np.uint64(977 * i + j)) % 5000}" for j in range(400)) for i in range(12)]
    pages = [(i, f"<html><script>{i}</script><p>{t}</p><p>{text[(i + 1) % 12]}</p></html>") for i, t in enumerate(text)]
    pages += [(100 + i, f"<html><body><h1>News</h1><p>{t.replace('w1', 'v1')}</p><p>{text[(i + 1) % 12]}</p></html>") for i, t in enumerate(text)] + [(None, None), (200, "")]
    made = page_pictures(spark.createDataFrame(pages, "page_id long, html string"))
    assert made.count() == 26
    group = {r.image_id: r.group_id for r in copies(made).collect()}
    assert all(group[100 + i] == group[i] for i in range(12))


def test_query_on_whole_table(spark, small):
    out = op1_image_copies(spark, small)
    assert out.columns == ["image_id", "group_id", "n_equal"] and out.count() == spark.read.parquet(f"{small}/pages.parquet").count()
    assert out.where("group_id > image_id").count() == 0 and BITS == 128
