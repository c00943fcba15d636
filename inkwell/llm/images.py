"""Copies of images by local descriptors.

Multiscale corners get an orientation from their patch's intensity centroid and a 128-bit
descriptor of brightness tests turned by it. Every corner that is the strongest within NEAR pixels
is described, so their number is in proportion to the area and a crop keeps those it shows.
Each Hamming table holds 62 bits of all descriptors, sorted, from another place on: descriptors of one
corner share a long beginning in some table, where they stand close together. A descriptor is joined to
the nearest one before it that is within KEY_RADIUS bits, and to the smallest of its run of such
neighbours, so that rows of pairs grow with the rows, whatever the groups. Pairs of images that met in two places
are checked: matches within RADIUS bits must agree on one similarity transform. That finds cropped, turned, rescaled
and edited copies, and what it unites needs no further comparison. Then no partner is left out: all descriptors of other
groups that share a table's first BUCKET_BITS are compared, in blocks, and pairs of images that meet so in two places
are checked too. Byte-equal images are one by their digest. The pairs that meet, and so the rows of that last step, grow with
the square of the images that share a corner.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import EDGES, components, discard, hold, key_groups, lookup, materialise, stars, with_ids

NEAR = 4
SCALES = (1.0, 1.22, 1.5, 1.84, 2.25)
BITS = 128
#: Orders of the bits: table t begins with bit 32 t. Its number is in a key's upper TABLE_BITS.
TABLES, TABLE_BITS = 4, 2
#: Bits by which the keys of rows that meet, and whole descriptors that match, may differ.
KEY_RADIUS, RADIUS = 7, 20
#: A table's row has an image's number and, in its low bits, which of 64 the square of CELL pixels is that the corner is in.
CELL, CELL_BITS = 8, 6
#: Rows before a row in a table's order that it is compared with.
BACK = 4
#: Rows of a table that are compared at once.
ROWS = 1 << 16
#: First bits of a table that descriptors share to be compared whatever their number, and how many of them a block has at most on average.
BUCKET_BITS, BLOCK = 24, 512
#: Units of up to so many rows are compared together with others, one distance between rows at a time.
FEW = 32
#: Matches that must agree, as a number and as a part of the corners of the image that has fewer; by how many pixels their places may be off.
AGREE = 5
PART = 0.2
OFF = 2.5
#: Each match proposes transforms with so many others; how far a match's own turn and zoom may be from one.
PARTNERS = 12
TURN, ZOOM = 0.4, 1.6
#: About how many pairs of images a block has, and how many of them are of one larger image at most.
PAIRS, UNIT = 2048, 256
#: Matches times transforms that are compared at once.
FITS = 1 << 14
#: An image's number has from this bit on the binary digits of its number of corners, so that the smaller image of a pair comes first.
SIZE_AT, SIZE_MOST = 53, 15
#: Pixels of images that are described at once.
PIXELS = 1 << 19

_rng = np.random.default_rng(20240101)
TESTS = np.clip(_rng.normal(0, 2.6, size=(BITS, 4)), -6, 6).astype(np.float32)
RING = 7
PACKED = np.dtype([("y", "<f4"), ("x", "<f4"), ("scale", "u1"), ("turn", "i1")])


def blur(m: np.ndarray) -> np.ndarray:
    """3 x 3 binomial smoothing of a stack of images."""
    p = np.pad(m, ((0, 0), (1, 1), (0, 0)), mode="edge")
    m = (p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]) / 4
    p = np.pad(m, ((0, 0), (0, 0), (1, 1)), mode="edge")
    return (p[:, :, :-2] + 2 * p[:, :, 1:-1] + p[:, :, 2:]) / 4


def shrink(m: np.ndarray, scale: float) -> np.ndarray:
    """The stack at a coarser scale, by bilinear sampling."""
    h, w = (max(1, int(s / scale)) for s in m.shape[1:])
    y, x = ((np.arange(n) + 0.5) * scale - 0.5 for n in (h, w))
    y0, x0 = np.clip(y.astype(int), 0, m.shape[1] - 2), np.clip(x.astype(int), 0, m.shape[2] - 2)
    fy, fx = (y - y0).astype(m.dtype)[None, :, None], (x - x0).astype(m.dtype)[None, None, :]
    rows = m[:, y0] * (1 - fy) + m[:, y0 + 1] * fy
    return rows[:, :, x0] * (1 - fx) + rows[:, :, x0 + 1] * fx


def highest(m: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """The largest value within `reach` places along an axis."""
    out, width = np.pad(m, [(reach, reach) if k == axis else (0, 0) for k in range(3)], constant_values=-np.inf), 1
    cut = lambda a, b: tuple(slice(a, b) if k == axis else slice(None) for k in range(3))
    while width < 2 * reach + 1:
        step = min(width, 2 * reach + 1 - width)
        out = np.maximum(out[cut(None, -step)], out[cut(step, None)])
        width += step
    return out


def corners(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, y, x) of local maxima of the Harris response, away from the border."""
    gy, gx = np.gradient(m, axis=(1, 2))
    a, b, c = blur(gy * gy), blur(gx * gx), blur(gy * gx)
    r = a * b - c * c - np.float32(0.05) * (a + b) ** 2
    r[:, :RING] = r[:, -RING:] = 0
    r[:, :, :RING] = r[:, :, -RING:] = 0
    return np.nonzero((r > 1.0) & (r >= highest(highest(r, NEAR, 1), NEAR, 2)))


def describe(m: np.ndarray, i: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(angle, descriptor bits) of corners of a smoothed stack."""
    flat, width = np.ascontiguousarray(m).ravel(), m.shape[2]
    at = (i * m.shape[1] + y) * width + x
    o = np.arange(-RING + 1, RING)
    dy, dx = np.meshgrid(o, o, indexing="ij")
    disc = dy**2 + dx**2 < RING**2
    dy, dx = dy[disc], dx[disc]
    patch = flat[at[:, None] + (dy * width + dx)]
    angle = np.arctan2(patch @ dy.astype(np.float32), patch @ dx.astype(np.float32))
    cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
    value = []
    for k in (0, 2):
        ty, tx = TESTS[None, :, k], TESTS[None, :, k + 1]
        # A test's place is RING - 1 pixels off at most, so it is inside.
        ry = np.rint(np.clip(ty * cos + tx * sin, 1 - RING, RING - 1)).astype(np.int32)
        rx = np.rint(np.clip(tx * cos - ty * sin, 1 - RING, RING - 1)).astype(np.int32)
        value.append(flat[at[:, None] + (ry * width + rx)])
    return angle, value[0] < value[1]


def features(stack: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each image of a stack of one size: (y, x, scale, angle) and packed descriptors of its corners."""
    found = []
    base = blur(stack.astype(np.float32))
    for scale in SCALES:
        m = base if scale == 1 else blur(shrink(base, scale))
        if min(m.shape[1:]) > 2 * RING:
            found.append((m, scale, *corners(m)))
    if not found:
        return [(np.zeros((0, 4), np.float32), np.zeros((0, BITS // 8), np.uint8))] * len(stack)
    level = np.concatenate([np.full(len(f[2]), k) for k, f in enumerate(found)])
    i, y, x = (np.concatenate([f[c] for f in found]) for c in (2, 3, 4))
    order = np.argsort(i, kind="stable")
    i, y, x, level = i[order], y[order], x[order], level[order]
    at, bits = np.zeros((len(i), 4), np.float32), np.zeros((len(i), BITS), dtype=bool)
    for k, (m, scale, *_) in enumerate(found):
        here = level == k
        angle, bits[here] = describe(m, i[here], y[here], x[here])
        at[here] = np.stack([(y[here] + 0.5) * scale, (x[here] + 0.5) * scale, np.full(here.sum(), scale), angle], axis=1)
    packed = np.packbits(bits, axis=1)
    bound = np.searchsorted(i, np.arange(len(stack) + 1))
    return [(at[a:b], packed[a:b]) for a, b in zip(bound[:-1], bound[1:], strict=True)]


def agreeing(at_a: np.ndarray, bits_a: np.ndarray, at_b: np.ndarray, bits_b: np.ndarray) -> bool:
    """Whether AGREE matches agree on one similarity transform, and a quarter of all matches, as of many
    matches of corners that look alike some agree by chance, and PART of the places with corners of the
    image that has fewer, as images that only share a detail are no copies."""
    if not len(at_a) or not len(at_b):
        return False
    words_a, words_b = (np.ascontiguousarray(x).view(np.uint64) for x in (bits_a, bits_b))
    far = np.bitwise_count(words_a[:, None, 0] ^ words_b[None, :, 0])
    far += np.bitwise_count(words_a[:, None, 1] ^ words_b[None, :, 1])
    b = far.argmin(axis=1)
    a = np.flatnonzero(far[np.arange(len(b)), b] <= RADIUS)
    if len(a) < AGREE:
        return False
    b = b[a]
    good = far[a, b] == far[:, b].min(axis=0)
    a, b = a[good], b[good]
    n = len(a)
    if n < AGREE:
        return False
    enough = max(AGREE, n / 4, PART * min(places(at_a), places(at_b)))
    if n < enough:
        return False
    turn, zoom = at_b[b, 3] - at_a[a, 3], at_b[b, 2] / at_a[a, 2]
    za, zb = at_a[a, 1] + 1j * at_a[a, 0], at_b[b, 1] + 1j * at_b[b, 0]
    own = zoom * np.exp(1j * turn)
    # Transforms that pass through a match: with its own turn and zoom, with neither, and through another match too.
    to = (np.arange(n) + np.arange(1, min(PARTNERS, n - 1) + 1)[:, None]) % n
    wide = np.abs(za[to] - za) >= 2 * OFF
    poses = np.concatenate([np.ones((1, n), complex), own[None, :], np.where(wide, (zb[to] - zb) / np.where(wide, za[to] - za, 1), 0)])
    # The first two suffice for most copies.
    step = max(1, FITS // (n * n))
    for x, y in [(0, 1), (1, 2), *((x, x + step) for x in range(2, len(poses), step))]:
        pose = poses[x:y, :, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            like = own[None, None, :] / pose
            fits = (np.abs(np.angle(like)) <= TURN) & (np.abs(np.log(np.abs(like))) <= np.log(ZOOM))
        fits &= np.abs(zb[None, :] - zb[:, None] - pose * (za[None, :] - za[:, None])) <= OFF * np.maximum(1, np.abs(pose))
        for k in zip(*np.nonzero(fits.sum(axis=2) >= enough), strict=True):
            # Of several corners at one place one counts.
            if min(len(set(np.round(z[fits[k]]).tolist())) for z in (za, zb)) >= enough:
                return True
    return False


def places(at: np.ndarray) -> int:
    """At how many places an image has corners: as many matches agree with an image of equal features."""
    return len(set(np.round(at[:, 1] + 1j * at[:, 0]).tolist()))


def image_features(images: DataFrame) -> DataFrame:
    """(image_id, at, bits, digest) of each row of images (image_id, height, width, pixels: a byte each, by rows).

    Images whose pixels are null or not height x width bytes have no digest. Those that have corners at fewer than AGREE places, as all under
    16 pixels a side, agree with none and have no features. The digest is that of the features, else of size and pixels.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for batch in batches:
            for x in range(0, batch.num_rows, 256):
                part = batch.slice(x, 256)
                ids, hs, ws, px = (c.to_pylist() for c in part.columns)
                at, bits, digest = [None] * len(ids), [None] * len(ids), [None] * len(ids)
                sizes: dict[tuple[int, int], list[int]] = {}
                for k, (h, w, p) in enumerate(zip(hs, ws, px, strict=True)):
                    if p is not None and h and w and h > 0 and w > 0 and len(p) == h * w:
                        digest[k] = hashlib.md5(b"%d %d " % (h, w) + p).digest()
                        if min(h, w) >= 16:
                            sizes.setdefault((h, w), []).append(k)
                for (h, w), every in sizes.items():
                    step = max(1, PIXELS // (h * w))
                    for own in (every[y : y + step] for y in range(0, len(every), step)):
                        stack = np.frombuffer(b"".join(px[k] for k in own), dtype=np.uint8).reshape(-1, h, w)
                        for k, (a, d) in zip(own, features(stack), strict=True):
                            if places(a) >= AGREE:
                                at[k], bits[k] = pack(a), d.tobytes()
                                digest[k] = hashlib.md5(at[k] + bits[k]).digest()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(at, pa.binary()), pa.array(bits, pa.binary()), pa.array(digest, pa.binary())], ["image_id", "at", "bits", "digest"])

    own = images.select(F.col("image_id").cast("long").alias("image_id"), "height", "width", "pixels")
    return own.mapInArrow(run, "image_id long, at binary, bits binary, digest binary")


def pack(at: np.ndarray) -> bytes:
    """Places in 10 bytes each: y, x, number of the scale, angle in 256 steps."""
    out = np.zeros(len(at), PACKED)
    out["y"], out["x"] = at[:, 0], at[:, 1]
    out["scale"], out["turn"] = np.abs(at[:, 2, None] - np.array(SCALES)).argmin(axis=1), np.rint(at[:, 3] * (127 / np.pi))
    return out.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    own = np.frombuffer(packed, PACKED)
    return np.stack([own["y"], own["x"], np.array(SCALES)[own["scale"]], own["turn"] * (np.pi / 127)], axis=1)


def table_rows(shown: DataFrame) -> DataFrame:
    """(key, spot) of shown (node, at, bits): each descriptor once for each table. key: the table's number and the first of
    its 128 bits, turned so that they begin with the table's first one; spot: its image and where it is there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for batch in batches:
            for x in range(0, batch.num_rows, 512):
                part = batch.slice(x, 512)
                own = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype=">u4").reshape(-1, TABLES)
                at = np.frombuffer(b"".join(part.column(1).to_pylist()), PACKED)
                node = np.repeat(part.column(0).to_numpy(), [len(b) // (BITS // 8) for b in part.column(2).to_pylist()])
                words = own.astype(np.uint64)
                cell = ((at["y"] // CELL).astype(np.int64) * 31 + (at["x"] // CELL).astype(np.int64)) % (1 << CELL_BITS)
                spot = pa.array(node << CELL_BITS | cell)
                for t in range(TABLES):
                    key = (words[:, t] << np.uint64(32) | words[:, (t + 1) % TABLES]) >> np.uint64(TABLE_BITS) | np.uint64(t << (64 - TABLE_BITS))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), spot], ["key", "spot"])

    return shown.select("node", "at", "bits").mapInArrow(run, "key long, spot long")


def alike_pairs(key: np.ndarray, spot: np.ndarray, held: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (a, b) of spots from rows in the tables' order, and where the last run begins: each row with the nearest
    of BACK rows before it that is alike and of another image, and with its run's smallest spot if they are alike.

    Rows are alike if they are of one table and within KEY_RADIUS. A run goes on while a row is like
    one of BACK rows before it. The first `held` rows are of those before these: they are one run, and no pair ends in them.
    """
    n, key, node = len(spot), key.view(np.uint64), spot >> CELL_BITS

    def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        off = key[x] ^ key[y]
        return (np.bitwise_count(off) <= KEY_RADIUS) & (off >> np.uint64(64 - TABLE_BITS) == 0)

    goes_on, to = np.zeros(n, bool), np.full(n, -1)
    goes_on[1:held] = True
    for d in range(1, min(BACK, n - 1) + 1):
        x = np.arange(d, n)
        close = alike(x, x - d)
        goes_on[d:] |= close
        new = close & (node[x] != node[x - d]) & (to[d:] < 0)
        to[d:][new] = (x - d)[new]
    first = np.flatnonzero(~goes_on)
    run = np.cumsum(~goes_on) - 1
    least = np.lexsort((spot, run))[first][run]
    star = (least != to) & (node[least] != node)
    star[star] = alike(np.flatnonzero(star), least[star])
    step = to >= 0
    star[:held] = step[:held] = False
    a, b = np.concatenate([spot[to[step]], spot[least[star]]]), np.concatenate([spot[step], spot[star]])
    return np.minimum(a, b), np.maximum(a, b), int(first[-1])


def candidates(rows: DataFrame) -> DataFrame:
    """(a, b, cells) of images that meet in two places of either or more, and in how many. The tables are dealt by ranges of key and spot,
    so a descriptor that many images have fills as many tasks as it needs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        keys, spots, held = [], [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                keys.append(batch.column(0).to_numpy())
                spots.append(batch.column(1).to_numpy())
            n = sum(map(len, keys))
            if n > held and (batch is None or n >= ROWS):
                key, spot = np.concatenate(keys), np.concatenate(spots)
                a, b, first = alike_pairs(key, spot, held)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                # The smallest of the last run, and its last rows, go along.
                rest = np.unique(np.append(np.arange(max(first, len(spot) - BACK), len(spot)), first + spot[first:].argmin()))
                keys, spots, held = [key[rest]], [spot[rest]], len(rest)

    return two_places(rows.repartitionByRange("key", "spot").sortWithinPartitions("key", "spot").mapInArrow(run, "a long, b long"))


def two_places(met: DataFrame) -> DataFrame:
    """(a, b, cells) of images that meet in two places of either or more, of spots (a, b) that meet."""
    cells = [F.bit_count(F.bit_or(F.expr(f"shiftleft(1L, CAST({x} & {(1 << CELL_BITS) - 1} AS INT))"))).alias(f"{x}_cells") for x in "ab"]
    return met.groupBy(*(F.shiftright(x, CELL_BITS).alias(x) for x in "ab")).agg(*cells).where("a_cells >= 2 AND b_cells >= 2").select("a", "b", (F.col("a_cells") + F.col("b_cells")).alias("cells"))


def bucket_rows(shown: DataFrame, table: int) -> DataFrame:
    """(bucket, spot, component, low, high) of shown (node, at, bits, component): each descriptor once, its bucket in the table, numbered through all tables, and all of its bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for batch in batches:
            for x in range(0, batch.num_rows, 512):
                part = batch.slice(x, 512)
                bits = b"".join(part.column(2).to_pylist())
                at = np.frombuffer(b"".join(part.column(1).to_pylist()), PACKED)
                n = [len(b) // (BITS // 8) for b in part.column(2).to_pylist()]
                cell = ((at["y"] // CELL).astype(np.int64) * 31 + (at["x"] // CELL).astype(np.int64)) % (1 << CELL_BITS)
                spot = np.repeat(part.column(0).to_numpy(), n) << CELL_BITS | cell
                bucket = np.frombuffer(bits, dtype=">u4").reshape(-1, TABLES)[:, table] >> (32 - BUCKET_BITS) | table << BUCKET_BITS
                whole = np.frombuffer(bits, dtype=">i8").reshape(-1, 2).astype(np.int64)
                own = [bucket.astype(np.int32), spot, np.repeat(part.column(3).to_numpy(), n), whole[:, 0], whole[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in own], ["bucket", "spot", "component", "low", "high"])

    return shown.select("node", "at", "bits", "component").mapInArrow(run, "bucket int, spot long, component long, low long, high long")


def bucket_sizes(shown: DataFrame) -> DataFrame:
    """(bucket, size) of the buckets of all tables."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for batch in batches:
            words = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=">u4").reshape(-1, TABLES)
            bucket, size = np.unique(words.astype(np.int64) >> (32 - BUCKET_BITS) | np.arange(TABLES) << BUCKET_BITS, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(size)], ["bucket", "size"])

    return shown.select("bits").mapInArrow(run, "bucket int, size long").groupBy("bucket").agg(F.sum("size").alias("size"))


def bucket_hits(bounds: np.ndarray, table: int, spot: np.ndarray, component: np.ndarray, whole: np.ndarray, block: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (a, b) of spots of different components in the units that bounds cut, within RADIUS bits of their
    128 (whole: two columns), unless they share a bucket of an earlier table. Rows of one block meet only where within says so."""
    words = [whole[:, t // 2] >> np.uint64(32 * (1 - t % 2)) << np.uint64(32) >> np.uint64(64 - BUCKET_BITS) for t in range(table)]
    x_out, y_out = [], []

    def take(x: np.ndarray, y: np.ndarray) -> None:
        far = np.bitwise_count(whole[x, 0] ^ whole[y, 0]) + np.bitwise_count(whole[x, 1] ^ whole[y, 1])
        good = (far <= RADIUS) & (component[x] != component[y]) & (within[x] | (block[x] != block[y]))
        x, y = x[good], y[good]
        for w in words:
            new = w[x] != w[y]
            x, y = x[new], y[new]
        x_out.append(x)
        y_out.append(y)

    n = np.diff(bounds)
    end = np.repeat(bounds[1:], n)
    rest = np.flatnonzero(np.repeat(n <= FEW, n))
    for d in range(1, FEW):
        rest = rest[rest + d < end[rest]]
        if not len(rest):
            break
        take(rest, rest + d)
    for low, high in zip(bounds[:-1][n > FEW].tolist(), bounds[1:][n > FEW].tolist(), strict=True):
        for top in range(low, high, 64):
            x, y = np.arange(top, min(top + 64, high))[:, None], np.arange(top, high)[None, :]
            near = np.bitwise_count(whole[x, 0] ^ whole[y, 0]) + np.bitwise_count(whole[x, 1] ^ whole[y, 1]) <= RADIUS
            a, b = np.nonzero(near & (x < y))
            take(a + top, b + top)
    a, b = (spot[np.concatenate(c)] if c else spot[:0] for c in (x_out, y_out))
    return np.minimum(a, b), np.maximum(a, b)


def whole_buckets(shown: DataFrame) -> DataFrame:
    """(a, b, cells) of images of different components in shown (node, at, bits, component) that meet in two places of either or
    more, of all descriptors that share a bucket and are within RADIUS. A bucket of many is dealt to blocks, and every
    pair of blocks is a unit of work, so none is whole in a task and no row is left out."""
    large = materialise(bucket_sizes(shown).where(F.col("size") > BLOCK).select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "image-buckets")
    hits = []
    for table in range(TABLES):
        own = with_ids(bucket_rows(shown, table), large, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = own.withColumn("block", F.pmod(F.xxhash64("spot"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        own = own.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).select("bucket", "i", "j", "block", "spot", "component", "low", "high")

        def run(batches: Iterable[pa.RecordBatch], table: int = table) -> Iterator[pa.RecordBatch]:
            hold()
            for t, bounds in key_groups(batches, ["bucket", "i", "j"]):
                i, j, block, spot, component, low, high = (t.column(c).to_numpy() for c in ("i", "j", "block", "spot", "component", "low", "high"))
                a, b = bucket_hits(bounds, table, spot, component, np.stack([low, high], axis=1).view(np.uint64), block, i == j)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        keys = ["bucket", "i", "j"]
        hits.append(materialise(own.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long"), "image-hits"))
    pairs = materialise(two_places(functools.reduce(DataFrame.union, hits)), "image-whole")
    discard(large, *hits)
    return pairs


def united(links: DataFrame) -> DataFrame:
    """(node, component) of written links (a, b), but for the nodes that name their component. Up to EDGES links (4 MB) are joined in a task,
    as the many small steps of components() are worth it only for more."""
    if links.count() > EDGES:
        return components(links).where("node <> component")
    return stars(links.coalesce(1)).select(F.col("a").alias("node"), F.col("b").alias("component"))


def checked(pairs: DataFrame, shown: DataFrame) -> DataFrame:
    """Those of written pairs (a, b) whose images in shown (node, at, bits) agree. Pairs are dealt to blocks of about PAIRS by their
    larger image b, up to UNIT of one b together, so that an image's features go once to each block that has pairs of it."""
    pairs, blocks = pairs.select("a", "b"), max(1, -(-pairs.count() // PAIRS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        block, large, row = None, {}, (1 << SIZE_AT) - 1
        for batch in batches:
            good = []
            for k in range(batch.num_rows):
                at_block, node, partners, at, bits = (c[k].as_py() for c in batch.columns)
                if at_block != block:
                    block, large = at_block, {}
                own = unpack(at), np.frombuffer(bits, np.uint8).reshape(-1, BITS // 8)
                if partners is None:
                    large[node] = own
                    continue
                # In the order of the images' rows: of equally near corners the first is a match.
                good += [(node, b) for b in partners if (agreeing(*own, *large[b]) if node & row < b & row else agreeing(*large[b], *own))]
            a, b = zip(*good, strict=True) if good else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    block = F.pmod(F.xxhash64("b", "part"), F.lit(blocks)).cast("int").alias("block")
    parts = materialise(pairs.groupBy("b").agg(F.ceil(F.count("*") / UNIT).cast("int").alias("parts")), "image-parts")
    dealt = with_ids(pairs, parts.where("parts > 1"), "b", "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int"))
    asks = dealt.groupBy(block, F.col("a").alias("node")).agg(F.collect_list("b").alias("partners"))
    held = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(block, F.col("b").alias("node"), F.lit(None).cast("array<long>").alias("partners"))
    sends = materialise(asks.union(held).groupBy("node").agg(F.collect_list(F.struct("block", "partners")).alias("sends")), "image-sends")
    # Features of images that met none stay where they are.
    own = with_ids(shown.select("node", "at", "bits"), sends, "node", lists=F.expr("flatten(transform(sends, s -> coalesce(s.partners, array())))"))
    own = own.select("node", "at", "bits", F.explode("sends").alias("s")).select("s.block", "node", "s.partners", "at", "bits", F.col("s.partners").isNotNull().alias("asks"))
    return own.repartition("block").sortWithinPartitions("block", "asks").drop("asks").mapInArrow(run, "a long, b long")


def copies(images: DataFrame) -> DataFrame:
    """(image_id, group_id, n_equal) of every row of images: the smallest image_id reachable over
    verified copies, and how many other images have equal features or pixels.

    Ids are integers. Rows that repeat an image_id are one image, the one of the smallest digest. A null id
    has a null group; an image without corners is alone, unless others are byte-equal to it. An
    empty table gives an empty one. Other columns are left out.
    """
    size = F.least(F.length(F.bin(F.coalesce(F.length("bits") / (BITS // 8), F.lit(0)).cast("long"))), F.lit(SIZE_MOST)).cast("long")
    made = materialise(image_features(images).withColumn("node", F.monotonically_increasing_id() + F.shiftleft(size, SIZE_AT)), "image-features")
    ids = made.where("image_id IS NOT NULL AND digest IS NOT NULL").groupBy("image_id").agg(F.min(F.struct("digest", "node")).alias("own"))
    ids = materialise(ids.select("image_id", "own.*"), "image-ids")
    classes = ids.groupBy("digest").agg(F.min(F.struct("image_id", "node")).alias("rep"), F.count("*").alias("n"))
    classes = materialise(classes.select("digest", "n", F.col("rep.image_id").alias("rep"), F.col("rep.node").alias("node")), "image-classes")

    # Images of equal features are one node, the row of the smallest image_id.
    shown = with_ids(made.where("length(bits) > 0").select("node", "at", "bits"), classes.select("node"), "node")
    pairs = materialise(candidates(table_rows(shown)), "image-pairs")
    # First each image with the one it meets most; what that unites needs no further check.
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("cells", -F.col("a"))).alias("a")).select("a", "b")
    best = materialise(best, "image-best")
    first = materialise(checked(best, shown), "image-first")
    known = united(first)
    at = {x: known.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")).hint("merge") for x in "ab"}
    rest = pairs.join(best.hint("merge"), ["a", "b"], "left_anti").join(at["a"], "a", "left").join(at["b"], "b", "left")
    rest = materialise(rest.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b"), "image-rest")
    links = materialise(checked(rest, shown), "image-links")
    discard(rest)
    # Then all that share a bucket, but for what is united.
    known = materialise(united(first.union(links)), "image-known")
    grouped = with_ids(shown, known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    met = whole_buckets(grouped)
    more = materialise(met.join(pairs.hint("merge"), ["a", "b"], "left_anti").select("a", "b"), "image-more")
    discard(met, pairs, first, links)
    linked = materialise(checked(more, shown), "image-whole-links")
    discard(more)
    linked = known.select(F.col("component").alias("a"), F.col("node").alias("b")).union(linked)
    # Components by image_id: the smallest in reach names the group.
    name = classes.select("node", "rep")
    by_id = linked.join(name.select(F.col("node").alias("a"), F.col("rep").alias("x")).hint("merge"), "a").join(name.select(F.col("node").alias("b"), F.col("rep").alias("y")).hint("merge"), "b")
    by_id = materialise(by_id.select(F.col("x").alias("a"), F.col("y").alias("b")), "image-by-id")
    groups = united(by_id).withColumnsRenamed({"node": "rep", "component": "group_id"})
    known = classes.join(groups.hint("merge"), "rep", "left").select("digest", F.coalesce("group_id", "rep").alias("group_id"), (F.col("n") - 1).alias("n_equal"))
    out = lookup(made.select("image_id"), lookup(ids, known, ["digest"]).select("image_id", "group_id", "n_equal"), ["image_id"])
    return out.select("image_id", F.coalesce("group_id", "image_id").alias("group_id"), F.coalesce("n_equal", F.lit(0)).cast("long").alias("n_equal"))


#: Pixels of a picture's row, bytes of a pixel, and rows by which its height goes up.
WIDTH, BYTES, STEP = 40, 2, 16
UNSEEN = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->")
BREAKS = re.compile(r"(?i)</?(?:p|div|ul|ol|h[1-6]|hr|article|section|nav|header|footer|title|head|body|table|tr)\b[^>]*>")
TAG = re.compile(r"<[^>]*>")
#: The grey of a byte: neighbours in the alphabet differ much.
GREY = (np.arange(256) * 97 % 251).astype(np.uint16)


def filled(text: bytes, unit: int) -> bytes:
    """The text, repeated up to a multiple of unit."""
    n = -(-len(text) // unit) * unit
    return (text * (n // len(text) + 1))[:n] if text else b""


def picture(html: str | None) -> np.ndarray:
    """A page's whole visible text as it would be printed in 80 columns, a grey pixel for two bytes. Every block of text
    begins a row and fills its last one by its beginning, as the page does to the next multiple of STEP rows, so that no area is
    blank. Pages with the same passages share parts of their pictures."""
    text, size = TAG.sub(" ", BREAKS.sub("\n", UNSEEN.sub(" ", html or ""))), WIDTH * BYTES
    rows = b"".join(filled(" ".join(block.split()).encode("utf-8", "replace"), size) for block in text.split("\n"))
    grey = GREY[np.frombuffer(filled(rows or b" ", size * STEP), np.uint8).reshape(-1, WIDTH, BYTES)]
    return (grey.sum(axis=2) // BYTES).astype(np.uint8)


def page_pictures(pages: DataFrame) -> DataFrame:
    """(image_id, height, width, pixels) of pages (page_id, html)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in range(0, batch.num_rows, 256):
                part = batch.slice(x, 256)
                own = [picture(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m.shape[0] for m in own], pa.int32()), pa.array([m.shape[1] for m in own], pa.int32()), pa.array([m.tobytes() for m in own], pa.binary())], ["image_id", "height", "width", "pixels"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "image_id long, height int, width int, pixels binary")


def op1_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no images: a page's picture is its printed text. Columns: image_id (the page's id), group_id, n_equal."""
    return copies(page_pictures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
