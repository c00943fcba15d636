"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Vectors of a label are dealt to shards of a bounded size. Each shard's graph is built in numpy,
a batch of vectors at a time; each pair of shards of a label is a unit of work, in which the
vectors of one are looked up in the graph of the other. Beams are widened until a sample,
compared by brute force, shows the target recall. Links are verified by cosine in double
precision, and their components united.
A beam that is full of links, or as wide as SCAN, gives way to the exact comparison of its
query with the whole shard, whose size is bounded: large groups cost no ever wider beams.
"""

from __future__ import annotations

import io
import logging
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, hold, lookup, materialise, mix64

log = logging.getLogger(__name__)

SIMILARITY = 0.98
SHARD = 4096
NEIGHBOURS = 16
BEAM = 48
RECALL = 0.99
#: Vectors a unit's audit draws at first; it goes on until so many links are known, or all vectors are drawn.
AUDIT = 128
ENOUGH = 64
QUERIES = 256
#: Beams of this width or more are slower than comparing the query with its whole shard.
SCAN = 768
#: Pairs that are verified at once.
PAIRS = 1 << 15


class Graph:
    """Unit vectors and, on each level, the neighbours of each (-1: none)."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        """Built in the order of the levels, which are drawn from the ids' hashes."""
        self.vectors = vectors.astype(np.float32)
        n = len(vectors)
        u = (mix64(ids.view(np.uint64)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        self.level = np.minimum((-np.log(np.maximum(u, 1e-300)) / np.log(NEIGHBOURS)).astype(np.int64), 6)
        self.order = np.lexsort((u, -self.level))
        self.links = [np.full((n, NEIGHBOURS * (2 if lv == 0 else 1)), -1, dtype=np.int32) for lv in range(int(self.level.max()) + 1 if n else 1)]
        self.entry = int(self.order[0]) if n else -1
        done = 1
        while done < n:
            batch = self.order[done : done + max(1, min(QUERIES, done))]
            self.insert(batch)
            done += len(batch)

    def insert(self, batch: np.ndarray) -> None:
        start = np.full(len(batch), self.entry)
        for lv in range(len(self.links) - 1, -1, -1):
            own = self.level[batch] >= lv
            found, sims = self.beam(self.vectors[batch], start, lv, BEAM if own.any() else 1)
            start = found[:, 0]
            new, found, sims = batch[own], found[own], sims[own]
            if not len(new):
                continue
            # The batch doesn't see itself in the graph: its own members are candidates too.
            inner = self.vectors[new] @ self.vectors[new].T
            np.fill_diagonal(inner, -2)
            found = np.concatenate([found, np.broadcast_to(new, inner.shape)], axis=1)
            sims = np.concatenate([sims, inner], axis=1)
            most = min(sims.shape[1], BEAM + NEIGHBOURS)
            top = np.argpartition(-sims, most - 1, axis=1)[:, :most]
            picked = self.spread(np.take_along_axis(found, top, 1), np.take_along_axis(sims, top, 1), NEIGHBOURS)
            self.links[lv][new, :NEIGHBOURS] = picked
            self.back(lv, new, picked)

    def back(self, lv: int, new: np.ndarray, picked: np.ndarray) -> None:
        """Links in the other direction; a node with too many keeps a spread of them."""
        row, _ = np.nonzero(picked >= 0)
        source, target = new[row], picked[picked >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        more = np.full((len(nodes), int(count.max()) if len(count) else 0), -1, dtype=np.int64)
        more[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        now = np.concatenate([self.links[lv][nodes], more], axis=1)
        for x in range(0, len(nodes), QUERIES):
            c = now[x : x + QUERIES]
            c = -np.sort(-c, axis=1)
            c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
            sims = np.einsum("qd,qcd->qc", self.vectors[nodes[x : x + QUERIES]], self.vectors[c])
            sims[c < 0] = -2
            width = self.links[lv].shape[1]
            few = (c >= 0).sum(1) <= width
            kept = np.full((len(c), width), -1, dtype=np.int64)
            order = np.argsort(-sims, axis=1)
            c, sims = np.take_along_axis(c, order, 1), np.take_along_axis(sims, order, 1)
            kept[few, : min(width, c.shape[1])] = c[few, :width]
            if (~few).any():
                kept[~few] = self.spread(c[~few], sims[~few], width)
            self.links[lv][nodes[x : x + QUERIES]] = kept

    def spread(self, found: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates up to `most`: the nearest first, passing over one that is nearer to
        a taken one than to the node; places left over go to the nearest of those passed over."""
        order = np.argsort(-sims, axis=1)
        found, sims = np.take_along_axis(found, order, 1), np.take_along_axis(sims, order, 1)
        v = self.vectors[found]
        among = np.einsum("qcd,qed->qce", v, v)
        taken = np.zeros(found.shape, dtype=bool)
        room = np.full(len(found), most)
        for k in range(found.shape[1]):
            near = np.where(taken, among[:, k], -2).max(axis=1)
            take = (found[:, k] >= 0) & (sims[:, k] > -2) & (near < sims[:, k]) & (room > most // 4)
            taken[:, k] = take
            room -= take
        late = np.where(taken, 0, np.where((found >= 0) & (sims > -2), 1, 2))
        order = np.argsort(late, axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(found, order, 1)
        out[np.take_along_axis(late, order, 1) == 2] = -1
        return out if out.shape[1] == most else np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def beam(self, queries: np.ndarray, start: np.ndarray, lv: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and similarities of a beam search of each query, the nearest first; -1 and -2: none."""
        q, rows = len(queries), np.arange(len(queries))
        seen = np.zeros((q, len(self.vectors)), dtype=bool)
        seen[rows, start] = True
        found, sims = np.full((q, width), -1, dtype=np.int64), np.full((q, width), -2, dtype=np.float32)
        found[:, 0], sims[:, 0] = start, np.einsum("qd,qd->q", queries, self.vectors[start])
        spent = np.zeros((q, width), dtype=bool)
        live = rows
        while len(live):
            open_sims = np.where(spent[live] | (found[live] < 0), -3, sims[live])
            best = open_sims.argmax(axis=1)
            going = open_sims[np.arange(len(live)), best] > -3
            live, best = live[going], best[going]
            if not len(live):
                break
            spent[live, best] = True
            near = self.links[lv][found[live, best]]
            new = near >= 0
            new &= ~seen[live[:, None], near]
            at, col = np.nonzero(new)
            seen[live[at], near[at, col]] = True
            near_sims = np.where(new, np.einsum("qd,qcd->qc", queries[live], self.vectors[near]), np.float32(-2))
            all_found = np.concatenate([found[live], np.where(new, near, -1)], axis=1)
            all_sims = np.concatenate([sims[live], near_sims], axis=1)
            all_spent = np.concatenate([spent[live], np.zeros(near.shape, bool)], axis=1)
            top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            found[live], sims[live], spent[live] = (np.take_along_axis(m, top, 1) for m in (all_found, all_sims, all_spent))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(found, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.full(len(queries), self.entry)
        for lv in range(len(self.links) - 1, 0, -1):
            start = self.beam(queries, start, lv, 4)[0][:, 0]
        return self.beam(queries, start, 0, min(width, len(self.vectors)))

    def near(self, queries: np.ndarray, least: float, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For a block of queries at a time: (query, node) pairs in the beams with about `least` or
        more, and the queries whose beams hold nothing else, so that there may be more outside."""
        slack = least - 1e-5
        for x in range(0, len(queries), QUERIES):
            found, sims = self.search(queries[x : x + QUERIES], width)
            full = (sims[:, -1] >= slack) & (width < len(self.vectors))
            q, at = np.nonzero((sims >= slack) & (found >= 0) & ~full[:, None])
            yield q + x, found[q, at], np.flatnonzero(full) + x

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, entry=self.entry, n=len(self.links), **{f"links{i}": x for i, x in enumerate(self.links)})
        return out.getvalue()

    @classmethod
    def unpack(cls, vectors: np.ndarray, packed: bytes) -> Graph:
        self, z = cls.__new__(cls), np.load(io.BytesIO(packed))
        self.vectors, self.entry = vectors.astype(np.float32), int(z["entry"])
        self.links = [z[f"links{i}"] for i in range(int(z["n"]))]
        return self


def unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt(np.einsum("nd,nd->n", raw, raw))[:, None]


def verified(a: np.ndarray, b: np.ndarray, q: np.ndarray, x: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of rows q of a and x of b have a cosine of `least` or more."""
    parts = [np.einsum("nd,nd->n", a[q[i : i + PAIRS]], b[x[i : i + PAIRS]]) >= least for i in range(0, len(q), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def scan(a: np.ndarray, b: np.ndarray, rows: np.ndarray, least: float, linked: np.ndarray) -> None:
    """Sets linked for these rows of a and all of b; what a product leaves in doubt is verified like other pairs."""
    for i in range(0, len(rows), QUERIES):
        own = rows[i : i + QUERIES]
        sims = a[own] @ b.T
        linked[own] = sims >= least
        q, x = np.nonzero(np.abs(sims - least) < 1e-9)
        linked[own[q], x] = verified(a, b, own[q], x, least)


def united(linked: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For the rows and the columns of a matrix of links: the smallest id reachable. Each row is read once."""
    back = linked if same else np.ascontiguousarray(linked.T)
    a_root = a_ids.copy()
    b_root = a_root if same else b_ids.copy()
    todo = linked.any(axis=1)
    for i in np.flatnonzero(todo):
        if not todo[i]:
            continue
        in_a, in_b, front = np.zeros(len(a_ids), bool), np.zeros(len(b_ids), bool), np.array([i])
        in_a[i] = True
        while len(front):
            new = linked[front].any(axis=0) & ~in_b
            in_b |= new
            new = back[np.flatnonzero(new)].any(axis=0) & ~in_a
            in_a |= new
            front = np.flatnonzero(new)
        todo[in_a | in_b if same else in_a] = False
        low = min(a_ids[in_a].min(), b_ids[in_b].min())
        a_root[in_a], b_root[in_b] = low, low
    return a_root, b_root


def index(vectors: DataFrame) -> DataFrame:
    """(label, shard, ids, vectors, graph): a row for each shard, its graph built in one task."""
    size = vectors.groupBy("label").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    dealt = lookup(vectors, size, ["label"]).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))

    def build(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        ids = t.column("vec_id").to_numpy()
        raw = np.array(t.column("embedding").to_pylist(), dtype=np.float64)
        graph = Graph(unit(raw), ids).pack()
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([raw.tobytes()], pa.binary()), pa.array([graph], pa.binary())], ["label", "shard", "ids", "vectors", "graph"])

    return dealt.groupBy("label", "shard").applyInArrow(build, "label string, shard int, ids binary, vectors binary, graph binary")


def links(shards: DataFrame, similarity: float, recall: float) -> DataFrame:
    """(vec_id, n_links, root) of vectors with links in a unit, a pair of shards of one label, and for each unit a row
    (audited, hit) of how many links its audit knows and how many of them were found."""
    names = ["vec_id", "n_links", "root", "audited", "hit"]

    def unit_rows(a_ids: np.ndarray, a: np.ndarray, b_ids: np.ndarray, b: np.ndarray, graph: Graph, same: bool) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        queries = a.astype(np.float32)
        # More vectors are drawn until enough links are known, at most all.
        order, near, n = np.argsort(mix64(a_ids.view(np.uint64)), kind="stable"), np.zeros((len(a), len(b)), bool), 0
        while n < len(a) and near.sum() < ENOUGH:
            n, was = min(len(a), max(AUDIT, 4 * n)), n
            scan(a, b, order[was:n], similarity, near)
            if same:
                np.fill_diagonal(near, False)
        drawn = order[:n]
        near = near[drawn]
        width, wanted = BEAM, int(near.sum())
        while True:
            # A bit for each pair of a unit: its size is that of two shards, whatever the groups.
            linked = np.zeros((len(a), len(b)), bool)
            if width >= SCAN:
                scan(a, b, np.arange(len(a)), similarity, linked)
            else:
                for q, x, full in graph.near(queries, similarity, width):
                    good = verified(a, b, q, x, similarity)
                    linked[q[good], x[good]] = True
                    scan(a, b, full, similarity, linked)
            if same:
                linked |= linked.T
                np.fill_diagonal(linked, False)
            got = int((near & linked[drawn]).sum())
            if got >= recall * wanted or width >= SCAN:
                break
            width *= 4
        a_root, b_root = united(linked, a_ids, b_ids, same)
        ids, root, count = a_ids, a_root, linked.sum(axis=1)
        if not same:
            ids, root, count = np.concatenate([a_ids, b_ids]), np.concatenate([a_root, b_root]), np.concatenate([count, linked.sum(axis=0)])
        # A last row has the unit's audit.
        own, none = count > 0, pa.nulls(1, pa.int64())
        rows = pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[own], count[own].astype(np.int64), root[own])] + [pa.nulls(int(own.sum()), pa.int64())] * 2, names)
        return rows, pa.RecordBatch.from_arrays([none, none, none, pa.array([wanted]), pa.array([got])], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for batch in batches:
            for r in batch.to_pylist():
                a_ids, b_ids = (np.frombuffer(r[k], dtype=np.int64) for k in ("a_ids", "b_ids"))
                a, b = (unit(np.frombuffer(r[k], dtype=np.float64).reshape(len(i), -1)) for k, i in (("a_vectors", a_ids), ("b_vectors", b_ids)))
                if a.shape[1] == b.shape[1]:
                    yield from unit_rows(a_ids, a, b_ids, b, Graph.unpack(b, r["graph"]), r["a"] == r["b"])

    keys = shards.select("label", F.col("shard").alias("b"))
    pairs = shards.select("label", F.col("shard").alias("a")).join(keys.hint("merge"), "label").where("a <= b")
    queries = shards.select("label", F.col("shard").alias("a"), F.col("ids").alias("a_ids"), F.col("vectors").alias("a_vectors"))
    graphs = shards.select("label", F.col("shard").alias("b"), F.col("ids").alias("b_ids"), F.col("vectors").alias("b_vectors"), "graph")
    units = pairs.join(queries.hint("merge"), ["label", "a"]).join(graphs.hint("merge"), ["label", "b"])
    return units.repartition("label", "a", "b").mapInArrow(run, "vec_id long, n_links long, root long, audited long, hit long")


def near_vectors(df: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of df (vec_id, embedding, label).

    Ids are integers, labels of any atomic type. Vectors link only inside a label that isn't null, and only to vectors of their own length.
    Null, empty or zero vectors and those with null, NaN or infinite components link with none.
    Rows that repeat a vec_id are one vector: of its rows that may link, the one of the
    smallest label and then embedding counts. A null vec_id has no links and a null component.
    """
    ids = df.select(F.col("vec_id").cast("long").alias("vec_id"))
    own = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~odd & F.exists("embedding", lambda x: x != 0))
    own = own.groupBy("vec_id").agg(F.min(F.struct("label", F.size("embedding").alias("size"), "embedding")).alias("x")).select("vec_id", "x.*")
    # Labels and lengths together are one label here.
    own = own.select("vec_id", F.concat_ws(" ", "size", "label").alias("label"), "embedding")
    shards = materialise(index(own), "hnsw-shards")
    seen = materialise(links(shards, similarity, recall), "hnsw-links")
    log.info("hnsw: of %s audited links %s were found", *seen.agg(F.sum("audited"), F.sum("hit")).first())
    seen = seen.where("vec_id IS NOT NULL")
    counts = seen.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))
    groups = components(seen.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "vec_id", "component": "component_id"})
    out = ids.join(counts.hint("merge"), "vec_id", "left").join(groups.hint("merge"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
