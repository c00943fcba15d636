"""What several operators share: tables in the shared folder, lookups without hot tasks, components."""

from __future__ import annotations

import ctypes
import gc
import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources.shared import discard, materialise, scratch_path, shared_dir, shuffles_dropped  # noqa: F401  for the operators

#: Up to so many ids and entries of their lists (16 bytes at most, so 4 MB) may be broadcast; more are joined by shuffle.
BROADCAST_IDS = 250_000


#: Rows of an Arrow batch where the session has Spark's default, 10,000: whole texts are long, and a
#: batch stands in the JVM, in the worker and in what the worker returns at once.
BATCH_ROWS = 2048


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS, unless they were set by the user."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


_held: dict[str, object] = {}


def hold(name: str | None = None, make: Callable[[], object] | None = None) -> object:
    """Of a Python worker, which serves one task after the other: the object of this name, made on first use. A worker holds one
    such object at a time; tasks that need none call hold(), so that nothing of other operators stays in their memory."""
    if name is None or name not in _held:
        if _held:
            _held.clear()
            give_back()
        if name is not None:
            _held[name] = make()
    return _held.get(name)


def give_back() -> None:
    """Returns the memory that Python, Arrow and malloc keep for later to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def lookup(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """left joined to right, which has one row for each key. Hot keys are on the left only, so
    adaptive execution can split their partitions and give each part the one right row."""
    return left.join(right.hint("merge"), on, how)


def with_ids(df: DataFrame, ids: DataFrame, key: str, how: str = "inner", lists: str | Column | None = None) -> DataFrame:
    """df joined to ids (one row for each key). The ids, and the entries of their column `lists` if
    there is one, are counted first: few enough are broadcast, more are joined by shuffle; the rows are the same."""
    n = F.sum(1 + F.size(lists)) if lists is not None else F.count("*")
    few = (ids.agg(n).first()[0] or 0) <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids.hint("merge"), key, how)


#: Bits of a map of hashes: 2 ** 24, two megabytes, whatever the corpus.
MAP_BITS = 24


def bit_map(hashes: DataFrame, column: str) -> np.ndarray:
    """A map of fixed size that has a bit for each hash (long). It lets through what it holds and, the fuller it is, more and more
    of the rest: it only saves rows of a join."""
    word = F.shiftrightunsigned(column, 64 - MAP_BITS + 6).alias("word")
    bit = F.expr(f"shiftleft(1L, CAST(shiftrightunsigned({column}, {64 - MAP_BITS}) & 63 AS INT))")
    with shuffles_dropped(hashes.sparkSession):
        found = hashes.groupBy(word).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(1 << (MAP_BITS - 6), dtype=np.uint64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (64-bit) the map lets through."""
    at = hashes.view(np.uint64) >> np.uint64(64 - MAP_BITS)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def key_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and the bounds of the groups in them, from batches sorted by integer keys.

    Only the last, unfinished group of a batch is held back.
    """
    rest: list[pa.Table] = []

    def bounds(t: pa.Table) -> np.ndarray:
        new = np.zeros(max(len(t) - 1, 0), dtype=bool)
        for k in keys:
            v = t.column(k).to_numpy()
            new |= v[1:] != v[:-1]
        return np.concatenate([[0], np.flatnonzero(new) + 1, [len(t)]])

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if rest and all(rest[-1].column(k)[-1] == t.column(k)[0] for k in keys):
            inner = bounds(t)
            if len(inner) == 2:
                rest.append(t)
                continue
            whole = pa.concat_tables([*rest, t.slice(0, inner[1])])
            yield whole, np.array([0, len(whole)])
            t = t.slice(inner[1])
        elif rest:
            whole = pa.concat_tables(rest)
            yield whole, np.array([0, len(whole)])
        cut = bounds(t)
        if len(cut) > 2:
            yield t.slice(0, cut[-2]), cut[:-1]
        rest = [t.slice(cut[-2])]
    if rest:
        whole = pa.concat_tables(rest)
        yield whole, np.array([0, len(whole)])


def forest_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 with links a-b: the smallest node reachable from each."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, root):
            return root
        root = new


#: Edges that a task joins to stars at once.
EDGES = 1 << 18


def stars(edges: DataFrame) -> DataFrame:
    """Edges (a, b), b the smaller, that join the same nodes as edges (a long, b long) do: of EDGES rows of a task each
    node with the smallest one they reach from it. So later steps have fewer edges and shorter ways."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        held, rows = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                rows += batch.num_rows
            if rows and (batch is None or rows >= EDGES):
                node, at = np.unique(np.concatenate([x for side in zip(*held, strict=True) for x in side]), return_inverse=True)
                root = forest_roots(len(node), at[:rows], at[rows:])
                own = np.flatnonzero(root != np.arange(len(node)))
                yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[root[own]])], ["a", "b"])
                held, rows = [], 0

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a long, b long); component is the smallest id reachable.

    Alternates large-star and small-star steps (each a min per node and a join), every step
    written to the shared folder, until the set of edges stays as it is. Self-links keep a node.
    No component is ever gathered in a task: each step handles single edges.
    """

    def step(e: DataFrame, both: bool) -> DataFrame:
        d = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        if both:
            d = d.union(d.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # One row of minima for each node, joined by the node and a hash of it: so both sides are shuffled for the join, and
        # adaptive execution can split a large node's rows.
        low = d.groupBy("u").agg(F.min("v").alias("m")).select("u", F.xxhash64("u").alias("h"), F.least("u", "m").alias("m"))
        d = lookup(d.withColumn("h", F.xxhash64("u")), low, ["u", "h"], "inner")
        if both:
            out = d.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = d.select(F.col("v").alias("a"), F.col("m").alias("b")).union(d.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def print_of(e: DataFrame) -> tuple:
        h = F.xxhash64("a", "b")
        with shuffles_dropped(e.sparkSession):
            return tuple(e.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())

    nodes = materialise(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "cc-nodes")
    e = materialise(stars(edges.where("a <> b")).distinct(), "cc-edges")
    was = print_of(e)
    while was[0]:
        last, e = e, materialise(step(step(e, True), False), "cc-step")
        discard(last)
        now = print_of(e)
        if now == was:
            break
        was = now
    roots = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
