"""N-gram Jaccard join by chosen paths.

Every text is its set of five-word shingles. Equal sets are one class. Each run splits the
classes recursively: a path draws min-hash coordinates at random, each with probability
1 / (similarity x coordinates), and goes on in a bucket for each value found there. A small
bucket is compared by brute force; in a large one chunks are, and what a chunk finds alike
goes on as one. Runs are repeated until samples of texts, compared with all others by brute
force, show the target recall. Candidates only join components; the links inside a component
are then all counted exactly.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, forest_roots, hold, key_groups, lookup, materialise, mix64, small_batches, with_ids
from .shingles import runs, text_sets
from .verify import block_pairs, verified

log = logging.getLogger(__name__)

SIMILARITY = 0.8
COORDINATES = 64
BUCKET = 256
RUNS = 12
RECALL = 0.99
AUDIT = 200
#: Audited links from which their recall says enough.
ENOUGH = 100
#: Part of equal coordinates from which two classes are candidates: six standard deviations below SIMILARITY.
ALIKE = 0.5

_seed = mix64(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
XOR, TIMES = (_seed[:COORDINATES] >> np.uint64(32)).astype(np.uint32), (_seed[COORDINATES:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, d1, d2, sig) of documents with words: size and digest of the shingle set, and its
    min-hashes, four bytes each. Of an id's texts the one with the smallest xxhash64 counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for batch in batches:
            for first, rows, row, h in text_sets(batch.column(1)):
                own, at = runs(row)
                if not len(own):
                    continue
                ids = batch.column(0).slice(first, rows).take(pa.array(own))
                low = (mix64(h) >> np.uint64(32)).astype(np.uint32)
                sig = np.empty((len(own), COORDINATES), dtype=np.uint32)
                for k in range(COORDINATES):
                    sig[:, k] = np.minimum.reduceat((low ^ XOR[k]) * TIMES[k], at)
                d1, d2 = (np.add.reduceat(mix64(h ^ np.uint64(s)), at).view(np.int64) for s in (1 << 50, 1 << 51))
                out = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * COORDINATES), len(own), [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([ids, batch.column(2).slice(first, rows).take(pa.array(own)), pa.array(np.diff(np.append(at, len(h)))), pa.array(d1), pa.array(d2), out], ["doc_id", "t", "n", "d1", "d2", "sig"])

    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, "doc_id long, t long, n long, d1 long, d2 long, sig binary")
    one = F.min(F.struct("t", "n", "d1", "d2", "sig")).alias("s")
    return rows.groupBy("doc_id").agg(one).select("doc_id", "s.n", "s.d1", "s.d2", "s.sig")


def chosen(path: np.ndarray, similarity: float) -> np.ndarray:
    """Which coordinates each path goes on by: a truth value for each path and coordinate."""
    h = mix64(path[:, None] ^ _seed[None, :COORDINATES])
    return (h >> np.uint64(11)) < np.uint64(int((1 << 53) / (similarity * COORDINATES)))


def onward(path: np.ndarray, node: np.ndarray, sig: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The (path, node) rows of the next level."""
    row, k = np.nonzero(chosen(path, similarity))
    step = mix64(sig[row, k].astype(np.uint64) + (k.astype(np.uint64) << np.uint64(32)))
    return mix64(path[row] * np.uint64(0xD6E8FEB86659FD93) ^ step), node[row]


def as_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)


def alike(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b) with at least ALIKE of their coordinates equal."""
    same = np.zeros((len(sig), len(sig)), dtype=np.uint8)
    for k in range(COORDINATES):
        same += sig[:, k, None] == sig[None, :, k]
    return np.nonzero(np.triu(same >= ALIKE * COORDINATES, 1))


def first_level(classes: DataFrame, runs: range, similarity: float) -> DataFrame:
    """(path, run, node) where all classes stand at the root of each run."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, sig = batch.column(0).to_numpy(), as_matrix(batch.column(1))
            for r in runs:
                root = mix64(np.full(1, r + 1, dtype=np.uint64))
                path, own = onward(np.repeat(root, len(node)), node, sig, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(np.full(len(path), r, np.int32)), pa.array(own)], ["path", "run", "node"])

    return classes.select("rep", "sig").mapInArrow(run, "path long, run int, node long")


def level(rows: DataFrame, classes: DataFrame, similarity: float, made: list[DataFrame]) -> DataFrame:
    """What one level makes of (path, run, node): candidate links (kind 0: a, b) and the rows of the
    next level (kind 1: path a, node b, run). made: gets the tables that it writes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for t, bounds in key_groups(batches, ["path", "chunk"]):
            node, path, r, large = (t.column(c).to_numpy() for c in ("node", "path", "run", "large"))
            sig = as_matrix(t.column("sig"))
            a, b, kind, runs = [], [], [], []
            for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                p, q = alike(sig[x:y])
                root = forest_roots(y - x, p, q)
                tied = np.flatnonzero(root != np.arange(y - x))
                a.append(node[x + tied])
                b.append(node[x + root[tied]])
                kind.append(np.zeros(len(tied), np.int8))
                runs.append(np.zeros(len(tied), np.int32))
                if large[x]:
                    own = np.flatnonzero(root == np.arange(y - x)) + x
                    path_on, node_on = onward(path[own].view(np.uint64), node[own], sig[own], similarity)
                    a.append(path_on.view(np.int64))
                    b.append(node_on)
                    kind.append(np.ones(len(node_on), np.int8))
                    runs.append(np.full(len(node_on), r[x], np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (kind, a, b, runs)], ["kind", "a", "b", "run"])

    # Written first, so that adaptive execution can split a large bucket's rows in the join.
    size = materialise(rows.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"), "path-sizes")
    made.append(size)
    rows = lookup(rows, size, ["path"], "inner")
    chunks = F.ceil(F.col("size") / BUCKET)
    rows = rows.select("path", "run", "node", (F.col("size") > BUCKET).alias("large"), F.pmod(F.xxhash64("node", "run"), chunks).cast("int").alias("chunk"))
    rows = rows.join(classes.select(F.col("rep").alias("node"), "sig").hint("merge"), "node")
    return rows.repartition("path", "chunk").sortWithinPartitions("path", "chunk", "node").mapInArrow(run, "kind byte, a long, b long, run int")


def candidates(classes: DataFrame, runs: range, similarity: float) -> DataFrame:
    """Candidate links (a, b) of the runs, a spanning forest for each bucket."""
    rows, found, levels = first_level(classes, runs, similarity), None, []
    while True:
        out = materialise(level(rows, classes, similarity, levels), "path-level")
        levels.append(out)
        links = out.where("kind = 0").select("a", "b")
        found = links if found is None else found.unionByName(links)
        rows = out.where("kind = 1").select(F.col("a").alias("path"), "run", F.col("b").alias("node"))
        if rows.isEmpty():
            found = materialise(found.distinct(), "path-found")
            discard(*levels)
            return found


def audit(docs: DataFrame, classes: DataFrame, drawn: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all links of the drawn classes b (rep; AUDIT at most), found by comparing each with every class."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(F.broadcast(drawn), "rep").groupBy("rep").agg(F.min_by("text", F.xxhash64("text")).alias("text")).toArrow()
    if not len(texts):
        return spark.createDataFrame([], "a long, b long")
    parts = [(h, r + first) for first, _, r, h in text_sets(texts.column("text").combine_chunks())]
    token, row = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(token, kind="stable")
    sent = spark.sparkContext.broadcast((token[order], row[order], np.bincount(row, minlength=len(texts)), texts.column("rep").to_numpy()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        token, row, size, rep = sent.value
        bits = np.zeros(1 << 20, dtype=bool)
        bits[token & np.uint64((1 << 20) - 1)] = True
        for batch in batches:
            for first, rows, r, h in text_sets(batch.column(1)):
                n = np.bincount(r, minlength=rows)
                may = bits[h & np.uint64((1 << 20) - 1)]
                r, h = r[may], h[may]
                low, high = np.searchsorted(token, h, "left"), np.searchsorted(token, h, "right")
                reps = high - low
                if not reps.sum():
                    continue
                at = np.arange(reps.sum()) + np.repeat(low - np.cumsum(reps) + reps, reps)
                pair, both = np.unique(np.repeat(r, reps) * len(size) + row[at], return_counts=True)
                x, y = pair // len(size), pair % len(size)
                own = both >= similarity * (n[x] + size[y] - both) - 1e-6
                a, b = batch.column(0).slice(first, rows).to_numpy()[x[own]], rep[y[own]]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    whole = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    # Each class once: links to the others of a class of equal sets say nothing of the search.
    return whole.mapInArrow(run, "a long, b long").join(classes.select(F.col("rep").alias("a")), "a", "left_semi").where("a <> b").distinct()


def measured(known: DataFrame, groups: DataFrame) -> tuple[int, int]:
    """Of the known links how many there are, and how many the components of candidates hold."""
    side = lambda x: groups.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")).hint("merge")
    both = known.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return tuple(both.agg(F.count("*"), F.count(F.when(F.col("ca") == F.col("cb"), 1))).first())


def connected(classes: DataFrame, docs: DataFrame, similarity: float, recall: float, runs: int) -> DataFrame:
    """(node, component) of the classes that runs of chosen paths join.

    The audit's classes are AUDIT of all, drawn by hash, and AUDIT of those that the first runs found a
    candidate for, as most others have no link. Runs go on until the part of the audited links that
    they hold is the recall; where those are under ENOUGH, until the runs before held that part of the classes joined.
    """
    drawn = classes.select("rep").orderBy(F.xxhash64("rep"), "rep").limit(AUDIT)
    known, found, done, was = None, None, 0, None
    while True:
        new = candidates(classes, range(done, done + runs), similarity)
        found, done = new if found is None else found.unionByName(new), done + runs
        groups = materialise(components(found), "path-groups")
        if known is None:
            linked = groups.where("node <> component").select(F.col("node").alias("rep")).orderBy(F.xxhash64("rep"), "rep").limit(AUDIT)
            known = materialise(audit(docs, classes, drawn.union(linked).distinct(), similarity), "path-known")
        n, hit = measured(known, groups)
        joined = groups.where("node <> component").count()
        log.info("chosen paths: %d runs hold %d of %d audited links, %d classes joined", done, hit, n, joined)
        if hit >= recall * n and (n >= ENOUGH or (was is not None and was >= recall * joined)):
            discard(known)
            return groups
        discard(groups)
        was = joined


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, runs: int = RUNS) -> DataFrame:
    """(doc_id, class_id, n_links) for every row of docs (doc_id, text).

    class_id is the smallest doc_id reachable over links, n_links the number of other documents whose
    five-word shingle sets have Jaccard similarity `similarity` or more with this one's; those
    with equal sets are linked. Texts without words, null texts and null ids have no links and
    are their own class (null for a null id). Rows that share a doc_id are one document; of
    its texts the one with the smallest xxhash64 counts. Ids are integers. Other columns are left out.
    """
    small_batches(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialise(signatures(docs), "path-sigs")
    own = signed.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    own = materialise(own, "path-classes")
    classes = materialise(signed.select(F.col("doc_id").alias("rep"), "sig").join(own.select("rep", "copies").hint("merge"), "rep"), "path-reps")

    groups = connected(classes, docs, similarity, recall, runs)
    members = groups.withColumnRenamed("node", "doc_id")
    texts = with_ids(docs, members, "doc_id").groupBy("doc_id", "component").agg(F.min_by("text", F.xxhash64("text")).alias("text")).join(own.select(F.col("rep").alias("doc_id"), "copies").hint("merge"), "doc_id")
    members = materialise(texts.withColumnRenamed("doc_id", "member"), "path-members")
    seen = materialise(verified(block_pairs(members), similarity), "path-links")
    discard(members)
    links = seen.groupBy(F.col("member").alias("rep")).agg(F.sum("links").alias("links"))
    classed = components(seen.select(F.col("member").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "rep", "component": "class_id"})
    result = own.select("n", "d1", "d2", "rep", "copies").join(links, "rep", "left").join(classed, "rep", "left")
    result = result.select("n", "d1", "d2", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    per_doc = lookup(signed.select("doc_id", "n", "d1", "d2"), result, ["n", "d1", "d2"]).select("doc_id", "class_id", "n_links")
    return ids.join(per_doc.hint("merge"), "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Shingle sets of five words, all pairs that share one, and the smallest id in reach of each document.
OP7_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\t\\n\\v\\f\\r ]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS class_id FROM r GROUP BY ALL),
k AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY ALL)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM documents JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""
