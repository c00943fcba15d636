"""Exact Jaccard links inside candidate components, in blocks.

A component's members are dealt to blocks of a bounded size; every pair of blocks is one unit
of work, so a component of any size is spread over tasks, and no pair is ever a row. Each unit
counts links per member and keeps a spanning forest of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forest_roots, hold, key_groups, materialise
from .shingles import text_sets

#: Members, and bytes of their texts, that a block has at most on average.
BLOCK, BYTES = 512, 1 << 22
#: Units of fewer members are compared several at a time, up to so many members together.
BUNDLE = 128
#: Columns of the incidence matrix multiplied at once.
WIDTH = 4096


def overlaps(row: np.ndarray, token: np.ndarray, n: int) -> np.ndarray:
    """Sizes of the common sets of all pairs of n sets, given as (row, token), without repeats."""
    _, col, df = np.unique(token, return_inverse=True, return_counts=True)
    own = df[col] > 1
    row, col = row[own], col[own]
    _, col = np.unique(col, return_inverse=True)
    out = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for low in range(0, int(col[-1]) + 1 if len(col) else 0, WIDTH):
        a, b = np.searchsorted(col, [low, low + WIDTH])
        m = np.zeros((n, min(WIDTH, int(col[b - 1]) - low + 1)), dtype=np.float32)
        m[row[a:b], col[a:b] - low] = 1
        out += m @ m.T
    return out


def block_pairs(members: DataFrame, component: str = "component", member: str = "member") -> DataFrame:
    """members with unit columns (component, i, j): a row for each pair of blocks its block is in.

    The number of blocks follows the component's members and bytes, so a unit has about two blocks at most, of short
    texts or of long ones, and a text is sent once for each block.
    """
    # Written first, so that adaptive execution can split a large component's rows in the join.
    size = materialise(members.groupBy(component).agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.octet_length("text")) / BYTES)).cast("int").alias("blocks")), "blocks")
    own = members.join(size.hint("merge"), component)
    own = own.withColumn("block", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return own.withColumn("other", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")


def verified(units: DataFrame, least: float, earlier: bool = False) -> DataFrame:
    """(member, links, root) for each member with links in a unit.

    units: component, i, j, block, member (long), copies, text and, if earlier, the order's columns
    o1, o2. links: copies of the members of Jaccard similarity `least` or more, or, if earlier,
    1 where one that stands before is among them; root: the smallest member in reach within the unit.
    """

    def bundle(t: pa.Table, unit: np.ndarray) -> pa.RecordBatch | None:
        n = len(t)
        member, copies, block, i, j = (t.column(c).to_numpy() for c in ("member", "copies", "block", "i", "j"))
        rows, tokens = [], []
        for first, _, r, h in text_sets(pa.chunked_array(t.column("text")).combine_chunks() if t.column("text").num_chunks > 1 else t.column("text").chunk(0)):
            rows.append(r + first)
            tokens.append(h)
        row, token = np.concatenate(rows), np.concatenate(tokens)
        size = np.bincount(row, minlength=n).astype(np.float32)
        both = overlaps(row, token, n)
        linked = both >= np.float32(least) * (size[:, None] + size[None, :] - both) - np.float32(1e-3)
        linked &= (both > 0) & (unit[:, None] == unit[None, :])
        np.fill_diagonal(linked, False)
        # Pairs inside a block belong to the unit of that block alone.
        linked &= (i == j)[:, None] | (block[:, None] != block[None, :])
        if not linked.any():
            return None
        a, b = np.nonzero(linked)
        order = np.argsort(member, kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n)
        root = member[order][forest_roots(n, rank[a], rank[b])][rank]
        if earlier:
            stand = np.empty(n, dtype=np.int64)
            stand[np.lexsort((t.column("o2").to_numpy(), t.column("o1").to_numpy()))] = np.arange(n)
            links = (linked & (stand[None, :] < stand[:, None])).any(1)
        else:
            links = linked @ copies
        own = linked.any(1)
        return pa.RecordBatch.from_arrays([pa.array(member[own]), pa.array(links[own].astype(np.int64)), pa.array(root[own])], ["member", "links", "root"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for t, bounds in key_groups(batches, ["component", "i", "j"]):
            unit, x = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), 0
            while x < len(bounds) - 1:
                y = max(x + 1, int(np.searchsorted(bounds, bounds[x] + BUNDLE, "right")) - 1)
                a, b = int(bounds[x]), int(bounds[y])
                if b - a > 1 and (out := bundle(t.slice(a, b - a), unit[a:b])) is not None:
                    yield out
                x = y

    keys = ["component", "i", "j"]
    dealt = units.select(*keys, "block", "member", "copies", "text", *(["o1", "o2"] if earlier else [])).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "member long, links long, root long")
