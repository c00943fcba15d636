"""Words and word shingles of Arrow texts, hashed in numpy over whole batches.

Words are runs of bytes other than ASCII white space, after lower-casing. A shingle is five
consecutive words; a group of one to four words has one shingle, all its words. Hashes of
shingles have 44 bits, so that a group's number fits above them in one sortable integer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mix64

WORDS = 5
HASH_BITS = 44
#: Bytes of text taken at once; a longer text is taken alone.
CHUNK = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
PLACE = mix64(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base to the power of 0..n-1."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, CHUNK + 4096)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * CHUNK:
            _powers[int(base)] = have
    return have[:n]


def chunks(texts: pa.Array, rows: int = 512) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets in them) of the lower-cased texts, about CHUNK bytes at a time; null is empty."""
    for top in range(0, len(texts), rows):
        own = pc.utf8_lower(pc.fill_null(texts.slice(top, rows).cast(pa.large_string()), ""))
        at = np.frombuffer(own.buffers()[1], dtype=np.int64)[own.offset : own.offset + len(own) + 1]
        data = np.frombuffer(own.buffers()[2] or b"", dtype=np.uint8)
        row = 0
        while row < len(own):
            end = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK, "right")) - 1)
            end = min(end, len(own))
            yield top + row, data[at[row] : at[end]], at[row : end + 1] - at[row]
            row = end


def runs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of an ascending array and where each begins."""
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    return group[first], first


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words; no word crosses a row's bounds."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    space = SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = space[:-1]
    before |= edge[:n]
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = space[1:]
    after |= edge[1:]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=total[1:])
    return starts, ends, mix64((total[ends] - total[starts]) * powers(INVERSE, n)[starts])


def shingles(hashes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups and hashes of the distinct shingles, sorted by both. group: of each word, ascending."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = np.flatnonzero(group[WORDS - 1 :] == group[: n - WORDS + 1]) if n >= WORDS else np.zeros(0, np.int64)
    h = np.zeros(len(whole), dtype=np.uint64)
    for k in range(WORDS):
        h += hashes[whole + k] * PLACE[k]
    first = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1])
    size = np.diff(np.append(first, n))
    place = np.arange(n) - np.repeat(first, size)
    short = size < WORDS
    part = np.add.reduceat(np.where(np.repeat(short, size), hashes * PLACE[np.minimum(place, WORDS - 1)], np.uint64(0)), first)
    h = np.concatenate([h, part[short] + size[short].astype(np.uint64)])
    rank = np.repeat(np.arange(len(first)), size)
    key = np.concatenate([rank[whole], rank[first[short]]]).astype(np.uint64)
    h = mix64(h) >> np.uint64(64 - HASH_BITS)
    if len(first) >> (64 - HASH_BITS):  # too many groups for one integer
        order = np.lexsort((h, key))
        key, h = key[order], h[order]
    else:
        key = (key << np.uint64(HASH_BITS)) | h
        key.sort()
        key, h = key >> np.uint64(HASH_BITS), key & np.uint64((1 << HASH_BITS) - 1)
    new = np.append(True, (key[1:] != key[:-1]) | (h[1:] != h[:-1]))
    return group[first][key[new].astype(np.int64)], h[new]


def text_sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each distinct shingle, its hash), chunk by chunk."""
    for row, data, at in chunks(texts):
        starts, _, h = words(data, at)
        yield row, len(at) - 1, *shingles(h, np.searchsorted(at, starts, "right") - 1)


def line_sets(texts: pa.Array, least: int = WORDS) -> Iterator[tuple]:
    """As text_sets for lines: (first row, row of each line, its number in the text, its number
    of words, line of each shingle, its hash). Lines under `least` words have no shingles."""
    for row, data, at in chunks(texts):
        starts, _, h = words(data, at)
        breaks = np.flatnonzero(data == 10)
        where = np.concatenate([np.arange(len(at) - 1), np.searchsorted(at, breaks, "right") - 1])
        line_at = np.concatenate([at[:-1], breaks + 1])
        order = np.lexsort((line_at, where))
        rows, line_at = where[order], line_at[order]
        number = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
        line = np.searchsorted(line_at, starts, "right") - 1
        n_words = np.bincount(line, minlength=len(rows))
        long = n_words[line] >= least if len(line) else np.zeros(0, bool)
        yield row, rows, number, n_words, *shingles(h[long], line[long])
