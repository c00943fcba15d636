"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations


def shingle_set(text: str | None, least: int = 1) -> frozenset:
    """Five-word shingles, or all words of a shorter text that has `least`."""
    w = (text or "").lower().split()
    if len(w) < least or not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def jaccard_pairs(sets: dict, least: float = 0.8) -> list[tuple]:
    """Keys (a, b), a before b, of sets that are alike; only pairs with something in common are looked at."""
    where: dict = {}
    for k, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(k)
    both: dict = {}
    for ks in where.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1 :]:
                both[a, b] = both.get((a, b), 0) + 1
    return [(a, b) for (a, b), n in both.items() if n >= least * (len(sets[a]) + len(sets[b]) - n) - 1e-9]


def smallest_reachable(nodes, links) -> dict:
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}
