"""Exact similarity join of the sets of one bounded group, by set-relation skipping.

Two ideas of the public literature on exact set similarity joins. Index level: the inverted lists
hold their entries in blocks by (size of the set, position of the token in it), so blocks that the
length or the positional filter rules out are skipped whole. Answer level: sets alike are
processed next to one another; for one of them (the pivot) overlaps are searched with a slack k,
and the answers of each follower that lacks or adds at most k tokens are derived from the pivot's
overlaps by the tokens in which both differ, without touching the index.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil

EPS = 1e-9


def need(a: int, b: int, t: float) -> int:
    """Least overlap with which sets of sizes a and b have Jaccard similarity t or more."""
    return ceil(t / (1 + t) * (a + b) - EPS)


def similar_sets(sets: list[frozenset], t: float, slack: int = 3) -> Iterator[tuple[int, int]]:
    """Index pairs (i, j), i != j, each unordered pair once, of the distinct non-empty ``sets`` whose Jaccard similarity is at least ``t`` (0 < t <= 1)."""
    n = len(sets)
    if n < 2:
        return
    freq = Counter(x for s in sets for x in s)
    rank = {x: r for r, (x, _) in enumerate(sorted(freq.items(), key=lambda e: (e[1], e[0])))}
    order = [sorted(rank[x] for x in s) for s in sets]
    ids = sorted(range(n), key=lambda i: (len(order[i]), order[i]))

    def prefix(size: int) -> int:
        return size - max(1, ceil(t * size - EPS) - 2 * slack) + 1  # twice: a partner may be larger than size / t by slack / t

    # token -> size -> position -> entries: a block is the list of one size and position
    index: dict[int, dict[int, dict[int, list[int]]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
    for i in ids:
        size = len(order[i])
        for pos in range(prefix(size)):
            index[order[i][pos]][size][pos].append(i)

    place = {i: k for k, i in enumerate(ids)}
    pivot, table = -1, {}
    for i in ids:
        s, size = sets[i], len(sets[i])
        derived = False
        if pivot >= 0:
            p = sets[pivot]
            more, less = s - p, p - s
            if len(more) <= slack and len(less) <= slack and need(size, size, t) > len(more):
                derived = True
                for j, o in table.items():
                    k = len(sets[j])
                    if place[j] <= place[i] or k < size or size < t * k - EPS:
                        continue
                    a = need(size, k, t)
                    if o + len(more) < a:  # the answer of the pivot rules it out
                        continue
                    x = sets[j]
                    for w in more:
                        o += w in x
                    for w in less:
                        o -= w in x
                    if o >= a:
                        yield i, j
        if derived:
            continue
        pivot, table = i, {}
        seen: set[int] = set()
        top = size / t + slack / t
        for pos in range(prefix(size)):
            lists = index.get(order[i][pos])
            if not lists:
                continue
            for k, by_pos in lists.items():
                if k < size or k > top:  # length: whole blocks of other sizes
                    continue
                a = max(1, need(size, k, t) - slack)
                for q, block in by_pos.items():
                    if 1 + min(size - pos - 1, k - q - 1) + min(pos, q) < a:  # position: the whole block
                        continue
                    seen.update(block)
        for j in seen:
            if place[j] <= place[i]:
                continue
            o = len(s & sets[j])
            if o >= max(1, need(size, len(sets[j]), t) - slack):
                table[j] = o
                if o >= need(size, len(sets[j]), t):
                    yield i, j
