"""Plain versions of pipeline stages."""

from __future__ import annotations

import collections


def lines_left(texts: dict[int, str], min_docs: int) -> dict[int, str]:
    key = lambda line: line.encode().strip().lower()
    where = collections.defaultdict(set)
    for i, t in texts.items():
        for line in (t or "").split("\n"):
            where[key(line)].add(i)
    return {i: "\n".join(x for x in (t or "").split("\n") if not key(x) or len(where[key(x)]) < min_docs) for i, t in texts.items()}


def groups(texts: dict[int, str], n: int = 5) -> dict[int, int]:
    """The smallest id that each document reaches over pairs at 0.8 or more."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().split()
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())
    root = {i: i for i in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
