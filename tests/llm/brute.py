"""Plain versions of the operators, for small inputs."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def similar(sets):
    """Pairs of keys of ``sets`` with Jaccard similarity of 0.8 or more."""
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    out = []
    for i, s in sets.items():
        shared = Counter(j for x in s for j in where[x] if j < i)
        out += [(i, j) for j, n in shared.items() if 100 * n >= 80 * (len(s) + len(sets[j]) - n)]
    return out


def fill(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by source, the excess shared anew until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set(s for s in names if not sizes[s])
    while True:
        free = [s for s in names if s not in full]
        level = (total - sum(most * sizes[s] for s in full)) / (sum(weight[s] for s in free) or 1)
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in names}
        full |= over
