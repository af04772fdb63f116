"""Hits of all content rules in many texts at once: places that may begin a hit by table, then the patterns at these."""

from __future__ import annotations

import re
from functools import cache

import numpy as np

from .rule_table import FOLDED, OPENINGS, RULES

#: Characters of an opening, looked up two by two; those of a short one, at most.
DEEP, SHORT = 6, 3


@cache
def compiled() -> list[tuple[str, str, re.Pattern]]:
    return [(r.name, r.action, re.compile(r.pattern, re.I)) for r in RULES]


@cache
def _tables() -> tuple[np.ndarray, int, list[np.ndarray]]:
    """The kind of each 16-bit character, the number of kinds, and for each pair of kinds the rules whose hits may have it at their
    first, third and fifth place: a bit each for long openings, and one for short ones, which say nothing about later places.

    Kinds are the characters of openings without case, other digits and white space of ASCII, and two for the rest within and beyond
    ASCII; the latter may be a digit or white space.
    """
    ascii_ = {chr(c).lower(): chr(c) for c in range(128)}
    own = sorted(set("".join(o for os in OPENINGS.values() for o in os.split("|"))) - set("#_·") | {c for c in ascii_ if c.isspace() or c.isdigit()})
    kinds = {c: k + 2 for k, c in enumerate(own)}  # 0: other ASCII, 1: others
    kind = np.ones(1 << 16, np.int32)
    for c in range(128):
        kind[c] = kinds.get(chr(c).lower(), 0)
    for c, k in kinds.items():
        kind[ord(c)] = k
    for c, plain in zip(FOLDED, "iisk", strict=True):
        kind[ord(c)] = kinds[plain]
    n = len(kinds) + 2
    stands = {"#": [1, *(k for c, k in kinds.items() if c.isdigit())], "_": [1, *(k for c, k in kinds.items() if c.isspace())]}
    pairs, always = [np.zeros((n, n), np.uint64) for _ in range(0, DEEP, 2)], [0] * (DEEP // 2)
    for number, rule in enumerate(RULES):
        for opening in OPENINGS[rule.name].split("|"):
            bit = 1 << (number if len(opening) > SHORT else number + 32)
            at = [stands.get(c) or [kinds[c]] if c != "·" else slice(None) for c in opening.ljust(DEEP, "·")]
            for k, table in enumerate(pairs):
                left, right = at[2 * k : 2 * k + 2]
                if left == right == slice(None):
                    always[k] |= bit
                elif slice(None) in (left, right):
                    table[left, right] |= np.uint64(bit)
                else:
                    table[np.ix_(left, right)] |= np.uint64(bit)
    return kind, n, [(t | np.uint64(a)).ravel() for t, a in zip(pairs, always, strict=True)]


def scan(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, rule's number, start, end) of all hits, by text, rule and place; what ``finditer`` finds rule by rule."""
    kind, n, tables = _tables()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.r_[0, np.cumsum(sizes)]
    units = np.frombuffer(("".join(texts) + "\n" * DEEP).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = kind[np.minimum(units, 0xFFFF)]
    pair = kinds[:-1] * n + kinds[1:]
    at = np.flatnonzero(tables[0][pair[: first[-1]]]) if first[-1] else np.zeros(0, np.int64)
    may = tables[0][pair[at]]
    for k, table in enumerate(tables[1:], 1):
        # Past a text's end other characters stand; a hit that ends there has an opening that is as short.
        may = may & table[pair[at + 2 * k]]
        at, may = at[may > 0], may[may > 0]
    may = may | may >> np.uint64(32)
    number = np.searchsorted(first, at, "right") - 1
    place = at - first[number]
    out: list[tuple[int, int, int, int]] = []
    for rule, (_, _, pattern) in enumerate(compiled()):
        chosen = np.flatnonzero(may >> np.uint64(rule) & np.uint64(1))
        match, now, end = pattern.match, -1, 0
        for i, p in zip(number[chosen].tolist(), place[chosen].tolist(), strict=True):
            if i != now:
                now, end = i, 0
            if p >= end and (m := match(texts[i], p)):
                end = m.end()
                out.append((i, rule, p, end))
    found = np.array(out, np.int64).reshape(-1, 4)
    return tuple(found[np.argsort(found[:, 0], kind="stable")].T)
