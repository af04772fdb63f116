"""64-bit hashes of word shingles for whole batches of texts, in numpy.

Words are maximal runs without ASCII white space; A-Z count as a-z.  A word's hash is a polynomial of
random 64-bit codes of its bytes, taken from prefix sums modulo 2**64, so that a batch costs a few
vector operations a byte and no Python object a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; a longer text is hashed alone.
STEP = 1 << 18
_rng = np.random.default_rng(20240229)
CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CODES[65:91] = CODES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15
PLACES = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {}


def scramble(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverses modulo 2**64 for i up to n; kept up to STEP."""
    if len(_powers.get("up", ())) <= n:
        up, down = (np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)], dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64)))
        if n > STEP:
            return up, down
        _powers.update(up=up, down=down)
    return _powers["up"], _powers["down"]


def _words(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word; ``first``: where each text starts, and the end."""
    n = len(data)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _power(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(CODES[data] * up[:n], out=total[1:])
    return scramble((total[end] - total[start]) * down[start]), np.searchsorted(first, start, side="right") - 1


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles.

    With 1 to size - 1 words the whole sequence is one shingle; null, empty and white-space texts have
    none.
    """
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP, side="right")) - 1)
        first = offsets[at : to + 1] - offsets[at]
        word, doc = _words(data[offsets[at] : offsets[to]], first)
        per = np.bincount(doc, minlength=to - at)
        ends = np.cumsum(per)
        full = np.zeros(max(0, len(word) - size + 1), np.uint64)
        for k in range(size if len(full) else 0):
            full += word[k : k + len(full)] * PLACES[k]
        full = scramble(full)
        for count, end in zip(per.tolist(), ends.tolist(), strict=True):
            begin = end - count
            if count >= size:
                yield np.unique(full[begin : end - size + 1])
            elif count:
                yield scramble(np.array([(word[begin:end] * PLACES[8 : 8 + count]).sum(dtype=np.uint64) + np.uint64(count)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
        at = to
