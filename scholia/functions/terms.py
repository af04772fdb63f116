"""Tokens of many texts at once: their places and the tokens themselves as arrays, without an object for each."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa

#: Letters and digits that aren't read in pairs, for Python's engine; the ideographs left out are newer than the SQL engine's tables.
OTHERS = "[^\\W_\u4e00-\u9fff\U0002ebf0-\U0002ee5d]+"


@cache
def _kinds() -> np.ndarray:
    """Of each code point: 0 for what is between tokens, 1 for a part of a run, 2 for a Han character, read in pairs."""
    out = np.zeros(0x110000, np.uint8)
    for run in re.finditer(OTHERS, "".join(map(chr, range(0x110000)))):
        out[run.start() : run.end()] = 1
    out[0x4E00:0xA000] = 2
    return out


class Tokens:
    """Pairs of Han characters (what is left of a run is alone) and runs of other letters and digits, of texts in lower case.

    ``row``: the number of a token's text; ``size``: its characters.
    """

    def __init__(self, texts: list[str]):
        joined = "".join(texts)
        self.plain = joined.isascii()
        self.units = np.frombuffer(joined.encode() if self.plain else joined.encode("utf-32-le"), np.uint8 if self.plain else np.uint32)
        kind = _kinds()[self.units]
        first = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]
        edge = np.ones(len(kind) + 1, bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[first] = True
        at = np.flatnonzero(edge)
        own = kind[at[:-1]] > 0
        start, end = at[:-1][own], at[1:][own]
        han = kind[start] == 2
        if han.any():
            pieces = np.where(han, (end - start + 1) // 2, 1)
            of = np.repeat(np.arange(len(start)), pieces)
            start = start[of] + 2 * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            end = np.where(han[of], np.minimum(start + 2, end[of]), end[of])
        self.start, self.end = start, end
        self.row, self.size = np.searchsorted(first, start, "right") - 1, end - start

    def only(self, chosen: np.ndarray) -> Tokens:
        for name in ("start", "end", "row", "size"):
            setattr(self, name, getattr(self, name)[chosen])
        return self

    def strings(self) -> pa.Array:
        inside = np.zeros(len(self.units) + 1, np.int8)
        inside[self.start] = 1
        inside[self.end] -= 1
        units = self.units[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
        offsets = np.r_[0, np.cumsum(self.size)]
        data = units.tobytes()
        if not self.plain:
            data = data.decode("utf-32-le").encode()
            offsets = np.r_[0, np.cumsum(1 + (units >= 0x80).astype(np.int64) + (units >= 0x800) + (units >= 0x10000))][offsets]
        return pa.StringArray.from_buffers(len(self.size), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def places(row: np.ndarray) -> np.ndarray:
    """The number of each element within those of its row, for rows in order."""
    begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
    return np.arange(len(row)) - np.repeat(begin, np.diff(np.r_[begin, len(row)]))
