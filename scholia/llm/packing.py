"""Integers packed for the shuffle, and columns of text cut into pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def squeeze(numbers: np.ndarray) -> bytes:
    """zstd of byte planes, which are mostly zero in the high ones."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes())


def expand(packed: bytes, kind: type) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def ranges(column: pa.Array, most: int = 1 << 20, rows: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive rows (from, to) of a column of strings, about ``most`` bytes and at most ``rows`` rows each; a longer text is alone."""
    n = len(column)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1] if n else np.zeros(1, kind)
    at = 0
    while at < n:
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1))
        yield at, to
        at = to
