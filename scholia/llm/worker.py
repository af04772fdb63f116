"""What a Python worker holds between tasks, and when it gives it back.

Spark reuses workers, for stages of other operators too.  An operator may keep what it has learned from
task to task; as soon as a task of another one begins, that is dropped.  At the end of each task free
memory goes back to the system, which neither Arrow's pool nor the C library does on its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

_kept: dict[str, Callable[[], None]] = {}


def keep(name: str, drop: Callable[[], None]) -> None:
    """This worker keeps something for the operator ``name`` until a task of another one calls ``drop``."""
    _kept[name] = drop


def _begin(name: str) -> None:
    for other in [k for k in _kept if k != name]:
        _kept.pop(other)()


def _end() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        return


def batches_of(name: str, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for ``mapInArrow``, as a task of the operator ``name``."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(name)
        try:
            yield from run(batches)
        finally:
            _end()

    return task
