"""Admission by key as a stream: decisions in the order of event time, with state that stays small.

Keys are dealt in ``GROUPS`` groups, so that what a call of the state costs is paid by the group and not by the key.  A group's
state is two lists: events that wait for the watermark, packed as they come in batches (a hot key has too many for
an element each), and the admitted uses in the window, ``cap`` of a key at most.  An event is decided by a timer at its time, i.e.
once the watermark says that nothing before it will come; so a
stream decides as a batch does, in whatever order files bring the events.  A last timer empties a group
that has been quiet for a window.  Events later than the watermark are left out by Spark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed lists and timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Without a count of its rows, for which the store reads a whole list each time that something is added to it.
UNCOUNTED = ("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")
OUTPUT = "event_id long, key string, ts long, admitted boolean"
#: Groups of keys; a stream that goes on from a checkpoint must have as many as before.
GROUPS = 1 << 10
#: Events that are decided at once, in turn of time; events of an element of the state that is put anew; decisions that are given on at once.
SLICE, ELEMENT, PIECE = 1 << 20, 1 << 18, 1 << 16
#: What waits, and the same as it is packed.
WAITING, ENCODED = (pa.schema([("event_id", pa.int64()), ("nameless", pa.bool_()), ("key", key), ("ts", pa.int64())]) for key in (pa.string(), pa.dictionary(pa.int32(), pa.string())))


def decided(ts: np.ndarray, stamps: list[int], cap: int, reach: int) -> tuple[np.ndarray, list[int]]:
    """Which events, in the order of time, are admitted after uses at ``stamps``, and the uses that still count then.

    At the cap all events are refused until the oldest use leaves, so the cost is that of the admitted ones.
    """
    admitted, at = np.zeros(len(ts), bool), 0
    while at < len(ts):
        stamps = [s for s in stamps if s >= ts[at] - reach]
        if len(stamps) < cap:
            admitted[at] = True
            stamps.append(int(ts[at]))
            at += 1
        else:
            at = int(np.searchsorted(ts, stamps[0] + reach, "right")) if stamps else len(ts)
    return admitted, stamps


def packed(events: pd.DataFrame | pa.Table) -> tuple[bytes]:
    """An element of the state: those columns of ``WAITING`` that ``events`` has, and the keys that occur."""
    if isinstance(events, pd.DataFrame):
        events = pa.Table.from_pandas(events, pa.schema([f for f in WAITING if f.name in events.columns]), preserve_index=False)
    if "key" in events.column_names:
        at = events.column_names.index("key")
        events = events.set_column(at, "key", pc.dictionary_encode(events["key"].combine_chunks()))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, events.schema) as out:
        out.write_table(events)
    return (sink.getvalue().to_pybytes(),)


def plain(events: pa.Table) -> pa.Table:
    return events.cast(WAITING)


def unpacked(elements: Iterable[tuple[bytes]]) -> pa.Table:
    """The events of all elements."""
    tables = [pa.ipc.open_stream(e).read_all() for (e,) in elements]
    return pa.concat_tables([ENCODED.empty_table(), *tables])


class Admission(StatefulProcessor):
    """Decides the events of a group's keys, each key's in turn; ``reach`` seconds before an event its uses still count."""

    def __init__(self, cap: int, reach: int):
        self.cap, self.reach = cap, reach

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events binary")
        self.stamps = handle.getListState("stamps", "uses binary")
        self.done: set[Any] = set()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            self.waiting.appendValue(packed(batch))
            low = int(batch["ts"].min())
            first = low if first is None else min(first, low)
        self.handle.registerTimer(first * 1000)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if key in self.done:  # the first of its timers decided all that the watermark has passed
            yield pd.DataFrame()
            return
        self.done.add(key)
        last = timerValues.getCurrentWatermarkInMs() // 1000
        uses, waiting = (unpacked(state.get() if state.exists() else []) for state in (self.stamps, self.waiting))
        at = waiting["ts"].to_numpy()
        ends = np.unique([*np.sort(at[at <= last])[SLICE::SLICE], last])
        turn, some = np.searchsorted(ends, at), False
        for k, end in enumerate(ends.tolist()):
            rows = pa.concat_tables([uses, waiting.filter(pa.array(turn == k))]).unify_dictionaries().combine_chunks()
            order, admitted = self.decide(rows, np.arange(len(rows)) < len(uses))
            ts, new = rows["ts"].to_numpy()[order], np.flatnonzero(order >= len(uses))
            rows = rows.take(pa.array(order))
            uses = rows.filter(pa.array(admitted & (ts + self.reach >= end)))
            for first in range(0, len(new), PIECE):
                piece, some = new[first : first + PIECE], True
                own = plain(rows.take(pa.array(piece)))
                event = pd.arrays.IntegerArray(own["event_id"].to_numpy(), own["nameless"].to_numpy())
                yield pd.DataFrame({"event_id": event, "key": own["key"].to_pandas(), "ts": ts[piece], "admitted": admitted[piece]})
        left = waiting.filter(pa.array(turn == len(ends)))
        for state, table in ((self.waiting, left), (self.stamps, uses)):
            if len(table):
                state.put([packed(plain(table.slice(first, ELEMENT))) for first in range(0, len(table), ELEMENT)])
            elif state.exists():
                state.clear()
        if len(left):
            self.handle.registerTimer(pc.min(left["ts"]).as_py() * 1000)
        elif len(uses):
            self.handle.registerTimer((pc.max(uses["ts"]).as_py() + self.reach + 1) * 1000)
        if not some:
            yield pd.DataFrame()

    def decide(self, rows: pa.Table, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of ``rows``, by key and time, ``used`` ones first, and in that order which are admitted, as used ones were."""
        code = np.concatenate([np.empty(0, np.int64), *(c.indices.fill_null(-1).to_numpy() for c in rows["key"].chunks)])
        order = np.lexsort((rows["event_id"].to_numpy(), rows["nameless"].to_numpy(), rows["ts"].to_numpy(), ~used, code))
        code, ts, used = code[order], rows["ts"].to_numpy()[order], used[order]
        if self.cap <= 0:
            return order, used
        admitted = np.ones(len(code), bool)
        begin = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
        end = np.r_[begin[1:], len(code)]
        # Without so many in a window none is refused.
        near = np.flatnonzero((code[self.cap :] == code[: -self.cap]) & (ts[self.cap :] - ts[: -self.cap] <= self.reach)) + self.cap
        for k in np.unique(np.searchsorted(begin, near, "right") - 1).tolist():
            first = begin[k] + int(used[begin[k] : end[k]].sum())
            admitted[first : end[k]], _ = decided(ts[first : end[k]], ts[begin[k] : first].tolist(), self.cap, self.reach)
        return order, admitted

    def close(self) -> None:
        pass


def admissions(events: DataFrame, cap: int, window: int, late: str = "1 hour", inclusive: bool = True) -> DataFrame:
    """(event_id, key, ts, admitted) for a stream events(event_id, key, ts long), as soon as nothing earlier can come.

    Without ``inclusive`` a use that is exactly ``window`` seconds old no longer counts.  The session's state store
    must be ``STORE``, and should be ``UNCOUNTED`` if a key can be hot.  A null key is a key; rows without a time are left out.
    """
    nameless, group = F.col("event_id").isNull().alias("nameless"), F.pmod(F.xxhash64("key"), F.lit(GROUPS)).alias("group")
    rows = events.where("ts is not null").select(group, F.coalesce("event_id", F.lit(0)).alias("event_id"), nameless, "key", "ts", F.timestamp_seconds("ts").alias("at"))
    return rows.withWatermark("at", late).groupBy("group").transformWithStateInPandas(Admission(cap, window if inclusive else window - 1), OUTPUT, "Append", "EventTime")
