"""Admission under three tiers against a plain walk over the events, in one task's reach and beyond it."""

import random
from collections import Counter

import pandas as pd
import pytest

from scholia.operators.graph import components
from scholia.sources.scratch import Scratch
from scholia.streaming import admission, state, usage

DDL = "event_id long, ts long, visitor string, ip string"


def walk(events, caps, window):
    """Each event given those admitted before it, with whole lists."""
    admitted, out = [], {}
    for k, t, visitor, ip in sorted(events, key=lambda e: (e[1], e[0])):
        recent = [e for e in admitted if e[0] >= t - window]
        if len(recent) >= caps[0]:
            out[k] = "global"
        elif visitor and sum(e[1] == visitor for e in recent) >= caps[1]:
            out[k] = "visitor"
        elif sum(e[2] == (ip or "") for e in recent) >= caps[2]:
            out[k] = "ip"
        else:
            out[k] = "ok"
            admitted.append((t, visitor, ip or ""))
    return out


def some(seed, n, span, visitors, ips, hot=0.0):
    rng = random.Random(seed)
    pick = lambda kind, k: f"{kind}0" if rng.random() < hot else f"{kind}{rng.randrange(k)}"
    return [(k, rng.randint(0, span), rng.choice([pick("v", visitors), pick("v", visitors), "", None]), rng.choice([pick("i", ips), pick("i", ips), pick("i", ips), None])) for k in range(n)]


def admit(times, cap, window):
    """Which uses of one key are admitted, in turn."""
    stamps, out = [], []
    for t in times:
        stamps = [s for s in stamps if s >= t - window]
        out.append(len(stamps) < cap)
        if out[-1]:
            stamps.append(t)
    return out


CASES = {
    "the site's cap binds all the time": (some(1, 500, 400, 4, 2), (12, 3, 8)),
    "only visitors and addresses refuse": (some(2, 900, 4000, 20, 4), (1000, 2, 3)),
    "the site's cap binds in a rush": (some(3, 500, 4000, 40, 40) + [(1000 + k, 2000 + k % 40, f"v{k}", f"i{k}") for k in range(300)], (60, 3, 8)),
    "a third of all events from one visitor and address": (some(4, 600, 3000, 30, 30, hot=0.33), (40, 3, 8)),
    "a closed site": (some(7, 50, 500, 5, 5), (0, 1, 5)),
}


@pytest.mark.parametrize("name", CASES)
def test_equals_a_plain_walk(spark, monkeypatch, name):
    events, caps = CASES[name]
    if "a third" in name or "rush" in name:  # components beyond a task's reach, in rounds
        monkeypatch.setattr(admission, "ROWS", 20)
        monkeypatch.setattr(admission, "ROUND", 150)
    rows = spark.createDataFrame(events, DDL).repartition(5)
    got = admission.in_turn(rows, caps, 50).collect()
    assert len(got) == len(events) and {r.event_id: r.reason for r in got} == walk(events, caps, 50)


def test_cases_are_of_every_kind():
    kinds = Counter(reason for events, caps in CASES.values() for reason in set(walk(events, caps, 50).values()))
    assert set(kinds) == {"ok", "global", "visitor", "ip"}


def test_window_edges_and_odd_rows(spark):
    """A use counts up to the window's length; rows without a time go; ties go by id; no rows give none."""
    events = [(1, 0, "a", "x"), (2, 50, "a", "x"), (3, 51, "a", "x"), (5, 51, "a", "x"), (4, 51, "a", "x"), (6, -120, "a", None), (7, -70, "a", None), (8, -69, "a", "")]
    rows = spark.createDataFrame([*events, (9, None, "a", "x")], DDL)
    assert {r.event_id: r.reason for r in admission.in_turn(rows, (9, 1, 9), 50).collect()} == walk(events, (9, 1, 9), 50)
    assert admission.in_turn(rows.limit(0), (9, 1, 9), 50).count() == 0
    assert usage.admissions_in_turn(rows.limit(0)).count() == 0


def test_free_events_are_in_no_component(spark):
    """Where bounds show that nobody can refuse, no event waits for another; contested ones part by visitor and address."""
    calm = [(k, k * 10, f"v{k}", f"i{k % 50}") for k in range(400)]
    rush = [(1000 + k, k % 9, f"r{k % 3}", f"j{k % 3}") for k in range(60)]
    scratch = Scratch(spark, "test-admission")
    rows = spark.createDataFrame(calm + rush, DDL).selectExpr("*", f"floor(ts * {admission.FINE} / 50) AS fine")
    parts = {r.event_id: r.component for r in admission._parted(rows, (100, 3, 8), scratch).collect()}
    assert all(parts[k] is None for k, *_ in calm)
    assert len({parts[1000 + k] for k in range(60)}) == 3 and None not in {parts[1000 + k] for k in range(60)}


def test_admissions_of_one_key_in_rounds(spark, monkeypatch):
    rng = random.Random(8)
    events = [(k, rng.choice(["hot", "hot", "b", None]), rng.randint(0, 2000)) for k in range(600)]
    monkeypatch.setattr(admission, "ROWS", 50)
    monkeypatch.setattr(admission, "ROUND", 100)
    got = {(r.event_id, r.key): r.admitted for r in usage.admissions(spark.createDataFrame(events, "event_id long, key string, ts long"), 3, 100).collect()}
    want = {}
    for key in ("hot", "b", None):
        own = sorted((t, k) for k, x, t in events if x == key)
        for (_, k), ok in zip(own, admit([t for t, _ in own], 3, 100)):
            want[k, key] = ok
    assert got == want and False in want.values()


def test_components(spark):
    """A long path, a star, a loop, repeats and null ends."""
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(5, 5), (300, 301), (301, 300), (None, 1), (1, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test-graph")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 7 for k in [7, *range(200, 260)]}, 5: 5, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test-graph")).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    """Files out of order, a restart from the checkpoint, an event too late, and state that empties."""
    rng = random.Random(1)
    events = [(k, rng.choice(["a", "b", "c", None]), rng.randint(0, 3000)) for k in range(300)]
    order = sorted(events, key=lambda e: e[2] + rng.randint(0, 200))
    put = lambda rows: spark.createDataFrame(rows, "event_id long, key string, ts long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get(state.STORE[0])
    spark.conf.set(*state.STORE)

    def run():
        stream = spark.readStream.schema("event_id long, key string, ts long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = state.admissions(stream, 3, 100, "300 seconds", inclusive=False).writeStream.option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        assert out.awaitTermination(300)
        return out.lastProgress["stateOperators"][0]["numRowsTotal"]

    try:
        put(order[:150])
        waiting = run()
        put(order[150:])
        put([(8888, "end", 10**6)])
        put([(7777, "a", 10)])
        left = run()
    finally:
        spark.conf.set(state.STORE[0], before)
    got = {(r.event_id, r.key): r.admitted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {}
    for key in ("a", "b", "c", None):
        own = sorted((t, k) for k, x, t in events if x == key)
        want |= {(k, key): ok for (_, k), ok in zip(own, admit([t for t, _ in own], 3, 99))}
    got.pop((8888, "end"), None)
    assert got == want and False in want.values()
    assert left <= 2 < waiting < 100


@pytest.mark.parametrize("cap", [0, 1, 3, 1000])
def test_keys_are_decided_from_their_seconds(spark, monkeypatch, cap):
    """batches that cut keys, several events a second, equal ids, keys and ids that are null."""
    monkeypatch.setattr(admission, "STRETCH", 7)
    rng = random.Random(5)
    rows = [(rng.choice([k, k % 50, None]), rng.choice(["a", "a", "b", None, "", f"k{k % 30}"]), rng.choice([None, *range(-30, 400, 3), 5, 5])) for k in range(1500)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = usage.admissions(spark.createDataFrame(rows, "event_id long, key string, ts long"), cap, 20).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = Counter()
    for key in {r[1] for r in rows}:
        own = sorted(((t, k is None, k or 0) for k, x, t in rows if x == key and t is not None))
        want.update((None if none else k, key, t, ok) for (t, none, k), ok in zip(own, admit([t for t, _, _ in own], cap, 20)))
    assert Counter(tuple(r) for r in got) == want


def test_a_hot_key_has_no_rounds(spark, monkeypatch):
    """all events of one key, whatever their number."""
    monkeypatch.setattr(admission, "_rounds", None)
    monkeypatch.setattr(admission, "ROWS", 10)
    rows = spark.range(500).selectExpr("id AS event_id", "'global' AS key", "id DIV 2 AS ts")
    assert usage.admissions(rows, 3, 50).where("admitted").count() == 15


@pytest.mark.parametrize("cap", [0, 2, 1000])
def test_a_stream_of_many_keys_has_the_state_of_its_groups(spark, tmp_path, monkeypatch, cap):
    """300 keys in 3 groups, in several files and two runs; ids that are null or long, keys that are null or empty."""
    monkeypatch.setattr(state, "GROUPS", 3)
    rng = random.Random(9)
    rows = [(rng.choice([None, 2**60 + k]), rng.choice(["hot", None, "", f"k{k % 300}"]), rng.randint(1, 2000)) for k in range(1200)]
    rows.sort(key=lambda r: r[2] + rng.randint(0, 100))
    put = lambda part: spark.createDataFrame(part, "event_id long, key string, ts long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    conf = dict([state.STORE, ("spark.sql.execution.arrow.maxRecordsPerBatch", "7")])
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)

    def run():
        stream = spark.readStream.schema("event_id long, key string, ts long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = state.admissions(stream, cap, 60, "200 seconds").writeStream.option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        assert out.awaitTermination(300)
        # an element list, uses and two entries of a timer, for each group
        assert out.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3 * 4

    try:
        put([*rows[:600], (None, "no time", None)])
        run()
        for part in (rows[600:900], rows[900:], [(1, None, 10**6)]):
            put(part)
        run()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = Counter()
    for key in {r[1] for r in rows}:
        own = sorted((t, k is None, k or 0) for k, x, t in rows if x == key)
        want.update((None if none else k, key, t, ok) for (t, none, k), ok in zip(own, admit([t for t, _, _ in own], cap, 60)))
    assert Counter(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.ts < 10**6) == want


class Rows(list):
    """A list state."""

    reads = 0

    def exists(self):
        return bool(self)

    def get(self):
        self.reads += 1
        return list(self)

    def put(self, rows):
        self[:] = rows

    def appendValue(self, row):
        self.append(row)


class Handle(dict):
    timers = ()

    def getListState(self, name, schema):
        return self.setdefault(name, Rows())

    def registerTimer(self, at):
        self.timers = (*self.timers, at)


class Now:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at * 1000


def batch(*rows):
    return pd.DataFrame(rows, columns=["event_id", "nameless", "key", "ts"])


def test_a_group_is_decided_once_for_a_watermark():
    """the second of two timers that have come reads nothing; keys that are gone don't stay in the state."""
    handle, gate = Handle(), state.Admission(1, 10)
    gate.init(handle)
    list(gate.handleInputRows((0,), iter([batch((2, False, "b", 5), (1, False, None, 5)), batch((3, False, None, 14), (4, False, "b", 16), (5, False, "a", 90))]), None))
    got = [pd.concat(gate.handleExpiredTimer((0,), Now(20), None)), pd.concat(gate.handleExpiredTimer((0,), Now(20), None))]
    assert len(got[1]) == 0 and handle["waiting"].reads == 1 and handle.timers == (5000, 90000)
    assert {r.event_id: r.admitted for r in got[0].itertuples()} == {1: True, 2: True, 3: False, 4: True}
    held = {name: state.unpacked(handle[name]).to_pylist() for name in ("waiting", "stamps")}
    assert [r["event_id"] for r in held["waiting"]] == [5] and [r["event_id"] for r in held["stamps"]] == [4]
    assert state.pa.ipc.open_stream(handle["waiting"][0][0]).read_all()["key"].chunk(0).dictionary.to_pylist() == ["a"]


@pytest.mark.parametrize("cap, size", [(0, 9), (2, 1), (2, 9), (3, 10**6), (1000, 9)])
def test_a_group_is_decided_in_slices_of_time(monkeypatch, cap, size):
    """a hot group's events are decided in turn, some at once, over several watermarks."""
    for name in ("SLICE", "ELEMENT", "PIECE"):
        monkeypatch.setattr(state, name, size)
    rng, handle, got = random.Random(4), Handle(), []
    events = [(k, False, rng.choice(["hot", "hot", None, f"k{k % 9}"]), rng.randint(1, 400)) for k in range(500)]
    lag = [rng.randrange(60) for _ in events]
    for low, high in ((0, 90), (90, 91), (91, 300), (300, 500), (500, 700)):
        gate = state.Admission(cap, 50)
        gate.init(handle)
        rows = [e for e in events if low < e[3] + lag[e[0]] <= high]
        for part in (rows[::2], rows[1::2]):
            if part:
                list(gate.handleInputRows((0,), iter([batch(*part)]), None))
        got += [r for part in gate.handleExpiredTimer((0,), Now(high - 60), None) for r in part.itertuples(index=False, name=None)]
    want = {}
    for key in {e[2] for e in events}:
        own = sorted((t, k) for k, _, x, t in events if x == key)
        want |= {k: (key, t, ok) for (t, k), ok in zip(own, admit([t for t, _ in own], cap, 50))}
    assert len(got) == len(events) and {k: rest for k, *rest in got} == {k: list(v) for k, v in want.items()}
    assert not handle["waiting"] and not handle["stamps"]
