"""Admission under three tiers, in parallel: who is refused can depend only on few others.

A tier refuses an event if the uses that it admitted in the window before it reach its cap.  What was offered bounds what was
admitted: where even that stays below the cap, the tier cannot refuse, and nobody needs to know its
count.  Bounds come from counts per key and slot, an eighth of a window long; the site's also from its
visitors and addresses, none of which has more than its own cap in a window.

The events that a slot with a possible refusal looks back on are a stretch of its key; stretches in turn
with an event in common are a component.  Components don't touch each other, so each is decided in the
order of time on its own; events in none are admitted.  Where the site's cap may be reached, the site's stretch joins
all events of that time in one component.

Small components are decided together, a task for about ``ROWS`` events.  Larger ones go in rounds: their events
are put in order by ranges of about ``ROUND`` events, and each round hands on, by component, the admitted uses of the last window.

Where keys are decided each on its own (``by_key``), only the first ``cap`` events of a second can be admitted, and at the cap nothing
is until the oldest use leaves.  So a key's walk needs how many events its seconds have, and not the events.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import places
from ..operators.graph import components
from ..sources.scratch import Scratch
from .state import decided

#: Slots of a window; events of a task; events of a round.
FINE, ROWS, ROUND = 8, 1 << 16, 1 << 20
NEVER = (1 << 62) - 1
#: Seconds of a key that are one row.
STRETCH = 3600


class Turnstile:
    """Decisions in the order of time: the site's cap, then the visitor's, then the address'.

    Only admitted uses count.  Those of the last window are remembered.
    """

    def __init__(self, caps: tuple[int, int, int], window: int, uses: Iterable[tuple[int, str | None, str]] = ()):
        self.caps, self.window = caps, window
        self.uses: deque[tuple[int, str | None, str]] = deque(uses)
        self.counts: Counter[tuple[str, str | None]] = Counter()
        for _, visitor, ip in self.uses:
            self.counts.update((("v", visitor), ("i", ip)))

    def decide(self, ts: int, visitor: str | None, ip: str) -> str:
        while self.uses and self.uses[0][0] < ts - self.window:
            _, old_visitor, old_ip = self.uses.popleft()
            for key in (("v", old_visitor), ("i", old_ip)):
                self.counts[key] -= 1
                if not self.counts[key]:
                    del self.counts[key]
        site, own, address = self.caps
        if len(self.uses) >= site:
            return "global"
        if visitor and self.counts["v", visitor] >= own:
            return "visitor"
        if self.counts["i", ip] >= address:
            return "ip"
        self.uses.append((ts, visitor, ip))
        self.counts.update((("v", visitor), ("i", ip)))
        return "ok"


def _offered(rows: DataFrame, key: str) -> DataFrame:
    """(key, fine, n, offered) per key and slot: its events, and those of the slot and the ``FINE`` before it."""
    per = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"), "fine").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("offered", F.sum("n").over(Window.partitionBy("key").orderBy("fine").rangeBetween(-FINE, 0)))


def _stretches(busy: DataFrame, tier: int) -> DataFrame:
    """(key, fine, stretch) for the slots that busy ones (key, fine) look back on; overlapping looks are one stretch."""
    by_key = Window.partitionBy("key").orderBy("fine")
    begin = F.coalesce(F.col("fine") - F.lag("fine").over(by_key) > FINE, F.lit(True))
    told = busy.withColumn("begin", F.when(begin, F.col("fine"))).withColumn("begin", F.last("begin", ignorenulls=True).over(by_key))
    told = told.select("key", F.xxhash64(F.lit(tier), "key", "begin").alias("stretch"), F.explode(F.sequence(F.col("fine") - FINE, "fine")).alias("fine"))
    return told.distinct()


def _capped(offered: DataFrame, cap: int) -> DataFrame:
    """(fine, most): what a tier admits in the window of any event of a slot, at most."""
    reach = offered.select("key", "n", F.explode(F.sequence("fine", F.col("fine") + FINE)).alias("fine")).groupBy("key", "fine").agg(F.sum("n").alias("n"))
    return reach.groupBy("fine").agg(F.sum(F.least("n", F.lit(cap))).alias("most"))


def _parted(rows: DataFrame, caps: tuple[int, int, int], scratch: Scratch) -> DataFrame:
    """``rows`` with their component; null where no tier can refuse."""
    site, own, address = caps
    visitors, ips = scratch.keep(_offered(rows, "visitor"), "visitors"), scratch.keep(_offered(rows, "ip"), "ips")
    nobody = rows.where("visitor is null").groupBy("fine").agg(F.count(F.lit(1)).alias("n"))
    nobody = nobody.select(F.explode(F.sequence("fine", F.col("fine") + FINE)).alias("fine"), "n").groupBy("fine").agg(F.sum("n").alias("anonymous"))
    whole = _offered(rows.withColumn("site", F.lit("")), "site")
    bounds = whole.join(_capped(ips, address).withColumnRenamed("most", "by_ip"), "fine").join(_capped(visitors, own).withColumnRenamed("most", "by_visitor"), "fine", "left").join(nobody, "fine", "left")
    by_visitor = F.coalesce("by_visitor", F.lit(0)) + F.coalesce("anonymous", F.lit(0))
    busy = bounds.where((F.col("offered") > site) & (F.col("by_ip") >= site) & (by_visitor >= site)).select("key", "fine")
    of_site = _stretches(busy, 0).select("fine", F.col("stretch").alias("site"))
    of_visitor = _stretches(visitors.where(F.col("offered") > own).select("key", "fine"), 1).select(F.col("key").alias("visitor"), "fine", F.col("stretch").alias("by_visitor"))
    of_ip = _stretches(ips.where(F.col("offered") > address).select("key", "fine"), 2).select(F.col("key").alias("ip"), "fine", F.col("stretch").alias("by_ip"))
    tied = rows.join(of_visitor, ["visitor", "fine"], "left").join(of_ip, ["ip", "fine"], "left").join(of_site, "fine", "left")
    tied = scratch.keep(tied.withColumn("first", F.coalesce("site", "by_ip", "by_visitor")), "tied")
    ends = F.explode(F.array_compact(F.array("first", "by_ip", "by_visitor")))
    labels = components(tied.where("first is not null").select(F.col("first").alias("a"), ends.alias("b")).distinct(), scratch)
    return tied.join(labels, F.col("first") == F.col("node"), "left").drop("site", "by_visitor", "by_ip", "first", "node")


def in_turn(events: DataFrame, caps: tuple[int, int, int], window: int, along: list[str] | None = None) -> DataFrame:
    """(``along``, event_id, ts, reason) for events(event_id, ts long, visitor, ip), decided in order of time and then of id.

    An event that one tier refuses uses up none of the others.  An event without a visitor (null or
    empty) has no cap of its own; one without an address has the address ''.  Caps of zero refuse all.  Rows without a time
    are left out.  Several events of one id and time are decided one after the other in an order of ``along``, visitor and address.
    """
    along = along or []
    spark, keep = events.sparkSession, [*along, "event_id", "ts"]
    scratch, result = Scratch(spark, "admission"), Scratch(spark, "admission-result")
    rows = events.where("ts is not null").select(*keep, F.nullif("visitor", F.lit("")).alias("visitor"), F.coalesce("ip", F.lit("")).alias("ip"), F.floor(F.col("ts") * FINE / window).alias("fine"))
    rows = scratch.keep(rows, "events")
    parted = scratch.keep(_parted(rows, caps, scratch), "parted")
    held = parted.where("component is not null")
    sizes = scratch.keep(held.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "sizes")
    total, large = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("size") > ROWS, F.col("size"))), F.lit(0))).first()
    types = {f.name: f.dataType.simpleString() for f in parted.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", reason string"
    order = ["component", "ts", "event_id", *along, "visitor", "ip"]

    def decide(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in order])
        reasons, now, gate = [], None, Turnstile(caps, window)
        for c, *use in zip(*(rows.column(x).to_pylist() for x in ("component", "ts", "visitor", "ip")), strict=True):
            if c != now:
                now, gate = c, Turnstile(caps, window)
            reasons.append(gate.decide(*use))
        return rows.select(keep).append_column("reason", pa.array(reasons, pa.string()))

    small = held.join(sizes.where(F.col("size") <= ROWS).select("component"), "component", "left_semi")
    parts = max(1, math.ceil((total - large) / ROWS))
    decided = small.withColumn("part", F.pmod(F.xxhash64("component"), F.lit(parts))).groupBy("part").applyInArrow(decide, schema)
    out = result.keep(parted.where("component is null").select(*keep, F.lit("ok").alias("reason")).unionByName(decided), "decided")
    if large:
        for turn in _rounds(held.join(sizes.where(F.col("size") > ROWS).select("component"), "component", "left_semi"), math.ceil(large / ROUND), caps, window, keep, order, scratch, result):
            out = out.unionByName(turn)
    scratch.end()
    return out


def _rounds(rows: DataFrame, rounds: int, caps: tuple[int, int, int], window: int, keep: list[str], order: list[str], scratch: Scratch, result: Scratch) -> Iterable[DataFrame]:
    """Decisions of large components, a table for each range of time; uses of the last window go from range to range."""
    order = [c for c in order if c != "component"]
    ranges = rows.repartitionByRange(rounds, *order).withColumn("turn", F.spark_partition_id()).withColumn("use", F.lit(False)).withColumn("reason", F.lit(None).cast("string"))
    ranges = scratch.keep(ranges, "ranges")
    schema = ranges.drop("turn").schema

    def decide(rows: pa.Table) -> pa.Table:
        plain = lambda table: zip(*(table.column(c).to_pylist() for c in ("ts", "visitor", "ip")), strict=True)
        gate = Turnstile(caps, window, plain(rows.filter(rows["use"]).sort_by("ts")))
        now = rows.filter(pc.invert(rows["use"])).sort_by([(c, "ascending") for c in order])
        reasons = [gate.decide(*use) for use in plain(now)]
        now = now.set_column(now.column_names.index("reason"), now.schema.field("reason"), pa.array(reasons, pa.string()))
        n = len(gate.uses)
        held = dict(zip(("ts", "visitor", "ip"), zip(*gate.uses, strict=True), strict=True)) if n else {}
        left = held | {"use": [True] * n, "component": [rows["component"][0].as_py()] * n}
        return pa.concat_tables([now, pa.table([pa.array(left.get(f.name, [None] * n), f.type) for f in now.schema], schema=now.schema)])

    state = None
    for turn in range(rounds):
        own = ranges.where(F.col("turn") == turn).drop("turn")
        after = scratch.keep((own if state is None else own.unionByName(state)).groupBy("component").applyInArrow(decide, schema), "uses")
        state = after.where("use")
        yield result.keep(after.where("not use").select(*keep, "reason"), "turn")


def by_key(events: DataFrame, cap: int, window: int) -> DataFrame:
    """(event_id, key, ts, admitted) for events(event_id, key, ts long), each key in order of time and then of id.

    A null key is a key; rows without a time are left out.  The seconds of a key come to one task, an hour of them a row; of events it
    sees their number alone.
    """
    rows = events.where("ts is not null").select("event_id", "key", "ts", F.coalesce(F.concat(F.lit("="), "key"), F.lit("none")).alias("own"))
    seconds = rows.groupBy("own", "ts").agg(F.least(F.count(F.lit(1)), F.lit(max(0, cap))).alias("n"))
    hours = seconds.groupBy("own", F.floor(F.col("ts") / STRETCH).alias("hour")).agg(F.array_sort(F.collect_list(F.struct("ts", "n"))).alias("seconds"))
    walked = hours.repartition("own").sortWithinPartitions("own", "hour").select("own", F.col("seconds.ts").alias("ts"), F.col("seconds.n").alias("n"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stamps = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            ts, n = (batch.column(k).flatten().to_numpy() for k in (1, 2))
            code = np.repeat(coded.indices.to_numpy(), batch.column(1).value_lengths().to_numpy())  # of seconds
            key, at = np.repeat(code, n), np.repeat(ts, n)  # of events
            late = np.flatnonzero(places(key) >= cap)
            begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            end = np.r_[begin[1:], len(key)]
            # Without so many in a window none is refused; a batch's first and last key may go on in others.
            one_by_one = {0, len(begin) - 1, *(np.searchsorted(begin, late[at[late] - at[late - cap] <= window], "right") - 1).tolist()}
            admitted = np.ones(len(key), np.int64)
            for k in sorted(one_by_one):
                own = coded.dictionary[int(key[begin[k]])].as_py()
                admitted[begin[k] : end[k]], left = decided(at[begin[k] : end[k]], stamps if own == now else [], cap, window)
                if k == len(begin) - 1:
                    now, stamps = own, left
            taken = np.add.reduceat(admitted, np.r_[0, np.cumsum(n)[:-1]])
            some = taken > 0
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[some])), pa.array(ts[some]), pa.array(taken[some])], names=["own", "ts", "taken"])

    taken = walked.where(F.lit(cap > 0)).mapInArrow(run, "own string, ts long, taken long")
    taken = Scratch(events.sparkSession, "admission-result").keep(taken, "taken")
    turn = F.row_number().over(Window.partitionBy("own", "ts").orderBy(F.asc_nulls_last("event_id")))
    joined = rows.withColumn("turn", turn).join(taken, ["own", "ts"], "left")
    return joined.select("event_id", "key", "ts", F.coalesce(F.col("turn") <= F.col("taken"), F.lit(False)).alias("admitted"))
