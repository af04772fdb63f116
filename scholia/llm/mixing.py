"""Mixing sources to target weights.

Words are aggregated per source, a repetition rate per source follows from its target, and each
document is emitted floor(rate) times plus once more when a number in [0, 1) drawn from a hash of
its id is below the rate's fraction.  Only the table of sources (one row each) meets a window; the
documents are read twice and never sorted or grouped as rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, quoted

WORD = r"[^\x20\x09-\x0D]+"
SEED = 7
#: Sources whose rates are broadcast.
FEW = 1 << 16


def word_count(text: Column) -> Column:
    """Maximal runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _numbered(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """``sizes`` with ``place``: the source's number by code point from 0, null last.

    Sources are sorted in ranges; a row a partition tells how many come before it, so no task sees all.
    """
    whole = sizes.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    # The upper bits of an id that increases are the partition, the lower 33 the row in it.
    whole = whole.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33).cast("int"))
    whole = scratch.keep(whole.withColumn("row", F.expr("at - shiftleft(cast(part AS bigint), 33)")).drop("at"), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = whole.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return whole.join(F.broadcast(parts.select("part", "before")), "part").select(*sizes.columns, (F.col("before") + F.col("row")).alias("place"))


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source (columns source, source_size): target and rate.

    Sources by code point, null last, weigh ``weights`` in turn.  They share ``share`` times all
    words; a target stops at ``most`` times its source's size and the excess goes to the others by
    weight, until none is above.  Each round reads two sums of the table of sources; there are as
    many rounds as sets of sources that stop together.  A source without words gets target and
    rate 0; so does everything if all stop.
    """
    scratch = Scratch(sizes.sparkSession, "targets")
    table = _numbered(sizes, scratch)
    table = table.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int")))
    table = scratch.keep(table.withColumn("cap", F.col("source_size") * F.lit(float(most))), "weighed")
    total = float(share) * float(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, stopped = 0.0, -1
    while True:
        full = (F.col("weight") * F.lit(level) > F.col("cap")) | (F.col("cap") <= 0) if stopped >= 0 else F.col("cap") <= 0
        n, caps, free = table.agg(F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == stopped or free == 0:
            break
        stopped, level = n, (total - caps) / free
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level))
    target = F.when(F.col("cap") <= 0, F.lit(0.0)).otherwise(target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = table.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")
    # Few sources are broadcast, so that one of them with a third of all rows is no task of its own.
    return F.broadcast(out) if table.count() <= FEW else out


def copies_of(rate: Column, doc_id: Column) -> Column:
    """floor(rate) plus a Bernoulli copy drawn from a hash of the id (null ids share one draw)."""
    digest = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(16**13))  # 52 bits
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def plan_mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, copies (columns source and text are read).

    Null and empty texts have size 0.  Null sources are one source, the last.  Rows that repeat an
    id get the same number of copies.  Other columns are ignored.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.keep(docs.select(F.col(quoted(id_col)).alias("id"), "source", word_count(F.col("text")).alias("size")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = targets(sizes, weights, share, most).withColumnRenamed("source", "_source")
    joined = rows.join(rates, F.col("source").eqNullSafe(F.col("_source")))
    return joined.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies_of(F.col("rate"), F.col("id")).alias("copies"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, each as often as ``plan_mix`` says, with the columns they had.

    Rates are joined to the documents by source, so texts are not shuffled by id.
    """
    sizes = docs.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))
    rates = targets(sizes, weights, share, most).select(F.col("source").alias("_source"), F.col("rate").alias("_rate"))
    joined = docs.join(rates, docs["source"].eqNullSafe(F.col("_source")))
    n = copies_of(F.col("_rate"), docs[quoted(id_col)]).cast("int")
    out = joined.select(*[docs[quoted(c)] for c in docs.columns], F.explode(F.array_repeat(F.lit(0), n)).alias("_copy"))
    out = out.toDF(*[f"c{k}" for k in range(len(out.columns))])  # by number: a column may have any name
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
