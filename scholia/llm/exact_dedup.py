"""Exact dedup with a heavy-hitter split, in DataFrame operations only.

Texts are equal when identical after lower-casing A-Z.  Their SHA-256 digests are written once;
everything after that reads 32-byte digests, not texts.

1. A Misra-Gries type sketch (``approx_top_k``: Spark's frequent-items aggregate, which merges
   partial sketches of ``SLOTS`` counters) names at most ``HEAVY`` digests that may be frequent.  Every
   digest on more than about ``N / (0.75 * SLOTS)`` rows is among them.
2. Exact counts and winners of those digests are computed (partial aggregation leaves a row per
   digest and task) and broadcast: at most ``HEAVY`` rows, whatever the input.  Heavy rows are
   resolved by a map-side join and never shuffled.
3. The remaining rows are shuffled by digest; no digest among them is frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, quoted
from .slots import parted

#: Digests that may be broadcast, and counters of each sketch (the fixed bound of the broadcast).
HEAVY, SLOTS = 256, 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text with A-Z lower-cased; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER).cast("binary"), 256)


def _winners(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows (id, digest), and keep_id and group_size of the frequent digests (written) and of the others."""
    rows = scratch.keep(docs.select(F.col(quoted(id_col)).alias("id"), text_digest(F.col(quoted(text_col))).alias("digest")), "digests")
    heavy = (
        rows.agg(F.expr(f"approx_top_k(digest, {HEAVY}, {SLOTS})").alias("top"))
        .select(F.explode("top").alias("top"))
        .where("top.count > 1")
        .select(F.col("top.item").alias("digest"))
    )
    best = (F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    winners = scratch.keep(rows.join(F.broadcast(heavy), "digest", "left_semi").groupBy("digest").agg(*best), "winners")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    return rows, winners, rest.groupBy("digest").agg(*best)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays.  Null and empty texts are one group.  A null
    id sorts below all others: it wins only in a group that has no other id (keep_id is then null).
    Rows that repeat an id are counted each; all of them are kept if that id wins.  Other columns
    are ignored, so their names cannot clash.  An empty table gives no rows.
    """
    rows, winners, own = _winners(docs, id_col, text_col, Scratch(docs.sparkSession, "exact"))
    settled = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").join(own, "digest")
    both = settled.unionByName(rest)
    return both.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts: that with the largest id.

    Of rows that repeat id and text one stays, the first by a hash of its columns.  Copies of frequent
    texts go map-side; of the others only rows whose digest may occur twice are shuffled.
    """
    _, winners, own = _winners(docs, id_col, text_col, Scratch(docs.sparkSession, "exact"))
    shared = Scratch(docs.sparkSession, "shared").keep(own.where("group_size > 1").unionByName(winners).select("digest", "keep_id", F.lit(True).alias("shared")), "shared")
    names = [f"c{k}" for k in range(len(docs.columns))]  # by number: a column may have any name
    rows = docs.withColumns({"_id": F.col(quoted(id_col)), "_digest": text_digest(F.col(quoted(text_col)))}).toDF(*names, "id", "digest")
    rows = rows.join(F.broadcast(winners.select("digest", F.col("keep_id").alias("best"), F.lit(True).alias("heavy"))), "digest", "left")
    rows = rows.where(F.col("heavy").isNull() | F.col("id").eqNullSafe(F.col("best")))
    some, alone = parted(rows, "digest", shared)
    some = some.join(shared, "digest", "left").where(F.col("shared").isNull() | F.col("id").eqNullSafe(F.col("keep_id")))
    hashed = F.xxhash64(*[c for c, f in zip(names, docs.schema.fields, strict=True) if "map<" not in f.dataType.simpleString()])
    first = F.row_number().over(Window.partitionBy("digest").orderBy(hashed))
    some = some.withColumn("first", first).where("first = 1")
    return alone.select(*names).unionByName(some.select(*names)).toDF(*docs.columns)
