"""Connected components of links between numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): for each end of ``links`` (a long, b long) the smallest number it is linked with, itself included.

    Each node takes the smallest label among its neighbours and then its label's label, so labels travel
    by jumps, until none changes.  Each round is written, so lineage stays short.
    Neighbours are aggregated, never gathered.  Null ends are ignored; no links give no rows.
    """
    known = links.where("a is not null and b is not null")
    both = scratch.keep(known.select("a", "b").union(known.select("b", "a")).distinct(), "links")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = scratch.keep(least.join(jump, "label", "left").select("node", F.least("label", "further").alias("label"), "was"), "labels")
        if after.where("label <> was").isEmpty():
            return after.select("node", F.col("label").alias("component"))
        labels = after.select("node", "label")
