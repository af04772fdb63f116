"""Semantic hits: sentences near to keyword anchors by cosine, from given embeddings."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .clean import strip


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def semantic_hits(sentences: DataFrame, anchors: list[list[float]], threshold: float, most: int = 4, by: str = "doc_id") -> DataFrame:
    """(by, best, hits): highest cosine with any anchor, and sentences at or above the threshold, at most ``most``.

    sentences(by, embedding, literal boolean): those with a literal keyword don't count.  Anchors are
    literals of the plan, a list of bounded length; vectors are taken as they are where not zero.
    """
    units = [[x / (math.sqrt(sum(v * v for v in a)) or 1.0) for x in a] for a in anchors]
    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    rows = sentences.where("not literal").withColumn("norm", norm)
    near = F.greatest(*[dot(F.col("embedding"), F.array(*[F.lit(x) for x in u])) for u in units]) if len(units) > 1 else dot(F.col("embedding"), F.array(*[F.lit(x) for x in units[0]]))
    rows = rows.withColumn("sim", F.when(F.col("norm") > 0, near / F.col("norm")))
    return rows.groupBy(by).agg(F.round(F.max("sim"), 6).alias("best"), F.least(F.lit(most), F.count_if(F.col("sim") >= threshold)).cast("long").alias("hits"))


#: Sentences and anchors that one task compares, about.
ROWS, ANCHORS = 1 << 16, 1 << 13


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    """Unit vectors in double precision; zero vectors and those that hold null or non-finite components are all NaN."""
    rows = column.combine_chunks()
    width = rows.value_lengths()[0].as_py()
    flat = np.asarray(rows.flatten().fill_null(float("nan"))).astype(np.float64).reshape(len(rows), width)
    with np.errstate(invalid="ignore", divide="ignore"):
        unit = flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))
    unit[~np.isfinite(unit).all(axis=1)] = np.nan
    return unit


def _nearest(rows: pa.Table) -> pa.Table:
    """Of a block of sentences (row not null) and a block of anchors: each sentence's highest cosine."""
    mine = rows.filter(pc.is_valid(rows["row"]))
    anchors = rows.filter(pc.is_null(rows["row"]))
    best = np.full(mine.num_rows, np.nan)
    if mine.num_rows and anchors.num_rows:
        sides, others = _unit(mine["embedding"]), _unit(anchors["embedding"])
        others = others[~np.isnan(others[:, 0])]
        for at in range(0, len(sides) if len(others) else 0, 2048):
            best[at : at + 2048] = (sides[at : at + 2048] @ others.T).max(axis=1)
    return pa.table({"row": mine["row"], "sim": pa.array(best, from_pandas=True)})


def anchored_hits(sentences: DataFrame, anchors: DataFrame, threshold: float, most: int = 4, by: str = "doc_id") -> DataFrame:
    """``semantic_hits`` with a table of anchors(embedding), of any number: (by, best, hits).

    Blocks of sentences meet blocks of anchors of their length in one matrix product a task; a sentence goes to as
    many tasks as there are blocks of anchors, and an anchor to as many as there are blocks of sentences.  Nothing comes to the driver but two counts.  Vectors that are null, empty,
    zero or hold null or non-finite components are near to nothing; a ``by`` without a near sentence has no best and no hits.
    """
    scratch = Scratch(sentences.sparkSession, "anchors")
    rows = sentences.where("not literal").select(F.col(by).alias("by"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = scratch.keep(rows.withColumn("row", F.monotonically_increasing_id()), "sentences")
    known = scratch.keep(anchors.select(F.col("embedding").cast("array<double>").alias("embedding")).where("size(embedding) > 0"), "anchors")
    parts, blocks = (max(1, math.ceil(t.count() / n)) for t, n in ((rows, ROWS), (known, ANCHORS)))
    one = rows.where("size(embedding) > 0").select("row", "embedding", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    other = known.select(F.lit(None).cast("long").alias("row"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod(F.xxhash64("embedding"), F.lit(blocks)).cast("int").alias("block"))
    met = one.unionByName(other).withColumn("width", F.size("embedding")).groupBy("part", "block", "width").applyInArrow(_nearest, "row long, sim double")
    near = rows.select("row", "by").join(met.groupBy("row").agg(F.max("sim").alias("sim")), "row", "left")
    return near.groupBy(F.col("by").alias(by)).agg(F.round(F.max("sim"), 6).alias("best"), F.least(F.lit(most), F.count_if(F.col("sim") >= threshold)).cast("long").alias("hits"))


def anchor_sentences(text: Column, least: int = 8, most: int = 150) -> Column:
    """Array of the first ``most`` sentences of ``least`` characters: split after every mark, with or without a blank, and at line ends.

    The limit is part of the feature: later sentences are not compared with anchors.
    """
    parts = F.split(F.coalesce(text, F.lit("")), r"(?U)(?<=[。！？；!?;.])\s*|\n+")
    return F.slice(F.filter(F.transform(parts, strip), lambda s: F.length(s) >= least), 1, most)


def without_keywords(sentences: Column, words: list[str]) -> Column:
    """Those sentences that contain none of some keywords, in either case."""
    return F.filter(sentences, lambda s: ~F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower(s), w))) if words else sentences
