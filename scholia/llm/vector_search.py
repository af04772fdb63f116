"""Nearest neighbours by cosine: cross-polytope hashing, multiprobe tables, exact reranking.

A hash turns a unit vector by three rounds of random signs and a fast Hadamard transform and names the
nearest signed axis.  A table's code is some whole hashes and one over the first 2**j coordinates, so
that a bucket holds about ``LOAD`` vectors whatever their number.  A query probes, in each of ``TABLES``
tables, the ``probes`` codes of least loss (sum over hashes of the squared distance in height between the
highest axis and the probed one).  ``probes`` is fitted: ``SAMPLE`` queries at most are compared with all
vectors, and the fewest probes that find ``TARGET`` of their neighbours are taken.

A table holds of each vector 16-bit components, their scale and the length of what rounding lost, which
bounds a cosine from both sides.  Tasks return vectors that can still be among a query's nearest by
these bounds; only those are fetched whole and compared in double precision.

Equal vectors are one node with its ``k + 1`` smallest ids, as no query needs more of them.  Buckets over ``BLOCK``
vectors, or as many queries, are cut into blocks that meet each other in tasks of their own.  Queries
that found fewer than ``k`` others are compared with all vectors.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .embedding_dedup import _pack
from .scratch import Scratch, quoted
from .worker import batches_of

TABLES, LOAD, BLOCK, SAMPLE, TARGET, SEED = 8, 128, 4096, 64, 0.97, 23
#: Rounding of a product and a sum in single precision.
SINGLE = 2.0**-23
#: Rows of a table that one task holds, about; rows that are turned at a time.
ROWS, STEP = 16384, 2048


def padded(dim: int) -> int:
    return 1 << max(1, (dim - 1).bit_length())


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, by butterflies; orthogonal."""
    n, half = x.shape[1], 1
    while half < n:
        x = x.reshape(-1, n // (2 * half), 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(-1, n)
        half *= 2
    return x / math.sqrt(n)


def shape(nodes: int, dim: int) -> list[int]:
    """Coordinates that each hash of a code looks at: the padded dimension, and fewer in the last."""
    full = padded(dim)
    left, out = max(2.0, nodes / LOAD), []
    while left >= 2 * full:
        out.append(full)
        left /= 2 * full
    last = 1 << max(0, round(math.log2(left)) - 1)
    return [*out, last] if left > 1.5 or not out else out


def turned(unit: np.ndarray, table: int, hashes: list[int]) -> list[np.ndarray]:
    """Heights of the signed axes (axis a as 2a and 2a + 1) for each hash of the table's code."""
    full = padded(unit.shape[1])
    wide = np.zeros((len(unit), full))
    wide[:, : unit.shape[1]] = unit
    out = []
    for number, used in enumerate(hashes):
        signs = np.random.default_rng([SEED, full, table, number]).choice([-1.0, 1.0], (3, full))
        x = wide
        for s in signs:
            x = hadamard(x * s)
        x = x[:, :used]
        out.append(np.stack([x, -x], axis=2).reshape(len(unit), 2 * used))
    return out


def codes(unit: np.ndarray, table: int, hashes: list[int]) -> np.ndarray:
    code = np.zeros(len(unit), np.int64)
    for heights, used in zip(turned(unit, table, hashes), hashes, strict=True):
        code = code * (2 * used) + heights.argmax(axis=1)
    return code


def probed(unit: np.ndarray, table: int, hashes: list[int], probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of least loss for each row, least first (a row of codes each), and their losses."""
    loss, code = np.zeros((len(unit), 1)), np.zeros((len(unit), 1), np.int64)
    for heights, used in zip(turned(unit, table, hashes), hashes, strict=True):
        own = (heights.max(axis=1, keepdims=True) - heights) ** 2
        near = np.argsort(own, axis=1, kind="stable")[:, :probes]
        loss = (loss[:, :, None] + np.take_along_axis(own, near, 1)[:, None, :]).reshape(len(unit), -1)
        code = (code[:, :, None] * (2 * used) + near[:, None, :]).reshape(len(unit), -1)
        best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        loss, code = np.take_along_axis(loss, best, 1), np.take_along_axis(code, best, 1)
    return code, loss


def named(code: np.ndarray, table: int, dim: int) -> np.ndarray:
    """Codes of all tables and lengths of vectors as one number."""
    return (code * TABLES + table) ^ (np.int64(dim) << np.int64(44))


def _plain(vectors: list[bytes], kind: type) -> np.ndarray:
    """Vectors in double precision, each times a power of two that brings its largest component near one."""
    raw = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1))[1][:, None])


def _unit(vectors: list[bytes], kind: type) -> np.ndarray:
    raw = _plain(vectors, kind)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows in double precision, however large or small the components."""
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def sketches(unit: np.ndarray) -> list[bytes]:
    """Scale, most that a cosine can be off by, and 16-bit components of each unit vector."""
    scale = (np.abs(unit).max(axis=1) / 32767).astype(np.float32)
    small = np.rint(unit / scale[:, None].astype(np.float64)).clip(-32767, 32767).astype(np.int16)
    lost = np.sqrt(((unit - small * scale[:, None].astype(np.float64)) ** 2).sum(axis=1))
    head = np.stack([scale, (lost + SINGLE * (unit.shape[1] + 8)).astype(np.float32)], axis=1)
    return [h.tobytes() + s.tobytes() for h, s in zip(head, small, strict=True)]


def _by_size(vectors: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Rows whose vectors have one length, for each length."""
    size = np.array([len(v) for v in vectors])
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield rows, [vectors[i] for i in rows.tolist()]


def _steps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, STEP):
            yield whole.slice(at, STEP)


def _index(nodes: int, kind: type):
    """Node and vector -> code, node, sketch, for each table."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            node = batch.column(0).to_numpy()
            for rows, vectors in _by_size(batch.column(1).to_pylist()):
                unit = _unit(vectors, kind)
                hashes, small = shape(nodes, unit.shape[1]), pa.array(sketches(unit), pa.binary())
                for table in range(TABLES):
                    code = named(codes(unit, table, hashes), table, unit.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(node[rows]), small], names=["code", "node", "sketch"])

    return batches_of("vector_search", run)


def _probes(nodes: int, probes: int, kind: type):
    """Node and vector of queries -> code, node, for each table and probe."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            node = batch.column(0).to_numpy()
            for rows, vectors in _by_size(batch.column(1).to_pylist()):
                unit = _unit(vectors, kind)
                hashes = shape(nodes, unit.shape[1])
                few = max(1, (1 << 22) // (probes * 2 * max(hashes)))  # losses held at a time
                for table, at in itertools.product(range(TABLES), range(0, len(unit), few)):
                    code = named(probed(unit[at : at + few], table, hashes, probes)[0], table, unit.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(code.ravel()), pa.array(np.repeat(node[rows][at : at + few], code.shape[1]))], names=["code", "node"])

    return batches_of("vector_search", run)


def _exact(sample: list[tuple[int, bytes]], k: int, kind: type):
    """Node and vector -> of each batch the k + 1 nearest of each sample query: query, node, score, vector."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = {len(own[0]) // kind().itemsize: (which, _unit(own, kind)) for which, own in _by_size([v for _, v in sample])}
        for batch in _steps(batches):
            node = batch.column(0).to_numpy()
            for rows, vectors in _by_size(batch.column(1).to_pylist()):
                unit = _unit(vectors, kind)
                if unit.shape[1] not in queries:
                    continue
                which, asked = queries[unit.shape[1]]
                score = asked @ unit.T
                best = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
                flat = best.ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([sample[w][0] for w in which.tolist()], best.shape[1]).astype(np.int64)), pa.array(node[rows][flat]), pa.array(np.take_along_axis(score, best, 1).ravel()), pa.array([vectors[i] for i in flat.tolist()], pa.binary())],
                    names=["query", "node", "score", "vector"],
                )

    return batches_of("vector_search", run)


def fitted_probes(table: DataFrame, asked: DataFrame, nodes: int, k: int, kind: type) -> int:
    """The fewest probes a table that find ``TARGET`` of the neighbours of ``SAMPLE`` queries, chosen by hash."""
    sample = [tuple(r) for r in asked.select("node", "vector").orderBy(F.xxhash64("vector"), "node").limit(SAMPLE).collect()]
    if not sample:
        return 1
    vector = dict(sample)
    near = table.select("node", "vector").mapInArrow(_exact(sample, k, kind), "query long, node long, score double, vector binary").where("query <> node")
    near = near.withColumn("_rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))).where(F.col("_rank") <= k)
    needed = []
    for r in near.collect():  # k rows a sample query
        unit = _unit([vector[r.query], r.vector], kind)
        hashes, most = shape(nodes, unit.shape[1]), 1
        for used in shape(nodes, unit.shape[1]):
            most *= 2 * used
        first = most
        for t in range(TABLES):
            lost = sum((h[0].max() - h[0][h[1].argmax()]) ** 2 for h in turned(unit, t, hashes))
            first = min(first, _codes_below(turned(unit[:1], t, hashes), lost) + 1)
        needed.append(first)
    needed.sort()
    return needed[min(len(needed) - 1, int(TARGET * len(needed)))] if needed else 1


def _codes_below(heights: list[np.ndarray], most: float) -> int:
    """Number of codes with a loss below ``most``: codes that would be probed before one of that loss."""
    sums = np.zeros(1)
    for h in heights:
        sums = (sums[:, None] + (h[0].max() - h[0]) ** 2).ravel()
        sums = sums[sums < most]
    return len(sums)


def _nearest(query: np.ndarray, node: np.ndarray, dot: np.ndarray, lost: np.ndarray, k: int) -> np.ndarray:
    """Rows that may be among the k nearest of their query, by the bounds dot - lost and dot + lost."""
    order = np.lexsort((lost - dot, query))
    q, low, high = query[order], (dot - lost)[order], (dot + lost)[order]
    begin = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    size = np.diff(np.r_[begin, len(q)])
    kth = np.where(size >= k, low[np.minimum(begin + k - 1, len(q) - 1)], -np.inf) if len(q) else low
    return order[high >= np.repeat(kth, size)]


def _meet(k: int):
    """Rows of one task (kind 0: vectors, 1: probes, 2: queries' unit vectors) -> what may be nearest."""

    def run(rows: pa.Table) -> pa.Table:
        kind, work, node = (rows.column(c).to_numpy() for c in ("kind", "work", "node"))
        data = rows.column("data")
        is_query = np.flatnonzero(kind == 2)
        asked = {n: data[int(i)].as_py() for n, i in zip(node[is_query].tolist(), is_query, strict=True)}
        index, probe = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        index, probe = index[np.argsort(work[index], kind="stable")], probe[np.argsort(work[probe], kind="stable")]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.float32))]
        for w in np.intersect1d(work[index], work[probe]):
            here = index[slice(*np.searchsorted(work[index], [w, w + 1]))]
            near = probe[slice(*np.searchsorted(work[probe], [w, w + 1]))]
            raw = np.frombuffer(b"".join(data.take(pa.array(here)).to_pylist()), np.uint8).reshape(len(here), -1)
            head = np.ascontiguousarray(raw[:, :8]).view(np.float32)
            small = np.ascontiguousarray(raw[:, 8:]).view(np.int16).astype(np.float32) * head[:, :1]
            for at in range(0, len(near), 256):
                ids = node[near[at : at + 256]]
                dot = np.frombuffer(b"".join(asked[n] for n in ids.tolist()), np.float32).reshape(len(ids), -1) @ small.T
                low = dot - head[:, 1]
                floor = np.partition(low, -k, axis=1)[:, -k][:, None] if low.shape[1] > k else np.full((len(ids), 1), -np.inf, np.float32)
                i, j = np.nonzero(dot + head[:, 1] >= floor)
                found.append((ids[i], node[here[j]], dot[i, j], head[j, 1]))
        query, near, dot, lost = (np.concatenate(x) for x in zip(*found, strict=True))
        pair = np.unique(np.stack([query, near]), axis=1, return_index=True)[1]  # a pair meets in several tables
        query, near, dot, lost = query[pair], near[pair], dot[pair], lost[pair]
        stay = _nearest(query, near, dot, lost, k)
        return pa.table({"query": query[stay], "node": near[stay], "dot": dot[stay].astype(np.float64), "lost": lost[stay].astype(np.float64)})

    return run


def _as_unit(kind: type):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            vectors = batch.column(1).to_pylist()
            out: list[bytes | None] = [None] * len(vectors)
            for rows, own in _by_size(vectors):
                for i, u in zip(rows.tolist(), _unit(own, kind).astype(np.float32), strict=True):
                    out[i] = u.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "data"])

    return batches_of("vector_search", run)


def _scores(kind: type):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            score = np.zeros(len(a))
            for rows, own in _by_size(a):
                score[rows] = cosines(_plain(own, kind), _plain([b[i] for i in rows.tolist()], kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["query", "node", "score"])

    return batches_of("vector_search", run)


def _in_blocks(index: DataFrame, probes: DataFrame, units: DataFrame, parts: int, scratch: Scratch) -> DataFrame:
    """Rows of ``_meet``, dealt to tasks by code, or by pairs of blocks of large codes."""
    many = lambda rows, name: rows.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name)).where(F.col(name) > 1)
    hot = scratch.keep(many(index, "of_index").join(many(probes, "of_probes"), "code", "full").select("code", *[F.coalesce(c, F.lit(1)).alias(c) for c in ("of_index", "of_probes")]), "hot")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        one = F.lit(1)
        rows = rows.join(hot, "code", "left").withColumn("mine", F.pmod(F.xxhash64("node"), F.coalesce(own, one)).cast("int"))
        rows = rows.withColumn("theirs", F.explode(F.sequence(F.lit(0), F.coalesce(other, one) - 1)))
        block: list[str | Column] = ["mine", "theirs"] if own == "of_index" else ["theirs", "mine"]
        return rows.withColumn("work", F.xxhash64("code", *block)).withColumn("part", F.pmod("work", F.lit(parts)))

    index = dealt(index, "of_index", "of_probes").select("part", F.lit(0).alias("kind"), "work", "node", F.col("sketch").alias("data"))
    probes = scratch.keep(dealt(probes, "of_probes", "of_index").select("part", F.lit(1).alias("kind"), "work", "node"), "probes")
    asked = probes.select("part", "node").distinct().join(units, "node").select("part", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("work"), "node", "data")
    return index.unionByName(probes.withColumn("data", F.lit(None).cast("binary"))).unionByName(asked)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` for each row of ``queries`` by cosine: query_id, rank, vec_id, score.

    Both tables have ``id_col`` and ``vector_col``; other columns are ignored.  Rows of the query's own id are no result.  Nearest first,
    equal scores by ascending id; all rows of the query's length if there are fewer than ``k``.  Rows whose id is
    null, or whose vector is null, empty, zero or holds null or non-finite components, take no part
    on either side.  Rows that repeat both id and vector count once; an id with several vectors is
    a row for each.  Neighbours are those found (see ``TARGET``), scores are exact.  No rows on
    either side give none.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vector-search")
    single = isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) and isinstance(queries.schema[vector_col].dataType.elementType, T.FloatType)
    kind = np.float32 if single else np.float64

    def packed(rows: DataFrame) -> DataFrame:
        column = F.col(quoted(vector_col)).cast("array<float>" if single else "array<double>")
        rows = rows.select(F.col(quoted(id_col)).cast("long").alias("id"), column.alias("vector")).where("id is not null")
        return rows.mapInArrow(_pack(kind), "id long, vector binary").where("vector is not null")

    # Of equal vectors the k + 1 smallest ids; ids that repeat with the vector have one rank.
    ranked = packed(vectors).withColumn("_rank", F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("_rank") <= k + 1)
    table = ranked.groupBy("vector").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    table = scratch.keep(table.select(F.monotonically_increasing_id().alias("node"), "vector", "ids"), "nodes")
    rows = packed(queries).dropDuplicates(["id", "vector"])
    # Queries that aren't rows of the table have nodes of their own, below zero.
    rows = scratch.keep(rows.join(table.select("node", "vector"), "vector", "left"), "queries")
    asked = rows.groupBy("vector").agg(F.max("node").alias("node"))
    asked = scratch.keep(asked.select(F.coalesce("node", -1 - F.monotonically_increasing_id()).alias("node"), "vector"), "asked")
    nodes = table.count()
    probes = fitted_probes(table, asked, nodes, k, kind)
    index = scratch.keep(table.select("node", "vector").mapInArrow(_index(nodes, kind), "code long, node long, sketch binary"), "index")
    units = scratch.keep(asked.select("node", "vector").mapInArrow(_as_unit(kind), "node long, data binary"), "units")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(nodes * TABLES / ROWS))
    schema = "query long, node long, dot double, lost double"
    own, per = k + 1, Window.partitionBy("query")  # the query's own vector is found as well

    def searched(met: DataFrame, name: str) -> DataFrame:
        met = met.groupBy("part").applyInArrow(_meet(own), schema).groupBy("query", "node").agg(F.max("dot").alias("dot"), F.max("lost").alias("lost"))
        met = met.withColumn("_low", F.col("dot") - F.col("lost")).withColumn("_rank", F.row_number().over(per.orderBy(F.desc("_low"))))
        met = met.withColumn("_floor", F.max(F.when(F.col("_rank") == own, F.col("_low"))).over(per))
        return scratch.keep(met.where("_floor is null or dot + lost >= _floor").select("query", "node"), name)

    sought = scratch.keep(asked.select("node", "vector").mapInArrow(_probes(nodes, probes, kind), "code long, node long"), "sought")
    found = searched(_in_blocks(index, sought, units, parts, scratch), "found")
    # Ids found beside the query's own vector, of which one may be the query.
    others = found.join(table.select("node", F.size("ids").alias("n")), "node").groupBy(F.col("query").alias("node")).agg(F.sum("n").alias("n"))
    short = scratch.keep(units.join(others, "node", "left").where(F.coalesce("n", F.lit(0)) <= k).select("node", "data"), "short")
    if not short.isEmpty():
        # Each of them meets the whole first table, which holds every vector, in blocks of both.
        first = index.where(F.pmod("code", F.lit(TABLES)) == 0).withColumn("code", ((F.octet_length("sketch") - 8) / 2).cast("long"))
        met = _in_blocks(first, short.select((F.octet_length("data") / 4).cast("long").alias("code"), "node"), units, parts, scratch)
        found = found.join(short.select(F.col("node").alias("query")), "query", "left_anti").unionByName(searched(met, "rest"))
    pairs = found.join(table.select("node", F.col("vector").alias("b")), "node").join(asked.select(F.col("node").alias("query"), F.col("vector").alias("a")), "query")
    scored = pairs.select("query", "node", "a", "b").mapInArrow(_scores(kind), "query long, node long, score double")
    best = scored.join(table.select("node", "ids"), "node").groupBy("query").agg(F.collect_list(F.struct((-F.col("score")).alias("far"), "ids")).alias("near"))
    # A query's list holds the nodes that its bounds left, each with k + 1 ids at most.
    flat = "flatten(transform(near, n -> transform(n.ids, i -> named_struct('far', n.far, 'vec_id', i))))"
    best = asked.select(F.col("node").alias("query"), "vector").join(best, "query").select("vector", F.expr(f"array_sort({flat})").alias("near"))
    result = Scratch(spark, "vector-search-result")
    lists = rows.select("id", "vector").join(best, "vector").select(F.col("id").alias("query_id"), F.expr(f"slice(filter(near, n -> n.vec_id <> id), 1, {k})").alias("near"))
    lists = result.keep(lists, "lists")
    scratch.end()
    out = lists.select("query_id", F.posexplode("near").alias("at", "n"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("n.vec_id").alias("vec_id"), (-F.col("n.far")).alias("score"))
