"""Embedding near-dedup: sign hashes of random hyperplanes in several tables, exact cosine, components.

Equal vectors are one node with a number of copies, named by a 64-bit hash of the vector.  Each node gets
a code of ``k`` signs in each of ``T`` tables; k grows with the logarithm of the number of nodes so that
buckets stay small, and T with it so that a pair whose cosine is exactly the threshold meets in some
table with probability ``FOUND`` at least (closer pairs more surely).  Nodes that meet are compared in
double precision.  Comparing is cheap beside sending a vector to one more table, so a bucket holds some
hundred nodes.

Vectors are rounded to integers below 2**20 and hyperplanes to integers below 2**14 before the signs
are taken: all sums are exact in a double, so signs never depend on the order of summation, and a pair
that meets in several tables is counted in the first of them only, without a distinct over pairs.

A bucket of more than ``BLOCK`` nodes is split into blocks and each pair of blocks is compared on
its own.  A task returns sums per node and the edges of a spanning forest, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .scratch import Scratch, quoted

COSINE, FOUND, BLOCK, SEED = 0.9, 0.9999, 2048, 11
#: Nodes a bucket holds by chance, on average; rows that one task compares, about.
LOAD, ROWS = 256, 16384


def shape(nodes: int, cosine: float = COSINE) -> tuple[int, int]:
    """Signs per code and number of tables for so many nodes."""
    k = min(60, max(4, math.ceil(math.log2(max(nodes, 1) / LOAD)))) if nodes > LOAD else 4
    same = (1 - math.acos(cosine) / math.pi) ** k
    return k, math.ceil(math.log(1 - FOUND) / math.log(1 - same))


def planes(dim: int, k: int, tables: int) -> np.ndarray:
    return np.rint(np.random.default_rng([SEED, dim]).standard_normal((dim, k * tables)).clip(-8, 8) * 2000)


def codes(unit: np.ndarray, k: int, tables: int) -> np.ndarray:
    """The codes of unit vectors, a column for each table."""
    signs = np.rint(unit * (1 << 20)) @ planes(unit.shape[1], k, tables) > 0
    return signs.reshape(len(unit), tables, k) @ (np.int64(1) << np.arange(k, dtype=np.int64))


def _vectors(column: list[bytes], kind: type) -> np.ndarray:
    """Unit vectors in double precision."""
    raw = np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)
    with np.errstate(over="ignore"):
        raw /= np.abs(raw).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def _pack(kind: type):
    """Valid vectors as their bytes; null for those that link with nothing."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1] if len(lists) else np.zeros(1, np.int32)
            values = lists.values.slice(ends[0], ends[-1] - ends[0])
            ends = ends - ends[0]
            plain = np.asarray(values.fill_null(float("nan"))).astype(kind) + kind(0)  # no -0.0
            per = lambda flags: np.diff(np.r_[0, np.cumsum(flags)][ends])
            good = np.asarray(lists.is_valid()) & (per(~np.isfinite(plain)) == 0) & (per(plain != 0) > 0)
            data = [pa.py_buffer(np.packbits(good, bitorder="little").tobytes()), pa.py_buffer((ends * plain.itemsize).astype(np.int32)), pa.py_buffer(plain)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.binary(), len(lists), data)], names=["id", "vector"])

    return run


def _code_batches(k: int, tables: int, kind: type):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                vectors = batch.column(1).to_pylist()
                out = [None] * len(vectors)
                by_size: dict[int, list[int]] = {}
                for i, v in enumerate(vectors):
                    by_size.setdefault(len(v), []).append(i)
                for size, rows in by_size.items():
                    found = codes(_vectors([vectors[i] for i in rows], kind), k, tables)
                    for i, c in zip(rows, found, strict=True):
                        out[i] = ((c * tables + np.arange(tables)) ^ (np.int64(size) << np.int64(48))).tolist()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], names=[*batch.schema.names, "codes"])

    return run


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs (i, j) over range(n)."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((a, b))
            if len(out) == n - 1:
                break
    return out


def _compare(cosine: float, k: int, tables: int, kind: type):
    def unit_of_work(table: int, side: np.ndarray, node: np.ndarray, copies: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows that are counted here."""
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(len(node)),) * 2
        pairs = [np.zeros((2, 0), np.int64)]
        for at in range(0, len(left), 512):
            rows = left[at : at + 512]
            i, j = np.nonzero(unit[rows] @ unit[right].T >= cosine)
            i, j = rows[i], right[j]
            near = node[i] != node[j] if side.any() else i < j
            pairs.append(np.stack([i[near], j[near]]))
        i, j = np.concatenate(pairs, axis=1)
        if table and len(i):
            used = np.unique(np.r_[i, j])
            code = np.zeros((len(node), tables), np.int64)
            code[used] = codes(unit[used], k, tables)
            new = (code[i, :table] != code[j, :table]).all(1)
            i, j = i[new], j[new]
        return i, j

    def run(rows: pa.Table) -> pa.Table:
        work = rows.column("work").to_numpy()
        order = np.argsort(work, kind="stable")
        work = work[order]
        table, side, node, copies = (rows.column(c).to_numpy()[order] for c in ("table", "side", "node", "copies"))
        vectors = rows.column("vector").to_pylist()
        linked, links, edges = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        begin = np.flatnonzero(np.r_[True, work[1:] != work[:-1]])
        for b, e in zip(begin.tolist(), [*begin[1:].tolist(), len(work)], strict=True):
            if e - b > 1:
                unit = _vectors([vectors[x] for x in order[b:e]], kind)
                own, many = node[b:e], copies[b:e]
                i, j = unit_of_work(int(table[b]), side[b:e], own, many, unit)
                total = np.bincount(np.r_[i, j], weights=many[np.r_[j, i]], minlength=e - b)
                linked.append(own[total > 0])
                links.append(total[total > 0].astype(np.int64))
                edges += [(int(own[p]), int(own[q])) for p, q in _forest(e - b, i, j)]
        x, inverse = np.unique(np.concatenate(linked), return_inverse=True)
        y = np.zeros(len(x), np.int64)
        np.add.at(y, inverse, np.concatenate(links))
        ends = np.array(edges, np.int64).reshape(-1, 2)
        kinds = np.r_[np.zeros(len(x), np.int32), np.ones(len(ends), np.int32)]
        return pa.table({"kind": kinds, "x": np.r_[x, ends[:, 0]], "y": np.r_[y, ends[:, 1]]})

    return run


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per row: id, n_links (other rows linked directly), component_id (smallest id), kept.

    Null, empty and zero vectors, and those that hold null or non-finite components, link with
    nothing (component_id is their own id, kept).  Vectors of different lengths never link.  Equal
    vectors link with each other.  Rows that repeat an id count each.  Rows with a null id link
    nothing; their component_id is null and kept is false.  Other columns are ignored.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding")
    single = isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    kind = np.float32 if single else np.float64  # what was read in single precision is kept so
    column = F.col(quoted(vector_col)).cast("array<float>" if single else "array<double>")
    rows = vectors.select(F.col(quoted(id_col)).cast("long").alias("id"), column.alias("vector")).mapInArrow(_pack(kind), "id long, vector binary")
    # Rows that link with nothing have no node, so they never meet in a join.
    rows = scratch.keep(rows.withColumn("node", F.when(F.col("id").isNotNull() & F.col("vector").isNotNull(), F.xxhash64("vector"))), "vectors")
    good = rows.where("node is not null")
    nodes = scratch.keep(good.groupBy("node", "vector").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")), "nodes")
    k, tables = shape(nodes.count(), cosine)
    coded = nodes.select("node", "vector", "copies").mapInArrow(_code_batches(k, tables, kind), "node long, vector binary, copies long, codes array<long>")
    coded = scratch.keep(coded, "codes")
    each = coded.select("node", "vector", "copies", F.posexplode("codes").alias("table", "code"))
    hot = coded.select(F.explode("codes").alias("code")).groupBy("code").count().where(F.col("count") > BLOCK)
    hot = scratch.keep(hot.select("code", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "hot")
    placed = each.join(hot, "code", "left")
    own = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int")
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    placed = placed.withColumn("side", (F.col("own") > F.col("other")).cast("int"))
    work = F.xxhash64("code", "table", F.least("own", "other"), F.greatest("own", "other"))
    total = coded.count() * tables
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / ROWS))
    placed = placed.select("node", "vector", "copies", "table", "side", work.alias("work")).withColumn("part", F.pmod("work", F.lit(parts)))
    met = scratch.keep(placed.groupBy("part").applyInArrow(_compare(cosine, k, tables, kind), "kind int, x long, y long"), "met")
    scratch.drop(coded, hot)
    counts = met.where("kind = 0").groupBy(F.col("x").alias("node")).agg(F.sum("y").alias("links"))
    labels = connected_components(met.where("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b")), scratch)
    about = nodes.select("node", "first", "copies").join(counts, "node", "left").join(labels, "node", "left")
    about = about.select("node", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    result = Scratch(spark, "embedding-groups")
    about = result.keep(about, "about")
    rows = result.keep(rows.select("id", "node"), "rows")
    scratch.end()
    least = about.groupBy("component").agg(F.min("first").alias("least"))
    about = about.join(least, "component").select("node", "n_links", "least")
    known = rows.where("node is not null").join(about, "node").select("id", "n_links", F.col("least").alias("component"))
    alone = rows.where("node is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    out = known.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), (F.col("id").isNotNull() & F.col("id").eqNullSafe(F.col("component"))).alias("kept"))
