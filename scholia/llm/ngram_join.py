"""N-gram Jaccard join by parity sketches.

A document is the set of hashes of its distinct word shingles.  Sets with Jaccard similarity >= 0.8
and sizes a <= b satisfy b <= 1.25 a and differ in at most (a + b) / 9 elements.

* Sketch.  Per size band the shingle hashes are dealt to P words and XORed there.  An element that
  only one set has changes one word, so the number of differing words (the Hamming distance of the
  sketches, word by word) never exceeds the symmetric difference.  A second sketch of single bits, 6
  to 12 a shingle, is the filter of candidate pairs: its Hamming distance is a lower bound in the same
  way, and XORing its halves gives the sketch of half the length.
* Pigeonhole join.  A band's largest allowed difference is D; with P = D + 1 + T words at least T + 1
  words of two similar sets agree.  Every word that some shingle reached becomes a join key.  Only
  documents with more than T unreached words could agree in unreached words alone; they also emit the
  shingles of a prefix (the (size - least overlap + 1) smallest hashes), which similar sets share.
  So no similar pair is missed, whatever its size.  A document takes part in its own band and in
  those of sizes down to 0.8 of its own.
* Verify.  Texts of a candidate pair are brought together and the sets are intersected exactly.

Equal sets are one node (named by a 64-bit digest of the set; two of 10**9 different sets share a
name with a chance of 3 %, and a task that meets the same node again does not repeat its keys).
Pairs are not listed within a group of near copies: first each key's nodes are paired with ``CENTERS``
of them only (those whose names come first under as many scramblings, which are mostly the same ones
for all keys of a group); those links give components.  Then, for keys whose nodes still lie in different components,
every pair across components is a candidate.  Pairs that are never verified lie in one component
already.

Keys travel as packed arrays, a row per task and bucket, about 8 bytes a key; the number of buckets grows
with the number of keys.  Keys with the same nodes (a passage gives many) are one: what is joined later is
the set of nodes, named by a sum of their scrambled names (sets that share a name are tested together).
Sets of at most ``HOT`` nodes are joined with themselves by name; larger ones are united where they have
the same first node by hash, and dealt to blocks of about ``BLOCK`` nodes; each pair of blocks is compared by the bit sketches, and only pairs that pass are rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .packing import expand, squeeze
from .scratch import Scratch, quoted
from .shingles import scramble, shingle_sets
from .slots import parted
from .worker import batches_of

#: Similar: 100 * intersection >= PERCENT * union, so difference <= (a + b) * (100 - PERCENT) / (100 + PERCENT).
PERCENT, SIZE = 80, 5
#: Each band of sizes ends at RATIO times its start.
RATIO = 1.35
#: Keys held by a task before it sends them off; nodes whose keys it remembers to have sent.
FLUSH, SEEN = 1 << 19, 1 << 18
#: Keys a bucket holds, about, and the least number of buckets; bits of a key beside its bucket.
KEYS, BUCKETS, SHORT = 1 << 20, 64, 40
#: Nodes of a key that are paired by a join; nodes of a block of more; rows one task compares, about.
HOT, BLOCK, ROWS = 32, 512, 2048
#: Bits of the shortest sketch; nodes that each key's others are paired with at first.
BITS, CENTERS = 256, 3
#: Tells the texts of rows that repeat an id apart.
VERSION = "xxhash64(text)"


def bands(largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the bands up to ``largest``, words P of each, and unreached words T it allows."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(max(starts[-1] + 1, int(starts[-1] * RATIO)))
    top = np.array(starts[1:]) - 1
    differ = (top + top * 100 // PERCENT) * (100 - PERCENT) // (100 + PERCENT)
    spare = np.ceil(0.07 * (differ + 1)).astype(int) + 2
    return np.array(starts), differ + 1 + spare, spare


STARTS, WORDS, SPARE = bands(1 << 40)


def join_keys(hashes: np.ndarray) -> np.ndarray:
    """The 64-bit join keys of one set (sorted distinct hashes)."""
    n = len(hashes)
    out = []
    own = int(np.searchsorted(STARTS, n, side="right")) - 1
    low = int(np.searchsorted(STARTS, -(-n * PERCENT // 100), side="right")) - 1
    high = hashes >> np.uint64(32)
    for band in range(low, own + 1):
        p = int(WORDS[band])
        word = ((high * np.uint64(p)) >> np.uint64(32)).astype(np.int64)  # hashes are sorted, so words are too
        begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        name = scramble((word[begin] + np.int64(band << 40)).astype(np.uint64))
        out.append(scramble(np.bitwise_xor.reduceat(hashes, begin) ^ name))
        if p - len(begin) > SPARE[band]:
            prefix = n - -(-n * PERCENT // 100) + 1
            out.append(scramble(np.sort(scramble(hashes))[:prefix] ^ scramble(np.array([band + (1 << 62)], np.uint64))))
    return np.concatenate(out)


def describe(hashes: np.ndarray) -> tuple[int, bytes]:
    """Name of a set (signed 64 bits) and its sketch of single bits."""
    n = len(hashes)
    name = scramble(np.array([scramble(hashes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
    bits = max(BITS, 1 << (6 * n - 1).bit_length())
    place = (hashes & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(place, minlength=bits) & 1).astype(np.uint8)
    return int(name.view(np.int64)[0]), np.packbits(odd, bitorder="little").tobytes()


def _describe_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            rows = [(len(h), *describe(h)) if len(h) else (0, None, None) for h in shingle_sets(batch.column(1), SIZE)]
            columns = [batch.column(0), batch.column(2), *[pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)]]
            columns.append(pa.array([r[2] for r in rows], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "version", "n", "node", "sketch"])


def _key_batches(buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        nodes: list[int] = []
        keys: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            owner = np.repeat(np.arange(len(keys), dtype=np.uint16), [len(k) for k in keys])
            every = np.concatenate(keys)
            bucket = (((every >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)
            every &= np.uint64((1 << SHORT) - 1)
            order = np.lexsort((every, bucket))
            every, owner, bucket = every[order], owner[order], bucket[order]
            begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            names, rows = np.array(nodes, np.int64), []
            for b, e in zip(begin, np.r_[begin[1:], len(bucket)], strict=True):
                used, index = np.unique(owner[b:e], return_inverse=True)
                rows.append((int(bucket[b]), squeeze(np.diff(every[b:e], prepend=np.uint64(0))), squeeze(index.astype(np.uint16)), names[used].tobytes()))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3)]],
                names=["bucket", "keys", "owners", "nodes"],
            )

        for batch in batches:
            for hashes in shingle_sets(batch.column(0), SIZE):
                if not len(hashes):
                    continue
                node = describe(hashes)[0]
                if node in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                nodes.append(node)
                keys.append(join_keys(hashes))
                held += len(keys[-1])
                if held >= FLUSH or len(nodes) == 1 << 16:
                    yield flush()
                    nodes, keys, held = [], [], 0
        if nodes:
            yield flush()

    return run


def _meet(table: pa.Table) -> pa.Table:
    """One bucket: kind 0, a candidate pair with one of a key's first nodes; kind 1, (set of nodes, node) of shared keys."""
    keys, nodes = [], []
    for k, i, n in zip(*[table.column(c).to_pylist() for c in ("keys", "owners", "nodes")], strict=True):
        keys.append(np.cumsum(expand(k, np.uint64), dtype=np.uint64))
        nodes.append(np.frombuffer(n, np.int64)[expand(i, np.uint16)])
    key, node = np.concatenate(keys), np.concatenate(nodes)
    del keys, nodes
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    again = np.r_[False, (key[1:] == key[:-1]) & (node[1:] == node[:-1])]
    key, node = key[~again], node[~again]
    many = np.diff(np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)])
    node, many = node[np.repeat(many > 1, many)], many[many > 1]
    begin = np.cumsum(many) - many
    if not len(many):
        return pa.table({"kind": np.zeros(0, np.int32), "x": np.zeros(0, np.int64), "y": np.zeros(0, np.int64)})
    # Each set of nodes once.
    name = np.add.reduceat(scramble(node.view(np.uint64)), begin)
    name, first = np.unique(name, return_index=True)
    own = np.repeat(begin[first], many[first])
    many = many[first]
    begin = np.cumsum(many) - many
    node = node[own + np.arange(len(own)) - np.repeat(begin, many)]
    owner = np.repeat(np.arange(len(many)), many)
    found = []
    for k in range(CENTERS):
        center = np.lexsort((scramble(node.view(np.uint64) + np.uint64(k)), owner))[begin]
        head = np.repeat(node[center], many)
        found.append(np.stack([np.minimum(head, node), np.maximum(head, node)])[:, head != node])
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
    kind = np.r_[np.zeros(pairs.shape[1], np.int32), np.ones(len(node), np.int32)]
    return pa.table({"kind": kind, "x": np.r_[pairs[0], np.repeat(name, many).view(np.int64)], "y": np.r_[pairs[1], node]})


def _sketches(column: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and sketches (a row each, of 64-bit words) of each length."""
    size = np.array([len(x) for x in column], np.int64)
    return {int(k) // 8: (rows, np.frombuffer(b"".join([column[i] for i in rows]), np.uint64).reshape(len(rows), -1)) for k in np.unique(size) for rows in [np.flatnonzero(size == k)]}


def _halved(sketches: np.ndarray) -> np.ndarray:
    half = sketches.shape[1] // 2
    return sketches[:, :half] ^ sketches[:, half:]


def _allowed(differ: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether sizes, and differing bits of the sketches, allow the similarity."""
    return (differ * (100 + PERCENT) <= (one + two) * (100 - PERCENT)) & (np.maximum(one, two) * PERCENT <= np.minimum(one, two) * 100)


def _filter_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows a, b, sizes and sketches of both those pairs that may link.

    Sizes that do are at most a factor of 1.25 apart, so one sketch is at most twice as long.
    """
    for batch in batches:
        one, two = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
        left, right = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        keep = np.zeros(batch.num_rows, bool)
        shape = np.array([(len(x), len(y)) for x, y in zip(left, right, strict=True)], np.int64).reshape(-1, 2)
        for a, b in np.unique(shape, axis=0).tolist():
            if max(a, b) > 2 * min(a, b):
                continue
            rows = np.flatnonzero((shape == (a, b)).all(1))
            x, y = (np.frombuffer(b"".join([c[i] for i in rows]), np.uint64).reshape(len(rows), -1) for c in (left, right))
            x, y = _halved(x) if a > b else x, _halved(y) if b > a else y
            keep[rows] = _allowed(np.bitwise_count(x ^ y).sum(1, dtype=np.int64), one[rows], two[rows])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))


def _compare_blocks(rows: pa.Table) -> pa.Table:
    """Pairs of nodes of different components that may link, of each pair of blocks among the rows."""
    work = rows.column("work").to_numpy()
    order = np.argsort(work, kind="stable")
    side, node, n, component = (rows.column(c).to_numpy()[order] for c in ("side", "node", "n", "component"))
    sketches = rows.column("sketch").to_pylist()
    begin = np.flatnonzero(np.r_[True, work[order][1:] != work[order][:-1]])
    out = [np.zeros((2, 0), np.int64)]
    for b, e in zip(begin.tolist(), [*begin[1:].tolist(), len(work)], strict=True):
        by = _sketches([sketches[i] for i in order[b:e]])
        two_sides = side[b:e].any()
        for size, (rows_x, x) in by.items():
            for rows_y, y in [by[size], *[(r, _halved(s)) for k, (r, s) in by.items() if k == 2 * size]]:
                step = max(1, (1 << 18) // (len(rows_y) * size))
                for at in range(0, len(rows_x), step):
                    i, j = rows_x[at : at + step, None] + b, rows_y[None, :] + b
                    differ = np.bitwise_count(x[at : at + step, None, :] ^ y[None, :, :]).sum(2, dtype=np.int64)
                    good = _allowed(differ, n[i], n[j]) & (component[i] != component[j]) & (node[i] != node[j])
                    good &= side[i] != side[j] if two_sides else True
                    p, q = np.nonzero(good)
                    p, q = node[i[p, 0]], node[j[0, q]]
                    out.append(np.stack([np.minimum(p, q), np.maximum(p, q)]))
    pairs = np.unique(np.concatenate(out, axis=1), axis=1)
    return pa.table({"a": pairs[0], "b": pairs[1]})


def _verify_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for one, two in zip(shingle_sets(batch.column(2), SIZE), shingle_sets(batch.column(3), SIZE), strict=True):
            both = len(np.intersect1d(one, two, assume_unique=True))
            linked.append(100 * both >= PERCENT * (len(one) + len(two) - both) and both > 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))


def _filtered(pairs: DataFrame, about: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b: nodes) whose sizes and bit sketches allow the similarity."""
    p, q = (about.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}")) for k in "ab")
    sized = pairs.join(p, "a").join(q, "b").where(f"greatest(n_a, n_b) * {PERCENT} <= least(n_a, n_b) * 100")
    return sized.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(batches_of("ngram", _filter_batches), "a long, b long")


def _across(shared: DataFrame, labels: DataFrame, about: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of nodes of a key that lie in different components and may link; a pair may occur again."""
    placed = shared.distinct().join(labels, "node", "left").select("name", "node", F.coalesce("component", "node").alias("component"))
    placed = scratch.keep(placed, "placed")
    center = F.min_by("node", F.xxhash64("node"))
    split = placed.groupBy("name").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("many"), center.alias("center"))
    placed = placed.join(split.where("low <> high").select("name", "many", "center"), "name")
    few = placed.where(F.col("many") <= HOT)
    met = few.alias("p").join(few.alias("q"), F.expr("p.name = q.name AND p.node < q.node AND p.component <> q.component"))
    cold = _filtered(met.select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct(), about)

    # Large sets of one group of near copies differ in a few nodes, and mostly share the first by hash: they are one set.
    hot = scratch.keep(placed.where(F.col("many") > HOT).select(F.col("center").alias("name"), "node", "component").distinct(), "hot")
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int")
    hot = hot.join(hot.groupBy("name").agg(blocks.alias("blocks")), "name").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    hot = hot.withColumn("side", (F.col("own") > F.col("other")).cast("int")).withColumn("work", F.xxhash64("name", F.least("own", "other"), F.greatest("own", "other")))
    hot = scratch.keep(hot.select("node", "component", "side", "work"), "blocks")
    parts = max(1, -(-hot.count() // ROWS))
    hot = hot.join(about.select("node", "n", "sketch"), "node").withColumn("part", F.pmod("work", F.lit(parts)))
    return cold.unionByName(hot.groupBy("part").applyInArrow(_compare_blocks, "a long, b long"))


def _verified(pairs: DataFrame, docs: DataFrame, about: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of ``pairs`` (a, b: nodes) that are similar."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    first = scratch.keep(about.select("node", "id", "version").join(wanted, "node", "left_semi"), "wanted")
    near, _ = parted(docs, "id", first)
    texts = near.withColumn("version", F.expr(VERSION)).join(first, ["id", "version"]).groupBy("id", "version", "node").agg(F.first("text").alias("text"))
    texts = scratch.keep(texts.select("node", "text"), "texts")
    met = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    met = met.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    links = met.select("a", "b", "text_a", "text_b").mapInArrow(batches_of("ngram", _verify_batches), "a long, b long")
    links = scratch.keep(links, "verified")
    scratch.drop(texts, first)
    return links


def ngram_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links).

    Null, empty and white-space texts have no shingles and link with nothing: component_id is their
    own id.  Rows with a null id are returned with a null component_id and link nothing.  Rows that
    repeat an id share that id's smallest component.  Ties cannot occur.  Other columns are ignored.
    An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "ngram")
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text"))
    versions = rows.withColumn("version", F.expr(VERSION))
    sets = versions.mapInArrow(batches_of("ngram", _describe_batches), "id long, version long, n long, node long, sketch binary")
    sets = scratch.keep(sets, "sets")
    known = sets.where("id is not null and node is not null")
    shingles = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(BUCKETS, int(0.6 * shingles / KEYS))  # a shingle gives about 0.6 keys
    packed = rows.where("id is not null").select("text").mapInArrow(batches_of("ngram", _key_batches(buckets)), "bucket int, keys binary, owners binary, nodes binary")
    met = scratch.keep(packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_meet, "kind int, x long, y long"), "met")
    shared = met.where("kind = 1").select(F.col("x").alias("name"), F.col("y").alias("node"))
    about = known.join(shared.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "version", "n", "sketch")).alias("one"))
    about = scratch.keep(about.select("node", "one.*"), "about")

    pairs = met.where("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    pairs = scratch.keep(_filtered(pairs, about), "pairs")
    links = _verified(pairs, rows, about, scratch)
    labels = scratch.keep(connected_components(links, scratch), "labels")
    # Keys whose nodes lie in different components: all pairs across components.
    across = scratch.keep(_across(shared, labels, about, scratch).distinct().join(pairs, ["a", "b"], "left_anti"), "across")
    scratch.drop(met, pairs)
    more = _verified(across, rows, about, scratch)
    # One edge per node of a component stands for the links verified before.
    stars = labels.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    labels = scratch.keep(connected_components(stars.unionByName(more), scratch), "groups")

    joined = sets.select("id", "n", "node").join(labels, "node", "left").select("id", "n", "node", F.coalesce("component", "node").alias("component"))
    joined = Scratch(docs.sparkSession, "ngram-groups").keep(joined, "joined")
    scratch.end()
    least = joined.where("component is not null and id is not null").groupBy("component").agg(F.min("id").alias("least"))
    out = joined.join(least, "component", "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("least", "id")).cast("long")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id (null ids stay)."""
    gone = ngram_groups(docs, id_col, text_col).toDF("id", "n", "component").where("id <> component").select("id").distinct()
    gone = Scratch(docs.sparkSession, "gone").keep(gone, "gone")
    names = [f"c{k}" for k in range(len(docs.columns))]  # by number: a column may have any name
    some, alone = parted(docs.withColumn("_id", F.col(quoted(id_col)).cast("long")).toDF(*names, "id"), "id", gone)
    return alone.unionByName(some.join(gone, "id", "left_anti").select(*names, "id")).select(*names).toDF(*docs.columns)
