"""Ranked lexical search: variable-block-max WAND over shards of postings.

The terms of a block of queries are numbered and sent along.  One pass over the texts writes, for
each document, its length in terms and its query terms with their counts; document frequencies and totals
come from that table.  A shard is what a task reads of it, cut at ``SHARD`` postings, so
building shards shuffles nothing.

Within a shard the postings of a term are cut into blocks by dynamic programming: the cuts minimise the
bound error, i.e. the sum over postings of the block's largest impact less the posting's, plus ``CUT`` mean impacts for each
block (else each posting would be one).  Cuts lie at multiples of ``CELL`` postings and a block has
``CELLS`` cells at most.

A query walks the shard's documents in order of id.  At each document the bounds of the blocks over it add
up; where they don't exceed the threshold, nothing can enter the list and the blocks are passed over.  The
others are the pivots: their postings are looked up and scored, ``STRIDE`` at a time, and the
threshold rises to the k-th best score.  It starts at the k-th best of one in ``SEEDING`` documents, which a
first search over those gives: a lower bound of the k-th best of all.  Results are exact; only bounds are floating.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .packing import ranges
from .scratch import Scratch, quoted, small_batches
from .worker import batches_of

#: A term: letters A-Z and a-z, digits, and all characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARD, CELL, CELLS, CUT, STRIDE, SEEDING = 1 << 21, 4, 64, 8, 512, 64
#: Lists that are cut together.
LISTS = 8192
#: Queries, and terms of queries, of one pass over the documents, about.
QUERIES, TERMS = 4096, 1 << 18

_term, _lower = re.compile(TERM), bytes.maketrans(UPPER.encode(), LOWER.encode())


def terms(text: str | None) -> list[str]:
    return _term.findall((text or "").encode("utf-8", "surrogatepass").translate(_lower).decode("utf-8", "surrogatepass"))


def weight(total: int, having: int) -> int:
    """w of a term that ``having`` of ``total`` documents hold."""
    return math.floor(1000 * math.log((2 * total + 2) / (2 * having + 1)))


def impacts(tf: np.ndarray, length: np.ndarray, total: int, terms_in_all: int) -> np.ndarray:
    """What a posting adds to a score, less the term's weight; 64-bit integers, rounding down."""
    m = 50 + (50 * length * total) // terms_in_all
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def block_ends(impact: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """For each list (postings from ``begin[i]`` to ``begin[i + 1]``) the ends of its blocks, counted from its start.

    All lists go forward together, a cell at a step: ``best[l, b]`` is the least cost of the list's cells up to the
    one ``b`` cells before the step, ``peak[l, b]`` and ``total[l, b]`` are largest impact and sum over the ``b`` last cells.
    """
    if len(begin) > LISTS + 1:
        return [e for at in range(0, len(begin) - 1, LISTS) for e in block_ends(impact, begin[at : at + LISTS + 1])]
    size = np.diff(begin)
    cells = -(-size // CELL)
    order = np.argsort(-cells, kind="stable")
    fee = CUT * np.add.reduceat(impact[: begin[-1]], begin[:-1]) / size if len(size) else np.zeros(0)
    alive = np.searchsorted(-cells[order], -np.arange(1, (cells.max(initial=0)) + 1), side="right")
    best = np.full((len(size), CELLS + 1), np.inf)
    best[:, 0] = 0
    peak, total, count = np.zeros_like(best), np.zeros_like(best), np.zeros_like(best)
    back = [np.zeros(0, np.int16)] * len(alive)
    where, ends = begin[:-1][order], begin[1:][order]
    for step, n in enumerate(alive.tolist()):
        at = where[:n] + step * CELL
        each = at[:, None] + np.arange(CELL)
        inside = each < ends[:n, None]
        value = np.where(inside, impact[np.minimum(each, len(impact) - 1)], 0)
        for held, new in ((peak, value.max(1)), (total, value.sum(1)), (count, inside.sum(1))):
            held[:n, 1:] = held[:n, :-1]
            held[:n, 0] = 0
            if held is peak:
                np.maximum(held[:n, 1:], new[:, None], out=held[:n, 1:])
            else:
                held[:n, 1:] += new[:, None]
        best[:n, 1:] = best[:n, :-1]
        cost = best[:n, 1:] + peak[:n, 1:] * count[:n, 1:] - total[:n, 1:] + fee[order][:n, None]
        taken = cost.argmin(1)
        best[:n, 0] = cost[np.arange(n), taken]
        back[step] = (taken + 1).astype(np.int16)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(size)
    for place, i in enumerate(order.tolist()):
        at, found = int(cells[i]), []
        while at:
            found.append(min(at * CELL, int(size[i])))
            at -= int(back[at - 1][place])
        out[i] = np.array(found[::-1], np.int64)
    return out


class Shard:
    """Postings of some documents by term, documents in order of id (null last), each term's in blocks with their bounds."""

    def __init__(self, length: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, weights: np.ndarray, total: int, terms_in_all: int):
        order = np.lexsort((doc, term))
        self.doc, term = doc[order], term[order]
        self.gain = weights[term] * impacts(tf[order], length[self.doc], total, terms_in_all)
        self.documents = len(length)
        known, first = np.unique(term, return_index=True)
        self.begin = dict(zip(known.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(term)], strict=True), strict=True))
        edges = np.r_[first, len(term)]
        self.blocks = {}
        for t, (b, _), ends in zip(known.tolist(), self.begin.values(), block_ends(self.gain, edges), strict=True):
            starts = np.r_[0, ends[:-1]] + b
            self.blocks[t] = (self.doc[starts], self.doc[ends + b - 1], np.maximum.reduceat(self.gain[b : b + ends[-1]], starts - b))

    def top(self, query: list[int], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents with the k best scores, of those above ``floor``; of equal scores the first documents."""
        held = [t for t in query if t in self.begin]
        keep, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not held:
            return keep, scores
        firsts, lasts, most = (np.concatenate(x) for x in zip(*(self.blocks[t] for t in held), strict=True))
        # Bounds are integers below 2**53, so their sums in doubles are exact.
        bound = np.cumsum(np.bincount(firsts, most, self.documents + 1) - np.bincount(lasts + 1, most, self.documents + 1))[: self.documents]
        pivots = np.flatnonzero(bound > floor)
        at = 0
        while at < len(pivots):
            here = pivots[at : at + STRIDE]
            at += STRIDE
            here = here[bound[here] > floor]
            if not len(here):
                continue
            score = np.zeros(len(here), np.int64)
            for t in held:
                b, e = self.begin[t]
                own = self.doc[b:e]
                low, high = np.searchsorted(own, [here[0], here[-1] + 1])  # blocks before and after are passed over
                place = low + np.searchsorted(own[low:high], here)
                hit = place < high
                hit[hit] = own[place[hit]] == here[hit]
                score[hit] += self.gain[b + place[hit]]
            good = score > floor
            keep, scores = np.r_[keep, here[good]], np.r_[scores, score[good]]
            if len(keep) >= k:
                best = np.sort(np.lexsort((keep, -scores))[:k])
                keep, scores = keep[best], scores[best]
                floor = int(scores.min())
        return keep, scores


def _postings(number: dict[str, int]):
    """Id and text -> id, length, terms, counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, to in ranges(whole.column(1)):
                batch = whole.slice(at, to - at)
                length, ids, tfs = [], [], []
                for text in batch.column(1).to_pylist():
                    found = terms(text)
                    counts = Counter(found)
                    own = sorted((number[t], n) for t, n in counts.items() if t in number)
                    length.append(len(found))
                    ids.append([t for t, _ in own])
                    tfs.append([n for _, n in own])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(length, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], names=["id", "n", "terms", "tfs"])

    return batches_of("lexical_search", run)


def _search(asked: list[list[int]], floors: np.ndarray, weights: np.ndarray, total: int, terms_in_all: int, k: int):
    """Rows of ``_postings`` -> query, id, score of what may be among a query's k best."""

    def searched(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks().sort_by([("id", "ascending")])  # nulls last
        lists, tfs = rows.column("terms").combine_chunks(), rows.column("tfs").combine_chunks()
        doc = np.repeat(np.arange(rows.num_rows), lists.value_lengths().to_numpy())
        shard = Shard(rows.column("n").to_numpy(), lists.flatten().to_numpy().astype(np.int64), doc, tfs.flatten().to_numpy().astype(np.int64), weights, total, terms_in_all)
        ids = rows.column("id")
        for q, query in enumerate(asked):
            keep, scores = shard.top(query, k, int(floors[q]))
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), q, np.int64)), ids.take(pa.array(keep)).combine_chunks(), pa.array(scores)], names=["query", "id", "score"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column(2).flatten())
            if size >= SHARD:
                yield from searched(held)
                held, size = [], 0
        if held:
            yield from searched(held)

    return batches_of("lexical_search", run)


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(docs: DataFrame, items: list[tuple[int | None, list[str]]], k: int, scratch: Scratch) -> DataFrame | None:
    """(query, rank, id, score) for one block of queries, or nothing if there is nothing to find."""
    number = {t: i for i, t in enumerate(sorted({t for _, own in items for t in own}))}
    table = scratch.keep(docs.mapInArrow(_postings(number), "id long, n long, terms array<int>, tfs array<int>"), "postings")
    total, terms_in_all = table.agg(F.expr("count_if(n > 0)"), F.coalesce(F.sum("n"), F.lit(0))).first()
    having = np.zeros(len(number), np.int64)
    for r in table.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # TERMS rows, about
        having[r.t] = r[1]
    if not having.any():
        return None
    weights = np.array([weight(total, int(h)) for h in having], np.int64)
    asked = [[number[t] for t in own] for _, own in items]

    def search(rows: DataFrame, floors: np.ndarray) -> DataFrame:
        return rows.where("size(terms) > 0").mapInArrow(_search(asked, floors, weights, total, terms_in_all, k), "query long, id long, score long")

    seeds = _best(search(table.where(F.pmod(F.xxhash64("id", "n"), F.lit(SEEDING)) == 0), np.zeros(len(items), np.int64)), ["query"], k)
    floors = np.zeros(len(items), np.int64)
    for r in seeds.where(F.col("rank") == k).select("query", "score").collect():  # a row a query
        floors[r.query] = max(0, r.score - 1)
    return _best(search(table, floors), ["query"], k)


def rank(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank, doc_id, score (all above 0, if fewer).

    Best first, equal scores by ascending id, null ids after others.  A document or an item without text has no
    terms: such a document is not counted, such an item finds nothing.  Documents that repeat an id
    count each; rows that repeat an item id are one item, with the terms of all of them.  Other
    columns are ignored.  Empty tables on either side give no rows.

    Queries are taken in blocks of about ``QUERIES`` rows and ``TERMS`` terms, split by hash, with a pass over the
    documents each.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch, result = Scratch(spark, "lexical-search"), Scratch(spark, "lexical-search-result")
    docs = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    lower = F.translate(F.coalesce(F.col(quoted(query_col)).cast("string"), F.lit("")), UPPER, LOWER)
    asked = items.select(F.col(quoted(item_col)).cast("long").alias("item"), F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term"))
    asked = scratch.keep(asked.distinct().groupBy("item").agg(F.collect_list("term").alias("terms")), "asked")
    rows, held = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks, out = max(1, math.ceil(rows / QUERIES), math.ceil(held / TERMS)), None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()  # about QUERIES rows of about TERMS terms in all
        found = _block(docs, [(r.item, r.terms) for r in own], k, scratch) if own else None
        if found is None:
            continue
        names = spark.createDataFrame([(q, r.item) for q, r in enumerate(own)], "query long, item long")
        # No more than k rows for each query of the block.
        found = result.keep(found.join(F.broadcast(names), "query").select("item", "rank", "id", "score"), f"block-{b}")
        out = found if out is None else out.unionByName(found)
    scratch.end()
    if out is None:
        out = spark.createDataFrame([], "item long, rank int, id long, score long")
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
