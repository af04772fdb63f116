"""Vector code compression: codebooks for parts of vectors by Lloyd's rounds that rescan few parts.

Vectors of integers are cut into ``PARTS`` equal parts; each part position has a codebook.  A round assigns each
part to its nearest entry and moves each entry to the floor of its parts' mean.

Between rounds a part keeps its entry and a slack: a lower bound of the distance to every other entry
less an upper bound of the distance to its own.  When entries move, the slack of a part of entry e shrinks by e's
move and the largest move of another at most; the sum of these since the start is e's drift, the same for all of its
parts.  So a part's key, its slack plus the drift of its entry when it was last scanned, need not be
touched: the part can have a new nearest entry only once its key is not above its entry's drift.

A task holds, for each entry, a heap of its parts by that key (in an array in key order, which is one),
over blocks of ``BLOCK`` vectors of its partition.  A round pops from each heap until the least key is above the
drift, measures the popped parts against all entries in exact integers and puts them back under
their new entries.  A part that moves changes two sums; tasks return these changes, so that what a round
sends follows the number of entries, and the sums are always those of all parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, quoted
from .worker import batches_of

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integers stay within +-LIMIT, so that squared distances are exact in doubles.
LIMIT = 1 << 22
#: Vectors that share heaps, and their bytes, at most; parts measured at a time.
BLOCK, BYTES, STEP = 1 << 16, 1 << 26, 4096
#: Bounds give way by this share of a distance, and a slack by so much, for rounding.
SLIP, LEAST = 1e-9, 1e-6

STATE = "kind int, id long, label_key string, vector binary, code binary, key binary, entry int, n long, sums array<long>"


def integers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int32)


def scan(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (the first of several), its squared distance and that of the next, for each part."""
    entry, near, next_ = np.zeros(len(parts), np.int64), np.zeros(len(parts)), np.zeros(len(parts))
    own = (book * book).sum(1).astype(np.float64)
    for at in range(0, len(parts), STEP):
        x = parts[at : at + STEP].astype(np.float64)
        far = (x * x).sum(1)[:, None] - 2 * (x @ book.T.astype(np.float64)) + own  # integers below 2**53: exact
        best = far.argmin(1)
        rows = np.arange(len(x))
        entry[at : at + STEP], near[at : at + STEP] = best, far[rows, best]
        far[rows, best] = np.inf
        next_[at : at + STEP] = far.min(1)
    return entry, near, next_


class Heaps:
    """For one part position: parts by entry, each entry's in order of their keys."""

    def __init__(self, entry: np.ndarray, key: np.ndarray, entries: int):
        self.order = np.lexsort((key, entry))
        self.begin = np.searchsorted(entry[self.order], np.arange(entries + 1))
        self.key = key[self.order]

    def popped(self, drift: np.ndarray) -> np.ndarray:
        """Parts from the top of each heap down to the first whose key is above its entry's drift."""
        out = []
        for e in np.flatnonzero(np.diff(self.begin)).tolist():
            b, end = self.begin[e], self.begin[e + 1]
            out.append(self.order[b : b + np.searchsorted(self.key[b:end], drift[e], side="right")])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows, size = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            piece = batch.slice(at, STEP)
            if rows and (rows + piece.num_rows > BLOCK or size + piece.nbytes > BYTES):
                yield pa.Table.from_batches(held)
                held, rows, size = [], 0, 0
            held.append(piece)
            rows += piece.num_rows
            size += piece.nbytes
    if rows:
        yield pa.Table.from_batches(held)


def _round(books: np.ndarray, drift: np.ndarray | None):
    """One assignment; ``drift`` is null in the first, in which every part is measured."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = books.shape[2]
        change = np.zeros((PARTS * ENTRIES, width + 1), np.int64)
        for rows in _blocks(batches):
            joined = lambda c: b"".join(rows.column(c).to_pylist())  # noqa: B023, E731
            vector = np.frombuffer(joined("vector"), np.int32).reshape(rows.num_rows, PARTS, width)
            if drift is None:
                code, key = np.zeros((rows.num_rows, PARTS), np.uint8), np.zeros((rows.num_rows, PARTS))
            else:
                code = np.frombuffer(joined("code"), np.uint8).reshape(-1, PARTS).copy()
                key = np.frombuffer(joined("key"), np.float64).reshape(-1, PARTS).copy()
            for p in range(PARTS):
                part, entries = vector[:, p], books.shape[1]
                old = code[:, p].astype(np.int64)
                seen = np.arange(rows.num_rows) if drift is None else Heaps(old, key[:, p], entries).popped(drift[p])
                new, near, next_ = scan(part[seen], books[p])
                code[seen, p] = new
                key[seen, p] = np.sqrt(next_) * (1 - SLIP) - np.sqrt(near) * (1 + SLIP) - LEAST + (0 if drift is None else drift[p][new])
                moved = np.ones(len(seen), bool) if drift is None else new != old[seen]
                what = np.c_[part[seen[moved]].astype(np.int64), np.ones(moved.sum(), np.int64)]
                np.add.at(change, p * ENTRIES + new[moved], what)
                if drift is not None:
                    np.subtract.at(change, p * ENTRIES + old[seen[moved]], what)
            n = rows.num_rows
            none = lambda kind: pa.nulls(n, kind)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(n, np.int32)), rows.column("id").combine_chunks(), rows.column("label_key").combine_chunks(), rows.column("vector").combine_chunks(), pa.array([c.tobytes() for c in code], pa.binary()), pa.array([k.tobytes() for k in key], pa.binary()), none(pa.int32()), none(pa.int64()), none(pa.list_(pa.int64()))],
                names=[x.split()[0] for x in STATE.split(", ")],
            )
        used = np.flatnonzero(change.any(axis=1))
        n = len(used)
        none = lambda kind: pa.nulls(n, kind)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(n, np.int32)), none(pa.int64()), none(pa.string()), none(pa.binary()), none(pa.binary()), none(pa.binary()), pa.array(used.astype(np.int32)), pa.array(change[used, -1]), pa.array(change[used, :-1].tolist(), pa.list_(pa.int64()))],
            names=[x.split()[0] for x in STATE.split(", ")],
        )

    return batches_of("vector_codes", run)


def _errors(books: np.ndarray):
    """Squared distance to the assigned entries, summed over parts, and the code as text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            vector = np.frombuffer(b"".join(rows.column("vector").to_pylist()), np.int32).reshape(rows.num_rows, PARTS, -1)
            code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(-1, PARTS)
            off = vector - books[np.arange(PARTS), code]
            error = (off * off).sum(axis=(1, 2))
            yield pa.RecordBatch.from_arrays([rows.column("id").combine_chunks(), rows.column("label_key").combine_chunks(), pa.array([c.tobytes().hex() for c in code]), pa.array(error)], names=["id", "label_key", "code", "error"])

    return batches_of("vector_codes", run)


def _packed(width: int):
    """Id, label and vector -> the same with the vector's integers as bytes; rows of other lengths or with bad components go."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            lists = lists.filter(keep := pa.array(lists.value_lengths().fill_null(-1).to_numpy() == width))
            values = np.asarray(lists.flatten().fill_null(float("nan"))).astype(np.float64).reshape(-1, width)
            good = np.isfinite(values).all(axis=1)
            data = [v.tobytes() for v in integers(values[good])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(keep).filter(pa.array(good)) for c in (0, 1)), pa.array(data, pa.binary())], names=["id", "label_key", "vector"])

    return batches_of("vector_codes", run)


def codebooks_text(books: np.ndarray) -> str:
    """All components by part, entry and position, joined by commas."""
    return ",".join(map(str, books.ravel().tolist()))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per kept row: id, code, error, label_error, codebooks_sha256.

    Dropped: rows whose vector is null, holds null or non-finite components, is empty, has a length that
    ``PARTS`` doesn't divide, or another length than the kept vector of the smallest id (null ids after others).  The first codebooks are the vectors of the
    ``ENTRIES`` smallest ids, equal ids by vector; of fewer, all.  Rows that repeat an id count each.  Integers stay within +-``LIMIT``.
    ``label_error`` is null where the sum exceeds 64 bits.  Other columns are ignored.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch, result = Scratch(spark, "vector-codes"), Scratch(spark, "vector-codes-result")
    array = F.col(quoted(vector_col)).cast("array<double>")
    rows = vectors.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(label_col)).cast("string").alias("label_key"), array.alias("vector"))
    fine = f"size(vector) > 0 and size(vector) % {PARTS} = 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    order = (F.asc_nulls_last("id"), "vector")
    least = rows.where(fine).orderBy(*order).select(F.size("vector")).first()
    width = least[0] if least else PARTS
    written = state = scratch.keep(rows.mapInArrow(_packed(width), "id long, label_key string, vector binary"), "vectors")
    first = rows.where(fine).where(F.size("vector") == width).orderBy(*order).limit(ENTRIES).select("vector").collect()
    if not first:
        scratch.end()
        return spark.createDataFrame([], "id long, code string, error long, label_error long, codebooks_sha256 string").withColumnRenamed("id", id_col)
    books = integers(np.array([r.vector for r in first])).astype(np.int64).reshape(len(first), PARTS, -1).swapaxes(0, 1).copy()
    sums, drift = np.zeros((PARTS, ENTRIES, width // PARTS + 1), np.int64), None
    for number in range(ROUNDS + 1):
        after = scratch.keep(state.mapInArrow(_round(books, drift), STATE), f"round-{number}")
        scratch.drop(written)
        written, state = after, after.where("kind = 0")
        if number == ROUNDS:
            break
        totals = after.where("kind = 1").groupBy("entry").agg(F.sum("n"), *[F.sum(F.col("sums")[i]) for i in range(width // PARTS)])
        for r in totals.collect():  # a row an entry
            sums[r[0] // ENTRIES, r[0] % ENTRIES] += np.array([*r[2:], r[1]], np.int64)
        count = sums[:, : books.shape[1], -1:]
        moved = np.where(count > 0, sums[:, : books.shape[1], :-1] // np.maximum(count, 1), books)
        move = np.sqrt(((moved - books) ** 2).sum(axis=2).astype(np.float64)) * (1 + SLIP)
        drift = (np.zeros_like(move) if drift is None else drift) + move + _largest_other(move)
        books = moved
    coded = result.keep(state.mapInArrow(_errors(books), "id long, label_key string, code string, error long"), "codes")
    scratch.end()
    per_label = coded.groupBy("label_key").agg(F.expr("try_sum(error)").alias("label_error"))
    out = coded.alias("c").join(per_label.alias("l"), F.expr("c.label_key <=> l.label_key"))
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _largest_other(move: np.ndarray) -> np.ndarray:
    """For each entry the largest move of another of its codebook."""
    if move.shape[1] == 1:
        return np.zeros_like(move)
    top = np.sort(move, axis=1)[:, -2:]
    return np.where(move == top[:, 1:], top[:, :1], top[:, 1:])
