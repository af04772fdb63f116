"""Scoring with a class-based bigram model.

Text is read once.  Tasks number the words of blocks of documents (about ``BLOCK`` tokens each, the
commonest words first) and write a row per block: its numbered tokens, and hash and count of each
distinct word; every later step works on those.  A block asks each bucket of 64-bit hashes for the
corpus-wide counts of its words with one packed row, and the bucket answers with one; then the block
is scored with arrays, some ``PART`` tokens at a time.  Nothing that grows with the vocabulary is
broadcast or collected.

Classes.  Every word that training has at least ``LEAST`` times is clustered; the number of classes
grows with their number (``class_count``).  The ``TOP`` most frequent are clustered first, by exchange:
starting from the classes of their commonest successors, each word in turn moves to the class that gives
the highest class-bigram likelihood, in at most ``ROUNDS`` rounds.  All others move together in ``SWEEPS``
distributed rounds: a word goes to the class under which the model gives its neighbours' classes the
highest likelihood, and then the counts of pairs of classes are taken anew.  Words that training has
once, and those that it has not seen, belong to one of ``TAILS`` classes by their spelling (last byte,
digits, length): the former stand for the latter.

Model.  p(word | previous) = p(class | previous class) p(word | class).  Transitions are smoothed
towards the classes' shares with weight ``PRIOR``; in the tail classes a count gives up ``DISCOUNT`` and what is gathered
so is the probability of a word that training has not seen.  Each sums to one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import expand, squeeze
from .scratch import Scratch, quoted
from .worker import batches_of

BLOCK, PART, TOP, CLASSES, TAILS, ROUNDS = 1 << 21, 1 << 17, 4096, 64, 32, 6
#: Least training count of a clustered word, and rounds that move those outside of the TOP.
LEAST, SWEEPS = 2, 2
PRIOR, DISCOUNT = 8.0, 0.6
#: Pseudo-words after the TOP words: the tail classes and the end of a text.
WORDS = TOP + TAILS + 1
END = WORDS - 1


def held_out(doc_id: Column) -> Column:
    """Documents that the model does not learn from; a null id is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def class_count(clustered: int) -> int:
    """Classes for so many clustered words; CLASSES at least."""
    return max(CLASSES, int(clustered**0.4 / 4))


def tail_class(word: bytes) -> int:
    """Class by spelling of a word that is not clustered."""
    if any(48 <= c <= 57 for c in word[:16]):
        return 0
    last = word[-1]
    if not 97 <= last <= 122:
        return 1 if last < 128 else 2
    return 3 + (last - 97 if len(word) < 7 else (last - 97 + 13) % 26) % (TAILS - 3)


_SCHEMA = "block long, ids array<long>, held array<boolean>, lengths array<int>, tokens binary, hashes binary, counts binary"
_TYPES = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
_NAMES = ["block", "ids", "held", "lengths", "tokens", "hashes", "counts"]


def word_hash(word: bytes) -> int:
    """59 bits of a hash of the word above 5 bits of its tail class, signed."""
    import xxhash

    value = xxhash.xxh3_64_intdigest(word) & ~31 | tail_class(word)
    return value - (1 << 64) if value >> 63 else value


def _number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block of documents."""
    from pyspark import TaskContext

    task, count = TaskContext.get().partitionId(), 0
    numbers: dict[bytes, int] = {}
    ids, held, lengths, parts, size = [], [], [], [], 0

    def block() -> pa.RecordBatch:
        tokens = np.concatenate(parts)
        every = np.bincount(tokens, minlength=len(numbers))
        order = np.argsort(-every, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        n = np.bincount(tokens[np.repeat(~np.array(held, bool), lengths)], minlength=len(numbers))[order].astype(np.int32)
        words = list(numbers)
        hashes = np.fromiter((word_hash(words[k]) for k in order.tolist()), np.int64, len(order))
        whole = [[(task << 24) + count], [ids], [held], [lengths], [squeeze(rank[tokens])], [hashes.tobytes()], [squeeze(n)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(whole, _TYPES, strict=True)], names=_NAMES)

    for batch in batches:
        texts = batch.column(2).cast(pa.large_binary())
        for doc, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
            words = (text.as_py() or b"").lower().split()
            parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint32, len(words)))
            ids.append(doc)
            held.append(out)
            lengths.append(len(words))
            size += len(words) + 1
            if size >= BLOCK:
                yield block()
                count += 1
                numbers, ids, held, lengths, parts, size = {}, [], [], [], [], 0
    if ids:
        yield block()


def _bucketed(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of hashes by bucket, then hash, and where each bucket begins in it."""
    bucket = (hashes >> 5) % buckets
    order = np.lexsort((hashes, bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def _ask(buckets: int) -> Callable:
    """Per block and bucket: hashes in order, and training counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, n = np.frombuffer(row["hashes"], np.int64), expand(row["counts"], np.int32)
                order, cuts = _bucketed(hashes, buckets)
                parts = [(k, order[cuts[k] : cuts[k + 1]]) for k in range(buckets) if cuts[k] < cuts[k + 1]]
                rows = [(row["block"], k, hashes[at].tobytes(), squeeze(n[at])) for k, at in parts]
                yield _rows(rows, ["owner", "bucket", "hashes", "counts"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()])

    return run


_ANSWER = "owner long, bucket int, counts binary, places binary, top array<struct<c: long, h: long>>, tails array<long>, clustered long, tokens long"
_ANSWER_TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.struct([("c", pa.int64()), ("h", pa.int64())])), pa.list_(pa.int64()), pa.int64(), pa.int64()]
_ANSWER_NAMES = ["owner", "bucket", "counts", "places", "top", "tails", "clustered", "tokens"]


def _count_bucket(rows: pa.Table) -> pa.Table:
    """To each block the corpus counts of its words, and the places in the bucket of those to cluster; a row without owner sums up."""
    hashes = [np.frombuffer(x, np.int64) for x in rows.column("hashes").to_pylist()]
    n = np.concatenate([expand(x, np.int32) for x in rows.column("counts").to_pylist()])
    every, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    c = np.bincount(inverse, weights=n, minlength=len(every)).astype(np.int64)
    place = np.cumsum(c >= LEAST) - 1
    out, at, bucket = [], 0, rows.column("bucket")[0].as_py()
    for owner, own in zip(rows.column("owner").to_pylist(), hashes, strict=True):
        mine = inverse[at : at + len(own)]
        at += len(own)
        places = place[mine][c[mine] >= LEAST]
        out.append((owner, bucket, squeeze(c[mine]), squeeze(np.diff(places, prepend=0).astype(np.uint32)), None, None, None, None))
    best = np.lexsort((every, -c))[:TOP]
    top = [{"c": int(c[k]), "h": int(every[k])} for k in best if c[k] >= LEAST]
    single = (c > 0) & (c < LEAST)
    tails = np.r_[np.bincount(every[single] & 31, weights=c[single], minlength=TAILS), np.bincount(every[single] & 31, minlength=TAILS)].astype(np.int64)
    out.append((None, bucket, None, None, top, tails.tolist(), int((c >= LEAST).sum()), int(c.sum())))
    return pa.Table.from_batches([_rows(out, _ANSWER_NAMES, _ANSWER_TYPES)])


_BLOCK_SCHEMA = "block long, ids array<long>, held array<boolean>, lengths array<int>, tokens binary, counts binary, words binary, movers binary, places binary, cuts binary, moved binary"


def _join_block(tops: np.ndarray, buckets: int) -> Callable:
    """One block with corpus counts and pseudo-words of its words, and those that sweeps move, by bucket and place."""
    turn = np.argsort(tops)
    sorted_tops = tops[turn]

    def run(answers: pa.Table, whole: pa.Table) -> pa.Table:
        out = whole.select(["block", "ids", "held", "lengths", "tokens"])
        hashes = np.frombuffer(whole.column("hashes")[0].as_py(), np.int64)
        order, cuts = _bucketed(hashes, buckets)
        by = np.argsort(answers.column("bucket").to_numpy()).tolist()
        counts, places = answers.column("counts").to_pylist(), answers.column("places").to_pylist()
        found = np.concatenate([np.zeros(0, np.int64), *(expand(counts[k], np.int64) for k in by)])
        place = np.full(len(order), -1, np.int64)
        place[found >= LEAST] = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(expand(places[k], np.uint32), dtype=np.int64) for k in by)])
        c = np.empty(len(order), np.int64)
        c[order] = found
        word = TOP + (hashes & 31)
        if len(tops):
            at = np.minimum(np.searchsorted(sorted_tops, hashes), len(tops) - 1)
            word = np.where(sorted_tops[at] == hashes, turn[at], word)
        moves = np.flatnonzero((place >= 0) & (word[order] >= TOP))
        packed = [c, word.astype(np.uint16), order[moves].astype(np.uint32), place[moves].astype(np.uint32), np.searchsorted(moves, cuts).astype(np.uint32)]
        for name, x in zip(("counts", "words", "movers", "places", "cuts"), packed, strict=True):
            out = out.append_column(name, pa.array([squeeze(x)], pa.binary()))
        return out.append_column("moved", pa.array([None], pa.binary()))

    return run


def _classes(row: dict, own: np.ndarray) -> np.ndarray:
    """Class of each word of a block."""
    out = own[expand(row["words"], np.uint16)]
    if row["moved"] is not None:
        out[expand(row["movers"], np.uint32)] = expand(row["moved"], np.uint16)
    return out


def _sequences(row: dict) -> Iterator[tuple]:
    """Parts of a block: ids, held flags, tokens' numbers with the end as -1, where documents start.

    A part has about PART tokens, or one longer document.
    """
    raw = expand(row["tokens"], np.uint32)
    lengths = np.array(row["lengths"], np.int64)
    stops = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        base = int(stops[at] - lengths[at])
        to = max(at + 1, int(np.searchsorted(stops, base + PART, side="right")))
        own = lengths[at:to]
        ends = np.cumsum(own + 1) - 1
        numbers = np.full(int(ends[-1]) + 1, -1, np.int64)
        inner = np.ones(len(numbers), bool)
        inner[ends] = False
        numbers[inner] = raw[base : int(stops[to - 1])]
        yield row["ids"][at:to], np.array(row["held"][at:to], bool), numbers, ends - own
        at = to


def _pairs(size: int, own: np.ndarray | None = None) -> Callable:
    """Counts of pairs of neighbouring pseudo-words (of ``size``, the last is the end) in training text, by bucket of the first; of classes with ``own``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []
        held_back = 0
        for row in (r for batch in batches for r in batch.to_pylist()):
            words = np.append(expand(row["words"], np.uint16) if own is None else _classes(row, own), size - 1).astype(np.int64)
            for _, held, numbers, starts in _sequences(row):
                word = words[numbers]
                before = np.roll(word, 1)
                before[starts] = size - 1
                learned = np.repeat(~held, np.diff(np.r_[starts, len(numbers)]))
                waiting.append((before * size + word)[learned].astype(np.uint32))
                held_back += len(waiting[-1])
                if held_back >= BLOCK:
                    code, n = np.unique(np.concatenate(waiting), return_counts=True)
                    codes, counts = _merged(np.r_[codes, code], np.r_[counts, n])
                    waiting, held_back = [], 0
        if waiting:
            code, n = np.unique(np.concatenate(waiting), return_counts=True)
            codes, counts = _merged(np.r_[codes, code], np.r_[counts, n])
        if len(codes):
            bucket = (codes // np.uint32(size)) % 64
            rows = [(b, codes[bucket == b].tobytes(), counts[bucket == b].tobytes()) for b in np.unique(bucket).tolist()]
            yield _rows(rows, ["bucket", "codes", "counts"], [pa.int32(), pa.binary(), pa.binary()])

    return run


def _collected(blocks: DataFrame, size: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the pairs of ``_pairs`` in order, and their counts; at most size squared."""
    merged = blocks.mapInArrow(batches_of("class_lm", _pairs(size, own)), "bucket int, codes binary, counts binary").groupBy("bucket").applyInArrow(_merge_bucket, "codes binary, counts binary").collect()
    code = np.concatenate([expand(r["codes"], np.uint32) for r in merged] or [np.zeros(0, np.uint32)])
    n = np.concatenate([expand(r["counts"], np.int64) for r in merged] or [np.zeros(0, np.int64)]).astype(np.float64)
    order = np.argsort(code)  # buckets come in any order
    return code[order], n[order]


def _contexts(own: np.ndarray, every: int) -> Callable:
    """Per block and bucket: places of the words to move, and counts of the classes before (below ``every``) and after them in training text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            movers, places, cuts = expand(row["movers"], np.uint32), expand(row["places"], np.uint32), expand(row["cuts"], np.uint32)
            cls = np.append(_classes(row, own), every - 1).astype(np.int64)
            mover = np.full(len(cls), -1, np.int64)
            mover[movers] = np.arange(len(movers))
            codes = [np.zeros(0, np.int64)]
            for _, held, numbers, starts in _sequences(row):
                m, here = mover[numbers], cls[numbers]
                before = np.roll(here, 1)
                before[starts] = every - 1
                seen = (m >= 0) & np.repeat(~held, np.diff(np.r_[starts, len(numbers)]))
                codes += [m[seen] * (2 * every) + before[seen], m[seen] * (2 * every) + every + np.roll(here, -1)[seen]]
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            m = code // (2 * every)
            stops = np.searchsorted(m, cuts)
            rows = []
            for k in np.flatnonzero(np.diff(cuts.astype(np.int64))).tolist():
                a, b = stops[k], stops[k + 1]
                packed = [places[cuts[k] : cuts[k + 1]], np.diff(m[a:b], prepend=cuts[k]).astype(np.uint32), (code[a:b] % (2 * every)).astype(np.uint16), n[a:b].astype(np.uint32)]
                packed[0] = np.diff(packed[0], prepend=np.uint32(0))
                rows.append((row["block"], k, *map(squeeze, packed)))
            yield _rows(rows, ["owner", "bucket", "places", "movers", "contexts", "counts"], [pa.int64(), pa.int32(), *[pa.binary()] * 4])

    return run


def choose(place: np.ndarray, context: np.ndarray, n: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """The best class of each word 0, 1, ... of which contexts are counted: that of the highest sum of counts times gains[context]."""
    width = len(gains)
    code, inverse = np.unique(place * width + context, return_inverse=True)
    n = np.bincount(inverse, weights=n, minlength=len(code))
    place, context = code // width, code % width
    begin = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(code) else np.zeros(0, int)
    out = np.zeros(int(place[-1]) + 1 if len(code) else 0, np.uint16)
    edges = np.r_[begin, len(code)]
    at = 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + (1 << 14), side="right")) - 1)
        a, b = edges[at], edges[to]
        out[place[begin[at:to]]] = np.add.reduceat(n[a:b, None] * gains[context[a:b]], begin[at:to] - a, axis=0).argmax(1)
        at = to
    return out


def _gains(pairs: np.ndarray, classes: int) -> np.ndarray:
    """Log likelihood of a class before (then: after) a word for each class that the word may be in, the word's own included."""
    move = np.log(_transitions(pairs))
    return np.vstack([move[:, :classes] - np.log(np.maximum(pairs.sum(0)[:classes], 1)), move[:classes].T])


def _transitions(pairs: np.ndarray) -> np.ndarray:
    share = (pairs.sum(0) + 1) / (pairs.sum() + len(pairs))
    return (pairs + PRIOR * share) / (pairs.sum(1, keepdims=True) + PRIOR)


def _move_bucket(gains: np.ndarray) -> Callable:
    """To each block the new classes of its words of a bucket."""

    def run(rows: pa.Table) -> pa.Table:
        asked, place, context, n = [], [], [], []
        for r in rows.to_pylist():
            places = np.cumsum(expand(r["places"], np.uint32), dtype=np.int64)
            asked.append(places)
            place.append(places[np.cumsum(expand(r["movers"], np.uint32), dtype=np.int64)])
            context.append(expand(r["contexts"], np.uint16).astype(np.int64))
            n.append(expand(r["counts"], np.uint32))
        best = choose(np.concatenate(place), np.concatenate(context), np.concatenate(n), gains)
        return pa.table({"owner": rows.column("owner"), "bucket": rows.column("bucket"), "moved": pa.array([squeeze(best[x]) for x in asked], pa.binary())})

    return run


def _move_block(answers: pa.Table, whole: pa.Table) -> pa.Table:
    by = np.argsort(answers.column("bucket").to_numpy()).tolist()
    moved = answers.column("moved").to_pylist()
    classes = np.concatenate([np.zeros(0, np.uint16), *(expand(moved[k], np.uint16) for k in by)])
    return whole.drop_columns(["moved"]).append_column("moved", pa.array([squeeze(classes)], pa.binary()))


def _merged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    begin = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, int)
    return codes[begin], np.add.reduceat(counts, begin) if len(begin) else counts


def _merge_bucket(rows: pa.Table) -> pa.Table:
    codes, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for c, n in zip(rows.column("codes").to_pylist(), rows.column("counts").to_pylist(), strict=True):
        codes, counts = _merged(np.r_[codes, np.frombuffer(c, np.uint32)], np.r_[counts, np.frombuffer(n, np.int64)])
    return pa.table({"codes": pa.array([squeeze(codes)], pa.binary()), "counts": pa.array([squeeze(counts)], pa.binary())})


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(before: np.ndarray, after: np.ndarray, n: np.ndarray, top: int = TOP, classes: int = CLASSES, tails: int = TAILS, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each pseudo-word, from counts n of pairs (before, after) sorted by both.

    Words below ``top`` get classes below ``classes``; each tail class and the end keep their own.  A
    word leaves its class and goes where the class-bigram likelihood of all pairs is highest, one
    after the other, until a round moves hardly any word.
    """
    words, every = top + tails + 1, classes + tails + 1
    common = np.full(words, -1)
    by_count = np.argsort(n, kind="stable")
    common[before[by_count]] = after[by_count]  # the commonest successor comes last
    own = np.r_[(common[:top] + 1) % classes, classes + np.arange(tails + 1)]
    turned = np.lexsort((before, after))
    right_of, left_of = np.searchsorted(before, np.arange(words + 1)), np.searchsorted(after[turned], np.arange(words + 1))
    leaders, leader_n = before[turned], n[turned]
    pairs = np.bincount(own[before] * every + own[after], weights=n, minlength=every * every).reshape(every, every)
    left, right = pairs.sum(1), pairs.sum(0)
    inner = np.arange(classes)
    for _ in range(rounds):
        moved = 0
        for w in range(top):
            a, b, c, d = right_of[w], right_of[w + 1], left_of[w], left_of[w + 1]
            if a == b and c == d:
                continue
            is_self = after[a:b] == w
            own_n = n[a:b][is_self].sum()
            to = np.bincount(own[after[a:b]], weights=np.where(is_self, 0.0, n[a:b]), minlength=every)
            come = np.bincount(own[leaders[c:d]], weights=np.where(leaders[c:d] == w, 0.0, leader_n[c:d]), minlength=every)
            old, n_to, n_come = own[w], to.sum() + own_n, come.sum() + own_n
            pairs[old] -= to
            pairs[:, old] -= come
            pairs[old, old] -= own_n
            left[old] -= n_to
            right[old] -= n_come
            rows, columns = np.flatnonzero(to), np.flatnonzero(come)
            block, wall = pairs[:classes][:, rows], pairs[columns][:, :classes]
            gain = (_xlogx(block + to[rows]) - _xlogx(block)).sum(1) + (_xlogx(wall + come[columns][:, None]) - _xlogx(wall)).sum(0)
            cell = pairs[inner, inner]
            gain += _xlogx(cell + to[:classes] + come[:classes] + own_n) + _xlogx(cell) - _xlogx(cell + to[:classes]) - _xlogx(cell + come[:classes])
            gain -= _xlogx(left[:classes] + n_to) - _xlogx(left[:classes]) + _xlogx(right[:classes] + n_come) - _xlogx(right[:classes])
            best = int(gain.argmax())
            best = int(old) if gain[best] <= gain[old] + 1e-9 else best
            pairs[best] += to
            pairs[:, best] += come
            pairs[best, best] += own_n
            left[best] += n_to
            right[best] += n_come
            own[w] = best
            moved += best != old
        if moved <= top // 500:
            break
    return own


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held`` tells which rows are not learned from (default: ``held_out`` of the id).  A text is its
    words and an end; null, empty and white-space texts are the end alone.  Rows that repeat are
    learned from and scored each.  With nothing to learn from, every token is unknown: base_score is
    0 and score rests on equal classes.  Other columns are ignored.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "class-lm")
    held = held if held is not None else held_out(F.col(quoted(id_col)))
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), held.alias("held"), F.col(quoted(text_col)).cast("string").alias("text"))
    numbered = scratch.keep(rows.mapInArrow(batches_of("class_lm", _number), _SCHEMA), "numbered")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = numbered.select("block", "hashes", "counts").mapInArrow(_ask(buckets), "owner long, bucket int, hashes binary, counts binary")
    answers = scratch.keep(asked.groupBy("bucket").applyInArrow(_count_bucket, _ANSWER), "answers")
    sums = answers.where("owner is null")
    top = sums.select(F.inline("top")).orderBy(F.desc("c"), "h").limit(TOP).collect()  # at most TOP rows
    ends = numbered.select(F.expr("size(filter(held, x -> not x))").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tails = sums.select(F.posexplode("tails").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()  # at most 2 * TAILS rows
    tail_n, tail_v = np.zeros(TAILS), np.zeros(TAILS)
    for r in tails:
        (tail_n if r["k"] < TAILS else tail_v)[r["k"] % TAILS] = r["n"]
    whole = sums.agg(F.coalesce(F.sum("clustered"), F.lit(0)).alias("clustered"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    tokens = int(whole["tokens"] + ends)
    types = int(whole["clustered"] + tail_v.sum() + (ends > 0))

    tops = np.array([r["h"] for r in top], np.int64)
    joined = answers.where("owner is not null").select("owner", "bucket", "counts", "places").groupBy("owner").cogroup(numbered.select("block", "ids", "held", "lengths", "tokens", "hashes").groupBy("block"))
    blocks = scratch.keep(joined.applyInArrow(_join_block(tops, buckets), _BLOCK_SCHEMA), "blocks")
    scratch.drop(numbered)
    scratch.drop(answers)

    code, n = _collected(blocks, WORDS)
    before, after = (code // WORDS).astype(np.uint16), (code % WORDS).astype(np.uint16)
    del code
    classes = class_count(int(whole["clustered"]))
    every = classes + TAILS + 1
    own = exchange(before, after, n, classes=classes)
    pairs = np.bincount(own[before] * every + own[after], weights=n, minlength=every * every).reshape(every, every)
    del before, after, n
    for _ in range(SWEEPS if whole["clustered"] > len(top) else 0):
        contexts = blocks.mapInArrow(batches_of("class_lm", _contexts(own, every)), "owner long, bucket int, places binary, movers binary, contexts binary, counts binary")
        moved = contexts.groupBy("bucket").applyInArrow(_move_bucket(_gains(pairs, classes)), "owner long, bucket int, moved binary")
        old, blocks = blocks, scratch.keep(moved.groupBy("owner").cogroup(blocks.groupBy("block")).applyInArrow(_move_block, _BLOCK_SCHEMA), "moved")
        scratch.drop(old)
        code, n = _collected(blocks, every, own)
        pairs = np.bincount(code, weights=n, minlength=every * every).reshape(every, every)
    move = np.log10(_transitions(pairs))
    class_n = pairs.sum(0)

    model = spark.sparkContext.broadcast((own, move, class_n, tail_n, tail_v, tokens, types, int(ends)))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, move, class_n, tail_n, tail_v, tokens, types, ends = model.value
        for row in (r for batch in batches for r in batch.to_pylist()):
            counts, words = np.append(expand(row["counts"], np.int64), ends), np.append(expand(row["words"], np.uint16), END)
            classes = np.append(_classes(row, own), own[END])
            base = np.log10((counts + 1) / (tokens + types + 1))
            emit = np.zeros(len(words))
            clustered = (counts >= LEAST) & (words < END)
            emit[clustered] = np.log10(counts[clustered] / class_n[classes[clustered]])
            rare = (counts < LEAST) & (words < END)
            t = words[rare].astype(np.int64) - TOP
            c = counts[rare]
            p = np.where(c > 0, c - DISCOUNT, DISCOUNT * tail_v[t]) / np.maximum(tail_n[t], 1)
            emit[rare] = np.log10(np.where(tail_n[t] > 0, p, 1.0))
            for ids, held, numbers, starts in _sequences(row):
                cls = classes[numbers]
                last = np.roll(cls, 1)
                last[starts] = own[END]
                sums = [np.add.reduceat(x, starts) for x in (move[last, cls] + emit[numbers], base[numbers], (counts > 0).astype(np.int64)[numbers])]
                sizes = np.diff(np.r_[starts, len(numbers)])
                columns = [pa.array(ids, pa.int64()), pa.array(held), pa.array(sizes), pa.array(sums[2]), pa.array(np.full(len(ids), tokens, np.int64)), pa.array(sums[1]), pa.array(sums[0])]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return blocks.mapInArrow(batches_of("class_lm", score), f"{quoted(id_col)} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
