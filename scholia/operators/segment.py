"""Words of Han text: a lexicon learned from a corpus, and the most probable way to read a run of characters.

A string of two to ``LONGEST`` characters is a word if it occurs ``LEAST`` times, holds together and is used freely.
It holds together if, for each cut, it is more frequent than its two sides let expect (by ``COHESION``, as a logarithm), and
so do both strings in it that are one character shorter.  It is used freely if the entropy of the characters on either side is ``FREEDOM`` at
least.  Counts are of whole texts, level by level: a string of k characters is counted only where a bitmap of
``SLOTS`` slots has both strings of k - 1 in it, so that the mass of strings by chance is never shuffled.  The ``WORDS`` most
frequent words make the lexicon; it is counted anew on the readings it gives.

A string is a number: 16 bits a character, so counting, joining and looking up are done on longs,
whole batches at a time.  Sorted arrays of those numbers stand in for a trie.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

LONGEST, LEAST, COHESION, FREEDOM, WORDS = 4, 5, 1.0, 0.5, 1 << 18
#: Slots of the bitmap (a prime), characters that are handled at a time, strings that are counted together.
SLOTS, PIECE, HELD = 4194301, 1 << 18, 1 << 20
FIRST, LAST = 0x4E00, 0x9FFF
#: Tokens before Han runs are read: those runs, and runs of other letters and digits.
RUNS = r"[\x{4e00}-\x{9fff}]+|[\p{L}\p{N}&&[^\x{4e00}-\x{9fff}]]+"


@dataclass(frozen=True)
class Lexicon:
    """Words as sorted numbers with the logarithms of their probabilities, and that of a character that is none."""

    words: np.ndarray
    logs: np.ndarray
    unknown: float

    def __len__(self) -> int:
        return len(self.words)

    @cached_property
    def places(self) -> Places:
        return Places(self.words)

    def log(self, value: np.ndarray) -> np.ndarray:
        """Logarithms of strings; minus infinity for those that are no words."""
        place = self.places.of(value)
        return np.where(place < 0, -np.inf, self.logs[place]) if len(self.logs) else np.full(len(value), -np.inf)


class Places:
    """Where each of some distinct numbers stands among them: a hash table with a quarter of its slots taken at most.

    A number that finds its slot taken goes to the next; look-ups walk on together, only those that met another number.
    """

    def __init__(self, words: np.ndarray):
        bits = max(4, int(4 * len(words)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.place, self.word = np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, np.int64)
        left = np.arange(len(words), dtype=np.int32)
        slot = self._slot(words)
        while len(left):
            free = self.place[slot] < 0
            self.place[slot[free]] = left[free]  # of several numbers one stays
            out = self.place[slot] != left
            left, slot = left[out], slot[out] + 1 & self.mask
        taken = self.place >= 0
        self.word[taken] = words[self.place[taken]]

    def _slot(self, value: np.ndarray) -> np.ndarray:
        return (value.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def of(self, value: np.ndarray) -> np.ndarray:
        """The place of each number, -1 if it is not there."""
        slot = self._slot(value)
        place = self.place[slot]
        on = np.flatnonzero((self.word[slot] != value) & (place >= 0))
        walk = slot[on]
        while len(on):
            walk = walk + 1 & self.mask
            now = self.place[walk]
            place[on] = now
            going = (self.word[walk] != value[on]) & (now >= 0)
            on, walk = on[going], walk[going]
        return place


def packed(word: str) -> int:
    """A string of at most four Han characters as one number (signed, 64 bits)."""
    value = 0
    for c in word:
        value = value << 16 | ord(c)
    return value - (1 << 64) if value >> 63 else value


def unpacked(value: int) -> str:
    value &= (1 << 64) - 1
    return "".join(chr(c) for k in (48, 32, 16, 0) if (c := value >> k & 0xFFFF))


def spelled(word: Column) -> Column:
    """``unpacked`` as an expression."""
    each = [F.shiftrightunsigned(word, k).bitwiseAND(F.lit(0xFFFF)) for k in (48, 32, 16, 0)]
    parts = [F.when(c > 0, F.decode(F.unhex(F.lpad(F.hex(c), 4, "0")), "UTF-16BE")).otherwise(F.lit("")) for c in each]
    return F.concat(*parts)


def _cut(units: np.ndarray) -> Iterator[np.ndarray]:
    """Pieces of about ``PIECE`` units that part, and share a unit, where no Han character stands."""
    at = 0
    while len(units) - at > 2 * PIECE:
        gaps = np.flatnonzero(~_han(units[at + PIECE : at + 2 * PIECE]))
        if not len(gaps):  # a run as long as that stays whole
            gaps = np.flatnonzero(~_han(units[at + PIECE :]))
        end = at + PIECE + int(gaps[0])
        yield units[at : end + 1]
        at = end
    yield units[at:]


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """16-bit units of the texts with a line end before and after each."""
    held, size = [], 0
    units = lambda: np.frombuffer(("\n" + "\n".join(held) + "\n").encode("utf-16-le", "surrogatepass"), np.uint16)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.append(text or "")
            size += len(held[-1])
            if size >= PIECE:
                yield from _cut(units())
                held, size = [], 0
    if held:
        yield from _cut(units())


def _han(units: np.ndarray) -> np.ndarray:
    return (units >= FIRST) & (units <= LAST)


def _numbers(units: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of the ``level`` units from each place on, and whether all are Han characters."""
    n = max(0, len(units) - level + 1)
    inside, value = np.ones(n, bool), np.zeros(n, np.uint64)
    fine, wide = _han(units), units.astype(np.uint64)
    for k in range(level):
        inside &= fine[k : n + k]
        value = value << np.uint64(16) | wide[k : n + k]
    return value.view(np.int64), inside


def _summed(each: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers and how often each occurs among about ``HELD`` that follow one another."""
    held, size = [], 0
    for numbers in each:
        held.append(numbers)
        size += len(numbers)
        if size >= HELD:
            yield np.unique(np.concatenate(held), return_counts=True)
            held, size = [], 0
    if size:
        yield np.unique(np.concatenate(held), return_counts=True)


def _give_back() -> None:
    """Free memory of this worker goes back to the system, which neither Arrow nor the C library does on its own."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        return


def _counts(level: int, frequent: np.ndarray | None):
    """Texts -> strings of ``level`` characters and how often."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for units in _pieces(batches):
            value, inside = _numbers(units, level)
            if frequent is not None:
                part, fine = _numbers(units, level - 1)
                likely = fine & frequent[part % SLOTS]
                inside &= likely[:-1] & likely[1:]
            yield value[inside]

    def characters(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = np.zeros(1 << 16, np.int64)
        for units in _pieces(batches):
            n += np.bincount(units[_han(units)], minlength=1 << 16)
        found = np.flatnonzero(n)
        yield found, n[found]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, n in characters(batches) if level == 1 else _summed(each(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["word", "n"])
        _give_back()

    return run


def _sides(candidates: np.ndarray):
    """Texts -> candidate, side (0 left, 1 right), character beside it (0: none that is Han) and how often, for each piece."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        places = Places(candidates)
        for units in _pieces(batches):
            beside = np.where(_han(units), units, 0).astype(np.int64)
            for level in range(2, LONGEST + 1):
                value, inside = _numbers(units, level)
                at = np.flatnonzero(inside)
                place = places.of(value[at]).astype(np.int64)
                place, at = place[place >= 0], at[place >= 0]
                yield np.r_[place << 17 | beside[at - 1], place << 17 | 1 << 16 | beside[at + level]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, n in _summed(each(batches)):
            columns = [candidates[found >> 17], (found >> 16 & 1).astype(np.int32), (found & 0xFFFF).astype(np.int32), n]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["word", "side", "beside", "n"])
        _give_back()

    return run


def read(units: np.ndarray, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of all runs begin, and how long they are: the most probable reading of each run.

    All runs go forward together, a character at a step.  Of equally probable readings the one
    whose last word is longest is taken.
    """
    fine = np.r_[False, _han(units), False]
    edges = np.flatnonzero(fine[1:] != fine[:-1])
    begin, size = edges[::2], edges[1::2] - edges[::2]
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    # Characters lie step by step: the first of all runs, the second of those that have one, and so on.  A longer run comes first, so
    # what belongs to the runs that are still going is the beginning of each step.
    alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    first = np.cumsum(alive) - alive
    step = np.repeat(np.arange(len(alive)), alive)
    at = begin[np.arange(len(step)) - first[step]] + step
    value, logs = np.zeros(len(at), np.uint64), []
    for level in range(1, LONGEST + 1):  # of the string that ends at a character; those that begin before its run are no words
        value |= units[np.maximum(at - level + 1, 0)].astype(np.uint64) << np.uint64(16 * (level - 1))
        log = np.full(len(at), -np.inf)
        whole = int(first[level - 1]) if level <= len(first) else len(at)
        log[whole:] = lexicon.log(value[whole:].view(np.int64))
        logs.append(log)
    logs[0] = np.where(logs[0] == -np.inf, lexicon.unknown, logs[0])
    best = np.empty(len(at))
    starts_at, counts = first.tolist(), alive.tolist()
    for number, (a, n) in enumerate(zip(starts_at, counts, strict=True)):
        score = best[a : a + n]
        score[:] = logs[number][a : a + n] if number < LONGEST else -np.inf  # the whole run so far as one word
        for level in range(1, min(LONGEST, number) + 1):
            before = starts_at[number - level]
            np.maximum(score, best[before : before + n] + logs[level - 1][a : a + n], out=score)
    back = np.zeros(len(units), np.int8)
    taken = np.zeros(len(at), np.int8)
    rank = np.arange(len(at)) - first[step]
    for level in range(1, LONGEST + 1):  # the longest of those that are as good
        before = np.where(step >= level, best[first[np.maximum(step - level, 0)] + rank], 0.0)
        taken[before + logs[level - 1] == best] = level
    back[at] = taken
    marked, now, low = np.zeros(len(units), np.int8), begin + size - 1, begin
    while len(now):
        length = back[now]
        now = now - length
        marked[now + 1] = length
        going = now >= low
        now, low = now[going], low[going]
    starts = np.flatnonzero(marked)
    return starts, marked[starts].astype(np.int64)


def _word_counts(lexicon: Lexicon):
    """Texts -> words of their readings and how often."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for units in _pieces(batches):
            starts, lengths = read(units, lexicon)
            for level in range(1, LONGEST + 1):
                yield _numbers(units, level)[0][starts[lengths == level]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, n in _summed(each(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["word", "n"])
        _give_back()

    return run


def _bitmap(strings: DataFrame) -> np.ndarray:
    """Taken slots of a table of strings as ``SLOTS`` flags; 128 rows of 4 KB come to the driver."""
    slot = F.pmod("word", F.lit(SLOTS)) + 1  # positions count from one
    rows = strings.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros(-(-SLOTS // 32768) * 32768, bool)
    for r in rows.collect():
        out[(r.bucket - 1) * 32768 : r.bucket * 32768] = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")
    return out[:SLOTS]


def _cuts(word: Column, level: int) -> Column:
    """The two strings of each cut of a string of ``level`` characters, with the cut's number."""
    sides = lambda k: (F.shiftrightunsigned(word, 16 * k), word.bitwiseAND(F.lit((1 << 16 * k) - 1)))
    return F.array(*[F.struct(F.lit(k).alias("cut"), part.alias("part")) for k in range(1, level) for part in sides(k)])


def strings(texts: DataFrame, scratch: Scratch, text_col: str = "text", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(word, n) of every Han character, and (word, n, cohesion) of the longer strings that hold together."""
    rows = texts.select(F.col(text_col).cast("string").alias("text"))
    count = lambda level, flags: rows.mapInArrow(_counts(level, flags), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    single = scratch.keep(count(1, None), "characters")
    total = single.agg(F.sum("n")).first()[0] or 0
    known, flags, out = F.broadcast(single), None, None  # no more rows than there are Han characters
    for level in range(2, LONGEST + 1):
        counted = count(level, flags).where(F.col("n") >= least)
        firm = scratch.keep(cohesion(counted, known, level, total).where(F.col("cohesion") >= COHESION), f"strings-{level}")
        flags = _bitmap(firm)
        known = (single if out is None else known).unionByName(firm.select("word", "n"))
        out = firm if out is None else out.unionByName(firm)
    return single, out


def cohesion(counted: DataFrame, known: DataFrame, level: int, total: int) -> DataFrame:
    """(word, n, cohesion) of strings of ``level`` characters: the least logarithm, over cuts, of how far a string is more frequent than its
    sides let expect.  ``known`` has the shorter strings (word, n); a string with a side that isn't there is left out.
    """
    each = counted.select("word", "n", F.explode(_cuts(F.col("word"), level)).alias("c")).select("word", "n", "c.cut", "c.part")
    met = each.join(known.select(F.col("word").alias("part"), F.log("n").alias("log")), "part")
    per = met.groupBy("word", "n", "cut").agg(F.sum("log").alias("sides"), F.count(F.lit(1)).alias("found")).where("found = 2")
    whole = per.groupBy("word", "n").agg(F.max("sides").alias("sides"), F.count(F.lit(1)).alias("cuts")).where(F.col("cuts") == level - 1)
    return whole.select("word", "n", (F.log("n") + math.log(max(total, 1)) - F.col("sides")).alias("cohesion"))


def freedom(texts: DataFrame, candidates: np.ndarray, text_col: str = "text") -> DataFrame:
    """(word, left_entropy, right_entropy) of sorted candidates: entropy of the characters beside them, line and text ends as one."""
    rows = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_sides(candidates), "word long, side int, beside int, n long")
    rows = rows.groupBy("word", "side", "beside").agg(F.sum("n").alias("n"))
    side = rows.groupBy("word", "side").agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("h"))
    pick = lambda k: F.coalesce(F.max(F.when(F.col("side") == k, F.col("h"))), F.lit(0.0))
    return side.groupBy("word").agg(pick(0).alias("left_entropy"), pick(1).alias("right_entropy"))


def words(texts: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """The words that a corpus shows: word, n, cohesion, left_entropy, right_entropy.  Null texts have none; no texts give no rows."""
    result = Scratch(texts.sparkSession, "han-words")
    found, _ = _learned(texts, result, text_col, least)
    return found.select(spelled(F.col("word")).alias("word"), "n", "cohesion", "left_entropy", "right_entropy")


def _learned(texts: DataFrame, scratch: Scratch, text_col: str, least: int) -> tuple[DataFrame, DataFrame]:
    single, firm = strings(texts, scratch, text_col, least)
    firm = scratch.keep(firm.orderBy(F.desc("n"), "word").limit(WORDS), "firm")
    candidates = np.sort(firm.select("word").toArrow().column(0).to_numpy())  # WORDS numbers at most
    free = freedom(texts, candidates, text_col).where((F.col("left_entropy") >= FREEDOM) & (F.col("right_entropy") >= FREEDOM))
    return scratch.keep(firm.join(free, "word"), "words"), single


def _lexicon(counted: DataFrame, known: dict[str, int]) -> Lexicon:
    """From (word, n); of ``known`` words the larger count holds.  WORDS words and the Han characters come to the driver."""
    table = counted.toArrow()
    n = dict(zip(table.column("word").to_pylist(), table.column("n").to_pylist(), strict=True))
    for w, k in known.items():
        n[packed(w)] = max(k, n.get(packed(w), 0))
    word = np.array(sorted(n), np.int64)
    count = np.array([n[w] for w in word.tolist()], float)
    total = count.sum() if len(count) else 1.0
    return Lexicon(word, np.log(count / total), float(np.log(0.5 / total)))


def learn(texts: DataFrame, text_col: str = "text", known: dict[str, int] | None = None, least: int = LEAST, rounds: int = 1) -> Lexicon:
    """A lexicon from the whole corpus; ``known`` words of up to ``LONGEST`` Han characters are in it with the counts given, at least.

    Each round reads the corpus with the lexicon so far, counts the words read and drops those that
    are read less than ``least`` times.  Without texts only known words are in it.
    """
    known = {w: n for w, n in (known or {}).items() if 0 < len(w) <= LONGEST and all(FIRST <= ord(c) <= LAST for c in w)}
    scratch = Scratch(texts.sparkSession, "han-lexicon")
    found, single = _learned(texts, scratch, text_col, least)
    lexicon = _lexicon(found.select("word", "n").unionByName(single), known)
    rows = texts.select(F.col(text_col).cast("string").alias("text"))
    for _ in range(rounds):
        again = rows.mapInArrow(_word_counts(lexicon), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        lexicon = _lexicon(again.where((F.col("n") >= least) | (F.shiftrightunsigned("word", 16) == 0)), known)
    scratch.end()
    return lexicon


def with_words(rows: DataFrame, text_col: str, out: str, lexicon: Lexicon) -> DataFrame:
    """``rows`` with the tokens of a text as a list: words of its Han runs and lower-cased runs of other letters and digits.

    Null and empty texts have none.
    """
    runs = rows.withColumn(out, F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(RUNS), F.lit(0)))
    schema = runs.schema
    place = runs.columns.index(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(place)
            tokens, ends = _in_words(lists.flatten().cast(pa.string()), lexicon)
            sizes = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            cut = pa.ListArray.from_arrays(pa.array(ends[sizes], pa.int32()), tokens)
            columns = [cut if k == place else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return runs.mapInArrow(run, schema)


def _in_words(runs: pa.Array, lexicon: Lexicon) -> tuple[pa.Array, np.ndarray]:
    """Tokens of runs that follow one another, and how many are before each run and in all.

    Words are cut out of the runs' own bytes, of which a Han character takes three, by more offsets.
    """
    if not len(runs):
        return runs, np.zeros(1, np.int64)
    _, places, data = runs.buffers()
    bounds = np.frombuffer(places, np.int32)[runs.offset : runs.offset + len(runs) + 1].astype(np.int64)
    if bounds[-1] == bounds[0]:
        return runs, np.arange(len(runs) + 1)
    raw = np.frombuffer(data, np.uint8)[: bounds[-1]]
    lead = lambda at, k: raw[at + k].astype(np.uint16)
    begin, size = bounds[:-1], np.diff(bounds)
    wide = np.flatnonzero(size >= 3)
    three = wide[raw[begin[wide]] >> 4 == 0xE]  # a run is Han if its first character is
    unit = (lead(begin[three], 0) & 0xF) << 12 | (lead(begin[three], 1) & 0x3F) << 6 | lead(begin[three], 2) & 0x3F
    han = three[_han(unit)]
    n = size[han] // 3
    # The units of all Han runs with one between them that is none.
    place = np.r_[0, np.cumsum(n + 1)]
    inside = np.repeat(np.arange(len(han)), n)
    among = np.arange(len(inside)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[han][inside] + 3 * among
    units = np.zeros(place[-1], np.uint16)
    units[place[inside] + among] = (lead(at, 0) & 0xF) << 12 | (lead(at, 1) & 0x3F) << 6 | lead(at, 2) & 0x3F
    starts, _ = read(units, lexicon)
    run = np.searchsorted(place, starts, "right") - 1
    cuts = begin[han][run] + 3 * (starts - place[run])
    other = np.ones(len(runs), bool)
    other[han] = False
    offsets = np.sort(np.r_[begin[other], cuts])
    out = pa.StringArray.from_buffers(len(offsets), pa.py_buffer(np.r_[offsets, bounds[-1]].astype(np.int32).tobytes()), data)
    return out, np.r_[np.searchsorted(offsets, bounds[:-1]), len(offsets)]
