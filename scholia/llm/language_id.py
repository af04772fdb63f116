"""Language identification with interpolated Kneser-Ney character models.

Fitting.  A bounded sample of labelled rows (``SAMPLE_TEXTS`` a language, those with the smallest hash of
their id and text, each read whole) is enough for character n-grams; the bound is on the rows that the
classifier is fitted to, every text is scored, and scored whole.  Four of five sampled texts are counted, the
fifth calibrates.

Model.  Per language and order 1 to ``ORDER``, interpolated Kneser-Ney over the characters of
space-delimited lower-case words (the space on either side belongs to the word).  All n-grams of all
languages are one sorted array of 64-bit hashes with a row of discounted probabilities and back-off
weights beside it; lookups are binary searches.

Scoring.  A text's cross-entropy under a language is the sum over its words divided by the number of
scored characters; the lowest wins.  A batch scores each distinct word once.

Calibration.  The margin between the two best languages becomes a score in [0, 1] by a logistic curve
whose slope comes from the calibration texts.  A text is rejected if it has no letter or if no learned
language explains its words: if their cross-entropy, each word under the language that explains it best
(so texts of several languages stay), is above the limit of the text's language.  A limit lies ``WAY`` of the way from the
``QUANTILE`` of that figure of the language's calibration texts to its median when their letters are shuffled
(a short text with a key or a number in letters lies higher than any calibration text).
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import ranges
from .scratch import quoted, small_batches
from .worker import batches_of

ORDER, SAMPLE_TEXTS, QUANTILE, WAY = 4, 400, 0.95, 2 / 3
#: Words whose scores a worker remembers, and the longest of them.
REMEMBER, LONGEST = 1 << 16, 40
#: A letter and the letters and combining marks after it.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def _tokens(text: str) -> list[str]:
    """Runs of letters and marks, lower-cased: digits, punctuation and spaces separate."""
    return text.lower().translate(_ASCII).split() if text.isascii() else WORD.findall(text.lower())


_ASCII = {i: " " for i in range(128) if not chr(i).isalpha()}


def _shuffled(text: str, seed: int) -> str:
    """The words' lengths and all letters of a text, the letters in any order."""
    words = _tokens(text)
    letters = list("".join(words))
    random.Random(seed).shuffle(letters)
    drawn = iter(letters)
    return " ".join("".join(next(drawn) for _ in w) for w in words)


def _hashes(codes: np.ndarray, reach: np.ndarray) -> Iterator[np.ndarray]:
    """For n = 1 to ORDER a hash of the n characters that end at each place; 0 where ``reach`` (characters before it) is less."""
    value = np.zeros(len(codes), np.uint64)
    for n in range(1, ORDER + 1):
        back = codes[np.maximum(np.arange(len(codes)) - (n - 1), 0)]
        value = (value ^ (back + np.uint64(n) * np.uint64(0x100000001B3))) * _MIX
        value ^= value >> np.uint64(29)
        yield np.where(reach >= n - 1, value, np.uint64(0))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _gram_hashes(grams: list[str]) -> np.ndarray:
    """The hash that ``_hashes`` gives to each n-gram."""
    lengths = np.array([len(g) for g in grams], np.int64)
    ends = np.cumsum(lengths) - 1
    within = np.arange(int(lengths.sum())) - np.repeat(ends - lengths + 1, lengths)
    every = np.stack([np.zeros(len(within), np.uint64), *_hashes(_codes("".join(grams)), within)])
    return every[lengths, ends] if len(grams) else np.zeros(0, np.uint64)


class Model:
    """A sorted array of hashes of n-grams and two rows of logarithms for each; a few MB, bounded by the sample.

    ``known`` is the interpolated probability of an n-gram's last character after the others, all lower orders
    included; ``skip`` the weight that falls to the lower order if a character was not seen after the n-gram.
    Without texts there is no language, and ``identify`` finds none.
    """

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        n = len(self.languages)
        words = {lang: Counter(_tokens(" ".join(t))) for lang, t in texts.items()}
        counts: list[list[Counter[str]]] = []
        self.characters = len({c for own in words.values() for w in own for c in w}) + 2
        for lang in self.languages:
            by: list[Counter[str]] = [Counter() for _ in range(ORDER + 1)]
            for w, c in words[lang].items():
                s = f" {w} "
                for end in range(2, len(s) + 1):
                    # The highest order that fits is counted as it is; lower orders by continuations.
                    g = s[max(0, end - ORDER) : end]
                    by[len(g)][g] += c
            for order in range(ORDER, 1, -1):
                by[order - 1].update(g[1:] for g in by[order])
            counts.append(by)
        every = {g for by in counts for order in by[1:] for g in order}
        grams = sorted(every | {g[:-1] for g in every if len(g) > 1}, key=lambda g: (len(g), g))
        place = {g: i for i, g in enumerate(grams)}
        share = np.zeros((len(grams), n))  # discounted share of the last character in its context
        weight = np.ones((len(grams) + 1, n))  # of the lower order after a context; the last row is the empty one
        for k, by in enumerate(counts):
            for order in range(1, ORDER + 1):
                ones, twos = (sum(c == x for c in by[order].values()) for x in (1, 2))
                discount = ones / (ones + 2 * twos) if ones and twos else 0.75
                total: Counter[str] = Counter()
                for g, c in by[order].items():
                    total[g[:-1]] += c
                kinds = Counter(g[:-1] for g in by[order])
                for g, c in by[order].items():
                    share[place[g], k] = max(c - discount, 0) / total[g[:-1]]
                for context, c in total.items():
                    weight[place.get(context, -1), k] = discount * kinds[context] / c
        chance = share
        lengths = np.array([len(g) for g in grams], np.int64)
        rest, context = (np.array([place.get(g[cut], len(grams)) for g in grams], np.int64) for cut in (slice(1, None), slice(None, -1)))
        for order in range(1, ORDER + 1):  # lower orders are whole before higher ones need them
            rows = np.flatnonzero(lengths == order)
            lower = np.vstack([chance, np.full((1, n), 1 / self.characters)])[rest[rows]]
            chance[rows] += weight[context[rows]] * lower
        hashes = _gram_hashes(grams)
        order = np.argsort(hashes)
        self.hashes, self.known, self.skip = hashes[order], np.log(chance[order]), np.log(weight[:-1][order])
        self.unseen = np.log(weight[-1] / self.characters)
        self.limit, self.slope = np.full(n, np.inf), 10.0

    def _rows(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def character_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each character of each word and the space after it: the word's number, and the log probability under each language.

        A character is scored given at most ORDER - 1 before it, the space before the word included.
        """
        lengths = np.array([len(w) + 2 for w in words])
        starts = np.cumsum(lengths) - lengths
        within = np.arange(int(lengths.sum())) - np.repeat(starts, lengths)
        hashes = list(_hashes(_codes("".join(f" {w} " for w in words)), within))
        scores = np.zeros((len(within), len(self.languages)))
        todo = np.flatnonzero(within > 0)
        for n in range(ORDER, 0, -1):
            fits = within[todo] >= n - 1
            here = todo[fits]
            row, known = self._rows(hashes[n - 1][here])
            scores[here[known]] += self.known[row[known]]
            left = here[~known]
            if n > 1:
                row, known = self._rows(hashes[n - 2][left - 1])
                scores[left[known]] += self.skip[row[known]]
            else:
                scores[left] += self.unseen
            todo = np.r_[left, todo[~fits]]
        return np.repeat(np.arange(len(words)), lengths - 1), scores[within > 0]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Negative natural log probability of each word under each language."""
        owner, scores = self.character_scores(words)
        return -np.add.reduceat(scores, np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]), axis=0)

    def calibrate(self, texts: list[tuple[str, str]]) -> None:
        """Limits and slope from labelled texts that were not counted."""
        clean: list[list[float]] = [[] for _ in self.languages]
        junk: list[list[float]] = [[] for _ in self.languages]
        margins = []
        scorer = Scorer(self)
        for seed, (lang, text) in enumerate(texts):
            entropy = scorer.entropies([text])[0]
            if entropy is not None and lang in self.languages:
                k = self.languages.index(lang)
                entropy, best = entropy[:-1], entropy[-1]
                clean[k].append(float(best))
                junk[k].append(float(scorer.entropies([_shuffled(text, seed)])[0][-1]))
                others = np.delete(entropy, k)
                margins.append(float(others.min() - entropy[k]) if len(others) else 1.0)
        for k, (own, shuffled) in enumerate(zip(clean, junk, strict=True)):
            if own and np.median(shuffled) > (high := np.quantile(own, QUANTILE)):
                self.limit[k] = high + WAY * (np.median(shuffled) - high)
        if margins:
            best, least = 10.0, math.inf
            for slope in np.geomspace(1, 200, 40):
                loss = float(np.logaddexp(0, -slope * np.array(margins)).mean()) + 1e-4 * slope
                if loss < least:
                    best, least = float(slope), loss
            self.slope = best


class Scorer:
    """Scores texts, remembering words within fixed bounds."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}  # the word's row of the table
        self.table = np.zeros((0, len(model.languages) + 2))  # scores, the best of them, characters
        self.filled = 0

    def _learn(self, new: list[str]) -> None:
        """Score words under each language and under the best, some 2**15 characters at a time."""
        at, begin = 0, self.filled
        if begin + len(new) > len(self.table):
            room = np.zeros((max(begin + len(new), 2 * len(self.table)), self.table.shape[1]))
            room[:begin] = self.table[:begin]
            self.table = room
        self.known.update(zip(new, range(begin, begin + len(new)), strict=True))
        while at < len(new):
            to, size = at, 0
            while to < len(new) and (to == at or size < 1 << 15):
                size += len(new[to]) + 2
                to += 1
            scores = self.model.word_scores(new[at:to])
            lengths = np.array([len(w) + 1 for w in new[at:to]])
            self.table[begin + at : begin + to] = np.column_stack([scores, scores.min(1), lengths])
            at = to
        self.filled += len(new)

    def entropies(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Cross-entropy per character under each language, and with each word under its best; None without a letter or a language."""
        if not self.model.languages:
            return [None] * len(texts)
        counted = [Counter(_tokens(text or "")) for text in texts]
        if self.filled > REMEMBER:
            self.known, self.table, self.filled = {}, self.table[:0], 0
        known = self.known
        new = list(set().union(*counted) - known.keys())
        self._learn(new)
        out: list[np.ndarray | None] = []
        for seen in counted:
            if not seen:
                out.append(None)
                continue
            n = np.fromiter(seen.values(), np.float64, len(seen))
            total = n @ self.table[np.fromiter(map(known.__getitem__, seen), np.int64, len(seen))]
            out.append(total[:-1] / total[-1])
        for w in new:
            if len(w) > LONGEST:
                del known[w]
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", where: Column | None = None) -> Model:
    """A model of the labelled rows of ``docs`` (those that ``where`` allows).

    Rows with a null label or no text are left out; equal texts of an id count once.  Without any
    labelled text the model has no language.
    """
    rows = docs.where(F.col(quoted(label_col)).isNotNull() & F.col(quoted(text_col)).isNotNull())
    rows = rows.where(where) if where is not None else rows
    text = F.col(quoted(text_col)).cast("string")
    draw = F.xxhash64(F.col(quoted(id_col)).cast("string"), text)
    texts: dict[str, list[str]] = {}
    spare: list[tuple[str, str]] = []
    for label, sampled in _sample(rows.select(F.col(quoted(label_col)).cast("string").alias("label"), draw.alias("draw"), text.alias("text"))).items():
        for rank, one in enumerate(sampled):
            if rank % 5 or len(sampled) == 1:
                texts.setdefault(label, []).append(one)
            if rank % 5 == 0:
                spare.append((label, one))
    model = Model(texts)
    model.calibrate(spare)
    return model


def _sample(rows: DataFrame) -> dict[str, list[str]]:
    """Per label the texts of the SAMPLE_TEXTS smallest draws, in order of draw.

    Labels are counted first (map-side, a row each and task); then rows whose draw lies below a share of
    all draws that holds 1.5 times the sample on average are deduplicated and collected: no label's
    rows meet in one task.  A label whose rows are mostly copies of each other may need a larger share.
    """
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    found: dict[str, list[tuple[int, str]]] = {label: [] for label in counts}
    share = {label: 1.5 * SAMPLE_TEXTS / n for label, n in counts.items()}
    while share:
        limits = F.create_map(*[F.lit(x) for label, s in share.items() for x in (label, min(2**63 - 1, int((2 * min(s, 1) - 1) * 2**63)))])
        low = rows.where(F.col("draw") <= F.try_element_at(limits, F.col("label"))).groupBy("label", "draw").agg(F.min("text").alias("text"))
        for label in share:
            found[label] = []
        for r in low.collect():
            found[r["label"]].append((r["draw"], r["text"]))
        share = {label: 4 * s for label, s in share.items() if s < 1 and len(found[label]) < SAMPLE_TEXTS}
    return {label: [text for _, text in sorted(some)[:SAMPLE_TEXTS]] for label, some in sorted(found.items())}


def identify(docs: DataFrame, model: Model, id_cols: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``id_cols`` (default: all columns) and lang_pred, score, lang_accepted for each row.

    Texts that are null or have no letter, and all texts if the model has no language, get ``und``,
    score 0 and are rejected.  Ties go to the first language by name.  Rows that repeat are scored
    each.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    kept = id_cols if id_cols is not None else docs.columns
    kept = [c for c in kept if c not in ("lang_pred", "score", "lang_accepted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        own = scorer.model
        for whole in batches:
            for at, to in ranges(whole.column(len(kept)), rows=512):
                batch = whole.slice(at, to - at)
                names, scores, accepted = [], [], []
                for entropy in scorer.entropies(batch.column(len(kept)).to_pylist()):
                    if entropy is None:
                        names.append("und")
                        scores.append(0.0)
                        accepted.append(False)
                        continue
                    entropy, best = entropy[:-1], entropy[-1]
                    k = int(entropy.argmin())
                    others = np.delete(entropy, k)
                    margin = float(others.min() - entropy[k]) if len(others) else 1.0
                    names.append(own.languages[k])
                    scores.append(1 / (1 + math.exp(-min(700.0, own.slope * margin))))
                    accepted.append(bool(best <= own.limit[k]))
                new = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*kept, "lang_pred", "score", "lang_accepted"])

    chosen = docs.select(*map(quoted, kept), F.col(quoted(text_col)).cast("string"))
    schema = docs.select(*map(quoted, kept)).schema.add("lang_pred", "string").add("score", "double").add("lang_accepted", "boolean")
    return chosen.toDF(*[f"c{k}" for k in range(len(chosen.columns))]).mapInArrow(batches_of("language_id", run), schema)
