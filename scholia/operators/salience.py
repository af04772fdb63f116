"""Salience of hits: rule prior, term weights, density and length."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed import CEILING, FLOOR, FULL_LENGTH, STOPWORDS, TOP_TERMS, UNKNOWN_WORD, WEIGHTS
from ..functions.rowwise import STEP, unnested
from ..functions.rule_scan import scan
from ..functions.rule_table import RULES
from ..functions.terms import Tokens, places
from ..sources.scratch import Scratch
from ..sources.versions import Versions
from .rules import exploded, of_rule, with_hits
from .segment import Lexicon, with_words

#: Tokens: pairs of Han characters, or runs of other letters and digits, lower-cased.
TOKEN = r"[\x{4e00}-\x{9fff}]{1,2}|[\p{L}\p{N}&&[^\x{4e00}-\x{9fff}]]+"

#: Stop words among tokens of more than one character; rows of partial counts that are added up together.
LONG_STOPWORDS = frozenset(w for w in STOPWORDS if len(w) > 1)
ADDED = 1 << 20
#: Terms that workers know with their document frequency, the most frequent ones.  Others are joined.
KNOWN = 1 << 17


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def content(found: Column) -> Column:
    """Tokens of more than one character that are no stop words."""
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def split(rows: DataFrame, text_col: str, out: str, lexicon: Lexicon | None) -> DataFrame:
    """``rows`` with the tokens of a text; with a lexicon Han text is read in words, else in pairs."""
    return with_words(rows, text_col, out, lexicon) if lexicon else rows.withColumn(out, tokens(F.col(text_col)))


def content_tokens(docs: DataFrame, id_col: str = "doc_id", lexicon: Lexicon | None = None) -> DataFrame:
    """Per document: n_tokens, n_content."""
    rows = split(docs.select(id_col, "text"), "text", "t", lexicon)
    return rows.select(id_col, F.size("t").cast("long").alias("n_tokens"), F.size(content(F.col("t"))).cast("long").alias("n_content"))


def _idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def half_up(x: np.ndarray, scale: int = 9) -> np.ndarray:
    """Rounded as the SQL engine does: the shortest decimals of a number, halves up."""
    more = x * 10.0**scale
    out = np.floor(more + 0.5) / 10.0**scale
    for i in np.flatnonzero(np.abs(more - np.floor(more) - 0.5) < 1e-9 * np.maximum(1e3, more)).tolist():
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-scale), ROUND_HALF_UP))
    return out


def _words(text: str) -> list[str]:
    """Content tokens of a text in lower case, as ``content(tokens(text))``."""
    found = Tokens([text])
    return [t for t in found.only(found.size > 1).strings().to_pylist() if t not in LONG_STOPWORDS]


class Counts(NamedTuple):
    """Content tokens of some documents: by document and term how often, terms as numbers of a dictionary."""

    total: np.ndarray  # a document's tokens
    row: np.ndarray
    term: np.ndarray
    tf: np.ndarray
    terms: pa.Array


def _counts(use: pa.Array, plain: bool) -> Counts:
    """``use``: texts in lower case, or lists of content tokens."""
    if plain:
        found = Tokens(use.to_pylist())
        found = found.only(found.size > 1)
        row, words = found.row, found.strings()
    else:
        lists = use.fill_null([]) if use.null_count else use
        row, words = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().cast(pa.string())
    coded = words.dictionary_encode()
    codes, terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    if plain and LONG_STOPWORDS:
        own = ~pc.is_in(terms, pa.array(sorted(LONG_STOPWORDS))).to_numpy(zero_copy_only=False)[codes]
        row, codes = row[own], codes[own]
    many = max(1, len(terms))
    both, tf = np.unique(row * many + codes, return_counts=True)
    return Counts(np.bincount(row, minlength=len(use)), both // many, both % many, tf, terms)


class Known:
    """What workers know of a corpus: its ``KNOWN`` most frequent terms with what their document frequency weighs, and bounds for others."""

    def __init__(self, statistics: DataFrame):
        self.n = statistics.where(F.col("term") == DOCUMENTS).agg(F.coalesce(F.max("df"), F.lit(0)).alias("n")).first().n
        weighed = statistics.where(F.col("term") != DOCUMENTS).select("term", "df", _idf(F.lit(self.n), F.col("df")).alias("idf"))
        best = weighed.orderBy(F.desc("df")).limit(KNOWN + 1).toArrow()
        self.whole = best.num_rows <= KNOWN
        best = best.slice(0, KNOWN).combine_chunks()
        self.terms, idf = pa.array(best["term"].to_pylist(), pa.string()), best["idf"].to_numpy()
        rare = [idf.min() if len(idf) else 1.0, np.log((self.n + 1) / 2) + 1]  # no other term is more frequent, or less than in one document
        self.low, self.high = np.r_[idf, rare[0]], np.r_[idf, rare[1]]

    def weighed(self, counts: Counts, top: int) -> tuple[Counts, np.ndarray]:
        """The counts of terms that may be among a document's heaviest, and their weights; NaN for terms that aren't known."""
        at = pc.index_in(counts.terms, value_set=self.terms).fill_null(-1).to_numpy()[counts.term]
        share = counts.tf / counts.total[counts.row]
        low, high = share * self.low[at], share * self.high[at]
        order = np.lexsort((-low, counts.row))
        bar = np.full(len(counts.total), -np.inf)
        last = order[places(counts.row) == top - 1]
        bar[counts.row[last]] = low[last] - 1e-8  # more than rounding changes
        may = high >= bar[counts.row]
        weights = np.where(at[may] >= 0, half_up(low[may]), np.nan)
        return counts._replace(row=counts.row[may], term=counts.term[may], tf=counts.tf[may]), weights

    def heaviest(self, counts: Counts, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, weight, rank) of the ``top`` heaviest terms, ties by term, where all terms are known."""
        counts, weights = self.weighed(counts, top)
        alphabetic = np.empty(len(counts.terms), np.int64)
        alphabetic[pc.array_sort_indices(counts.terms).to_numpy()] = np.arange(len(counts.terms))
        order = np.lexsort((alphabetic[counts.term], -weights, counts.row))
        rank = places(counts.row) + 1
        order, rank = order[rank <= top], rank[rank <= top]
        return counts.row[order], counts.term[order], weights[order], rank


def _used(docs: DataFrame, keep: list[str], lexicon: Lexicon | None) -> DataFrame:
    """``keep`` and what Python counts: texts in lower case, or with a lexicon their content tokens."""
    if lexicon:
        return split(docs.select(*keep, F.col("text").alias("_text")), "_text", "_use", lexicon).select(*keep, content(F.col("_use")).alias("_use"))
    return docs.select(*keep, F.lower(F.coalesce("text", F.lit(""))).alias("_use"))


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, STEP):
            yield whole.slice(at, STEP)


def tfidf(docs: DataFrame, top: int = TOP_TERMS, id_col: str = "doc_id", lexicon: Lexicon | None = None) -> DataFrame:
    """(id, term, w, rank): share in the document times ln((N + 1) / (df + 1)) + 1, the ``top`` heaviest, ties by term.

    Document frequencies are counted once into a table; workers are given the ``KNOWN`` most frequent terms, which are most of
    all occurrences, so only others are shuffled, to the table and back to their document, and of these only such as may be heavy enough.
    Where all terms are known nothing is shuffled.  ``id_col`` must tell documents apart, if there are others.
    """
    scratch = Scratch(docs.sparkSession, "term-weights")
    statistics = scratch.keep(term_statistics(docs, lexicon), "statistics")
    return _tfidf(docs, Known(statistics), statistics, scratch, top, id_col, lexicon)


def _tfidf(docs: DataFrame, known: Known, statistics: DataFrame, scratch: Scratch, top: int, id_col: str, lexicon: Lexicon | None) -> DataFrame:
    whole = known.whole
    kinds = [("term", T.StringType()), ("w", T.DoubleType()), ("rank", T.IntegerType())] if whole else [("term", T.StringType()), ("w", T.DoubleType()), ("tf", T.LongType()), ("total", T.LongType())]
    schema = T.StructType([*docs.select(id_col).schema.fields, *[T.StructField(*k) for k in kinds]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            counts = _counts(block.column(1), not lexicon)
            if whole:
                row, term, w, rank = known.heaviest(counts, top)
                more = [pa.array(w), pa.array(rank, pa.int32())]
            else:
                counts, w = known.weighed(counts, top)
                row, term = counts.row, counts.term
                more = [pa.array(w, mask=np.isnan(w)), pa.array(counts.tf), pa.array(counts.total[row])]
            yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(row)), counts.terms.take(pa.array(term)), *more], names=schema.names)

    rows = _used(docs, [id_col], lexicon).mapInArrow(run, schema)
    if whole:
        return rows
    rows = scratch.keep(rows, "counted")  # read twice
    met = rows.where("w is null").join(statistics.where(F.col("term") != DOCUMENTS).hint("merge"), "term")
    rare = met.select(id_col, "term", F.round(F.col("tf") / F.col("total") * _idf(F.lit(known.n), F.col("df")), 9).alias("w"))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("w"), "term"))
    return rows.where("w is not null").select(id_col, "term", "w").unionByName(rare).withColumn("rank", rank).where(F.col("rank") <= top)


def _by_document(weights: DataFrame, id_col: str) -> DataFrame:
    """(id, weights): array<struct<w, term>> by rank, from rows of ``tfidf``."""
    lists = weights.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("rank", "w", "term"))).alias("weights"))
    return lists.select(id_col, F.transform("weights", lambda x: F.struct(x["w"].alias("w"), x["term"].alias("term"))).alias("weights"))


#: The row of a statistics table that counts documents.
DOCUMENTS = ""


def term_statistics(docs: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """(term, df): how many of the documents hold a term; the row of the term '' counts the documents."""

    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("df", T.LongType())])

    def added(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:  # added up before they are shuffled
        yield from pa.concat_tables(held).group_by("term", use_threads=False).aggregate([("df", "sum")]).select(["term", "df_sum"]).rename_columns(schema.names).to_batches()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for block in _blocks(batches):
            counts = _counts(block.column(0), not lexicon)
            df = np.bincount(counts.term, minlength=len(counts.terms))
            own = np.flatnonzero(df)
            held += [pa.table([counts.terms.take(pa.array(own)), pa.array(df[own])], schema.names), pa.table([pa.array([DOCUMENTS]), pa.array([block.num_rows], pa.int64())], schema.names)]
            rows += len(own) + 1
            if rows >= ADDED:
                yield from added(held)
                held, rows = [], 0
        if held:
            yield from added(held)

    return _used(docs, [], lexicon).mapInArrow(run, schema).groupBy("term").agg(F.sum("df").alias("df"))


def keep_statistics(docs: DataFrame, path: str, lexicon: Lexicon | None = None) -> int:
    """Add a batch of new papers to the statistics table at ``path``, as one commit; returns the version made.

    Counts add up, so the table equals one of all papers, in whatever batches they came.  An empty batch makes a version as well.
    """
    batch = term_statistics(docs, lexicon)
    table = Versions(docs.sparkSession, path)
    if not table.versions():
        table.create(batch.schema, "term")
    return table.add_up(batch)


def tfidf_under(docs: DataFrame, statistics: DataFrame, top: int = TOP_TERMS, id_col: str = "doc_id", lexicon: Lexicon | None = None) -> DataFrame:
    """``tfidf`` of papers under a statistics table, without a look at the corpus that it counts.

    A term that the table doesn't have counts as held by no document: the highest weight there is.
    """
    n = statistics.where(F.col("term") == DOCUMENTS).agg(F.coalesce(F.max("df"), F.lit(0)).alias("n_docs")).scalar()
    own = split(docs.select(id_col, "text"), "text", "t", lexicon).select(id_col, content(F.col("t")).alias("t"))
    terms = unnested(own.withColumn("total", F.size("t")), [id_col, "total"], F.col("t"), "term").groupBy(id_col, "total", "term").agg(F.count(F.lit(1)).alias("tf"))
    rows = terms.join(statistics.where(F.col("term") != DOCUMENTS), "term", "left")
    idf = F.log((n + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    rows = rows.withColumn("w", F.round(F.col("tf") / F.col("total") * idf, 9))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("w"), "term"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select(id_col, "term", "w", "rank")


def salience(docs: DataFrame, id_col: str = "doc_id", lexicon: Lexicon | None = None) -> DataFrame:
    """One row per hit: id, ord, rule, action, n, hit, the four factors and salience.

    The rules run once.  Where workers know all terms, a batch of documents is scanned, weighed and its hits are measured in one pass.  Else
    a document's term weights (``TOP_TERMS`` at most) come into the row of its hits, so that weights don't go along with each hit.  With
    a lexicon Han text is read in words, in documents and in hits.
    """
    if lexicon:  # hits go to Python without the weights
        weights = _by_document(tfidf(docs, id_col=id_col, lexicon=lexicon), id_col).select(id_col, F.map_from_entries(F.transform("weights", lambda x: F.struct(x["term"], x["w"]))).alias("weights"), F.element_at("weights", 1)["w"].alias("peak"))
        rows = with_words(exploded(with_hits(docs, id_col), id_col), "hit", "t", lexicon).join(weights.hint("merge"), id_col, "left")
        rows = rows.withColumn("c", content(F.col("t")))
        share = lambda term: F.coalesce(F.try_element_at(F.col("weights"), term) / F.col("peak"), F.lit(UNKNOWN_WORD))
        total = F.aggregate("c", F.lit(0.0), lambda sum_, term: sum_ + share(term))
        rows = rows.withColumn("mean", F.when(F.size("c") > 0, total / F.size("c"))).withColumn("n_t", F.size("t")).withColumn("n_c", F.size("c"))
    else:
        scratch = Scratch(docs.sparkSession, "term-weights")
        statistics = scratch.keep(term_statistics(docs), "statistics")
        known = Known(statistics)
        if known.whole:
            rows = _at_once(docs, known, id_col)
        else:
            weights = _by_document(_tfidf(docs, known, statistics, scratch, TOP_TERMS, id_col, None), id_col)
            rows = _measured(with_hits(docs, id_col).join(weights.hint("merge"), id_col, "left"), id_col)
        rows = rows.select("*", *[of_rule(F.col("ord"), field).alias(name) for name, field in (("rule", "name"), ("action", "action"), ("prior", "prior"))])
    rows = rows.withColumn("f_rule", F.col("prior")).withColumn("f_tfidf", F.round(F.least(F.lit(1.0), F.coalesce("mean", F.lit(0.0))), 6))
    rows = rows.withColumn("f_density", F.round(F.col("n_c") / F.greatest(F.lit(1), F.col("n_t")), 6))
    rows = rows.withColumn("f_length", F.round(F.least(F.lit(1.0), F.length("hit") / F.lit(FULL_LENGTH)), 6))
    raw = sum((F.lit(w) * F.col(f"f_{k}") for k, w in WEIGHTS.items()), F.lit(0.0))
    score = F.bround(F.greatest(F.lit(FLOOR), F.least(F.lit(CEILING), F.round(raw, 6))), 2)
    return rows.select(id_col, "ord", "rule", "action", "n", "hit", "f_rule", "f_tfidf", "f_density", "f_length", score.alias("salience"))


#: What is measured of a hit: its number within its rule, the mean weight of its content tokens (null without), tokens, content tokens.
MEASURED = [("ord", T.IntegerType()), ("n", T.IntegerType()), ("hit", T.StringType()), ("mean", T.DoubleType()), ("n_t", T.IntegerType()), ("n_c", T.IntegerType())]


def _means(row: np.ndarray, low: list[str], terms: pa.Array, key: np.ndarray, share: np.ndarray) -> list[pa.Array]:
    """mean, n_t and n_c of hits in lower case, of documents ``row``; ``key``: numbers of document and term, in order, and their ``share``."""
    found = Tokens(low)
    n_t = np.bincount(found.row, minlength=len(low))
    found = found.only(found.size > 1)
    coded = found.strings().dictionary_encode()
    codes = coded.indices.to_numpy()
    hit, at = found.row, pc.index_in(coded.dictionary, value_set=terms).fill_null(-1).to_numpy()[codes]
    if LONG_STOPWORDS:
        own = ~pc.is_in(coded.dictionary, pa.array(sorted(LONG_STOPWORDS))).to_numpy(zero_copy_only=False)[codes]
        hit, at = hit[own], at[own]
    asked = np.where(at >= 0, row[hit] * max(1, len(terms)) + at, -1)
    place = np.searchsorted(key, asked)
    there = np.r_[key, -2][place] == asked
    n_c = np.bincount(hit, minlength=len(low))
    total = np.bincount(hit, np.where(there, np.r_[share, 0.0][place], UNKNOWN_WORD), len(low))  # in the order of tokens
    return [pa.array(total / np.maximum(1, n_c), mask=n_c == 0), pa.array(n_t, pa.int32()), pa.array(n_c, pa.int32())]


def _at_once(docs: DataFrame, known: Known, id_col: str) -> DataFrame:
    """id and ``MEASURED`` of each hit, from one pass over the texts."""
    schema = T.StructType([*docs.select(id_col).schema.fields, *[T.StructField(*k) for k in MEASURED]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            texts, lows = [x or "" for x in block.column(1).to_pylist()], block.column(2).to_pylist()
            counts = _counts(block.column(2), True)
            row, term, w, rank = known.heaviest(counts, TOP_TERMS)
            peak = np.zeros(len(texts))
            peak[row[rank == 1]] = w[rank == 1]
            key = row * max(1, len(counts.terms)) + term
            order = np.argsort(key)
            text, rule, start, end = scan(texts)
            where = list(zip(text.tolist(), start.tolist(), end.tolist(), strict=True))
            # A text in lower case has its hits at their places, unless letters become several or depend on what follows.
            same = [len(a) == len(b) and "\u03a3" not in a for a, b in zip(texts, lows, strict=True)]
            low = [lows[i][a:b] if same[i] else texts[i][a:b].lower() for i, a, b in where]
            hits = [pa.array(rule, pa.int32()), pa.array(places(text * len(RULES) + rule), pa.int32()), pa.array([texts[i][a:b] for i, a, b in where], pa.string())]
            yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(text)), *hits, *_means(text, low, counts.terms, key[order], (w / peak[row])[order])], names=schema.names)

    return docs.select(id_col, "text", F.lower(F.coalesce("text", F.lit(""))).alias("_low")).mapInArrow(run, schema)


def _measured(weighed: DataFrame, id_col: str) -> DataFrame:
    """id and ``MEASURED`` of each hit of (id, hits, weights), weights null without terms."""
    schema = T.StructType([*weighed.select(id_col).schema.fields, *[T.StructField(*k) for k in MEASURED]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            source, out, low = [], [], []
            for i, (hits, lows) in enumerate(zip(*(c.to_pylist() for c in block.columns[1:3]), strict=True)):
                for own, lowered in zip(hits, lows, strict=True):
                    source += [i] * len(lowered)
                    out += [(own["ord"], n, hit) for n, hit in enumerate(own["hits"])]
                    low += lowered
            of = np.repeat(np.arange(block.num_rows), block.column(3).value_lengths().fill_null(0).to_numpy())
            coded, w = block.column(3).flatten().cast(pa.string()).dictionary_encode(), block.column(4).flatten().to_numpy()
            key = of * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
            order, first = np.argsort(key), np.r_[0, np.cumsum(np.bincount(of, minlength=block.num_rows))]
            row = np.array(source, np.int64)
            hits = [pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 3, (pa.int32(), pa.int32(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(row)), *hits, *_means(row, low, coded.dictionary, key[order], (w / w[first[of]])[order])], names=schema.names)

    low = F.transform("hits", lambda r: F.transform(r["hits"], lambda h: F.lower(h)))
    return weighed.select(id_col, "hits", low.alias("low"), F.transform("weights", lambda x: x["term"]).alias("terms"), F.transform("weights", lambda x: x["w"]).alias("weights")).mapInArrow(run, schema)


def factors(scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The factors as rows: id, ord, n, key, value, weight, contribution."""
    each = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"f_{k}").alias("value"), F.lit(w).alias("weight")) for k, w in WEIGHTS.items()])
    rows = scored.select(id_col, "ord", "n", F.inline(each))
    return rows.select(id_col, "ord", "n", "key", F.bround("value", 3).alias("value"), "weight", F.bround(F.round(F.col("value") * F.col("weight"), 6), 3).alias("contribution"))


def ranges(scored: DataFrame) -> DataFrame:
    """Per rule and action: hits, and least, mean and highest salience (the mean from hundredths, whose sum is exact)."""
    mean = F.sum(F.round(F.col("salience") * 100).cast("long")) / (F.lit(100.0) * F.count(F.lit(1)))
    return scored.groupBy("rule", "action").agg(F.count(F.lit(1)).alias("hits"), F.min("salience").alias("low"), F.round(mean, 6).alias("mean"), F.max("salience").alias("high"))
