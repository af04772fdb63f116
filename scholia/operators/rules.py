"""Matching the table of content rules: hits, offsets, snippets, first rule, markup, fallback."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed import DENSITY_WORDS
from ..functions.rowwise import STEP, fields, map_rows, unnested
from ..functions.rule_scan import scan
from ..functions.rule_table import NOTES, RULES, searched
from .clean import clean_snippet

#: Java flags under which patterns find what Python's re.IGNORECASE does: Unicode case and classes, \n ends lines.
FLAGS = "(?iUd)"
WINDOW = 320


def catalog(spark: SparkSession) -> DataFrame:
    """The rules as a table: ord, name, action, prior, description, note, pattern."""
    rows = [(i, r.name, r.action, r.prior, r.description, NOTES[r.name], r.pattern) for i, r in enumerate(RULES)]
    return spark.createDataFrame(rows, "ord int, name string, action string, prior double, description string, note string, pattern string")


#: What each rule finds in a text, of those that find something, by rule and place.
HITS = T.ArrayType(T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("hits", T.ArrayType(T.StringType()))]))


def of_rule(ord_: Column, field: str) -> Column:
    """A field of the rule of a number."""
    return F.element_at(F.array(*[F.lit(NOTES[r.name] if field == "note" else getattr(r, field)) for r in RULES]), ord_ + 1)


def _scanned(docs: DataFrame, keep: list[str], made: list[T.StructField], make: Callable[[list[str]], list[pa.Array]]) -> DataFrame:
    """``keep`` and the columns ``make`` gives for some texts; null texts count as empty.  No shuffle."""
    schema = T.StructType([*docs.select(*keep).schema.fields, *made])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                new = make([t or "" for t in batch.column(len(keep)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], names=schema.names)

    return docs.select(*keep, F.col("text").alias("_use")).mapInArrow(run, schema)


def _lists(texts: list[str]) -> list[pa.Array]:
    text, rule, start, end = scan(texts)
    hits = pa.array([texts[i][a:b] for i, a, b in zip(text.tolist(), start.tolist(), end.tolist(), strict=True)], pa.string())
    begin = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (rule[1:] != rule[:-1])][: len(text)])
    own = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(text)], pa.int32()), hits)
    each = pa.StructArray.from_arrays([pa.array(rule[begin], pa.int32()), own], names=["ord", "hits"])
    return [pa.ListArray.from_arrays(pa.array(np.searchsorted(text[begin], np.arange(len(texts) + 1)), pa.int32()), each)]


def with_hits(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``hits`` (``HITS``)."""
    return _scanned(docs, list(keep), [T.StructField("hits", HITS)], _lists)


def rule_hits(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per hit: id, ord, rule, action, prior, note, n (the hit's number within its rule), hit.

    Null and empty texts have none.  No shuffle, no join: batches of texts are scanned for all rules at once.
    """
    return exploded(with_hits(docs, id_col), id_col)


def exploded(rows: DataFrame, *along: str) -> DataFrame:
    """The hits of a column ``hits`` as rows, with the columns ``along``."""
    each = unnested(rows, list(along), F.col("hits"), "r")
    named = [of_rule(F.col("r.ord"), field).alias(name) for name, field in (("rule", "name"), ("action", "action"), ("prior", "prior"), ("note", "note"))]
    return each.select(*along, "r.ord", *named, F.posexplode("r.hits").alias("n", "hit"))


def summary(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per rule and action: hits, documents with a hit, prior.  Texts give counts, hits are not made."""
    rows = with_counts(docs, id_col)
    per = unnested(rows, [id_col], F.col("counts"), "c").groupBy(id_col, "c.ord").agg(F.sum("c.n").alias("n"))
    total = per.groupBy("ord").agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("docs"))
    return total.select(of_rule(F.col("ord"), "name").alias("rule"), of_rule(F.col("ord"), "action").alias("action"), "hits", "docs", of_rule(F.col("ord"), "prior").alias("prior"))


def with_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``counts``: array<struct<ord, n>>, how often each rule finds something, of those that do."""
    kind = T.ArrayType(T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("n", T.LongType())]))

    def make(texts: list[str]) -> list[pa.Array]:
        text, rule, _, _ = scan(texts)
        both, n = np.unique(text * len(RULES) + rule, return_counts=True)
        each = pa.StructArray.from_arrays([pa.array(both % len(RULES), pa.int32()), pa.array(n, pa.int64())], names=["ord", "n"])
        return [pa.ListArray.from_arrays(pa.array(np.searchsorted(both // len(RULES), np.arange(len(texts) + 1)), pa.int32()), each)]

    return _scanned(docs, list(keep), [T.StructField("counts", kind)], make)


def match_stats(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: keep_count, review_count, fallback_count, total_matches, from counts alone."""
    count = lambda action: F.aggregate("counts", F.lit(0).cast("long"), lambda a, r: a + F.when(of_rule(r["ord"], "action") == action, r["n"]).otherwise(0))
    rows = with_counts(docs, id_col, "text").select(id_col, "text", count("keep").alias("keep_count"), count("review").alias("review_count"))
    rows = rows.select(id_col, "keep_count", "review_count", F.when(F.col("keep_count") == 0, F.size(fallback(F.col("text")))).otherwise(0).cast("long").alias("fallback_count"))
    return rows.withColumn("total_matches", F.expr("keep_count + review_count + fallback_count"))


def first_rule(text: Column) -> Column:
    """struct(rule, action) of the first rule in order that finds something; here `.` also matches line ends."""
    found = [F.when(F.rlike(text, F.lit("(?iUds)" + searched(r))), F.struct(F.lit(r.name).alias("rule"), F.lit(r.action).alias("action"))) for r in RULES]
    return F.coalesce(*found)


def density(low: Column) -> Column:
    """Number of distinct density keywords in a sentence in lower case."""
    return sum((F.contains(low, F.lit(w)).cast("int") for w in DENSITY_WORDS), F.lit(0))


def fallback(text: Column, most: int = 3) -> Column:
    """array<struct<score, pos, sentence>>: the sentences with most density keywords, ties by position."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[。！？；.!?\n]"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+\z", ""))
    lowered = F.transform(parts, lambda s, i: F.struct(F.lower(s).alias("low"), i.alias("pos"), s.alias("sentence")))
    long = F.filter(lowered, lambda x: F.length(x["sentence"]) >= 10)
    scored = F.transform(long, lambda x: F.struct((-density(x["low"])).alias("score"), x["pos"].alias("pos"), x["sentence"].alias("sentence")))
    return F.slice(F.array_sort(F.filter(scored, lambda x: x["score"] < 0)), 1, most)


def kept(text: Column) -> Column:
    """Whether any keep rule finds something; the first that does decides."""
    return reduce(or_, (F.rlike(F.coalesce(text, F.lit("")), F.lit(FLAGS + searched(r))) for r in RULES if r.action == "keep"))


def fallback_topk(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Candidates of documents without a keep hit: id, rank, start, end, snippet, salience, action.

    The keep rules are a condition of the array and no filter, which would be pushed below what composes the
    texts, and compose one anew for each rule.
    """
    rows = unnested(docs, [id_col, "text"], F.when(~kept(F.col("text")), fallback(F.col("text"))), "k", "c")
    start = F.instr(F.col("text"), F.col("c.sentence")) - 1
    return rows.select(
        id_col,
        (F.col("k") + 1).alias("rank"),
        start.alias("start"),
        (start + F.length("c.sentence")).alias("end"),
        F.col("c.sentence").alias("snippet"),
        F.lit(0.5).alias("salience"),
        F.lit("keep").alias("action"),
    )


#: What ends a sentence: a full-width mark, a mark before white space or the text's end, a blank line.
_END = re.compile(r"[。！？]|[.!?](?=\s|\Z)|(?<=\n)\n")


class Sentences:
    """Where the sentences of a text end, found once, and the windows of hits between those places."""

    def __init__(self, text: str):
        self.text = text
        self.ends = [0, *(m.end() for m in _END.finditer(text))]

    def window(self, start: int, end: int, reach: int = WINDOW) -> tuple[int, int]:
        """The span grown to sentence ends on both sides, at most ``reach`` characters each; a right side without one ends at a blank."""
        floor, ceiling = max(0, start - reach), min(len(self.text), end + reach)
        before, after = bisect_right(self.ends, start), bisect_left(self.ends, end)
        left = max(floor, self.ends[before - 1])
        if after < len(self.ends) and self.ends[after] <= ceiling:
            return left, self.ends[after]
        blank = self.text.rfind(" ", end + 1, ceiling) if ceiling < len(self.text) else -1
        return left, ceiling if blank < 0 else blank


def spans(texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
    """For each text (rule's number, start, end) of its hits in rule order, then position."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, *hit in zip(*(x.tolist() for x in scan([t or "" for t in texts])), strict=True):
        out[i].append(tuple(hit))
    return out


def find_matches(text: str | None, found: list[tuple[int, int, int]] | None = None) -> list[tuple]:
    """(ord, rule, action, start, end, hit, window, snip_start, snip_end) in rule order, then position; ``found``: the text's ``spans``."""
    text = text or ""
    sentences = Sentences(text)
    out = []
    for i, start, end in spans([text])[0] if found is None else found:
        left, right = sentences.window(start, end)
        out.append((i, RULES[i].name, RULES[i].action, start, end, text[start:end], text[left:right], left, right))
    return out


MATCH = "ord:int rule:string action:string start:int end:int hit:string window:string snip_start:int snip_end:int"


def rule_matches(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """All matches with code-point offsets and sentence snippets (offsets need Python: Spark's count UTF-16 units)."""
    found = map_rows(docs, [id_col], ["text"], fields(MATCH), find_matches, spans)
    return found.withColumn("window", clean_snippet(F.col("window"))).withColumnRenamed("window", "snippet")


def marked_up(text: str | None, mode: str, compat: bool = False, found: list[tuple[int, int, int]] | None = None) -> str | None:
    """A text with keep hits emphasised (``extract``) or review hits flagged (``review``).

    Overlapping hits are merged first; with ``compat`` they are marked one by one as they come.  ``found``: the text's ``spans``.
    """
    if text is None:
        return None
    action, before, after = ("keep", "**【核心】", "**\n") if mode == "extract" else ("review", "⚠️【可能冗余】", "⚠️")
    own = [(s, e) for i, s, e in (spans([text])[0] if found is None else found) if RULES[i].action == action]
    if compat:
        if mode == "review":
            for s, e in sorted(own, key=lambda x: x[0], reverse=True):
                text = text[:s] + before + text[s:e] + after + text[e:]
            return text
        chosen = sorted(own, key=lambda x: x[0])
    else:
        merged: list[list[int]] = []
        for s, e in sorted(own):
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        chosen = [tuple(x) for x in merged]
    out, last = [], 0
    for s, e in chosen:
        out += [text[last:s] if last < s else "", before, text[s:e], after]
        last = e
    return "".join([*out, text[last:]])


def markup(docs: DataFrame, mode: str, compat: bool = False, id_col: str = "doc_id") -> DataFrame:
    return map_rows(docs, [id_col], ["text"], fields("marked:string"), lambda t, found: [(marked_up(t, mode, compat, found),)], spans)


def matches_union(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rule hits and fallback candidates in one table, from one scan."""
    rows = with_hits(docs, id_col, "text")
    row = lambda rule, action, snippet, spare: F.struct(rule.alias("rule"), action.alias("action"), snippet.alias("snippet"), F.lit(spare).alias("is_fallback"))
    hits = F.flatten(F.transform("hits", lambda r: F.transform(r["hits"], lambda h: row(of_rule(r["ord"], "name"), of_rule(r["ord"], "action"), h, False))))
    spare = F.transform(fallback(F.col("text")), lambda c: row(F.lit("fallback_candidate"), F.lit("keep"), c["sentence"], True))
    each = F.when(F.exists("hits", lambda r: of_rule(r["ord"], "action") == "keep"), hits).otherwise(F.concat(hits, spare))
    return unnested(rows, [id_col], each, "m").select(id_col, "m.*")


def top_per(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)


def full(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, text, items): each text as it is with all its hits, array<struct<rule, action, hit>>, in rule order, then position."""
    each = F.transform("hits", lambda r: F.transform(r["hits"], lambda h: F.struct(of_rule(r["ord"], "name").alias("rule"), of_rule(r["ord"], "action").alias("action"), h.alias("hit"))))
    return with_hits(docs, id_col, "text").select(id_col, "text", F.flatten(each).alias("items"))
