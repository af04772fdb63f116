"""Which of many keywords a text contains, in one pass over the text.

Keywords go to the workers as lists; each worker builds an automaton of them once (Aho and Corasick's:
the time a text takes doesn't depend on how many keywords there are).  A lexicon of more than ``LIMIT`` characters is
cut into blocks of that size, each of which takes a pass of its own, so no worker holds more.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1 << 23


@lru_cache(maxsize=2)
def automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, w in enumerate(words):
        out.add_word(w, k)
    out.make_automaton()
    return out


def contained(text: str, words: tuple[str, ...]) -> list[int]:
    """Numbers of the words that ``text`` contains, in order."""
    return sorted({k for _, k in automaton(words).iter(text)}) if words and text else []


def blocks(words: list[str]) -> list[tuple[str, ...]]:
    """Words in blocks of ``LIMIT`` characters at most; a longer word is alone."""
    out: list[list[str]] = [[]]
    size = 0
    for w in words:
        if out[-1] and size + len(w) > LIMIT:
            out.append([])
            size = 0
        out[-1].append(w)
        size += len(w)
    return [tuple(b) for b in out if b]


def with_contained(rows: DataFrame, text_cols: list[str], out: str, words: list[list[str]]) -> DataFrame:
    """``rows`` with a list for each text column: the words, of those given for it, that its lower-cased text contains, in the words' order.

    Lists are called ``out`` and the text column's number.  Words are compared lower-cased and repeats count once; empty words, and texts
    that are null, contain nothing.  No shuffle.
    """
    for number, (column, own) in enumerate(zip(text_cols, words, strict=True)):
        parts = blocks(list(dict.fromkeys(w.lower() for w in own if w)))
        name = f"{out}{number}"
        rows = rows.withColumn(name, F.array().cast("array<string>"))
        for part in parts:
            rows = _with_block(rows, column, name, part)
    return rows


def _with_block(rows: DataFrame, column: str, name: str, words: tuple[str, ...]) -> DataFrame:
    asked = rows.withColumn("_low", F.lower(F.coalesce(column, F.lit(""))))
    place, low = rows.columns.index(name), len(rows.columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column(place).to_pylist()
            found = [[*b, *(words[k] for k in contained(t, words))] for b, t in zip(before, batch.column(low).to_pylist(), strict=True)]
            columns = [pa.array(found, pa.list_(pa.string())) if k == place else c for k, c in enumerate(batch.columns[:low])]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:low])

    return asked.mapInArrow(run, rows.schema)


def counted(docs: DataFrame, keywords: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, subject, covered, categories, words) for keywords(subject, category, word): how many of a subject's categories a text touches,
    how many it has, and how many distinct words of it the text contains.  A row for each document and subject that has any.

    Words go to the workers in blocks of about ``LIMIT`` characters, split by hash, with a pass over the texts each; what they
    belong to stays a table, joined with the hits by word.
    """
    known = keywords.where("word <> '' and subject is not null and category is not null").select("subject", "category", F.lower("word").alias("word")).distinct()
    subjects = known.groupBy("subject").agg(F.count_distinct("category").cast("int").alias("categories"))
    distinct = known.select("word").distinct()
    count = math.ceil((distinct.agg(F.sum(F.length("word"))).first()[0] or 0) / LIMIT)
    rows, names = docs.select(id_col, F.col(text_col).alias("_text")), []
    for b in range(count):
        own = [r[0] for r in distinct.where(F.pmod(F.xxhash64("word"), F.lit(count)) == b).collect()]  # about LIMIT characters
        names.append(f"_block{b}_")
        rows = with_contained(rows, ["_text"], names[-1], [sorted(own)])
    found = F.concat(*[F.col(f"{n}0") for n in names]) if names else F.array().cast("array<string>")
    hits = rows.select(id_col, F.explode(found).alias("word"))
    per = hits.join(known, "word").groupBy(id_col, "subject").agg(F.count_distinct("category").cast("int").alias("covered"), F.count_distinct("word").cast("int").alias("words"))
    return per.join(subjects, "subject").select(id_col, "subject", "covered", "categories", "words")
