"""Text cleaning: quality gate, repeated lines, reflow, snippets, sentences, chunks, names."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import WATERMARKS
from ..functions.rowwise import fields, map_rows, unnested

# Characters that count as ordinary text.
GOOD_ASCII = r"""A-Za-z0-9.,;:!?()\[\]{}'"\-+/=%@#&*<>|_~$"""
GOOD_CJK = "，。、；：！？（）【】「」『』“”‘’《》—…·"
GARBLED_WEIGHT, GARBLED_SHARE, GOOD_SHARE = 8, 0.15, 0.6


def strip(text: Column) -> Column:
    """Without white space (Unicode) at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def quality_ok(text: Column) -> Column:
    """Whether a text looks like writing: few (cid:n) marks and enough ordinary characters; null does not."""
    text = F.coalesce(text, F.lit(""))
    marks = (F.length(text) - F.length(F.replace(text, F.lit("(cid:"), F.lit("")))) / 5
    total = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    good = F.length(F.regexp_replace(text, rf"[^{GOOD_ASCII}\x{{4e00}}-\x{{9fff}}{GOOD_CJK}]", ""))
    garbled = (marks > 0) & (marks * GARBLED_WEIGHT > F.length(text) * F.lit(GARBLED_SHARE))
    return (total > 0) & ~garbled & (good / F.greatest(total, F.lit(1)) >= F.lit(GOOD_SHARE))


def first_good(*candidates: Column) -> Column:
    """The first text that passes the gate, else ''."""
    return F.coalesce(*[F.when(quality_ok(c), c) for c in candidates], F.lit(""))


def strip_repeated(text: str | None, aggressive: bool = False) -> str | None:
    """Without lines that recur as page furniture does; unchanged if that took over 30 % of the lines.

    Distinct lines are numbered, and a vector over them holds which ones go.
    """
    if not text or "\n" not in text:
        return text
    lines = np.array(text.split("\n"), object)
    number, distinct = pd.factorize(np.array([x.strip() for x in lines], object))
    often, size = np.bincount(number), np.fromiter(map(len, distinct), np.int64, len(distinct))
    least, longest = (3, 140) if aggressive else (4, 60)
    gone = (often >= least) & (size <= longest)
    if aggressive:
        gone |= (often >= 2) & np.array([any(w in x.lower() for w in WATERMARKS) for x in distinct])
    gone &= size > 0
    if often[gone].sum() > 0.30 * often[size > 0].sum():
        return text
    return "\n".join(lines[~gone[number]])


def strip_repeated_lines(docs: DataFrame, aggressive: bool = False, text_col: str = "text") -> DataFrame:
    """``docs`` with the text stripped.  Row-local: lines are counted where their text is, without a shuffle."""
    keep = [c for c in docs.columns if c != text_col]
    return map_rows(docs, keep, [text_col], fields(f"{text_col}:string"), lambda t: [(strip_repeated(t, aggressive),)])


# What starts a new block, and what ends a sentence at a line's end.
NEW_BLOCK = re.compile(
    r"^(\d+(\.\d+)*[\.\)、]?\s|[•·\-\*]\s|\[\d+\]|第[一二三四五六七八九十\d]+[章节]|"
    r"(Abstract|Introduction|Related Work|Method|Conclusion|References|Acknowledg|图|表|Fig|Table|Algorithm)\b)"
)
LINE_ENDS = "。！？.!?；;:："


def _is_han(c: str) -> bool:
    return "一" <= c <= "鿿"


def reflow(text: str | None) -> str | None:
    """Lines that a layout broke put together again; blank lines, sentence ends and headings keep their breaks."""
    if not text:
        return text
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = re.sub(r"([A-Za-z])-\n[ \t]*([a-z])", r"\1\2", text)
    blocks: list[str] = []
    joining = False
    for line in map(str.strip, text.split("\n")):
        if not line:
            joining = False
        elif not joining or blocks[-1][-1] in LINE_ENDS or NEW_BLOCK.match(line):
            blocks.append(line)
            joining = True
        else:
            blocks[-1] += line if _is_han(blocks[-1][-1]) and _is_han(line[0]) else " " + line
    return "\n".join(blocks)


def reflow_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    keep = [c for c in docs.columns if c != text_col]
    return map_rows(docs, keep, [text_col], fields(f"{text_col}:string"), lambda t: [(reflow(t),)])


def clean_snippet(text: Column) -> Column:
    """Hyphenated line breaks joined, other breaks one space, runs of blanks one space, trimmed."""
    out = F.regexp_replace(text, r"(?U)([A-Za-z])-\s*\n\s*([a-z])", "$1$2")
    out = F.regexp_replace(out, r"(?U)\s*\n\s*", " ")
    return strip(F.regexp_replace(out, r"[ \t]{2,}", " "))


def norm_text(text: Column) -> Column:
    """White space runs as one space, trimmed; null as ''."""
    return F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"(?U)\s+", " ")


# Remains of references and links.
JUNK = r"(\[[A-Z]\]\s*\.|et al\.|doi:|https?://|arXiv:|^\s*\d+\s*\.\s*$|参考文献|References)"


def sentence_like(text: Column, least: int = 14, most: int = 240, terminal: bool = False) -> Column:
    """Whether a text can be a sentence of prose."""
    s = strip(text)
    n = F.length(s)
    letters = F.length(F.regexp_replace(s, r"[^\x{4e00}-\x{9fff}A-Za-z]", ""))
    count = lambda c: n - F.length(F.replace(s, F.lit(c), F.lit("")))
    ok = n.between(least, most) & (letters >= F.greatest(F.lit(8.0), n * F.lit(0.4))) & (count("|") < 3) & (count("\t") < 2)
    ok = ok & ~F.rlike(s, F.lit("(?iUd)" + JUNK))
    return ok & F.rlike(s, F.lit(r"""(?U)[。！？.!?]["'）)\]]?\z""")) if terminal else ok


def sentences(text: Column) -> Column:
    """Array of normalised sentences: broken lines joined, split after final punctuation."""
    out = F.regexp_replace(text, r"(?U)([A-Za-z])-\s*\n\s*([a-z])", "$1$2")
    out = F.regexp_replace(out, r"(?U)\s*\n\s*", " ")
    parts = F.split(out, r"(?U)(?<=[。！？；])\s*|(?<=[.!?;])\s+")
    return F.filter(F.transform(parts, norm_text), lambda x: x != "")


def pack_paragraphs(text: str | None, size: int = 2000) -> list[str]:
    """Paragraphs packed greedily to about ``size`` characters; a longer paragraph stays whole."""
    if text is None:
        return []
    chunks: list[list[str]] = []
    room = 0
    for paragraph in text.split("\n\n"):
        need = len(paragraph) + 2
        if not chunks or need > room:
            chunks.append([])
            room = size
        chunks[-1].append(paragraph)
        room -= need
    return ["\n\n".join(c) for c in chunks]


def chunk_paragraphs(docs: DataFrame, size: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk int from 0, text) for each chunk."""
    return map_rows(docs, [id_col], [text_col], fields("chunk:int text:string"), lambda t: enumerate(pack_paragraphs(t, size)))


def original_name(name: Column) -> Column:
    """Without the time stamp that uploads get in front."""
    return F.regexp_replace(name, r"^\d+_", "")


def truncated(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def ocr_reading_order(boxes: DataFrame, id_col: str = "page_id", least: float = 0.5) -> DataFrame:
    """(id, line int, text) from (id, width double, tokens array<struct<points, text, score>>): columns, then lines, then left to right.

    Boxes without text or below the least score are left out (no score counts as 1).  A page has two
    columns if a quarter of its boxes at least have their middle in either half.  A line is half the
    upper median of the boxes' heights, 8 without any height.  Ties keep the order of recognition.
    """
    side = lambda t, k, pick: pick(F.transform(t["points"], lambda p: p[k]))

    def box(t: Column, at: Column) -> Column:
        left, top = side(t, 0, F.array_min), side(t, 1, F.array_min)
        middle, height = (left + side(t, 0, F.array_max)) / 2, side(t, 1, F.array_max) - top
        return F.struct((middle >= F.coalesce("width", F.lit(0.0)) / 2).alias("right"), top.alias("top"), left.alias("left"), height.alias("height"), at.alias("at"), t["text"].alias("text"))

    readable = F.filter(F.coalesce("tokens", F.array().cast(boxes.schema["tokens"].dataType)), lambda t: (F.coalesce(t["text"], F.lit("")) != "") & (F.coalesce(t["score"], F.lit(1.0)) >= least))
    rows = boxes.select(id_col, F.transform(readable, box).alias("b"))
    heights = F.array_sort(F.filter(F.transform("b", lambda x: x["height"]), lambda h: h > 0))
    rows = rows.select(id_col, "b", heights.alias("h"), F.size(F.filter("b", lambda x: x["right"])).alias("r"))
    band = F.coalesce(F.get("h", F.floor(F.size("h") / 2).cast("int")) / 2, F.lit(8.0))
    two = (F.col("r") >= F.size("b") * 0.25) & (F.size("b") - F.col("r") >= F.size("b") * 0.25)
    rows = rows.select(id_col, "b", band.alias("band"), two.alias("two"))
    key = lambda x: F.struct((F.col("two") & x["right"]).alias("column"), F.bround(x["top"] / F.col("band")).alias("line"), x["left"].alias("left"), x["at"].alias("at"), x["text"].alias("text"))
    ordered = unnested(rows, [id_col], F.array_sort(F.transform("b", key)), "line", "x")
    return ordered.select(id_col, "line", "x.text")
