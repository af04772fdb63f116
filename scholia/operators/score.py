"""Grading papers on structure, innovation, data support and method under profiles and rubrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import automaton
from ..functions import lexicon as lists
from ..functions.fixed import NUMBER, NUMBER_STRICT, PROFILES, STRUCTURE_POINTS
from ..functions.rowwise import unnested
from .sections import with_sections

#: Keywords that are looked for one by one, at most; more are found together by an automaton.
MANY = 400
DIMENSIONS = ["structure", "innovation", "data_support", "method"]
FULL_AT = {"expr": 6, "conc": 3, "cross": 2}


def covered_flag(low: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(low, w)) if words else F.lit(False)


def saturate(n: Column, rate: Column) -> Column:
    return F.when(n > 0, 1 - F.pow(1 - rate, n)).otherwise(F.lit(0.0))


def structure(cols: dict[str, Column] | None = None) -> Column:
    c = cols or {n: F.col(n) for n in STRUCTURE_POINTS}
    return sum((F.when(c[n].isNotNull(), p).otherwise(0) for n, p in STRUCTURE_POINTS.items()), F.lit(0))


def numbers(text: Column, strict: bool) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?Ud)" + (NUMBER_STRICT if strict else NUMBER)), F.lit(0)))


def _measured(docs: DataFrame, grades: list[tuple[str, str]], words: dict, teacher_cap: int, semantic: dict[str, str] | None, id_col: str) -> DataFrame:
    """A row per document and (mode, subject) of ``grades``: what the text has, and what the profile asks for.

    Sections, numbers and the keywords that occur are found once per document; each grade then reads
    only the short list of keywords.
    """
    extra = {k: F.col(semantic[k]) if semantic and k in semantic else F.lit(0) for k in ("innovation", "method")}
    # Lower-cased once: inside a lambda it would be done for each keyword.
    low = F.lower("text")
    rows = with_sections(docs.withColumn("text", F.coalesce(F.col("text"), F.lit(""))), _lower=low, _both=F.concat(F.lower(F.coalesce("abstract", F.lit(""))), F.lit(" "), low))
    innovation = {m: words["innovation"][m] for m, _ in grades}
    method = {(m, s): [*words["method"][m], *[w for ws in words["rubrics"][s].values() for w in ws]] for m, s in grades}
    asked = [lists.distinct([w for ws in lists_ for w in ws]) for lists_ in (innovation.values(), method.values())]
    if sum(map(len, asked)) > MANY:  # one pass over the text, however many there are
        rows = automaton.with_contained(rows, ["_both", "text"], "_there", asked)
        there = [F.col("_there0"), F.col("_there1")]
    else:
        one_by_one = lambda text, own: F.filter(F.array(*[F.lit(w) for w in own]), lambda w: F.contains(text, w))
        there = [one_by_one(F.col("_both"), asked[0]), one_by_one(F.col("_lower"), asked[1])]
    conclusion = F.coalesce(F.nullif("conclusion", F.lit("")), F.col("text"))
    strict = sorted({PROFILES[m]["strict"] for m, _ in grades})
    rows = rows.select(
        id_col,
        F.length("text").alias("text_length"),
        structure().alias("structure"),
        (F.lit(5) - sum((F.col(n).isNotNull().cast("int") for n in STRUCTURE_POINTS), F.lit(0))).alias("missing"),
        F.col("keywords").isNull().alias("no_keywords"),
        # The abstract is part of the text, but may end in a keyword that the text's next character breaks.
        there[0].alias("new_words"),
        there[1].alias("words"),
        *[numbers(t, k).alias(f"{n}_{int(k)}") for k in strict for n, t in (("c", conclusion), ("e", F.col("text")))],
        *[extra[k].cast("int").alias(f"semantic_{k}") for k in extra],
    )
    among = lambda column, ws: F.size(F.filter(column, lambda w: w.isin(*lists.distinct(ws)))) if ws else F.lit(0)

    def grade(mode: str, subject: str) -> Column:
        p, rubric, k = PROFILES[mode], words["rubrics"][subject], int(PROFILES[mode]["strict"])
        covered = sum((F.when(among("words", ws) > 0, 1).otherwise(0) for ws in rubric.values()), F.lit(0))
        cap = max(70, min(100, teacher_cap)) if mode == "teacher" else p["cap"]
        parts = {
            "mode": F.lit(mode), "subject": F.lit(subject), "categories": F.lit(len(rubric)), "cap": F.lit(cap), "rate": F.lit(float(p["rate"])), "depth": F.lit(float(p["depth"])),
            **{f"full_{n}": F.lit(float(p[n])) for n in FULL_AT}, "innovation_words": among("new_words", innovation[mode]), "method_words": among("words", method[mode, subject]),
            "covered": covered, "n_conc": F.size(f"c_{k}"), "n_expr": F.size(f"e_{k}"), "n_cross": F.size(F.array_intersect(f"c_{k}", f"e_{k}")),
        }
        return F.struct(*[v.alias(n) for n, v in parts.items()])

    return rows.select(id_col, "text_length", "structure", "missing", "no_keywords", "semantic_innovation", "semantic_method", F.inline(F.array(*[grade(m, s) for m, s in grades])))


def _graded(rows: DataFrame) -> DataFrame:
    """Points, total and confidence of what ``_measured`` found."""
    rows = rows.withColumn("innovation_hits", F.expr("innovation_words + semantic_innovation")).withColumn("method_hits", F.expr("method_words + semantic_method"))
    data = sum((F.least(F.col(f"full_{k}"), F.col(f"full_{k}") * F.col(f"n_{k}") / full) for k, full in FULL_AT.items()), F.lit(0.0))
    share = F.lit(0.6) * F.col("covered") / F.col("categories") + F.lit(0.4) * saturate(F.col("method_hits"), F.col("depth"))
    rows = rows.withColumn("innovation", F.bround(F.round(25 * saturate(F.col("innovation_hits"), F.col("rate")), 9)).cast("int"))
    rows = rows.withColumn("data_support", F.least(F.lit(25), F.bround(F.round(data, 9)).cast("int")))
    rows = rows.withColumn("method", F.bround(F.round(25 * share, 9)).cast("int"))
    rows = rows.withColumn("total", F.least(F.col("cap"), sum((F.col(d) for d in DIMENSIONS), F.lit(0))))
    reasons = {
        "short text": (F.col("text_length") < 800, 0.35),
        "hits in one category": ((F.col("method_hits") >= 8) & (F.col("covered") <= 1), 0.30),
        "few hits": ((F.col("innovation_hits") == 0) & (F.col("method_hits") <= 1), 0.30),
        "little coverage": ((F.col("covered") <= 1) & (F.col("subject") != "general"), 0.15),
    }
    conf = F.lit(1.0)
    for when, less in reasons.values():
        conf = conf - F.when(when, F.lit(less)).otherwise(F.lit(0.0))
    conf = F.bround(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)), 9), 2)
    rows = rows.withColumn("conf_score", conf).withColumn("reasons", F.array_compact(F.array(*[F.when(w, F.lit(r)) for r, (w, _) in reasons.items()])))
    rows = rows.withColumn("conf_level", F.when(F.col("conf_score") >= 0.75, "高").when(F.col("conf_score") >= 0.45, "中").otherwise("低"))
    return rows.drop("rate", "depth", *[f"full_{k}" for k in FULL_AT])


def score_all(docs: DataFrame, mode: str = "teacher", subject: str = "general", lexicon: dict | None = None, teacher_cap: int = 85, semantic: dict[str, str] | None = None, id_col: str = "doc_id") -> DataFrame:
    """One row per document with every part of the score; no shuffle.

    An unknown mode counts as teacher, an unknown subject as general.  ``semantic`` names columns with
    numbers of semantic hits for innovation and method (none: 0).  Null texts count as empty.
    """
    words = lexicon or lists.load()
    mode = mode if mode in PROFILES else "teacher"
    subject = subject if subject in words["rubrics"] else "general"
    return _graded(_measured(docs, [(mode, subject)], words, teacher_cap, semantic, id_col))


#: First suggestion of each dimension, as a condition and a text.
SUGGESTIONS = {
    "structure": [("missing > 0", "add the sections that are missing"), ("no_keywords", "add a line of keywords")],
    "innovation": [("innovation_hits = 0", "state what is new in the abstract"), ("innovation_hits < 2", "state the contributions twice at least")],
    "data_support": [("n_conc = 0", "support the conclusion with numbers"), ("n_expr = 0", "report quantities in the experiments"), ("n_cross = 0", "quote the experiments' numbers in the conclusion")],
    "method": [("covered < categories", "cover all parts of the method"), ("method_hits < 3", "describe the method in more detail")],
}


def first_suggestion(dimension: str) -> Column:
    return F.coalesce(*[F.when(F.expr(when), F.lit(text)) for when, text in SUGGESTIONS[dimension]])


def suggestions(scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, rank, dimension, suggestion): lowest dimension first, ties in the dimensions' order; a warning at low confidence is rank 0."""
    each = F.array(*[F.struct(F.col(d).alias("score"), F.lit(i).alias("ord"), F.lit(d).alias("dimension"), first_suggestion(d).alias("suggestion")) for i, d in enumerate(DIMENSIONS)])
    found = F.filter(F.array_sort(each), lambda x: x["suggestion"].isNotNull())
    row = lambda rank, dimension, text: F.struct(rank.cast("int").alias("rank"), dimension.alias("dimension"), text.alias("suggestion"))
    ranked = F.transform(found, lambda x, i: row(i + 1, x["dimension"], x["suggestion"]))
    warn = F.when(F.col("conf_level") == "低", F.array(row(F.lit(0), F.lit("confidence"), F.array_join("reasons", "; ")))).otherwise(F.array().cast("array<struct<rank:int,dimension:string,suggestion:string>>"))
    return unnested(scored, [id_col], F.concat(warn, ranked), "s").select(id_col, "s.*")  # one pass: a union would grade all papers twice


def matrix(docs: DataFrame, lexicon: dict | None = None, id_col: str = "doc_id") -> DataFrame:
    """Totals of each document under every profile and subject, from one scan."""
    words = lexicon or lists.load()
    rows = _graded(_measured(docs, [(m, s) for m in PROFILES for s in words["rubrics"]], words, 85, None, id_col))
    return rows.select(id_col, "mode", "subject", *DIMENSIONS, "total")


def level(total: Column) -> Column:
    return F.when(total >= 85, "优秀").when(total >= 70, "良好").when(total >= 55, "中等").otherwise("待改进")


def rubric_coverage(docs: DataFrame, lexicon: dict | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, subject, covered, categories) for every subject."""
    words = lexicon or lists.load()
    low = F.lower(F.coalesce("text", F.lit("")))
    each = [
        F.struct(F.lit(s).alias("subject"), F.size(F.filter(F.array(*[covered_flag(low, w) for w in r.values()]), lambda x: x)).alias("covered"), F.lit(len(r)).alias("categories"))
        for s, r in words["rubrics"].items()
    ]
    return docs.select(id_col, F.inline(F.array(*each)))
