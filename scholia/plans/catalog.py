"""Every query of the library: what Spark runs, and the same in DuckDB's SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import automaton, fixed, lexicon
from ..functions.rowwise import unnested
from ..functions.rule_table import NOTES, RULES
from ..operators import clean, dataset, quota, rollup, rules, salience, score, sections, segment, semantic, text_ai
from ..sources import papers as sources
from ..sources.scratch import Scratch
from ..sources.versions import Versions
from ..streaming import state as states
from ..streaming import usage as streams
from . import sqltext as s

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


papers, documents = sources.papers, sources.documents
P = f"WITH {s.PAPERS} "
PH = f"WITH {s.PAPERS}, {s.HITS} "
PS = f"WITH {s.PAPERS}, {s.SECTIONS} "

# Scans and cleaning.


@query("SELECT doc_id, lang, source, length(text)::INT AS n FROM documents")
def scan_documents(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", "lang", "source", F.length("text").alias("n"))


@query("SELECT page_id, url, regexp_extract(lower(url), '\\.([a-z]+)$', 1) IN ('pdf', 'docx', 'txt', 'md') AS allowed FROM pages")
def filter_allowed_ext(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url", sources.allowed(F.col("url")).alias("allowed"))


_GOOD = clean.GOOD_ASCII.replace("'", "''")
_QUALITY = rf"""(length(regexp_replace(x, '\s', '', 'g')) > 0 AND NOT ((length(x) - length(replace(x, '(cid:', ''))) / 5 > 0 AND (length(x) - length(replace(x, '(cid:', ''))) / 5 * 8 > length(x) * 0.15::DOUBLE)
 AND length(regexp_replace(x, '[^{_GOOD}\x{{4e00}}-\x{{9fff}}{clean.GOOD_CJK}]', '', 'g')) / greatest(length(regexp_replace(x, '\s', '', 'g')), 1) >= 0.6::DOUBLE)"""


@query(f"SELECT doc_id, {_QUALITY} AS ok FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)")
def text_quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", clean.quality_ok(F.col("text")).alias("ok"))


@query(
    f"SELECT doc_id, coalesce(CASE WHEN {_QUALITY.replace('(x', '(a').replace(' x', ' a').replace('(a,', '(a,')} THEN a END, CASE WHEN {_QUALITY.replace('(x', '(b').replace(' x', ' b')} THEN b END, '') AS text "
    "FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN repeat('(cid:12) ', 50) ELSE text END AS a, reverse(text) AS b FROM documents)"
)
def extract_coalesce(spark: SparkSession, d: str) -> DataFrame:
    first = F.when(F.col("doc_id") % 3 == 0, F.repeat(F.lit("(cid:12) "), 50)).otherwise(F.col("text"))
    return documents(spark, d).select("doc_id", clean.first_good(first, F.reverse("text")).alias("text"))


_LINES = "array_to_string([p_brand, 'Journal of Tests', p_name, 'Journal of Tests', CAST(p_partkey AS STRING), p_type, 'download here', p_name || ' two', p_brand || ' three', CASE WHEN p_partkey % 2 = 0 THEN 'Journal of Tests' ELSE 'x' END, 'Journal of Tests', 'download here', 'a', 'b', 'c', 'd', 'e', 'f', 'g'], chr(10))"
_LINES_SPARK = _LINES.replace("array_to_string([", "array_join(array(").replace("], chr(10))", "), chr(10))")


def _strip_sql(least: int, longest: int, aggressive: bool) -> str:
    marks = " OR ".join(f"contains(lower(x), {s.q(w)})" for w in fixed.WATERMARKS)
    recurs = f"(c >= {least} AND length(x) <= {longest})" + (f" OR (c >= 2 AND ({marks}))" if aggressive else "")
    return f"""WITH src AS (SELECT p_partkey AS doc_id, {_LINES} AS text FROM part),
 lines AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM src)),
 marked AS (SELECT *, x <> '' AND ({recurs}) AS gone FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM lines)),
 agg AS (SELECT doc_id, count(*) FILTER (gone) > 0.30::DOUBLE * count(*) FILTER (x <> '') AS unchanged, string_agg(x, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id)
 SELECT doc_id, CASE WHEN unchanged THEN text ELSE kept END AS text FROM agg JOIN src USING (doc_id)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(_LINES_SPARK).alias("text"))


@query(_strip_sql(4, 60, False))
def strip_repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    return clean.strip_repeated_lines(_lines(spark, d))


@query(_strip_sql(3, 140, True))
def strip_repeated_lines_aggr(spark: SparkSession, d: str) -> DataFrame:
    return clean.strip_repeated_lines(_lines(spark, d), aggressive=True)


@query(f"WITH {s.PAPERS}, {s.reflowed()} SELECT * FROM reflowed")
def reflow_lines(spark: SparkSession, d: str) -> DataFrame:
    return clean.reflow_lines(papers(spark, d))


@query(rf"""{P} SELECT doc_id, {s.strip(r"regexp_replace(regexp_replace(regexp_replace(text, '([A-Za-z])-\s*\n\s*([a-z])', '\1\2', 'g'), '\s*\n\s*', ' ', 'g'), '[ \t]{2,}', ' ', 'g')")} AS snippet FROM papers""")
def clean_snippet(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).select("doc_id", clean.clean_snippet(F.col("text")).alias("snippet"))


@query(rf"""SELECT doc_id, md5(regexp_replace({s.strip("coalesce(text, '')")}, '\s+', ' ', 'g')) AS h FROM documents""")
def norm_text(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.md5(clean.norm_text(F.col("text"))).alias("h"))


@query(f"SELECT doc_id, k.pos::INT AS pos, l[k.pos + 1] AS s FROM (SELECT doc_id, {s.sentences('text')} AS l FROM documents), LATERAL (SELECT unnest(range(len(l))) AS pos) k")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return unnested(documents(spark, d), ["doc_id"], clean.sentences(F.col("text")), "pos", "s")


@query(f"SELECT doc_id, count(*) AS sentences, (count(*) FILTER ({s.sentence_like(True)})) AS good FROM (SELECT doc_id, unnest({s.sentences('text')}) AS s FROM documents) GROUP BY doc_id")
def sentence_like_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = unnested(documents(spark, d), ["doc_id"], clean.sentences(F.col("text")), "s")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.count_if(clean.sentence_like(F.col("s"), terminal=True)).alias("good"))


@query("SELECT doc_id, substring(text, 1, 6000) AS prompt, length(substring(text, 1, 200000))::INT AS stored FROM documents")
def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", clean.truncated(F.col("text"), 6000).alias("prompt"), F.length(clean.truncated(F.col("text"), 200000)).alias("stored"))


@query("SELECT p_partkey, regexp_replace(CAST(p_partkey AS STRING) || '_' || p_name, '^\\d+_', '') AS name FROM part")
def original_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", clean.original_name(F.expr("CAST(p_partkey AS STRING) || '_' || p_name")).alias("name"))


@query("""WITH RECURSIVE p AS (SELECT doc_id, k.pos::INT AS pos, l[k.pos + 1] AS s, length(l[k.pos + 1]) + 2 AS need FROM (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS l FROM documents), LATERAL (SELECT unnest(range(len(l))) AS pos) k),
 w(doc_id, pos, chunk, room) AS (SELECT doc_id, pos, 0, 2000 - need FROM p WHERE pos = 0 UNION ALL SELECT p.doc_id, p.pos, CASE WHEN need > room THEN chunk + 1 ELSE chunk END, CASE WHEN need > room THEN 2000 ELSE room END - need FROM w JOIN p ON p.doc_id = w.doc_id AND p.pos = w.pos + 1)
 SELECT doc_id, chunk, string_agg(s, chr(10) || chr(10) ORDER BY pos) AS text FROM w JOIN p USING (doc_id, pos) GROUP BY doc_id, chunk""")
def chunk_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return clean.chunk_paragraphs(docs)


@query("""WITH b AS (SELECT p_partkey % 50 AS page_id, p_name AS text, (p_size * 11 % 600)::DOUBLE AS x, (p_partkey * 7 % 800)::DOUBLE AS y, p_size / 50.0::DOUBLE AS score FROM part WHERE p_size / 50.0::DOUBLE >= 0.5::DOUBLE),
 n AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n, count(*) FILTER (x + 40 >= 350) OVER (PARTITION BY page_id) AS r FROM b)
 SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY r >= n * 0.25 AND n - r >= n * 0.25 AND x + 40 >= 350, round_even(y / 5, 0), x, y, text, score) - 1)::INT AS line, text FROM n""")
def ocr_reading_order(spark: SparkSession, d: str) -> DataFrame:
    box = "array(array(x, y), array(x + 80D, y), array(x + 80D, y + 10D), array(x, y + 10D))"
    rows = table(spark, d, "part").selectExpr("p_partkey % 50 AS page_id", "p_name AS text", "CAST(p_size * 11 % 600 AS DOUBLE) AS x", "CAST(p_partkey * 7 % 800 AS DOUBLE) AS y", "CAST(p_size AS DOUBLE) / 50 AS score")
    rows = rows.select("page_id", F.expr(f"struct({box} AS points, text, score)").alias("token"))
    pages = rows.groupBy("page_id").agg(F.array_sort(F.collect_list("token")).alias("tokens")).withColumn("width", F.lit(700.0))  # the boxes of one page
    return clean.ocr_reading_order(pages)


# Rules and salience.


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {s.q(r.name)}, {s.q(r.action)}, {r.prior}::DOUBLE, {s.q(r.description)}, {s.q(NOTES[r.name])}, {s.q(r.pattern)})" for i, r in enumerate(RULES)) + ") t(ord, name, action, prior, description, note, pattern)")
def rules_catalog(spark: SparkSession, d: str) -> DataFrame:
    return rules.catalog(spark)


@query(PH + "SELECT * FROM each_hit")
def rule_hits(spark: SparkSession, d: str) -> DataFrame:
    return rules.rule_hits(papers(spark, d))


@query(PH + "SELECT rule, action, count(*) AS hits, count(DISTINCT doc_id) AS docs, avg(prior) AS prior FROM each_hit GROUP BY ALL")
def rule_summary(spark: SparkSession, d: str) -> DataFrame:
    return rules.summary(papers(spark, d))


_FALLBACK = f"""parts AS (SELECT doc_id, text, k.pos, {s.strip("l[k.pos + 1]")} AS sentence FROM (SELECT doc_id, text, string_split_regex(text, '[。！？；.!?\\n]') AS l FROM papers), LATERAL (SELECT unnest(range(len(l))) AS pos) k),
 dens AS (SELECT *, {s.contained("lower(sentence)", fixed.DENSITY_WORDS)} AS score FROM parts),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos)::INT AS rank FROM dens WHERE length(sentence) >= 10 AND score > 0),
 cand AS (SELECT * FROM ranked WHERE rank <= 3), kept AS (SELECT DISTINCT doc_id FROM each_hit WHERE action = 'keep'),
 fall AS (SELECT doc_id, rank, (instr(text, sentence) - 1)::INT AS "start", (instr(text, sentence) - 1 + length(sentence))::INT AS "end", sentence AS snippet, 0.5::DOUBLE AS salience, 'keep' AS action FROM cand WHERE doc_id NOT IN (SELECT doc_id FROM kept))"""


@query(f"""WITH {s.PAPERS}, {s.HITS}, {_FALLBACK}, n AS (SELECT doc_id, count(*) FILTER (action = 'keep') AS k, count(*) FILTER (action = 'review') AS r FROM each_hit GROUP BY doc_id),
 f AS (SELECT doc_id, count(*) AS f FROM fall GROUP BY doc_id)
 SELECT doc_id, coalesce(k, 0) AS keep_count, coalesce(r, 0) AS review_count, coalesce(f, 0) AS fallback_count, coalesce(k, 0) + coalesce(r, 0) + coalesce(f, 0) AS total_matches FROM papers LEFT JOIN n USING (doc_id) LEFT JOIN f USING (doc_id)""")
def match_stats(spark: SparkSession, d: str) -> DataFrame:
    return rules.match_stats(papers(spark, d))


@query(f"WITH {s.PAPERS}, {s.HITS}, {_FALLBACK} SELECT * FROM fall")
def fallback_topk(spark: SparkSession, d: str) -> DataFrame:
    return rules.fallback_topk(papers(spark, d))


@query(f"WITH {s.PAPERS}, {s.HITS}, {_FALLBACK} SELECT doc_id, rule, action, hit AS snippet, FALSE AS is_fallback FROM each_hit UNION ALL SELECT doc_id, 'fallback_candidate', action, snippet, TRUE FROM fall")
def matches_union(spark: SparkSession, d: str) -> DataFrame:
    return rules.matches_union(papers(spark, d))


_SNIPPET = rf"""{s.strip(r"regexp_replace(regexp_replace(regexp_replace(substring(text, snip_start + 1, snip_end - snip_start), '([A-Za-z])-\s*\n\s*([a-z])', '\1\2', 'g'), '\s*\n\s*', ' ', 'g'), '[ \t]{2,}', ' ', 'g')")}"""


@query(f'WITH {s.PAPERS}, {s.PLACES}, {s.WINDOWS} SELECT doc_id, ord, rule, action, "start", "end", hit, {_SNIPPET} AS snippet, snip_start, snip_end FROM windows')
def rule_matches(spark: SparkSession, d: str) -> DataFrame:
    return rules.rule_matches(papers(spark, d))


@query(f"WITH {s.PAPERS}, {s.PLACES}, {s.marked('keep', s.q('**【核心】'), s.q('**') + ' || chr(10)')} SELECT * FROM marked")
def markup_extract(spark: SparkSession, d: str) -> DataFrame:
    return rules.markup(papers(spark, d), "extract")


@query(f"WITH {s.PAPERS}, {s.PLACES}, {s.marked('review', s.q('⚠️【可能冗余】'), s.q('⚠️'))} SELECT * FROM marked")
def markup_review(spark: SparkSession, d: str) -> DataFrame:
    return rules.markup(papers(spark, d), "review")


@query(PH + ", items AS (SELECT doc_id, list({'rule': rule, 'action': action, 'hit': hit} ORDER BY ord, n) AS items FROM each_hit GROUP BY doc_id) SELECT doc_id, text, to_json(coalesce(items, []))::VARCHAR AS items FROM papers LEFT JOIN items USING (doc_id)".replace(") , items", "), items"))
def process_full(spark: SparkSession, d: str) -> DataFrame:
    return rules.full(papers(spark, d)).withColumn("items", F.to_json("items"))


def _first_rule_sql(text: str, field: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {s.q(r.pattern)}, 'is') THEN {s.q(getattr(r, field))}" for r in RULES) + " END"


_SAID = f"""said AS (SELECT doc_id, k.pos, l[k.pos + 1] AS s FROM (SELECT doc_id, {s.sentences('text')} AS l FROM papers), LATERAL (SELECT unnest(range(len(l))) AS pos) k)"""


@query(f"{P}, {_SAID} SELECT doc_id, pos::INT AS pos, {_first_rule_sql('s', 'name')} AS rule, {_first_rule_sql('s', 'action')} AS action FROM said".replace("WITH papers", "WITH papers", 1).replace(") , said", "), said"))
def first_rule(spark: SparkSession, d: str) -> DataFrame:
    rows = unnested(papers(spark, d), ["doc_id"], clean.sentences(F.col("text")), "pos", "s").withColumn("r", rules.first_rule(F.col("s")))
    return rows.select("doc_id", "pos", "r.rule", "r.action")


@query(f"SELECT doc_id, len({s.TOKENS('text')}) AS n_tokens, len({s.CONTENT(s.TOKENS('text'))}) AS n_content FROM documents")
def content_tokens(spark: SparkSession, d: str) -> DataFrame:
    return salience.content_tokens(documents(spark, d))


@query(f"WITH {s.tfidf('documents')} SELECT * FROM weights")
def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    return salience.tfidf(documents(spark, d))


_SAL = f"WITH {s.PAPERS}, {s.HITS}, {s.tfidf()}, {s.SALIENCE} "


@query(_SAL + "SELECT * FROM sal")
def salience_scores(spark: SparkSession, d: str) -> DataFrame:
    return salience.salience(papers(spark, d))


@query(_SAL + " UNION ALL ".join(f"SELECT doc_id, ord, n, '{k}' AS key, round_even(f_{k}, 3) AS value, {w}::DOUBLE AS weight, round_even(round(f_{k} * {w}::DOUBLE, 6), 3) AS contribution FROM sal" for k, w in fixed.WEIGHTS.items()))
def salience_factors(spark: SparkSession, d: str) -> DataFrame:
    return salience.factors(salience.salience(papers(spark, d)))


@query(_SAL + "SELECT rule, action, count(*) AS hits, min(salience) AS low, round(sum(round(salience * 100)::BIGINT) / (100.0::DOUBLE * count(*)), 6) AS mean, max(salience) AS high FROM sal GROUP BY ALL")
def salience_ranges(spark: SparkSession, d: str) -> DataFrame:
    return salience.ranges(salience.salience(papers(spark, d)))


@query(f"""WITH t AS (SELECT doc_id, {s.CONTENT(s.TOKENS('text'))} AS t FROM documents), known AS (SELECT * FROM t WHERE doc_id % 10 <> 0), n AS (SELECT count(*) AS n FROM known),
 df AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(t) AS term FROM known) GROUP BY term), fresh AS (SELECT doc_id, len(t) AS total, unnest(t) AS term FROM t WHERE doc_id % 10 = 0),
 w AS (SELECT doc_id, term, round(count(*) / any_value(total) * (ln(((SELECT n FROM n) + 1) / (coalesce(any_value(df), 0) + 1)) + 1), 9) AS w FROM fresh LEFT JOIN df USING (term) GROUP BY doc_id, term)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term)::INT AS rank FROM w) WHERE rank <= {fixed.TOP_TERMS}""")
def tfidf_under_statistics(spark: SparkSession, d: str) -> DataFrame:
    """New papers (a tenth) under statistics kept from the others in three batches."""
    docs, path = documents(spark, d), f"{Scratch(spark, 'statistics').root}/terms"
    for batch in range(3):
        salience.keep_statistics(docs.where(f"doc_id % 10 <> 0 AND doc_id % 3 = {batch}"), path)
    return salience.tfidf_under(docs.where("doc_id % 10 = 0"), Versions(spark, path).read())


# Words of Han text.


def _han_documents(spark: SparkSession, d: str) -> DataFrame:
    """Composed once, as several passes read them."""
    return Scratch(spark, "han-documents").keep(sources.han_documents(spark, d), "texts")


@query(f"""WITH {s.HAN_DOCUMENTS}, {s.HAN_WORDS} SELECT word, n, round(cohesion, 6) AS cohesion, round(left_entropy, 6) AS left_entropy, round(right_entropy, 6) AS right_entropy FROM han_words""")
def han_words(spark: SparkSession, d: str) -> DataFrame:
    return segment.words(_han_documents(spark, d)).select("word", "n", *[F.round(c, 6).alias(c) for c in ("cohesion", "left_entropy", "right_entropy")])


@query()
def han_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words of each document under the lexicon that all of them teach, and a digest of their order."""
    docs = _han_documents(spark, d)
    rows = segment.with_words(docs, "text", "tokens", segment.learn(docs))
    return rows.select("doc_id", F.size("tokens").alias("n_tokens"), F.sha2(F.array_join("tokens", " ").cast("binary"), 256).alias("tokens_sha256"))


@query()
def han_tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    docs = _han_documents(spark, d)
    return salience.tfidf(docs, lexicon=segment.learn(docs))


@query()
def han_salience(spark: SparkSession, d: str) -> DataFrame:
    """Hits of all papers scored on words: those of Chinese papers are read with a lexicon learned from all papers."""
    docs = papers(spark, d)
    return salience.salience(docs, lexicon=segment.learn(docs))


# Sections and scores.


@query(PS + "SELECT doc_id, abstract, keywords, method, experiment, conclusion FROM sec")
def extract_sections(spark: SparkSession, d: str) -> DataFrame:
    return sections.extract_sections(papers(spark, d))


def _scored(mode: str, subject: str, columns: str) -> tuple[str, Callable[[SparkSession, str], DataFrame]]:
    sql = f"WITH {s.PAPERS}, {s.SECTIONS}, {s.scored(mode, subject)} SELECT {columns} FROM scored"
    return sql, lambda spark, d: score.score_all(papers(spark, d), mode, subject).selectExpr(*columns.split(", "))


for _name, _mode, _subject, _columns in (
    ("score_structure", "teacher", "general", "doc_id, structure, missing, no_keywords"),
    ("score_innovation", "expert", "general", "doc_id, innovation_hits, innovation"),
    ("score_data", "professor", "general", "doc_id, n_expr, n_conc, n_cross, data_support"),
    ("score_method", "teacher", "cs", "doc_id, covered, method_hits, method"),
    ("score_confidence", "teacher", "materials", "doc_id, conf_score, conf_level"),
    ("score_total", "teacher", "cs", "doc_id, structure, innovation, data_support, method, total, cap, conf_level"),
):
    SQL[_name], QUERIES[_name] = _scored(_mode, _subject, _columns)


def _tip(dimension: str) -> str:
    return "CASE " + " ".join(f"WHEN {when} THEN {s.q(text)}" for when, text in score.SUGGESTIONS[dimension]) + " END"


_REASONS = "array_to_string(list_filter([CASE WHEN text_length < 800 THEN 'short text' END, CASE WHEN method_hits >= 8 AND covered <= 1 THEN 'hits in one category' END, CASE WHEN innovation_hits = 0 AND method_hits <= 1 THEN 'few hits' END, CASE WHEN covered <= 1 AND subject <> 'general' THEN 'little coverage' END], lambda x: x IS NOT NULL), '; ')"
_DIMS = " UNION ALL ".join(f"SELECT doc_id, {x} AS score, {i} AS ord, '{x}' AS dimension, {_tip(x)} AS suggestion FROM scored" for i, x in enumerate(score.DIMENSIONS))


@query(f"WITH {s.PAPERS}, {s.SECTIONS}, {s.scored('teacher', 'cs')}, dims AS ({_DIMS}) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY score, ord))::INT AS rank, dimension, suggestion FROM dims WHERE suggestion IS NOT NULL UNION ALL SELECT doc_id, 0, 'confidence', {_REASONS} FROM scored WHERE conf_level = '低'")
def score_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return score.suggestions(score.score_all(papers(spark, d), "teacher", "cs"))


@query(
    f"WITH {s.PAPERS}, {s.SECTIONS}, "
    + ", ".join(s.scored(m, x, name=f"s_{m}_{x}") for m in fixed.PROFILES for x in lexicon.RUBRICS)
    + " "
    + " UNION ALL ".join(f"SELECT mode, subject, count(*) AS docs, sum(total)::BIGINT AS totals, sum(method)::BIGINT AS methods FROM s_{m}_{x} GROUP BY ALL" for m in fixed.PROFILES for x in lexicon.RUBRICS)
)
def score_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = score.matrix(papers(spark, d))
    return rows.groupBy("mode", "subject").agg(F.count(F.lit(1)).alias("docs"), F.sum("total").alias("totals"), F.sum("method").alias("methods"))


@query(P + " UNION ALL ".join(f"SELECT doc_id, '{x}' AS subject, {s.covered('lower(text)', r)} AS covered, {len(r)} AS categories FROM papers" for x, r in lexicon.RUBRICS.items()))
def rubric_coverage(spark: SparkSession, d: str) -> DataFrame:
    return score.rubric_coverage(papers(spark, d))


_KEYWORDS = "SELECT DISTINCT p_brand AS subject, split_part(p_type, ' ', 1) AS category, p_name AS word FROM part"


@query(f"""{P}, k AS (SELECT subject, category, lower(word) AS word FROM ({_KEYWORDS})), hits AS (SELECT doc_id, word FROM papers JOIN (SELECT DISTINCT word FROM k) w ON contains(lower(text), word))
 SELECT doc_id, subject, count(DISTINCT category)::INT AS covered, any_value(categories)::INT AS categories, count(DISTINCT word)::INT AS words FROM hits JOIN k USING (word) JOIN (SELECT subject, count(DISTINCT category) AS categories FROM k GROUP BY subject) USING (subject) GROUP BY doc_id, subject""")
def lexicon_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Papers against a lexicon of all part names, by brand and kind."""
    table(spark, d, "part").createOrReplaceTempView("part")
    return automaton.counted(papers(spark, d), spark.sql(_KEYWORDS))


# Roll-ups.

_ALL = f"WITH {s.PAPERS}, {s.HITS}, {s.tfidf()}, {s.SALIENCE}, {s.SECTIONS}, {s.scored('teacher', 'cs')}"


@query(f"""{_ALL}, dims AS ({_DIMS}), lo AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score, ord) AS k, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS h FROM dims),
 ends AS (SELECT doc_id, max(dimension) FILTER (h = 1) AS strongest, max(dimension) FILTER (k = 1) AS weakest, coalesce(string_agg(suggestion, '; ' ORDER BY k) FILTER (k <= 2 AND suggestion IS NOT NULL), '') AS suggestions FROM lo GROUP BY doc_id),
 kp AS (SELECT doc_id, count(*) AS keeps, round_even(round(avg(salience) * 100, 6), 0)::INT AS salience_pct FROM sal WHERE action = 'keep' GROUP BY doc_id)
 SELECT doc_id, total, CASE WHEN total >= 85 THEN '优秀' WHEN total >= 70 THEN '良好' WHEN total >= 55 THEN '中等' ELSE '待改进' END AS level, strongest, weakest, coalesce(keeps, 0) AS keeps, salience_pct, suggestions
 FROM scored JOIN ends USING (doc_id) LEFT JOIN kp USING (doc_id)""")
def overview(spark: SparkSession, d: str) -> DataFrame:
    docs = papers(spark, d)
    return rollup.overview(score.score_all(docs, "teacher", "cs"), salience.salience(docs))


@query("SELECT o_orderkey::VARCHAR AS id, epoch_us(o_orderdate) // 1000000 AS timestamp, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS time_str, CASE WHEN o_orderkey % 5 = 0 THEN '未知文件' ELSE o_orderpriority END AS filename, CASE WHEN o_orderkey % 3 = 0 THEN 'structured' ELSE o_orderstatus END AS analysis_mode, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_custkey END AS text_length, 0::BIGINT AS match_count, 0::BIGINT AS keep_count, round_even((o_orderkey % 97) / 97.0::DOUBLE, 3) AS salience_avg FROM orders")
def history_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr(
        "cast(o_orderkey as string) AS id", "unix_seconds(cast(o_orderdate as timestamp)) AS timestamp", "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS filename",
        "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS analysis_mode", "CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS text_length",
        "cast(null as long) AS match_count", "cast(null as long) AS keep_count", "(o_orderkey % 97) / 97.0D AS salience_avg",
    )
    return rollup.history_summary(rows)


@query(f"""{_ALL}, lines AS (SELECT doc_id, string_agg('- [' || round_even(round(salience * 100, 6), 0)::INT::VARCHAR || '%] ' || rule || ': ' || regexp_replace(hit, '\\s+\\z', ''), chr(10) ORDER BY salience DESC, ord, n) AS found FROM sal WHERE action = 'keep' GROUP BY doc_id)
 SELECT doc_id, '# Analysis report' || chr(10) || '- length: ' || text_length || chr(10) || chr(10) || '## Score ' || total || '/100' || chr(10) || '- structure: ' || structure || '/25' || chr(10) || '- innovation: ' || innovation || '/25' || chr(10) || '- data_support: ' || data_support || '/25' || chr(10) || '- method: ' || method || '/25'
 || coalesce(chr(10) || chr(10) || '## Core passages' || chr(10) || found, '') AS report FROM scored LEFT JOIN lines USING (doc_id)""")
def report_text(spark: SparkSession, d: str) -> DataFrame:
    docs = papers(spark, d)
    return rollup.report_text(score.score_all(docs, "teacher", "cs"), salience.salience(docs))


_FILES = "SELECT CAST(o_orderkey AS STRING) || '_' || o_orderpriority || CAST(o_custkey % 40 AS STRING) || '.pdf' AS safe_name, o_orderkey AS modified, o_custkey AS size FROM orders"


@query(f"WITH f AS (SELECT *, regexp_replace(safe_name, '^\\d+_', '') AS filename FROM ({_FILES})) SELECT filename, safe_name, size, modified FROM f QUALIFY row_number() OVER (PARTITION BY filename ORDER BY modified DESC, safe_name) = 1")
def latest_per_name(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "orders").createOrReplaceTempView("orders")
    rows = spark.sql(_FILES).withColumn("filename", clean.original_name(F.col("safe_name")))
    return rollup.latest_per(rows, "filename", "modified", "safe_name").select("filename", "safe_name", "size", "modified")


@query(f"""WITH files AS ({_FILES}), names AS (SELECT safe_name, 'Named ' || CAST(size % 10 AS STRING) AS original FROM files WHERE size % 2 = 0), analyses AS (SELECT '1-URGENT' || CAST(c_custkey % 40 AS STRING) || '.pdf' AS filename FROM customer),
 f AS (SELECT safe_name, size, modified, coalesce(original, regexp_replace(safe_name, '^\\d+_', '')) AS filename FROM files LEFT JOIN names USING (safe_name)), n AS (SELECT filename, count(*) AS c FROM analyses GROUP BY filename),
 l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY filename ORDER BY modified DESC, safe_name) = 1)
 SELECT filename, safe_name, size, modified, coalesce(c, 0) AS analyzed_count FROM l LEFT JOIN n USING (filename)""")
def doc_library(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "orders").createOrReplaceTempView("orders")
    files = spark.sql(_FILES)
    names = files.where("size % 2 = 0").selectExpr("safe_name", "'Named ' || CAST(size % 10 AS STRING) AS original")
    analyses = table(spark, d, "customer").selectExpr("'1-URGENT' || CAST(c_custkey % 40 AS STRING) || '.pdf' AS filename")
    return rollup.doc_library(files, names, analyses)


@query("WITH old AS (SELECT c_custkey * 2 AS k, min(c_custkey) AS v FROM customer GROUP BY 1), new AS (SELECT s_suppkey AS k, s_suppkey + 100000 AS v FROM supplier UNION ALL SELECT s_suppkey, s_suppkey + 200000 FROM supplier) SELECT k, v FROM old UNION ALL SELECT k, min(v) FROM new WHERE k NOT IN (SELECT k FROM old) GROUP BY k")
def upsert_ignore(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer").selectExpr("c_custkey * 2 AS k", "c_custkey AS v").groupBy("k").agg(F.min("v").alias("v"))
    suppliers = table(spark, d, "supplier")
    new = suppliers.selectExpr("s_suppkey AS k", "s_suppkey + 100000 AS v").unionByName(suppliers.selectExpr("s_suppkey AS k", "s_suppkey + 200000 AS v"))
    return rollup.insert_or_ignore(old, new, "k", ["v"])


_CUSTOMERS, _SUPPLIERS, _PARTS = "c_custkey AS k, c_custkey AS v", "s_suppkey * 2 AS k, s_suppkey + 100000 AS v", "p_partkey AS k, p_partkey + 200000 AS v"


@query(f"""WITH a AS (SELECT {_CUSTOMERS} FROM customer), s AS (SELECT {_SUPPLIERS} FROM supplier), b AS (SELECT * FROM a WHERE k NOT IN (SELECT k FROM s) UNION ALL SELECT * FROM s),
 c AS (SELECT * FROM b UNION ALL SELECT {_PARTS} FROM part WHERE p_partkey NOT IN (SELECT k FROM b))
 SELECT 2 AS version, k, v FROM b UNION ALL SELECT 4, k, v FROM c WHERE k % 5 <> 0 OR k NOT IN (SELECT p_partkey FROM part)""")
def versioned_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Inserts, replacements and deletions as commits of a table, read at two versions."""
    rows = lambda name, columns: table(spark, d, name).selectExpr(*columns.split(", "))
    first = rows("customer", _CUSTOMERS)
    made = Versions(spark, f"{Scratch(spark, 'versions').root}/table").create(first.schema, "k", 16)
    made.insert_or_ignore(first, ["v"])
    made.insert_or_replace(rows("supplier", _SUPPLIERS))
    made.insert_or_ignore(rows("part", _PARTS), ["v"])
    made.delete(rows("part", _PARTS).where("k % 5 = 0"))
    return made.read(2).select(F.lit(2).alias("version"), "k", "v").unionByName(made.read().select(F.lit(4).alias("version"), "k", "v"))


# Quotas and costs.

_EV = "ev AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS ts, CASE WHEN user_id % 3 <> 0 THEN 'v' || CAST(user_id AS STRING) END AS visitor, 'ip' || CAST(user_id % 20 AS STRING) AS ip FROM events)"
_USE = f"""{_EV}, use AS (SELECT event_id, unnest(list_filter(['global', 'ip:' || substring(sha256(ip), 1, 16), 'vid:' || visitor], lambda x: x IS NOT NULL)) AS key, ts FROM ev)"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _event_keys(table(spark, d, "events"))


def _event_keys(events: DataFrame) -> DataFrame:
    rows = events.withColumn("ts", quota.epoch(F.col("ts")))
    return rows.selectExpr("event_id", "user_id", "ts", "CASE WHEN user_id % 3 <> 0 THEN 'v' || CAST(user_id AS STRING) END AS visitor", "'ip' || CAST(user_id % 20 AS STRING) AS ip")


def _last(spark: SparkSession, d: str) -> Column:
    """The time of the last event, as a scalar subquery of the plan."""
    return _events(spark, d).agg(F.max("ts")).scalar()


@query(f"WITH {_USE} SELECT * FROM use")
def usage_explode(spark: SparkSession, d: str) -> DataFrame:
    return quota.usage_rows(_events(spark, d))


@query(f"WITH {_USE} SELECT event_id, key, ts, count(*) OVER (PARTITION BY key ORDER BY ts RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS used FROM use")
def rolling_usage(spark: SparkSession, d: str) -> DataFrame:
    return quota.rolling_count(quota.usage_rows(_events(spark, d)), fixed.DAY)


@query(f"WITH {_USE} SELECT event_id, key, ts, count(*) OVER (PARTITION BY key ORDER BY ts RANGE BETWEEN 17999 PRECEDING AND CURRENT ROW) AS used FROM use")
def rolling_usage_5h(spark: SparkSession, d: str) -> DataFrame:
    return quota.rolling_count(quota.usage_rows(_events(spark, d)), fixed.PREMIUM_WINDOW, inclusive=False)


@query(f"WITH {_EV} SELECT event_id, ip AS key, ts, count(*) OVER (PARTITION BY ip ORDER BY ts RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) <= 5 AS allowed FROM ev")
def waitlist_limit(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("event_id", F.col("ip").alias("key"), "ts")
    return quota.rolling_count(rows, 3600, inclusive=False).select("event_id", "key", "ts", (F.col("used") <= 5).alias("allowed"))


@query(f"""WITH {_USE}, b AS (SELECT event_id, key, count(*) OVER (PARTITION BY key ORDER BY ts RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY key, ts) AS n FROM use),
 w AS (SELECT event_id, coalesce(max(n) FILTER (key = 'global'), 0) AS g, coalesce(max(n) FILTER (key LIKE 'vid:%'), 0) AS v, coalesce(max(n) FILTER (key LIKE 'ip:%'), 0) AS i FROM b GROUP BY event_id),
 r AS (SELECT *, CASE WHEN g >= 2000 THEN 'global' WHEN v >= 5 THEN 'visitor' WHEN i >= 20 THEN 'ip' ELSE 'ok' END AS reason FROM w)
 SELECT event_id, reason, CASE WHEN reason = 'ok' THEN greatest(0, 5 - v) ELSE 0 END::BIGINT AS remaining FROM r""")
def quota_check(spark: SparkSession, d: str) -> DataFrame:
    return quota.quota_check(_events(spark, d))


@query(
    f"""WITH RECURSIVE {_EV}, line AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS n FROM ev),
 walk(n, uses, event_id, ts, reason) AS (SELECT 0::BIGINT, []::STRUCT(t BIGINT, v VARCHAR, i VARCHAR)[], NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR
 UNION ALL SELECT n, CASE WHEN reason = 'ok' THEN list_append(live, {{'t': ts, 'v': visitor, 'i': ip}}) ELSE live END, event_id, ts, reason
 FROM (SELECT *, CASE WHEN len(live) >= {fixed.GLOBAL_CAP} THEN 'global' WHEN visitor IS NOT NULL AND len(list_filter(live, lambda u: u.v = visitor)) >= {fixed.VISITOR_CAP} THEN 'visitor' WHEN len(list_filter(live, lambda u: u.i = ip)) >= {fixed.IP_CAP} THEN 'ip' ELSE 'ok' END AS reason
 FROM (SELECT l.n, l.event_id, l.ts, l.visitor, l.ip, list_filter(w.uses, lambda u: u.t >= l.ts - {fixed.DAY}) AS live FROM walk w JOIN line l ON l.n = w.n + 1)))
 SELECT event_id, ts, reason FROM walk WHERE n > 0"""
)
def quota_admissions(spark: SparkSession, d: str) -> DataFrame:
    return streams.admissions_in_turn(_events(spark, d))


_KEY_ADMISSIONS = f"""WITH RECURSIVE {_USE}, line AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS n FROM use),
 walk(key, n, stamps, event_id, ts, admitted) AS (SELECT DISTINCT key, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::BOOLEAN FROM line
 UNION ALL SELECT key, n, CASE WHEN len(live) < {fixed.VISITOR_CAP} THEN list_append(live, ts) ELSE live END, event_id, ts, len(live) < {fixed.VISITOR_CAP}
 FROM (SELECT l.*, list_filter(w.stamps, lambda u: u >= l.ts - {fixed.DAY}) AS live FROM walk w JOIN line l ON l.key = w.key AND l.n = w.n + 1))
 SELECT event_id, key, ts, admitted FROM walk WHERE n > 0"""


@query(_KEY_ADMISSIONS)
def key_admissions(spark: SparkSession, d: str) -> DataFrame:
    return streams.admissions(quota.usage_rows(_events(spark, d)))


@query(f"SELECT * FROM ({_KEY_ADMISSIONS}) WHERE ts <= (SELECT max(epoch_us(ts) // 1000000) FROM events) - 3600")
def stream_admissions(spark: SparkSession, d: str) -> DataFrame:
    """The same decisions by a stream of the event files, as far as its watermark, an hour behind the last event, has come."""
    scratch = Scratch(spark, "stream-admissions")
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    conf = dict([states.STORE, states.UNCOUNTED, ("spark.sql.shuffle.partitions", str(parts))])  # each partition has a state store, to be opened and committed in each round
    before = {k: spark.conf.get(k, None) for k in conf}
    events = _event_keys(spark.readStream.schema(streams.EVENTS).parquet(f"{d}/events.parquet*"))
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        run = streams.admissions(quota.usage_rows(events)).writeStream.option("checkpointLocation", f"{scratch.root}/at").outputMode("append").trigger(availableNow=True).start(f"{scratch.root}/out")
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(states.OUTPUT).parquet(f"{scratch.root}/out")


@query(f"WITH {_USE} SELECT key, count(*) AS kept FROM use WHERE ts >= (SELECT max(ts) FROM ev) - 86400 GROUP BY key")
def usage_retention(spark: SparkSession, d: str) -> DataFrame:
    return quota.retained(quota.usage_rows(_events(spark, d)), _last(spark, d)).groupBy("key").agg(F.count(F.lit(1)).alias("kept"))


@query(f"""WITH {_USE}, m AS (SELECT max(ts) AS now FROM ev), g AS (SELECT key, now, count(*) AS used, min(ts) AS lo, max(ts) AS hi FROM use, m WHERE now - ts < 18000 GROUP BY ALL)
 SELECT key, used, greatest(0, 5 - used)::BIGINT AS remaining, used < 5 AS can_use, CASE WHEN used >= 5 THEN lo + 18000 END AS locked_until, lo + 18000 AS next_recover, hi + 18000 AS full_reset FROM g""")
def v4pro_status(spark: SparkSession, d: str) -> DataFrame:
    return quota.window_status(quota.usage_rows(_events(spark, d)), _last(spark, d))


_ENGINE = "CASE WHEN event_id % 3 = 0 THEN 'v4pro' WHEN event_id % 3 = 1 THEN 'flash' ELSE 'other' END"
_COST_SQL = f"SELECT event_id, ts, user_id, engine, tin, tout, round((tin / 1e6 * CASE WHEN engine = 'v4pro' THEN 1.74::DOUBLE ELSE 0.14::DOUBLE END + tout / 1e6 * CASE WHEN engine = 'v4pro' THEN 3.48::DOUBLE ELSE 0.28::DOUBLE END) * 7.1::DOUBLE, 6) AS est_cost_cny FROM (SELECT event_id, user_id, ts, {_ENGINE} AS engine, event_id % 5000 AS tin, event_id % 700 AS tout FROM ev)"


def _costs(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).selectExpr("event_id", "ts", f"{_ENGINE} AS engine", "event_id % 5000 AS prompt_tokens", "event_id % 700 AS completion_tokens")
    return rows.withColumn("est_cost_cny", quota.cost(F.col("engine"), F.col("prompt_tokens"), F.col("completion_tokens")))


@query(f"WITH {_EV}, c AS ({_COST_SQL}) SELECT event_id, engine, est_cost_cny FROM c")
def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    return _costs(spark, d).select("event_id", "engine", "est_cost_cny")


@query(f"""WITH {_USE}, c AS ({_COST_SQL}), m AS (SELECT max(ts) - 86400 AS since FROM ev),
 t AS (SELECT coalesce(sum(tin), 0)::BIGINT AS prompt_tokens, coalesce(sum(tout), 0)::BIGINT AS completion_tokens, round(coalesce(sum(est_cost_cny), 0), 4) AS est_cost_cny, count(*) AS cost_calls FROM c, m WHERE ts >= since)
 SELECT (SELECT count(*) FROM use, m WHERE key = 'global' AND ts >= since) AS analyses, (SELECT count(DISTINCT key) FROM use, m WHERE key LIKE 'vid:%' AND ts >= since) AS unique_visitors, prompt_tokens, completion_tokens, est_cost_cny, cost_calls,
 CASE WHEN cost_calls > 0 THEN round(est_cost_cny / cost_calls, 4) ELSE 0.0 END AS avg_cost_cny, (SELECT count(*) FROM ev, m WHERE event_id % 50 = 0 AND ts >= since) AS waitlist_new, (SELECT count(*) FROM ev WHERE event_id % 50 = 0) AS waitlist_total FROM t""")
def usage_stats(spark: SparkSession, d: str) -> DataFrame:
    waiting = _events(spark, d).where("event_id % 50 = 0").select(F.col("ts").alias("created_at"))
    return quota.usage_stats(quota.usage_rows(_events(spark, d)), _costs(spark, d), waiting, _last(spark, d))


@query("SELECT c_custkey, substring(sha256(c_name), 1, 16) AS h, regexp_matches(md5(c_name), '^[0-9a-f]{32}$') AS valid FROM customer")
def hash_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", quota.short_hash(F.col("c_name")).alias("h"), quota.visitor_valid(F.md5("c_name")).alias("valid"))


_MAIL = "CASE WHEN c_custkey % 3 = 0 THEN ' ' || c_name || '@mail.example ' WHEN c_custkey % 3 = 1 THEN c_name || '@nowhere' ELSE 'User' || CAST(c_custkey AS STRING) || '@a.example' END"


@query(rf"SELECT c_custkey, lower(trim(e)) AS email, regexp_matches(lower(trim(e)), '^[^@\s]+@[^@\s]+\.[^@\s]+$') AND length(lower(trim(e))) <= 200 AS valid FROM (SELECT c_custkey, {_MAIL} AS e FROM customer)")
def email_valid(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").selectExpr("c_custkey", f"{_MAIL} AS e")
    return rows.select("c_custkey", F.lower(F.trim("e")).alias("email"), quota.email_valid(F.col("e")).alias("valid"))


# Text functions.

_COLLOQUIAL = "'系统' || p_name || CASE WHEN p_partkey % 2 = 0 THEN '很快，所以用它。' ELSE '我们觉得很稳定。' END || CASE WHEN p_partkey % 3 = 0 THEN '然后看结果。' ELSE '' END"


def _nested(text: str) -> str:
    for weak, strong in fixed.POLISH.items():
        text = f"replace({text}, {s.q(weak)}, {s.q(strong[0])})"
    return text


@query(f"SELECT p_partkey, {_nested(_COLLOQUIAL)} AS polished FROM part")
def polish(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_partkey", f"{_COLLOQUIAL} AS text").select("p_partkey", text_ai.polish(F.col("text")).alias("polished"))


@query(f"SELECT p_partkey, array_to_string(list_filter({s.words(list(fixed.POLISH))}, lambda w: contains({_COLLOQUIAL}, w)), ',') AS words FROM part")
def weak_words(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey", f"{_COLLOQUIAL} AS text")
    return rows.select("p_partkey", F.array_join(text_ai.weak_words(F.col("text")), ",").alias("words"))


_HINTS = ", ".join(f"CASE WHEN contains(x, {s.q(w)}) THEN {s.q('- ' + w + ' -> ' + '、'.join(b))} END" for w, b in fixed.POLISH.items())


@query(f"SELECT p_partkey, 'Rewrite the text below in an academic style; keep its logic and avoid subjective wording.' || chr(10) || coalesce(array_to_string(list_filter([{_HINTS}], lambda h: h IS NOT NULL), chr(10)) || chr(10), '') || chr(10) || x AS prompt FROM (SELECT p_partkey, {_COLLOQUIAL} AS x FROM part)")
def academic_prompt(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey", f"{_COLLOQUIAL} AS text")
    return rows.select("p_partkey", text_ai.academic_prompt(F.col("text")).alias("prompt"))


@query("SELECT conv_id, count(*) AS turns, string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS messages FROM conversations GROUP BY conv_id")
def assemble_messages(spark: SparkSession, d: str) -> DataFrame:
    return text_ai.assemble_messages(table(spark, d, "conversations"))


_ZH = "SELECT doc_id, replace(text, '. ', '。') AS text FROM documents"


@query(f"""WITH docs AS ({_ZH}), parts AS (SELECT doc_id, text, string_split(regexp_replace(text, '([。！？])\\s*', '\\1' || chr(1), 'g'), chr(1)) AS l FROM docs),
 sents AS (SELECT doc_id, k.pos, l[k.pos + 1] AS s FROM parts, LATERAL (SELECT unnest(range(len(l))) AS pos) k WHERE len(l) > 3),
 w AS (SELECT doc_id, pos, unnest(list_filter({s.TOKENS('s')}, lambda t: length(t) > 1)) AS w FROM sents), freq AS (SELECT doc_id, w, count(*) AS f FROM w GROUP BY ALL),
 sc AS (SELECT doc_id, pos, sum(f) AS score FROM w JOIN freq USING (doc_id, w) GROUP BY ALL),
 r AS (SELECT doc_id, pos, s FROM sents LEFT JOIN sc USING (doc_id, pos) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(score, 0) DESC, pos) <= 3),
 a AS (SELECT doc_id, string_agg(s, '' ORDER BY pos) AS summary FROM r GROUP BY doc_id) SELECT doc_id, coalesce(summary, text) AS summary FROM docs LEFT JOIN a USING (doc_id)""")
def summarize(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).withColumn("text", F.replace("text", F.lit(". "), F.lit("。")))
    return text_ai.summarize(docs)


@query(f"WITH {s.tfidf('documents', 5)} SELECT doc_id, string_agg(term, ', ' ORDER BY rank) AS keywords FROM weights GROUP BY doc_id")
def keywords_topk(spark: SparkSession, d: str) -> DataFrame:
    return text_ai.keywords_topk(documents(spark, d))


_THOUGHT = "CASE WHEN conv_id % 2 = 0 THEN '<think>' || role || '</think> ' || text ELSE text END"


@query(f"SELECT conv_id, turn, {s.strip(f"regexp_replace(CASE WHEN contains(x, '</think>') THEN list_last(string_split(x, '</think>')) ELSE x END, '<think>.*?</think>', '', 'gs')")} AS answer FROM (SELECT conv_id, turn, {_THOUGHT} AS x FROM conversations)")
def strip_think(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{_THOUGHT} AS x")
    return rows.select("conv_id", "turn", text_ai.strip_think(F.col("x")).alias("answer"))


_ANSWER = """CASE WHEN p_partkey % 3 = 0 THEN '```json' || chr(10) || '{"研究问题": "' || p_name || '", "结论": "' || p_brand || '"}' || chr(10) || '```' WHEN p_partkey % 3 = 1 THEN 'So: {"潜在风险或局限": "' || p_name || '"} done' ELSE p_name END"""


@query("""SELECT p_partkey, unnest(CASE WHEN p_partkey % 3 = 0 THEN ['research_question', 'conclusion'] WHEN p_partkey % 3 = 1 THEN ['potential_risks'] ELSE ['raw'] END) AS key,
 unnest(CASE WHEN p_partkey % 3 = 0 THEN [p_name, p_brand] ELSE [p_name] END) AS value FROM part""")
def llm_json_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey", f"{_ANSWER} AS raw")
    return rows.select("p_partkey", F.inline(text_ai.parse_answer(F.col("raw"))))


_ANCHOR_IDS = (0, 1, 2)


@query(f"""WITH a AS (SELECT embedding AS v FROM embeddings WHERE vec_id IN {_ANCHOR_IDS}), c AS (SELECT e.label, e.vec_id, max(list_cosine_similarity(e.embedding::DOUBLE[], a.v::DOUBLE[])) AS sim FROM embeddings e, a WHERE e.vec_id % 4 <> 0 GROUP BY ALL)
 SELECT label, round(max(sim), 6) AS best, least(4, count(*) FILTER (sim >= 0.2::DOUBLE))::BIGINT AS hits FROM c GROUP BY label""")
def semantic_hits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    anchors = [r[0] for r in rows.where(F.col("vec_id").isin(*_ANCHOR_IDS)).select("embedding").collect()]  # three rows
    return semantic.semantic_hits(rows.selectExpr("label", "embedding", "vec_id % 4 = 0 AS literal"), anchors, 0.2, by="label")


@query("""WITH a AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 5 = 0), c AS (SELECT e.label, e.vec_id, max(list_cosine_similarity(e.embedding::DOUBLE[], a.v)) AS sim FROM embeddings e, a WHERE e.vec_id % 5 <> 0 AND e.vec_id % 4 <> 0 GROUP BY ALL)
 SELECT label, round(max(sim), 6) AS best, least(4, count(*) FILTER (sim >= 0.3::DOUBLE))::BIGINT AS hits FROM c GROUP BY label""")
def anchored_hits(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth vector as an anchor of all others."""
    rows = table(spark, d, "embeddings")
    sentences = rows.where("vec_id % 5 <> 0").selectExpr("label", "embedding", "vec_id % 4 = 0 AS literal")
    return semantic.anchored_hits(sentences, rows.where("vec_id % 5 = 0"), 0.3, by="label")


@query(f"""SELECT doc_id, len(l)::INT AS n, md5(array_to_string(l, chr(10))) AS h FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([。！？；!?;.])\\s*', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda x: {s.strip('x')}), lambda x: length(x) >= 8)[:150] AS l FROM documents)""")
def anchor_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d).select("doc_id", semantic.anchor_sentences(F.col("text")).alias("l"))
    return rows.select("doc_id", F.size("l").alias("n"), F.md5(F.array_join("l", "\n")).alias("h"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || '；' || p_brand WHEN 1 THEN 'a：' || p_name || '；b：' || p_size ELSE p_name END AS value FROM part")
def flat_values(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey", """CASE p_partkey % 3 WHEN 0 THEN '["' || p_name || '", "' || p_brand || '"]' WHEN 1 THEN '{"a": "' || p_name || '", "b": ' || p_size || '}' ELSE p_name END AS v""")
    return rows.select("p_partkey", text_ai.flat_value(F.col("v")).alias("value"))


@query("""SELECT p_partkey, unnest(CASE WHEN p_partkey % 3 = 2 THEN ['conclusion'] ELSE ['conclusion', 'score'] END) AS key, unnest(CASE p_partkey % 3 WHEN 0 THEN [p_name, p_size || '.5%'] WHEN 1 THEN [p_name, p_size::VARCHAR] ELSE [p_name || ' \\alpha'] END) AS value FROM part""")
def json_repair(spark: SparkSession, d: str) -> DataFrame:
    broken = """CASE p_partkey % 3 WHEN 0 THEN 'Well: {"结论": "' || p_name || '", "score": ' || p_size || '.5%}' WHEN 1 THEN '{"结论": "' || p_name || '", "score": ' || p_size || ',' ELSE concat('{"结论": "', p_name, ' ', chr(92), 'alpha",}') END AS raw"""
    rows = table(spark, d, "part").selectExpr("p_partkey", broken)
    return rows.select("p_partkey", F.inline(text_ai.parse_answer(F.col("raw"))))


@query("SELECT p_partkey, role, content FROM (SELECT p_partkey, unnest(['system', 'user']) AS role, unnest(['You answer.', 'Name it.' || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE chr(10) || chr(10) || p_name END]) AS content FROM part)")
def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey", "' Name it. ' AS task", "CASE WHEN p_partkey % 4 = 0 THEN '  ' ELSE p_name END AS text")
    return rows.select("p_partkey", F.inline(text_ai.chat_messages(F.col("task"), F.col("text"), "You answer.")))


@query("WITH t AS (SELECT p_partkey, range(p_size) AS p, [p_size, 7, 2] AS a FROM part) SELECT p_partkey, array_to_string(list_concat(p, a)[:40], ' ') AS input_ids, array_to_string(list_concat(list_transform(p, lambda x: -100), a)[:40], ' ') AS labels FROM t")
def masked_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey", "transform(sequence(1, p_size), x -> CAST(x - 1 AS INT)) AS p", "array(CAST(p_size AS INT), 7) AS a")
    rows = rows.select("p_partkey", text_ai.masked_labels(F.col("p"), F.col("a"), end_id=2, most=40).alias("m"))
    return rows.select("p_partkey", *[F.array_join(F.col(f"m.{n}").cast("array<string>"), " ").alias(n) for n in ("input_ids", "labels")])


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'cloud' WHEN p_size % 3 = 0 THEN 'local' ELSE 'simple' END AS engine FROM part")
def engine_choice(spark: SparkSession, d: str) -> DataFrame:
    flags = {"local": F.col("p_size") % 3 == 0, "cloud": F.col("p_size") % 2 == 0}
    return table(spark, d, "part").select("p_partkey", text_ai.first_engine(flags, ["cloud", "local"]).alias("engine"))


_SHOWN = [("R", "en", "returned"), ("A", "en", "accepted"), ("A", "ja", "受理"), ("O", "ja", "未処理")]


@query(f"SELECT l_returnflag AS label, coalesce(w.t, l_returnflag) AS shown, count(*) AS n FROM lineitem LEFT JOIN (VALUES {', '.join(f'({s.q(a)}, {s.q(t)})' for a, g, t in _SHOWN if g == 'en')}) w(a, t) ON a = l_returnflag GROUP BY ALL")
def ui_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return rollup.translated(labels, spark.createDataFrame(_SHOWN, "label string, lang string, text string"), "en")


@query(f"{_SAL} SELECT doc_id, count(*) AS match_count, count(*) FILTER (action = 'keep') AS keep_count, round_even(round(avg(salience), 9), 3) AS salience_avg FROM sal GROUP BY doc_id")
def record_stats(spark: SparkSession, d: str) -> DataFrame:
    return rollup.record_stats(salience.salience(papers(spark, d)))


@query("SELECT p_partkey, (1700000000 + p_partkey)::VARCHAR || '_' || replace(p_name, ' ', '_') || '.pdf' AS stored FROM part")
def upload_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", rollup.upload_name(F.col("p_partkey") + 1700000000, F.concat("p_name", F.lit(".PDF"))).alias("stored"))


@query(f"SELECT * FROM ({_FILES}) WHERE safe_name NOT IN (SELECT CAST(o_orderkey AS STRING) || '_' || o_orderpriority || CAST(o_custkey % 40 AS STRING) || '.pdf' FROM orders WHERE o_custkey % 2 = 0)")
def excluded_files(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "orders").createOrReplaceTempView("orders")
    files = spark.sql(_FILES)
    return dataset.without_names(files, files.where("size % 2 = 0"), "safe_name")


# Training rows and metrics.

_LABEL = "CASE " + " ".join(f"WHEN rule = '{r}' THEN {s.q(x)}" for r, x in fixed.SECTION_OF.items()) + " END"
_CORE = f"CASE WHEN rule IN {tuple(fixed.POSITIVE)} THEN '是' WHEN rule IN {tuple(fixed.NEGATIVE)} THEN '否' END"
_WEAK = f"""{s.PAPERS}, {_SAID}, once AS (SELECT doc_id, s, min(pos) AS pos FROM said WHERE {s.sentence_like(True)} GROUP BY ALL),
 ruled AS (SELECT *, {_first_rule_sql('s', 'name')} AS rule, {_first_rule_sql('s', 'action')} AS action FROM once), kept AS (SELECT * FROM ruled WHERE rule IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 60),
 weak AS (SELECT 'section' AS instruction, s AS input, {_LABEL} AS output, doc_id::VARCHAR AS _paper FROM kept WHERE action = 'keep' UNION ALL SELECT 'is_core', s, {_CORE}, doc_id::VARCHAR FROM kept WHERE action = 'keep'),
 rows_ AS (SELECT * FROM weak WHERE output IS NOT NULL), uniq AS (SELECT instruction, input, output, min(_paper) AS _paper FROM rows_ GROUP BY ALL)"""


def _weak(spark: SparkSession, d: str) -> DataFrame:
    return dataset.weak_labels(papers(spark, d))


@query(f"WITH {_WEAK} SELECT * FROM rows_")
def weak_labels(spark: SparkSession, d: str) -> DataFrame:
    return _weak(spark, d)


@query(f"WITH {_WEAK} SELECT * FROM uniq")
def dedup_rows(spark: SparkSession, d: str) -> DataFrame:
    return dataset.dedup_rows(_weak(spark, d))


@query(f"WITH {_WEAK} SELECT * FROM uniq QUALIFY row_number() OVER (PARTITION BY instruction, output ORDER BY md5(instruction || chr(1) || input || chr(1) || output), input) <= 90")
def cap_per_class(spark: SparkSession, d: str) -> DataFrame:
    return dataset.cap_per_class(dataset.dedup_rows(_weak(spark, d)))


@query(f"""WITH {_WEAK}, n AS (SELECT _paper, count(*) AS n FROM uniq GROUP BY _paper), o AS (SELECT _paper, coalesce(sum(n) OVER (ORDER BY md5(_paper), _paper ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
 SELECT uniq.*, CASE WHEN before < (SELECT floor(count(*) * 0.1::DOUBLE) FROM uniq) THEN 'val' ELSE 'train' END AS split FROM uniq JOIN o USING (_paper)""")
def train_val_split(spark: SparkSession, d: str) -> DataFrame:
    return dataset.split_by_paper(dataset.dedup_rows(_weak(spark, d)))


@query(f"WITH {_WEAK} SELECT uniq.*, CASE WHEN ('0x' || substring(md5(instruction || chr(1) || input || chr(1) || output), 1, 8))::BIGINT < {int(0.1 * 16**8)} THEN 'val' ELSE 'train' END AS split FROM uniq")
def row_split(spark: SparkSession, d: str) -> DataFrame:
    return dataset.split_rows(dataset.dedup_rows(_weak(spark, d)))


@query(f"WITH {_WEAK} SELECT instruction, output, count(*) AS n FROM rows_ GROUP BY ALL")
def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    return dataset.label_distribution(_weak(spark, d))


_SAYS = "CASE WHEN p_partkey % 3 = 0 THEN 'We propose ' || p_name || '.' ELSE 'The dataset holds ' || p_name || '.' END"


@query(f"""WITH g AS (SELECT paper, list(DISTINCT s) FILTER (k = 0) AS core, list(DISTINCT s) AS candidates FROM (SELECT CAST(p_partkey // 8 AS STRING) AS paper, p_partkey % 3 AS k, {_SAYS} AS s FROM part) GROUP BY paper),
 c AS (SELECT DISTINCT paper, unnest(core) AS s FROM g), o AS (SELECT DISTINCT paper, unnest(candidates) AS s FROM g)
 SELECT 'is_core' AS instruction, s AS input, '是' AS output, paper AS _paper FROM c UNION ALL SELECT 'is_core', s, '否', paper FROM o WHERE (paper, s) NOT IN (SELECT paper, s FROM c)
 UNION ALL SELECT 'pick_core', array_to_string(list_sort(candidates), chr(10)), list_sort(core)[1], paper FROM g WHERE len(candidates) BETWEEN 2 AND 12 AND len(core) > 0""")
def gold_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("CAST(p_partkey div 8 AS STRING) AS paper", "p_partkey % 3 AS k", f"{_SAYS} AS s")
    gold = rows.groupBy("paper").agg(F.array_sort(F.collect_set(F.when(F.col("k") == 0, F.col("s")))).alias("core"), F.array_sort(F.collect_set("s")).alias("candidates"))  # a paper's own sentences
    return dataset.gold_labels(gold)


_OUTPUT = "CASE WHEN p_partkey % 5 = 0 THEN '不是' WHEN p_partkey % 5 = 1 THEN '是的，核心' WHEN p_partkey % 5 = 2 THEN '该句属于方法部分，不是实验' WHEN p_partkey % 5 = 3 THEN 'Yes' ELSE p_name END"
_GOLD = "CASE WHEN p_partkey % 5 IN (0, 1, 3) THEN CASE WHEN p_size % 2 = 0 THEN '是' ELSE '否' END WHEN p_partkey % 5 = 2 THEN '方法' ELSE p_name END"


def _answers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey", "p_type", f"{_OUTPUT} AS output", f"{_GOLD} AS gold")
    return rows.withColumn("pred", dataset.parse_label(F.col("output"), F.col("gold")))


_PRED = f"pred AS (SELECT p_partkey, p_type, {_GOLD} AS gold, CASE p_partkey % 5 WHEN 0 THEN '否' WHEN 1 THEN '是' WHEN 2 THEN '方法' WHEN 3 THEN '是' ELSE p_name END AS pred FROM part)"


@query(f"WITH {_PRED} SELECT p_partkey, gold, pred FROM pred")
def parse_labels(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("p_partkey", "gold", "pred")


@query(f"""WITH {_PRED}, c AS (SELECT p_type, count(*) AS n, sum((pred = gold)::INT) AS ok, sum((pred = '是' AND gold = '是')::INT) AS tp, sum((pred = '是' AND gold <> '是')::INT) AS fp, sum((pred <> '是' AND gold = '是')::INT) AS fn FROM pred GROUP BY p_type),
 r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM c)
 SELECT p_type, n, round(ok / n, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM r""")
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return dataset.metrics(_answers(spark, d), ["p_type"])
