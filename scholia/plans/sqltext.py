"""Pieces of DuckDB SQL, made from the same tables as the Spark operators."""

from __future__ import annotations

from ..functions import fixed, lexicon
from ..functions.rule_table import NOTES, RULES
from ..operators import clean, sections, segment
from ..sources.papers import HAN, HAN_TOKENS, PAPER_TEXT

PAPERS = f"papers AS (SELECT p_partkey AS doc_id, {PAPER_TEXT} AS text FROM part)"


def q(text: str) -> str:
    """An SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+\z', '', 'g')"


def words(items: list[str]) -> str:
    return "[" + ", ".join(q(w) for w in items) + "]"


def contained(low: str, items: list[str]) -> str:
    return f"len(list_filter({words(lexicon.distinct(items))}, lambda w: contains({low}, w)))::INT"


def covered(low: str, rubric: dict[str, list[str]]) -> str:
    return "(" + " + ".join(f"(CASE WHEN {contained(low, w)} > 0 THEN 1 ELSE 0 END)" for w in rubric.values()) + ")::INT"


HITS = "hits AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {i} AS ord, {q(r.name)} AS rule, {q(r.action)} AS action, {r.prior}::DOUBLE AS prior, {q(NOTES[r.name])} AS note, regexp_extract_all(text, {q(r.pattern)}, 0, 'i') AS found FROM papers"
    for i, r in enumerate(RULES)
) + "), each_hit AS (SELECT doc_id, ord, rule, action, prior, note, k.n::INT AS n, found[k.n + 1] AS hit FROM hits, LATERAL (SELECT unnest(range(len(found))) AS n) k)"

_LETTERS = r"[^\x{4e00}-\x{9fff}A-Za-z]"
_SENTENCE = strip("s")


def sentence_like(terminal: bool) -> str:
    n = f"length({_SENTENCE})"
    count = lambda c: f"({n} - length(replace({_SENTENCE}, {q(c)}, '')))"
    out = f"{n} BETWEEN 14 AND 240 AND length(regexp_replace({_SENTENCE}, '{_LETTERS}', '', 'g')) >= greatest(8.0, {n} * 0.4::DOUBLE)"
    out += f" AND {count('|')} < 3 AND {count(chr(9))} < 2 AND NOT regexp_matches({_SENTENCE}, {q(clean.JUNK)}, 'i')"
    return f"({out}" + (rf""" AND regexp_matches({_SENTENCE}, {q('[。！？.!?]["' + "'" + r'）)\]]?\z')}))""" if terminal else ")")


def sentences(text: str) -> str:
    """A list of normalised sentences; RE2 has no lookbehind, so ends are marked before the split."""
    out = rf"regexp_replace(regexp_replace({text}, '([A-Za-z])-\s*\n\s*([a-z])', '\1\2', 'g'), '\s*\n\s*', ' ', 'g')"
    out = rf"regexp_replace(regexp_replace({out}, '([。！？；])\s*', '\1' || chr(1), 'g'), '([.!?;])\s+', '\1' || chr(1), 'g')"
    norm = rf"regexp_replace({strip('x')}, '\s+', ' ', 'g')"
    return f"list_filter(list_transform(string_split({out}, chr(1)), lambda x: {norm}), lambda x: x <> '')"


def section(name: str) -> str:
    if name == "keywords":
        return f"nullif({strip(f'regexp_extract(text, {q(sections.KEYWORDS)}, 1, {q("i")})')}, '')"
    bodies = ", ".join(f"nullif(regexp_extract(text, {q(sections.heading(*h))}, 1, 'im'), '')" for h in sections.HEADINGS[name])
    stops = rf"\n[ \t]*(?:{sections.STOPS[name]}).*"
    cut = f"regexp_replace({strip(f'coalesce({bodies})')}, {q(stops)}, '', 's')"
    return f"nullif(substring({strip(cut)}, 1, {sections.LIMITS[name]}), '')"


SECTIONS = f"sec AS (SELECT doc_id, text, {', '.join(f'{section(n)} AS {n}' for n in sections.NAMES)} FROM papers)"


def numbers(text: str, strict: bool) -> str:
    return f"list_distinct(regexp_extract_all({text}, {q(fixed.NUMBER_STRICT if strict else fixed.NUMBER)}))"


def scored(mode: str, subject: str, teacher_cap: int = 85, name: str = "scored") -> str:
    """CTEs that end in ``scored``, as score_all gives it."""
    p, rubric = fixed.PROFILES[mode], lexicon.RUBRICS[subject]
    low = "lower(text)"
    depth_words = [*lexicon.METHOD[mode], *[w for ws in rubric.values() for w in ws]]
    graded = " + ".join(f"least({p[k]}.0::DOUBLE, {p[k]}.0::DOUBLE * n_{k} / {full})" for k, full in (("expr", 6), ("conc", 3), ("cross", 2)))
    sat = lambda n, rate: f"(CASE WHEN {n} > 0 THEN 1 - pow({1.0 - rate!r}::DOUBLE, {n}) ELSE 0.0 END)"
    cap = max(70, min(100, teacher_cap)) if mode == "teacher" else p["cap"]
    structure = " + ".join(f"(CASE WHEN {n} IS NOT NULL THEN {v} ELSE 0 END)" for n, v in fixed.STRUCTURE_POINTS.items())
    missing = " + ".join(f"({n} IS NULL)::INT" for n in fixed.STRUCTURE_POINTS)
    return f"""{name}_a AS (SELECT doc_id, length(text)::INT AS text_length, ({structure})::INT AS structure, ({missing})::INT AS missing, keywords IS NULL AS no_keywords,
 {contained(f"lower(coalesce(abstract, '')) || ' ' || {low}", lexicon.INNOVATION[mode])} AS innovation_hits,
 {numbers("coalesce(conclusion, text)", p["strict"])} AS c, {numbers("text", p["strict"])} AS e,
 {covered(low, rubric)} AS covered, {contained(low, depth_words)} AS method_hits FROM sec),
 {name}_b AS (SELECT *, len(c)::INT AS n_conc, len(e)::INT AS n_expr, len(list_intersect(c, e))::INT AS n_cross, {len(rubric)} AS categories FROM {name}_a),
 {name}_c AS (SELECT *, round_even(round(25 * {sat("innovation_hits", p["rate"])}, 9), 0)::INT AS innovation,
 least(25, round_even(round({graded}, 9), 0)::INT)::INT AS data_support,
 round_even(round(25 * (0.6::DOUBLE * covered / {len(rubric)} + 0.4::DOUBLE * {sat("method_hits", p["depth"])}), 9), 0)::INT AS method FROM {name}_b),
 {name}_d AS (SELECT *, least({cap}, structure + innovation + data_support + method)::INT AS total, {cap} AS cap,
 round_even(round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - (CASE WHEN text_length < 800 THEN 0.35::DOUBLE ELSE 0.0 END) - (CASE WHEN method_hits >= 8 AND covered <= 1 THEN 0.30::DOUBLE ELSE 0.0 END)
 - (CASE WHEN innovation_hits = 0 AND method_hits <= 1 THEN 0.30::DOUBLE ELSE 0.0 END) - (CASE WHEN covered <= 1 AND {'TRUE' if subject != 'general' else 'FALSE'} THEN 0.15::DOUBLE ELSE 0.0 END))), 9), 2) AS conf_score FROM {name}_c),
 {name} AS (SELECT *, CASE WHEN conf_score >= 0.75 THEN '高' WHEN conf_score >= 0.45 THEN '中' ELSE '低' END AS conf_level, '{mode}' AS mode, '{subject}' AS subject FROM {name}_d)"""


TOKENS = lambda text: rf"regexp_extract_all(lower({text}), '[\x{{4e00}}-\x{{9fff}}]{{1,2}}|(?:[^\P{{L}}\x{{4e00}}-\x{{9fff}}]|\p{{N}})+')"
CONTENT = lambda t: f"list_filter({t}, lambda t: length(t) > 1 AND NOT list_contains({words(fixed.STOPWORDS)}, t))"


def tfidf(source: str = "papers", top: int = fixed.TOP_TERMS) -> str:
    """CTEs that end in ``weights`` (doc_id, term, w, rank)."""
    return f"""terms AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({CONTENT(TOKENS("text"))}) AS term FROM {source}) GROUP BY ALL),
 dfs AS (SELECT term, ln(((SELECT count(*) FROM {source}) + 1) / (count(*) + 1)) + 1 AS idf FROM terms GROUP BY term),
 weighed AS (SELECT doc_id, term, round(tf / sum(tf) OVER (PARTITION BY doc_id) * idf, 9) AS w FROM terms JOIN dfs USING (term)),
 weights AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term)::INT AS rank FROM weighed) WHERE rank <= {top})"""


SALIENCE = f"""rel AS (SELECT doc_id, term, w / max(w) OVER (PARTITION BY doc_id) AS share FROM weights),
 toks AS (SELECT *, {TOKENS("hit")} AS t FROM each_hit), cont AS (SELECT *, {CONTENT("t")} AS c FROM toks),
 means AS (SELECT doc_id, ord, n, avg(coalesce(share, 0.15::DOUBLE)) AS mean FROM (SELECT doc_id, ord, n, unnest(c) AS term FROM cont) LEFT JOIN rel USING (doc_id, term) GROUP BY ALL),
 feats AS (SELECT cont.*, prior AS f_rule, round(least(1.0::DOUBLE, coalesce(mean, 0.0)), 6) AS f_tfidf, round(len(c) / greatest(1, len(t)), 6) AS f_density,
 round(least(1.0::DOUBLE, length(hit) / 20.0::DOUBLE), 6) AS f_length FROM cont LEFT JOIN means USING (doc_id, ord, n)),
 sal AS (SELECT doc_id, ord, rule, action, n, hit, f_rule, f_tfidf, f_density, f_length,
 round_even(greatest(0.05::DOUBLE, least(0.95::DOUBLE, round(0.6::DOUBLE * f_rule + 0.22::DOUBLE * f_tfidf + 0.1::DOUBLE * f_density + 0.08::DOUBLE * f_length, 6))), 2) AS salience FROM feats)"""


# Hits with their places: what lies between hits and the hits themselves add up to a hit's start.
PLACES = "cut AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {i} AS ord, {q(r.name)} AS rule, {q(r.action)} AS action, text, string_split_regex(text, {q(r.pattern)}, 'i') AS gaps, regexp_extract_all(text, {q(r.pattern)}, 0, 'i') AS found FROM papers"
    for i, r in enumerate(RULES)
) + """), placed AS (SELECT doc_id, ord, rule, action, text, found[k + 1] AS hit, (list_sum(list_transform(gaps[:k + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(found[:k], lambda x: length(x))), 0))::INT AS "start"
 FROM cut, LATERAL (SELECT unnest(range(len(found))) AS k) WHERE len(found) > 0), spans AS (SELECT *, ("start" + length(hit))::INT AS "end" FROM placed)"""

#: Windows of hits: the last sentence end in reach before them, and the first after them.
WINDOWS = r"""ends AS (SELECT doc_id, k AS stop FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS k FROM papers)
 WHERE substring(text, k, 1) IN ('。', '！', '？') OR substring(text, k, 1) IN ('.', '!', '?') AND (k = length(text) OR regexp_matches(substring(text, k + 1, 1), '^\s')) OR k > 1 AND substring(text, k - 1, 2) = chr(10) || chr(10)),
 reach AS (SELECT *, row_number() OVER () AS hit_no, greatest(0, "start" - 320) AS lo, least(length(text), "end" + 320) AS hi FROM spans),
 near AS (SELECT hit_no, max(stop) FILTER (stop <= "start" AND stop > lo) AS l, min(stop) FILTER (stop >= "end" AND stop <= hi) AS r FROM reach JOIN ends USING (doc_id) GROUP BY hit_no),
 sided AS (SELECT reach.*, coalesce(l, lo)::INT AS snip_start, r, substring(text, "end" + 2, hi - "end" - 1) AS tail FROM reach LEFT JOIN near USING (hit_no)),
 windows AS (SELECT *, coalesce(r, CASE WHEN hi < length(text) AND contains(tail, ' ') THEN "end" + 1 + length(tail) - instr(reverse(tail), ' ') ELSE hi END)::INT AS snip_end FROM sided)"""


def marked(action: str, before: str, after: str) -> str:
    """CTEs that end in ``marked`` (doc_id, marked): hits of an action between two marks, those that overlap as one."""
    return f"""mine AS (SELECT DISTINCT doc_id, "start" AS s, "end" AS e FROM spans WHERE action = {q(action)}),
 isles AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM mine),
 numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isle FROM isles),
 merged AS (SELECT doc_id, isle, min(s) AS s, max(e) AS e FROM numbered GROUP BY ALL), led AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS last FROM merged),
 parts AS (SELECT doc_id, max(e) AS tail, string_agg(substring(text, last + 1, s - last) || {before} || substring(text, s + 1, e - s) || {after}, '' ORDER BY s) AS done FROM led JOIN papers USING (doc_id) GROUP BY doc_id),
 marked AS (SELECT doc_id, coalesce(done || substring(text, tail + 1), text) AS marked FROM papers LEFT JOIN parts USING (doc_id))"""


def reflowed() -> str:
    """CTEs that end in ``reflowed`` (doc_id, text): a line goes on where neither the one before ends nor it begins something."""
    han = "[\\x{4e00}-\\x{9fff}]"
    return f"""whole AS (SELECT doc_id, regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '([A-Za-z])-\\n[ \\t]*([a-z])', '\\1\\2', 'g') AS text FROM papers),
 lines AS (SELECT doc_id, pos, {strip('a[pos + 1]')} AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM whole), LATERAL (SELECT unnest(range(len(a))) AS pos)),
 pairs AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY pos), '') AS p FROM lines),
 joints AS (SELECT doc_id, pos, s, CASE WHEN p = '' OR contains({q(clean.LINE_ENDS)}, right(p, 1)) OR regexp_matches(s, {q(clean.NEW_BLOCK.pattern)}) THEN chr(10) WHEN regexp_matches(right(p, 1), '{han}') AND regexp_matches(s, '^{han}') THEN '' ELSE ' ' END AS joint FROM pairs WHERE s <> ''),
 reflowed AS (SELECT doc_id, coalesce(substring(string_agg(joint || s, '' ORDER BY pos), 2), '') AS text FROM whole LEFT JOIN joints USING (doc_id) GROUP BY doc_id)"""


def _han_word() -> str:
    number = "('0x' || substring(md5(w), 1, 8))::BIGINT"
    char = lambda k: f"substring({q(HAN)}, ({number} >> {2 + 10 * k}) % {len(HAN)} + 1, 1)"
    return f"CASE WHEN w IN ('.', '!', '?', ';') THEN '。' ELSE {char(0)} || CASE WHEN {number} % 4 > 0 THEN {char(1)} ELSE '' END || CASE WHEN {number} % 4 = 3 THEN {char(2)} ELSE '' END END"


def _han_levels() -> str:
    """Strings of each length that hold together, from those one character shorter."""
    out = "han_1 AS MATERIALIZED (SELECT g, n FROM han_n WHERE k = 1), han_s1 AS (SELECT * FROM han_1)"
    for k in range(2, segment.LONGEST + 1):
        inner = "TRUE" if k == 2 else f"substring(g, 1, {k - 1}) IN (SELECT g FROM han_{k - 1}) AND substring(g, 2) IN (SELECT g FROM han_{k - 1})"
        out += f""", han_{k} AS MATERIALIZED (SELECT * FROM (SELECT h.g, h.n, min(ln(h.n) + ln((SELECT sum(n) FROM han_1)) - ln(x.n) - ln(y.n)) AS cohesion
 FROM (SELECT * FROM han_n WHERE k = {k} AND {inner}) h, LATERAL (SELECT unnest(range(1, {k})) AS c) JOIN han_s{k - 1} x ON x.g = substring(h.g, 1, c) JOIN han_s{k - 1} y ON y.g = substring(h.g, c + 1) GROUP BY ALL) WHERE cohesion >= {segment.COHESION!r}::DOUBLE),
 han_s{k} AS (SELECT g, n FROM han_s{k - 1} UNION ALL SELECT g, n FROM han_{k})"""
    return out


HAN_DOCUMENTS = f"han_documents AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(lower(coalesce(text, '')), {q(HAN_TOKENS)}), lambda w: {_han_word()}), '') AS text FROM documents)"

#: Strings of Han runs with what stands beside them; cohesion over cuts, entropy of either side.
HAN_WORDS = f"""han_runs AS (SELECT unnest(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]+')) AS r FROM han_documents),
 han_at AS (SELECT r, unnest(range(1, length(r) + 1)) AS i FROM han_runs),
 han_grams AS (SELECT substring(r, i, k) AS g, k, CASE WHEN i > 1 THEN substring(r, i - 1, 1) ELSE '' END AS a, substring(r, i + k, 1) AS b FROM han_at, (SELECT unnest(range(1, {segment.LONGEST + 1})) AS k) WHERE i + k <= length(r) + 1),
 han_n AS MATERIALIZED (SELECT g, k, count(*) AS n FROM han_grams GROUP BY ALL HAVING k = 1 OR count(*) >= {segment.LEAST}),
 {_han_levels()},
 han_firm AS MATERIALIZED (SELECT * FROM ({" UNION ALL ".join(f"SELECT g, n, cohesion FROM han_{k}" for k in range(2, segment.LONGEST + 1))}) ORDER BY n DESC LIMIT {segment.WORDS}),
 han_side AS (SELECT g, side, ln(sum(m)) - sum(m * ln(m)) / sum(m) AS h FROM (SELECT g, side, c, count(*) AS m FROM (SELECT g, 0 AS side, a AS c FROM han_grams SEMI JOIN han_firm USING (g) UNION ALL SELECT g, 1, b FROM han_grams SEMI JOIN han_firm USING (g)) GROUP BY ALL) GROUP BY ALL),
 han_words AS (SELECT f.g AS word, f.n, f.cohesion, l.h AS left_entropy, r.h AS right_entropy FROM han_firm f JOIN han_side l ON l.g = f.g AND l.side = 0 JOIN han_side r ON r.g = f.g AND r.side = 1 WHERE l.h >= {segment.FREEDOM!r}::DOUBLE AND r.h >= {segment.FREEDOM!r}::DOUBLE)"""
