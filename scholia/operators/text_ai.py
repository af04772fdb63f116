"""Text functions without a model: polish, weak words, summary, keywords, answers of models."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed import ANSWER_KEYS, POLISH, SUMMARY_STOPWORDS
from ..functions.rowwise import STEP
from .clean import strip
from .salience import tfidf, tokens


def polish(text: Column) -> Column:
    """Each colloquial word replaced by its first alternative, in the table's order."""
    return reduce(lambda out, item: F.replace(out, F.lit(item[0]), F.lit(item[1][0])), POLISH.items(), text)


def weak_words(text: Column) -> Column:
    """Colloquial words that a text contains, in the table's order."""
    return F.filter(F.array(*[F.lit(w) for w in POLISH]), lambda w: F.contains(text, w))


def summarize(docs: DataFrame, most: int = 3, id_col: str = "doc_id", pattern: str = r"(?U)(?<=[。！？])\s*") -> DataFrame:
    """(id, summary): the ``most`` sentences whose words are commonest, in order; a shorter text unchanged.

    Ties go to the earlier sentence.  The score of a sentence is the sum of its words' counts in the text.  No shuffle:
    sentences and words are expressions, a batch of texts is counted at once.
    """
    keep = lambda s: F.filter(tokens(s), lambda t: (F.length(t) > 1) & ~t.isin(*SUMMARY_STOPWORDS))
    rows = docs.where("text is not null").select(id_col, "text", F.split("text", pattern).alias("parts"))
    words = F.when(F.size("parts") > most, F.transform("parts", keep))  # not needed for a text that stays as it is
    schema = T.StructType([*docs.select(id_col).schema.fields, T.StructField("summary", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                best = _commonest(batch.column(3), most)
                made = [text if i not in best else "".join(parts[k] for k in best[i]) for i, (text, parts) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=schema.names)

    return rows.select(id_col, "text", "parts", words.alias("words")).mapInArrow(run, schema)


def _commonest(words: pa.ListArray, most: int) -> dict[int, list[int]]:
    """For each row that isn't null (words by sentence): its ``most`` best sentences, in order."""
    sizes = words.value_lengths().fill_null(0).to_numpy()
    sentences = words.flatten()
    inside = sentences.value_lengths().to_numpy()
    codes = sentences.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(words)), sizes)
    sentence = np.repeat(np.arange(len(inside)), inside)
    _, place, count = np.unique(row[sentence] * max(1, len(codes.dictionary)) + codes.indices.to_numpy().astype(np.int64), return_inverse=True, return_counts=True)
    score = np.bincount(sentence, count[place], len(inside))
    order = np.lexsort((-score, row))  # a stable sort: of equal scores the earlier sentence
    first = np.r_[0, np.cumsum(sizes)]
    return {i: sorted((order[first[i] : first[i] + most] - first[i]).tolist()) for i in np.flatnonzero(sizes).tolist()}


def keywords_topk(docs: DataFrame, most: int = 5, id_col: str = "doc_id") -> DataFrame:
    rows = tfidf(docs, most, id_col).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("k"))
    return rows.select(id_col, F.array_join(F.transform("k", lambda x: x["term"]), ", ").alias("keywords"))


def strip_think(text: Column) -> Column:
    """What a reasoning model answers after its thoughts."""
    out = F.when(F.contains(text, F.lit("</think>")), F.substring_index(text, "</think>", -1)).otherwise(text)
    return strip(F.regexp_replace(out, r"(?s)<think>.*?</think>", ""))


def normal_key(key: Column) -> Column:
    """The name that a key of an answer stands for: an exact alias, else the longest alias it contains, else itself."""
    exact = F.create_map(*[F.lit(x) for item in ANSWER_KEYS.items() for x in item])
    longest = sorted(ANSWER_KEYS, key=len, reverse=True)
    inside = F.coalesce(*[F.when(F.contains(key, F.lit(a)), F.lit(ANSWER_KEYS[a])) for a in longest], key)
    return F.coalesce(F.try_element_at(exact, key), inside)


def parse_answer(raw: Column) -> Column:
    """array<struct<key, value>> of an answer's JSON object: fences off, else the outermost braces, else those repaired, else {raw}.

    Values are strings (nested ones as JSON).  Of keys with one name the first stays.
    """
    bare = F.regexp_replace(F.regexp_replace(strip(raw), r"^```(?:json)?\s*", ""), r"\s*```\z", "")
    braces = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    as_map = lambda c: F.from_json(c, T.MapType(T.StringType(), T.StringType()))
    open_ = F.coalesce(F.nullif(braces, F.lit("")), F.regexp_extract(raw, r"(?s)(\{.*)", 1))  # the closing brace may be missing
    found = F.coalesce(as_map(bare), as_map(braces), as_map(repaired(open_)))
    pairs = F.transform(F.map_entries(found), lambda e: F.struct(normal_key(e["key"]).alias("key"), e["value"].alias("value")))
    seen = lambda acc, e: F.when(F.exists(acc, lambda x: x["key"] == e["key"]), acc).otherwise(F.concat(acc, F.array(e)))
    kept = F.aggregate(pairs, F.expr("cast(array() as array<struct<key:string,value:string>>)"), seen)
    return F.when(F.size(F.map_keys(found)) > 0, kept).otherwise(F.array(F.struct(F.lit("raw").alias("key"), raw.alias("value"))))


def academic_prompt(text: Column) -> Column:
    """A request to rewrite a text, with a hint for each colloquial word that it contains."""
    hints = F.array(*[F.struct(F.lit(w).alias("w"), F.lit("、".join(better)).alias("b")) for w, better in POLISH.items()])
    found = F.transform(F.filter(hints, lambda h: F.contains(text, h["w"])), lambda h: F.concat(F.lit("- "), h["w"], F.lit(" -> "), h["b"]))
    head = F.lit("Rewrite the text below in an academic style; keep its logic and avoid subjective wording.")
    return F.array_join(F.concat(F.array(head), found, F.array(F.lit(""), text)), "\n")


def assemble_messages(turns: DataFrame, by: str = "conv_id") -> DataFrame:
    """(by, turns, messages): the turns of a conversation in order, a line of role and text each."""
    rows = turns.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))  # one conversation's own turns
    line = F.transform("t", lambda x: F.concat(F.coalesce(x["role"], F.lit("")), F.lit(": "), F.coalesce(x["text"], F.lit(""))))
    return rows.select(by, F.size("t").cast("long").alias("turns"), F.array_join(line, "\n").alias("messages"))


def flat_value(value: Column) -> Column:
    """An answer's value as text: a JSON list by full-width semicolons, an object as key and value pairs, else as it is."""
    items = F.from_json(value, T.ArrayType(T.StringType()))
    pairs = F.map_entries(F.from_json(value, T.MapType(T.StringType(), T.StringType())))
    lines = F.transform(pairs, lambda e: F.concat(e["key"], F.lit("："), F.coalesce(e["value"], F.lit("None"))))
    listed = F.transform(items, lambda x: F.coalesce(x, F.lit("None")))
    return F.when(F.startswith(value, F.lit("[")) & items.isNotNull(), F.array_join(listed, "；")).when(F.startswith(value, F.lit("{")) & pairs.isNotNull(), F.array_join(lines, "；")).otherwise(value)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: A string of JSON, to its end or the text's, or what lies between strings.  Possessive: each character is read once.
_JSON_PART = r'(?s)"[^"\\]*+(?:\\(?:.)?[^"\\]*+)*+"?|[^"]++'
#: The longest start of a string that holds no half of an escape.
_WHOLE_ESCAPES = r'(?s)^("[^"\\]*+(?:(?:\\[^u]|\\u[0-9a-fA-F]{4})[^"\\]*+)*+).*$'


def repaired(json: Column) -> Column:
    """A JSON object with what models often get wrong put right: bare percentages, commas before a closing bracket, unknown
    escapes, and an end anywhere: strings, literals, numbers, pairs, lists and objects are completed.

    Brackets close in the order of their nesting, of which a stack over the brackets outside strings keeps
    track; what stands in strings stays, but for unknown escapes.
    """
    without_blank = lambda parts: F.when(F.rlike(F.try_element_at(parts, F.lit(-1)), F.lit(r"^\s+\z")), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    is_string = lambda p: F.startswith(p, F.lit('"'))
    closed = lambda p: F.rlike(p, F.lit(r'(?s)^"[^"\\]*+(?:\\.[^"\\]*+)*+"$'))
    escapes = lambda p: F.regexp_replace(p, r'(?<!\\)((?:\\\\)*+)\\(?!["\\/bfnrtu])', r"$1\\\\")
    whole = lambda p: F.when(closed(p), p).otherwise(F.concat(F.regexp_replace(p, _WHOLE_ESCAPES, "$1"), F.lit('"')))
    percent = lambda p: F.regexp_replace(p, r"(:\s*)(-?\d+(?:\.\d+)?%)", '$1"$2"')
    fixed_parts = lambda parts: F.transform(parts, lambda p: F.when(is_string(p), whole(escapes(p))).otherwise(F.regexp_replace(percent(p), r",(\s*[}\]])", "$1")))
    outside = lambda parts: F.array_join(F.filter(parts, lambda p: ~is_string(p)), "")
    opens = lambda b: b.isin("[", "{")
    top = lambda stack: F.substring(stack, 1, 1)
    pairs = lambda stack, b: ((b == "]") & (top(stack) == "[")) | ((b == "}") & (top(stack) == "{"))
    push = lambda stack, b: F.when(opens(b), F.concat(b, stack)).when(pairs(stack, b), F.substring(stack, 2, 1 << 30)).otherwise(stack)
    stack_of = lambda parts: F.aggregate(F.regexp_extract_all(outside(parts), F.lit(r"[\[\]{}]"), F.lit(0)), F.lit(""), push)
    found = bound(F.regexp_extract_all(json, F.lit(_JSON_PART), F.lit(0)), without_blank)
    made = bound(found, lambda parts: bound(fixed_parts(parts), lambda fixed: bound(stack_of(parts), lambda stack: _completed(fixed, stack))))
    return F.coalesce(made, json)


def _completed(fixed: Column, stack: Column) -> Column:
    """The parts of an object as text, with what its end and its open brackets ask for; null without parts."""
    is_string = lambda p: F.startswith(p, F.lit('"'))
    last, before = F.try_element_at(fixed, F.lit(-1)), F.regexp_replace(F.coalesce(F.try_element_at(fixed, F.lit(-2)), F.lit("")), r"\s+\z", "")
    bare = F.regexp_replace(last, r"[\s,]+\z", "")
    literal = bare
    for word in ("true", "false", "null"):
        literal = F.regexp_replace(literal, rf"(?<![A-Za-z])(?:{'|'.join(word[:k] for k in range(len(word) - 1, 0, -1))})\z", word)
    number = F.regexp_replace(literal, r"(?<=\d)(?:\.|\.?[eE][-+]?)\z", "")
    number = F.regexp_replace(number, r"(?<![\w.])-\z", "")
    tail = F.regexp_replace(number, r"[\s,]+\z", "")
    valued = F.when(F.rlike(tail, F.lit(r":\s*\z")), F.concat(tail, F.lit("null"))).otherwise(tail)
    is_key = F.endswith(before, F.lit("{")) | (F.endswith(before, F.lit(",")) & F.startswith(stack, F.lit("{")))
    end = F.when(is_string(last) & is_key, F.concat(last, F.lit(":null"))).when(is_string(last), last).otherwise(valued)
    whole_text = F.concat(F.array_join(F.slice(fixed, 1, F.greatest(F.lit(0), F.size(fixed) - 1)), ""), end)
    closers = F.translate(stack, "[{", "]}")
    return F.when(F.size(fixed) > 0, F.concat(whole_text, closers))


def chat_messages(instruction: Column, text: Column, system: str) -> Column:
    """array<struct<role, content>> of a training row: the system's line, then the task with its text below, if there is one."""
    given, task = F.trim(F.coalesce(text, F.lit(""))), F.trim(instruction)
    said = F.when(given != "", F.concat_ws("\n\n", task, given)).otherwise(task)
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", said))


def masked_labels(prompt_ids: Column, answer_ids: Column, end_id: int | None = None, most: int = 1024) -> Column:
    """struct<input_ids, labels> from token ids: the prompt's labels are -100, both are cut at ``most`` (a limit of the feature)."""
    answer = F.concat(answer_ids, F.array(F.lit(end_id))) if end_id is not None else answer_ids
    ids, labels = F.concat(prompt_ids, answer), F.concat(F.transform(prompt_ids, lambda _: F.lit(-100)), answer)
    return F.struct(F.slice(ids, 1, most).alias("input_ids"), F.slice(labels, 1, most).alias("labels"))


def first_engine(available: dict[str, Column], order: list[str], fallback: str = "simple") -> Column:
    """The first engine in order whose flag is true, else the fallback."""
    return F.coalesce(*[F.when(available[e], F.lit(e)) for e in order if e in available], F.lit(fallback))
