"""Term weights in the row: the same with few known terms, which shuffles the others, and with all."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scholia.functions.terms import OTHERS, Tokens
from scholia.operators import rollup, salience, text_ai

TEXTS = ["alpha beta beta gamma", "beta delta. Delta 方法方法在", "", None, "alpha ALPHA beta epsilon zeta eta theta", "beta", "x 的 y"]


def want(top):
    words = [salience._words((x or "").lower()) for x in TEXTS]
    df = Counter(t for w in words for t in set(w))
    out = {}
    for i, own in enumerate(words):
        weights = sorted((-round(k / len(own) * (math.log((len(TEXTS) + 1) / (df[t] + 1)) + 1), 9), t) for t, k in Counter(own).items())
        out |= {(i, r + 1): (t, -w) for r, (w, t) in enumerate(weights[:top])}
    return out


@pytest.mark.parametrize("known", [0, 2, 1 << 17])
def test_weights_with_few_known_terms(spark, monkeypatch, known):
    """F19."""
    monkeypatch.setattr(salience, "KNOWN", known)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for top in (2, 100):
        got = {(r.doc_id, r["rank"]): (r.term, r.w) for r in salience.tfidf(docs, top).collect()}
        assert {k: (t, round(w, 8)) for k, (t, w) in got.items()} == {k: (t, round(w, 8)) for k, (t, w) in want(top).items()}


def test_words_are_the_tokens_of_the_columns(spark):
    text = "The 方法方 x_y a1b2 Ünï 的在 ٣٤ \U0001f600 ab"
    row = spark.range(1).select(salience.content(salience.tokens(F.lit(text))).alias("t")).first()
    assert salience._words(text.lower()) == row.t


def test_known_terms_are_not_shuffled(spark):
    """where all terms are known a document's weights and hits meet in its row."""
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert "Exchange" not in salience.salience(docs)._jdf.queryExecution().executedPlan().toString()


def test_keywords_with_few_known_terms(spark, monkeypatch):
    """F26."""
    monkeypatch.setattr(salience, "KNOWN", 2)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    best = want(3)
    own = {i: ", ".join(best[i, r][0] for r in (1, 2, 3) if (i, r) in best) for i in range(len(TEXTS)) if (i, 1) in best}
    assert {r.doc_id: r.keywords for r in text_ai.keywords_topk(docs, 3).collect()} == own


def test_records_shuffle_only_hits(spark):
    """one exchange, that of the groups."""
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = rollup.record_stats(salience.salience(docs))
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


SAID = ["In conclusion, alpha beta beta performs well。本文提出了一种新方法，准确率提高了 3.5%。The ΟΔΟΣ model", "We propose İalpha beta to address ΟΔΟΣ. In recent years, alpha ALPHA grew.\n", None, "", "nothing here", "In summary, ΟΔΟΣ ends", "我们提出方法方法在 x. In other words, theta eta.\n"]


def test_hits_are_measured_in_one_pass(spark):
    """rules, weights and hits of a text in one pass of Python."""
    docs = spark.createDataFrame(list(enumerate(SAID)), "doc_id long, text string")
    assert salience.salience(docs)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_salience_is_the_same_with_few_known_terms(spark, monkeypatch):
    """F18."""
    docs = spark.createDataFrame(list(enumerate(SAID)), "doc_id long, text string")
    whole = sorted(salience.salience(docs).collect())
    monkeypatch.setattr(salience, "KNOWN", 2)
    assert len(whole) > 8 and sorted(salience.salience(docs).collect()) == whole


def test_only_terms_that_may_be_heavy_are_shuffled(spark, monkeypatch):
    """a term that isn't known has bounds."""
    monkeypatch.setattr(salience, "KNOWN", 1)
    known = salience.Known(salience.term_statistics(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")))
    counts = salience._counts(pa.array(["beta " * 50 + "zeta", "", "zeta eta"]), True)
    assert [known.weighed(counts, top)[0].row.tolist() for top in (1, 2)] == [[0, 2, 2], [0, 0, 2, 2]]
    assert np.isnan(known.weighed(counts, 2)[1]).tolist() == [False, True, True, True]


def test_tokens_of_many_texts():
    """as the patterns find them, text by text."""
    rng = random.Random(1)
    pattern = re.compile("[一-鿿]{1,2}|" + OTHERS)
    for letters in ("ab1_ .", "ab1_ .方法的在ü\U0001f600٣\U0002ebf0é\n"):
        for _ in range(300):
            texts = ["".join(rng.choices(letters, k=rng.randrange(15))) for _ in range(rng.randrange(6))]
            found = Tokens(texts)
            assert list(zip(found.row.tolist(), found.strings().to_pylist(), strict=True)) == [(i, w) for i, t in enumerate(texts) for w in pattern.findall(t)]


def test_weights_are_rounded_as_the_engine_does(spark):
    x = [5e-10, 2.5e-9, 1.0000000005, 0.1234567885, 0.3, 12.0000000015, 1e-12, 7.9999999995]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 9).alias("r")).collect()
    assert salience.half_up(np.array(x)).tolist() == [r.r for r in rows]
